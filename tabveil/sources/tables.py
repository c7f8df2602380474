"""Reading and writing tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, **options) -> DataFrame:
    """A CSV file with a header and a given schema; only the named columns are parsed."""
    df = spark.read.csv(path, header=True, schema=schema, **options)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, **options) -> None:
    df.write.mode("overwrite").csv(path, header=True, **options)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def literal(spark: SparkSession, rows: list[tuple], schema: str, copies: int = 1) -> DataFrame:
    """A table of given rows, each a number of times."""
    df = spark.createDataFrame(rows, schema)
    return df.crossJoin(spark.range(copies).select()) if copies != 1 else df


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """df written to a new shared folder and read back: what was learnt no longer depends on its source. With by, in a folder
    for each value of that column, so that a reader of one value reads nothing else."""
    path = shared_folder(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new name under spark.checkpoint.dir, which driver and executors share, or else under the warehouse.

    A temporary folder of this machine is taken only where everything runs in the driver's process.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and re.match(r"local(\[|$)", spark.sparkContext.master):
        root = tempfile.mkdtemp(prefix="spark-shared-")
    root = root or f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
