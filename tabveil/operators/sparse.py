"""Noisy tables over domains that are too large to build: cells that nobody observed are drawn, not listed."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import laplace, uniform
from .distributions import same

#: Drawn cells of a block, about, and values of a column that are numbered together.
BLOCK, BUCKET = 20_000, 10_000
#: Whole numbers that numpy draws from; beyond, Python's own are used and the binomial law is told from Poisson's by
#: less than the chance of a single cell.
_WIDE = 1 << 62


def threshold(cells: int, scale: float, most: int) -> tuple[float, float]:
    """The least noise that lets a cell of count 0 pass, and its chance, so that most of cells pass on average at most.

    A clamp at 0 alone lets one cell in two pass; its threshold is 0.
    """
    chance = min(0.5, most / cells)
    return max(0.0, -scale * math.log(2 * chance)), chance


def _drawn(seed: str, cells: int, blocks: int, chance: float, sizes: list[int]):
    """Of each block of the domain, the codes of the cells that pass: a binomial number of distinct ones."""

    def run(rows):
        for batch in rows:
            for b in batch.column(0).to_pylist():
                first, size = cells * b // blocks, cells * (b + 1) // blocks - cells * b // blocks
                key = hashlib.sha256(f"{seed}|{b}".encode()).digest()
                rng, own = np.random.default_rng(np.frombuffer(key, np.uint32)), random.Random(key)
                n = int(rng.binomial(size, chance)) if size < _WIDE else int(rng.poisson(size * chance))
                if size <= 1 << 20:
                    taken = rng.choice(size, n, replace=False).tolist()
                else:
                    taken = set()
                    while len(taken) < n:
                        taken.add(own.randrange(size))
                at = np.array([first + t for t in taken], dtype=np.int64 if cells < _WIDE else object)
                codes = []
                for size_of in reversed(sizes):
                    codes.append(pa.array((at % size_of).astype(np.int64)))
                    at = at // size_of
                yield pa.RecordBatch.from_arrays(codes[::-1], [f"code{i}" for i in range(len(sizes))])

    return run


def _numbered(values: DataFrame, column: str, size: int) -> DataFrame:
    """value and code, from 0 on, of the distinct values of a column, by a hash and then in order."""
    buckets = max(1, -(-size // BUCKET))
    dealt = values.withColumn("__bucket", F.pmod(F.xxhash64(column), F.lit(buckets)))
    sizes = dealt.groupBy("__bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for BUCKET values
    dealt = dealt.withColumn("__in", F.row_number().over(Window.partitionBy("__bucket").orderBy(column)) - 1)
    return dealt.join(F.broadcast(sizes.select("__bucket", before.alias("before"))), "__bucket").select(column, (F.col("__in") + F.col("before")).alias("code"))


def unseen_cells(values: dict[str, DataFrame], sizes: dict[str, int], chance: float, seed: str) -> DataFrame:
    """The columns of values: cells of their domain, each there with the chance, whether observed or not. values has the
    distinct values of each column, a table each, and sizes their numbers.

    The domain is cut into blocks of consecutive cells; how many of a block's cells are there is drawn from the binomial law,
    and as many distinct ones by index. An index stands for one value of each column. So the work grows with the
    cells that are there, not with the domain.
    """
    cells = math.prod(sizes.values())
    blocks = max(1, math.ceil(cells * chance / BLOCK))
    spark, names = next(iter(values.values())).sparkSession, [*sizes]
    schema = ", ".join(f"code{i} long" for i in range(len(names)))
    out = spark.range(blocks, numPartitions=min(blocks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(_drawn(seed, cells, blocks, chance, [*sizes.values()]), schema)
    for i, c in enumerate(names):
        coded = _numbered(values[c].select(F.col(f"`{c}`").alias("value")), "value", sizes[c])
        out = out.join(coded.select(F.col("value").alias(f"value{i}"), F.col("code").alias(f"code{i}")), f"code{i}")
    return out.select(*[F.col(f"value{i}").alias(c) for i, c in enumerate(names)])


def noisy_cells(seen: DataFrame, values: dict[str, DataFrame], sizes: dict[str, int], value: str, scale: float, most: int, seed: str) -> DataFrame:
    """The columns of sizes, value: seen(columns, value) with Laplace noise, and unobserved cells whose noise passes.

    Every cell of the domain is treated alike: it gets noise of the scale and is kept if it exceeds the threshold that lets
    about most cells of count 0 pass. Observed cells get noise keyed by the cell. An unobserved one is there with the chance that
    noise passes, and as Laplace noise has no memory, it then exceeds the threshold by an exponential amount. At
    a domain of 2 * most cells and fewer the threshold is 0, and the law that of a dense table clamped at 0. Without
    noise only observed cells are there. Keep the seed secret: numpy's generator, which draws the cells, can be traced by who knows it.
    """
    cols = [F.col(f"`{c}`") for c in sizes]
    if scale == 0:
        return seen.select(*cols, F.col(value).cast("double").alias(value))
    least, chance = threshold(math.prod(sizes.values()), scale, most)
    noise = laplace(uniform(seed, *[F.col(f"`{c}`") for c in sizes]), scale)
    kept = seen.select(*cols, (F.col(value) + noise).alias(value)).where(F.col(value) > least)
    more = unseen_cells(values, sizes, chance, seed).alias("d")
    more = more.join(seen.alias("s"), same([F.col(f"d.`{c}`") for c in sizes], [F.col(f"s.`{c}`") for c in sizes]), "left_anti")
    beyond = least - F.lit(float(scale)) * F.ln(uniform(f"{seed}|unseen", *[F.col(f"`{c}`") for c in sizes]))
    return kept.unionByName(more.select(*[F.col(f"d.`{c}`").alias(c) for c in sizes]).withColumn(value, beyond))
