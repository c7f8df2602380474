"""Marginal, joint, contingency and conditional distributions as long tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Cells of a dense domain at most; beyond, building it is an error rather than a stalled job.
MAX_CELLS = 10_000_000


class NotFittedError(ValueError):
    """The model has not been fitted."""


def ensure_list(x: str | list[str] | tuple[str, ...]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes NULL, as either is one missing category."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("float", "double")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def same(left: list[Column], right: list[Column]) -> Column:
    """Null-safe equality of keys."""
    return reduce(lambda x, y: x & y, (a.eqNullSafe(b) for a, b in zip(left, right, strict=True)))


def contingency(df: DataFrame, cols: str | list[str]) -> DataFrame:
    """cols, count: the observed combinations, NULL a category."""
    return clean(df).groupBy(*ensure_list(cols)).agg(F.count("*").alias("count"))


def joint(df: DataFrame, cols: str | list[str]) -> DataFrame:
    """cols, count, p."""
    counts = contingency(df, cols)
    return shares(counts, "count")


def shares(df: DataFrame, value: str, by: list[str] | None = None, out: str = "p") -> DataFrame:
    """df with out = value over its total (of each group of by); all-zero groups become uniform.

    Without by, the total is a table of one row that is joined back, so the cells stay where they are.
    """
    if not by:
        totals = df.agg(F.sum(value).alias("__total"), F.count("*").alias("__cells"))
        share = F.when(F.col("__total") == 0, 1 / F.col("__cells")).otherwise(F.col(value) / F.col("__total"))
        return df.crossJoin(F.broadcast(totals)).withColumn(out, share).drop("__total", "__cells")
    w = Window.partitionBy(*by)
    total, cells = F.sum(value).over(w), F.count("*").over(w)
    return df.withColumn(out, F.when(total == 0, 1 / cells).otherwise(F.col(value) / total))


def marginals(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, value (as text), count, p of all cols in one shuffle."""
    texts = clean(df.select(*cols)).select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = texts.unpivot([], cols, "column", "value")
    return shares(long.groupBy("column", "value").agg(F.count("*").alias("count")), "count", ["column"])


def uniform_distribution(df: DataFrame, col: str) -> DataFrame:
    """col, p: the same share for each observed value."""
    return shares(clean(df.select(col)).distinct().withColumn("__zero", F.lit(0)), "__zero").drop("__zero")


def domain(df: DataFrame, cols: list[str], max_cells: int = MAX_CELLS) -> DataFrame:
    """Every combination of the observed values of cols; ValueError beyond max_cells."""
    sizes = cardinalities(df, cols)
    if (cells := math.prod(sizes.values())) > max_cells:
        raise ValueError(f"the domain of {cols} has {cells} cells; at most {max_cells} are allowed")
    parts = [clean(df.select(c)).distinct() for c in cols]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # domains of checked size, not rows


def dense(df: DataFrame, cols: list[str], max_cells: int = MAX_CELLS) -> DataFrame:
    """cols, count over the whole domain, 0 where nothing was observed; the domain of one column is what it holds."""
    if len(cols) == 1:
        return contingency(df, cols)
    return filled(contingency(df, cols), domain(df, cols, max_cells), cols)


def filled(seen: DataFrame, cells: DataFrame, cols: list[str]) -> DataFrame:
    """cols, count of all cells, by the counts of those seen."""
    on = same([F.col(f"d.`{c}`") for c in cols], [F.col(f"s.`{c}`") for c in cols])
    return cells.alias("d").join(seen.alias("s"), on, "left").select(*[F.col(f"d.`{c}`").alias(c) for c in cols], F.coalesce("s.count", F.lit(0)).alias("count"))


#: Columns that one grouping-sets aggregate names at most; its id has a bit for each.
ID_COLUMNS = 60


def grouped_counts(df: DataFrame, sets: list[tuple[str, ...]], weight: str | None = None, counts: dict[str, Column] | None = None) -> DataFrame:
    """__set (the index of a set), all columns of the sets, count: the observed cells of each set of columns.

    One scan and one shuffle for all sets, and partial counts before it; columns outside a row's set are NULL. weight
    is a column of counts, if a row stands for several; counts names other aggregates in place of count. Sets of more than
    ID_COLUMNS columns in all are counted in parts.
    """
    counts = counts or {"count": F.count("*") if weight is None else F.sum(weight)}
    parts, names = [[]], set()
    for k, s in enumerate(sets):
        if len(names | set(s)) > ID_COLUMNS:
            parts.append([])
            names = set()
        names |= set(s)
        parts[-1].append(k)
    df = clean(df)
    out = [_grouped(df, sets, part, counts) for part in parts if part]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def _grouped(df: DataFrame, sets: list[tuple[str, ...]], part: list[int], counts: dict[str, Column]) -> DataFrame:
    cols = sorted({c for k in part for c in sets[k]})
    ids = {k: sum(1 << len(cols) - 1 - i for i, c in enumerate(cols) if c not in sets[k]) for k in part}
    of = {g: [k for k in part if ids[k] == g] for g in ids.values()}  # the same columns in another order are one group
    names = {c: F.col(f"`{c}`") for c in cols}
    found = df.groupingSets([[names[c] for c in cols if c in sets[ks[0]]] for ks in of.values()], *names.values()).agg(*[x.alias(n) for n, x in counts.items()], F.grouping_id().alias("__id"))
    which = F.create_map(*[x for g, ks in of.items() for x in (F.lit(g).cast("long"), F.array(*map(F.lit, ks)))])[F.col("__id").cast("long")]
    return found.withColumn("__set", F.explode(which)).select("__set", *names.values(), *counts)


def conditional(counts: DataFrame, parents: list[str], value: str = "count") -> DataFrame:
    """counts with p given the parents; a parent combination without any count is uniform over the child."""
    return shares(counts, value, parents)


def cardinalities(df: DataFrame, cols: list[str] | None = None, with_null: bool = True) -> dict[str, int]:
    """Distinct values of each column, NULL one of them if with_null, in one pass."""
    cols = cols or df.columns
    row = clean(df.select(*cols)).agg(*[F.count_distinct(c).alias(f"n{i}") for i, c in enumerate(cols)], *[F.max(F.col(c).isNull()).cast("int").alias(f"z{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"n{i}"] + (row[f"z{i}"] or 0 if with_null else 0) for i, c in enumerate(cols)}


def cardinality_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """column, n_distinct (NULL left out), rank from the largest on, ties by name."""
    cols = cols or df.columns
    one = clean(df.select(*cols)).agg(*[F.count_distinct(c).alias(c) for c in cols])
    long = one.unpivot([], cols, "column", "n_distinct")
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_distinct"), "column")))  # one row a column


def high_cardinality(df: DataFrame, threshold: int = 50) -> DataFrame:
    return cardinality_table(df).where(F.col("n_distinct") > threshold).select("column", "n_distinct")


def rare_categories(df: DataFrame, cols: list[str], threshold: float = 0.05) -> DataFrame:
    """column, value, p of the values whose share of the non-null rows is below threshold."""
    texts = clean(df.select(*cols)).select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = texts.unpivot([], cols, "column", "value").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))
    return shares(long, "count", ["column"]).where(F.col("p") < threshold).select("column", "value", "p")
