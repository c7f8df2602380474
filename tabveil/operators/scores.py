"""Dependence scores of a column and a parent set, many sets to a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import token
from .distributions import clean

#: Candidate sets whose counts one job takes.
CHUNK = 32


def _cells(base: DataFrame, sets: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """set, a (child), b (parents), c for the observed cells of each (child, parents), from one pass and one shuffle."""
    keys = [F.struct(F.lit(k).alias("set"), token(child).alias("a"), F.array(*[token(p) for p in parents]).cast("array<string>").alias("b")) for k, (child, parents) in enumerate(sets)]
    return base.select("count", F.explode(F.array(*keys)).alias("key")).groupBy("key.set", "key.a", "key.b").agg(F.sum("count").alias("c"))


def collapsed(df: DataFrame) -> DataFrame:
    """Distinct rows and their counts: all that the scores need of the table."""
    return clean(df).groupBy(*df.columns).agg(F.count("*").alias("count"))


def scores(base: DataFrame, sets: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """set, r, mi for each (child, parents) over base, a table from collapsed().

    r is half the distance between the joint and the independent distribution. Cells that weren't observed
    add their independent mass, so the product of the domains is never built: r = (sum over observed
    cells of |p_ab - p_a p_b| + 1 - sum over these of p_a p_b) / 2.
    """
    n = F.col("n")
    cells = _cells(base, sets).crossJoin(F.broadcast(base.agg(F.sum("count").alias("n"))))  # one row: all sets have the same rows
    pa, pb = F.sum("c").over(Window.partitionBy("set", "a")) / n, F.sum("c").over(Window.partitionBy("set", "b")) / n
    cells = cells.select("set", (F.col("c") / n).alias("p"), (pa * pb).alias("q"))
    r = (F.sum(F.abs(F.col("p") - F.col("q"))) + 1 - F.sum("q")) / 2
    return cells.groupBy("set").agg(r.alias("r"), F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))).alias("mi"))


def score_all(base: DataFrame, sets: list[tuple[str, tuple[str, ...]]], function: str = "R") -> list[float]:
    """The scores of all sets on the driver, one number a set; sets without parents score 0."""
    if function not in ("R", "MI"):
        raise ValueError("the score function is R or MI")
    out = [0.0] * len(sets)
    asked = [k for k, (_, parents) in enumerate(sets) if parents]
    for at in range(0, len(asked), CHUNK):
        part = asked[at : at + CHUNK]
        for row in scores(base, [sets[k] for k in part]).collect():
            out[part[row.set]] = row.r if function == "R" else row.mi
    return out


def max_domain_size(n: int, epsilon: float, split: float, d: int, theta: float, child: int) -> float:
    """Cells of a parent set at most, so that the noisy joint with child's values stays theta-useful."""
    return n * (1 - split) * epsilon / (2 * d * theta * child)


def maximal_parent_sets(nodes: dict[str, int], limit: float) -> set[frozenset[str]]:
    """The maximal subsets of nodes (name -> cardinality) whose product of cardinalities is limit at most."""
    if limit < 1:
        return set()
    names = sorted(nodes)

    def grow(k: int, room: float) -> set[frozenset[str]]:
        if k == len(names):
            return {frozenset()}
        without = grow(k + 1, room)
        if nodes[names[k]] > room:
            return without
        having = {s | {names[k]} for s in grow(k + 1, room / nodes[names[k]])}
        return having | {s for s in without if not any(s < t for t in having)}

    return grow(0, limit)
