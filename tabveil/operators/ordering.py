"""Exact order statistics, without a task that holds all values."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from .distributions import clean

#: Values around a rank that are looked at one by one, and the accuracy of the percentiles that narrow a bracket.
FIT, ACCURACY = 4096, 10_000


@dataclass
class _Bracket:
    """An open interval that holds the value of a rank; before values lie at or below low, inside ones between."""

    rank: int
    before: int
    inside: int
    low: float | None = None
    high: float | None = None

    def holds(self):
        kept = F.lit(True) if self.low is None else F.col("x") > F.lit(self.low)
        return kept if self.high is None else kept & (F.col("x") < F.lit(self.high))

    def narrow(self, a: float, b: float, below_a: int, to_a: int, below_b: int, to_b: int) -> float | None:
        """Uses exact counts below and up to a <= b: the value if it is one of them, or else a smaller bracket."""
        if below_a <= self.rank < to_a:
            return a
        if below_b <= self.rank < to_b:
            return b
        end = self.before + self.inside
        if self.rank < below_a:
            self.high, end = a, below_a
        elif self.rank >= to_b:
            self.low, self.before = b, to_b
        else:
            self.low, self.high, self.before, end = a, b, to_a, below_b
        self.inside = end - self.before
        return None


def order_statistics(df: DataFrame, column: str, ranks: list[int], n: int | None = None) -> list[float]:
    """The values at the ranks (0 is the least) among the numbers of column; NULL and NaN are left out.

    Each round takes two aggregates for all ranks together: approximate percentiles on both sides of each rank, and exact
    counts at these, which leave about 4 / ACCURACY of a bracket's values whatever their distribution. A value that many
    rows repeat ends the search when a bracket's end meets it. What is left of each bracket, FIT values at most, is
    looked at as it is. n is the number of values, counted unless given.
    """
    x = clean(df.select(F.col(column).cast("double").alias("x"))).where("x is not null")
    n = x.count() if n is None else n
    if bad := [r for r in ranks if not 0 <= r < n]:
        raise ValueError(f"there are {n} values, none of rank {bad}")
    found: dict[int, float] = {}
    brackets = [_Bracket(r, 0, n) for r in sorted(set(ranks))]
    while wide := [b for b in brackets if b.inside > FIT]:
        asked = []
        for b in wide:
            at = (b.rank - b.before + 0.5) / b.inside
            ends = [max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)]
            asked.append(F.percentile_approx(F.when(b.holds(), F.col("x")), F.array(*map(F.lit, ends)), ACCURACY))
        guesses = [sorted(g) for g in x.agg(*[q.alias(f"q{i}") for i, q in enumerate(asked)]).first()]
        points = sorted({v for g in guesses for v in g})
        counts = x.agg(*[F.count_if(test).alias(f"c{i}") for i, test in enumerate(t for v in points for t in (F.col("x") < F.lit(v), F.col("x") <= F.lit(v)))]).first()
        at = {v: (counts[2 * i], counts[2 * i + 1]) for i, v in enumerate(points)}
        for b, (low, high) in zip(wide, guesses, strict=True):
            if (value := b.narrow(low, high, *at[low], *at[high])) is not None:
                found[b.rank] = value
        brackets = [b for b in brackets if b.rank not in found]
    if brackets:
        near = x.where(reduce(or_, [b.holds() for b in brackets]))
        values = sorted((r.x, r.n) for r in near.groupBy("x").agg(F.count("*").alias("n")).collect())  # FIT values a rank
        for b in brackets:
            place = b.before
            for v, k in values:
                if (b.low is None or v > b.low) and (b.high is None or v < b.high):
                    place += k
                    if b.rank < place:
                        found[b.rank] = v
                        break
    return [found[r] for r in ranks]


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact quantiles, interpolated between the two values around each; empty without values."""
    x = clean(df.select(F.col(column).cast("double").alias("x"))).where("x is not null")
    if not (n := x.count()):
        return []
    places = [s * (n - 1) for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    value = dict(zip(ranks, order_statistics(x, "x", ranks, n), strict=True))
    out = []
    for p in places:
        low, high = math.floor(p), math.ceil(p)
        out.append(value[low] if low == high else (high - p) * value[low] + (p - low) * value[high])
    return out
