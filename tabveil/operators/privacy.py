"""Differentially private mechanisms over distribution tables, and their budget."""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import gumbel, laplace, uniform
from ..sources import tables
from . import sparse
from .distributions import MAX_CELLS, ensure_list, filled, grouped_counts, shares


class Ledger:
    """Spends of a budget, composed sequentially; spending more than there is raises."""

    def __init__(self, epsilon: float) -> None:
        check_epsilon(epsilon)
        self.epsilon, self.spends = epsilon, []

    def spend(self, mechanism: str, epsilon: float) -> float:
        if not math.isinf(self.epsilon) and sum(e for _, e in self.spends) + epsilon > self.epsilon * (1 + 1e-9):
            raise ValueError(f"{mechanism} needs {epsilon}, beyond the budget of {self.epsilon}")
        self.spends.append((mechanism, epsilon))
        return epsilon


def check_epsilon(epsilon: float) -> None:
    if isinstance(epsilon, bool) or not isinstance(epsilon, (int, float)) or math.isnan(epsilon):
        raise TypeError("epsilon must be a number")
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")


def noise_seed(seed: str, mechanism: str, cols: list[str], epsilon: float) -> str:
    """A seed of its own for each release, so that no two tables share noise that a difference would cancel."""
    return "|".join([seed, mechanism, repr(float(epsilon)), *(f"{len(c)}:{c}" for c in cols)])


def _noisy(df: DataFrame, value: str, keys: list[str], scale: float, seed: str):
    """value plus Laplace noise keyed by the release's seed and the cell, at least 0; no noise for a scale of 0."""
    noise = F.lit(0.0) if scale == 0 else laplace(uniform(seed, *keys), scale)
    return F.greatest(F.lit(0.0), F.col(value) + noise)


def fresh(seed: str | None) -> str:
    """The given seed, or for None one that no other release has."""
    return secrets.token_hex(16) if seed is None else seed


@dataclass
class Observed:
    """What a noisy table over some columns needs: the cells seen, each column's values, their numbers, and the rows."""

    seen: DataFrame
    values: dict[str, DataFrame]
    sizes: dict[str, int]
    n: int

    @classmethod
    def of(cls, df: DataFrame, cols: list[str], weight: str | None = None) -> Observed:
        """One aggregate over df, written once. weight is a column of counts, if a row stands for several."""
        every = [(c,) for c in cols] + [tuple(cols)]
        counts = tables.keep(grouped_counts(df, every, weight), "__set")
        cut = [counts.where(F.col("__set") == k).select(*[F.col(f"`{c}`") for c in s], "count") for k, s in enumerate(every)]
        found = {r["__set"]: r for r in counts.groupBy("__set").agg(F.count("*").alias("k"), F.sum("count").alias("n")).collect()}  # a row a set
        sizes = {c: found[k].k if k in found else 0 for k, c in enumerate(cols)}
        values = {c: cut[k].select(F.col(f"`{c}`")) for k, c in enumerate(cols)}
        return cls(cut[-1], values, sizes, found[0].n if found else 0)

    @property
    def cells(self) -> int:
        return math.prod(self.sizes.values())

    def dense(self) -> DataFrame:
        """All cells of the domain and their counts; its size is for the caller to check."""
        if len(self.values) == 1:
            return self.seen
        return filled(self.seen, reduce(DataFrame.crossJoin, self.values.values()), [*self.values])


def dp_contingency(df: DataFrame, cols: str | list[str], epsilon: float, seed: str | None = None, max_cells: int = MAX_CELLS, weight: str | None = None) -> DataFrame:
    """cols, count: Laplace(1 / epsilon) on every cell of the domain, clamped, rounded up.

    A domain of more than max_cells is never built: see sparse.noisy_cells. Then cells of a noisy count of 0 are left out.
    """
    check_epsilon(epsilon)
    cols = ensure_list(cols)
    seed, scale, own = noise_seed(fresh(seed), "contingency", cols, epsilon), 1 / epsilon, Observed.of(df, cols, weight)
    if len(cols) == 1 or own.cells <= max_cells:
        cells = own.dense()
        noisy = cells.withColumn("count", _noisy(cells, "count", cols, scale, seed))
    else:
        noisy = sparse.noisy_cells(own.seen, own.values, own.sizes, "count", scale, max_cells, seed)
    return noisy.withColumn("count", F.ceil("count").cast("long"))


def dp_joint(df: DataFrame, cols: str | list[str], epsilon: float, seed: str | None = None, max_cells: int = MAX_CELLS, mechanism: str = "joint", n: int | None = None) -> DataFrame:
    """cols, p: shares with Laplace(2 / (n * epsilon)), clamped and normalised; with one column a marginal.

    mechanism names the release: another one of the same columns and epsilon has noise of its own. n is the number of rows,
    counted unless given. A domain of more than max_cells is never built: see sparse.noisy_cells.
    """
    check_epsilon(epsilon)
    cols = ensure_list(cols)
    own = Observed.of(df, cols)
    n = own.n if n is None else n
    if len(cols) == 1 or own.cells <= max_cells:
        return noisy_shares(own.dense(), cols, epsilon, seed, mechanism, n)
    seed, scale = noise_seed(fresh(seed), mechanism, cols, epsilon), 2 / (n * epsilon) if n else 0.0
    seen = own.seen.withColumn("count", F.col("count") / max(n, 1))
    noisy = sparse.noisy_cells(seen, own.values, own.sizes, "count", scale, max_cells, seed)
    return shares(noisy.withColumnRenamed("count", "v"), "v").select(*[F.col(f"`{c}`") for c in cols], "p")


def noisy_shares(cells: DataFrame, cols: list[str], epsilon: float, seed: str | None, mechanism: str, n: int) -> DataFrame:
    """cols, p from the counts of all cells of a domain, of n rows in all."""
    scale = 2 / (n * epsilon) if n else 0.0
    cells = shares(cells, "count")
    noisy = _noisy(cells, "p", cols, scale, noise_seed(fresh(seed), mechanism, cols, epsilon))
    return shares(cells.withColumn("v", noisy), "v").select(*[F.col(f"`{c}`") for c in cols], "p")


def dp_conditional(df: DataFrame, child: str, parents: list[str], epsilon: float, seed: str | None = None, max_cells: int = MAX_CELLS, n: int | None = None) -> DataFrame:
    """parents, child, p: a noisy joint, normalised within each parent combination.

    Each combination needs a distribution, so domains of more than max_cells are refused; the size of a parent set is
    bounded where a network is learnt.
    """
    check_epsilon(epsilon)
    own = Observed.of(df, [*parents, child])
    if parents and own.cells > max_cells:
        raise ValueError(f"the domain of {[*parents, child]} has {own.cells} cells; at most {max_cells} are allowed")
    return noisy_conditional(own.dense(), child, parents, epsilon, seed, own.n if n is None else n)


def noisy_conditional(cells: DataFrame, child: str, parents: list[str], epsilon: float, seed: str | None, n: int) -> DataFrame:
    """parents, child, p from the counts of all cells of a domain, of n rows in all."""
    noisy = noisy_shares(cells, [*parents, child], epsilon, seed, "conditional", n)
    return shares(noisy.withColumnRenamed("p", "v"), "v", parents).select(*[F.col(f"`{c}`") for c in [*parents, child]], "p") if parents else noisy


def r_sensitivity(n: int) -> float:
    """Of the R score of a table of n rows; n must be positive."""
    if n < 1:
        raise ValueError("the sensitivity needs one row at least")
    return 3 / n + 2 / n**2


def mi_sensitivity(n: int) -> float:
    """Of the mutual information of a table of n rows; the term of the other rows vanishes at n = 1."""
    if n < 1:
        raise ValueError("the sensitivity needs one row at least")
    if n == 1:
        return 0.0
    return 2 / n * math.log((n + 1) / 2) + (n - 1) / n * math.log((n + 1) / (n - 1))


def exponential(scores: DataFrame, key: str, score: str, epsilon: float, sensitivity: float, seed: str) -> DataFrame:
    """The row chosen with probability in proportion to exp(epsilon * score / (2 * sensitivity)).

    The Gumbel trick: the highest of the scaled scores plus keyed Gumbel noise; at an infinite epsilon the highest
    score, ties by the noise.
    """
    check_epsilon(epsilon)
    noise = gumbel(uniform(seed, key))
    order = [F.desc(score), F.desc(noise)] if math.isinf(epsilon) else [F.desc(F.col(score) * (epsilon / (2 * sensitivity)) + noise)]
    return scores.orderBy(*order, key).limit(1)
