"""Synthesizers: learn a differentially private model of a table and draw artificial rows from it."""

from __future__ import annotations

import copy
import hashlib
import json
import logging
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources import tables
from . import privacy, scores
from .distributions import MAX_CELLS, NotFittedError, cardinalities, clean, filled, grouped_counts, shares
from .metrics import js_many, js_marginal
from .sampling import draw

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Pair:
    """A column of a network and its parents."""

    attribute: str
    parents: tuple[str, ...] = ()


class Synthesizer:
    """fit, sample, score, save and load. tables_ holds the learned distributions, one DataFrame each.

    fit writes the distributions to the shared folder, so a fitted model needs its source no more and doesn't follow its
    changes. weight names a column of counts, if a row stands for several. Without a seed each fit draws noise of its own; a given one makes fits repeatable, and must stay secret.
    """

    def __init__(self, epsilon: float = 1.0, seed: str | None = None, max_cells: int = MAX_CELLS) -> None:
        privacy.check_epsilon(epsilon)
        self.epsilon, self.max_cells = epsilon, max_cells
        self.seed = seed  # never saved
        self.tables_: dict[str, DataFrame] | None = None

    def _capture(self, df: DataFrame, weight: str | None = None) -> DataFrame:
        self.schema_, self.release_ = T.StructType([f for f in df.schema if f.name != weight]), privacy.fresh(self.seed)
        self.ledger_ = privacy.Ledger(self.epsilon)
        return clean(df)

    def _counted(self, df: DataFrame, sets: list[tuple[str, ...]], weight: str | None = None) -> tuple[dict[str, DataFrame], list[DataFrame], dict[str, int]]:
        """(values of each column, cells of each set, distinct values): one aggregate, written once; n_ follows from it."""
        every = [(c,) for c in self.schema_.names] + sets
        counts = tables.keep(grouped_counts(df, every, weight), "__set")
        cut = [counts.where(F.col("__set") == k).select(*[F.col(f"`{c}`") for c in s], "count") for k, s in enumerate(every)]
        found = {r["__set"]: r for r in counts.groupBy("__set").agg(F.count("*").alias("k"), F.sum("count").alias("n")).collect()}  # a row a set
        self.n_ = found[0].n if found else 0
        d = len(self.schema_)
        return dict(zip(self.schema_.names, cut[:d], strict=True)), cut[d:], {c: found[k].k if found else 0 for k, c in enumerate(self.schema_.names)}

    def _keep(self, found: dict[str, DataFrame]) -> None:
        """Writes the tables in one job, and reads them from there on."""
        wide = [t.select(F.lit(k).alias("__set"), F.col("p"), *[F.col(f"`{c}`") for c in t.columns if c != "p"]) for k, t in enumerate(found.values())]
        kept = tables.keep(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide), "__set")
        sizes = dict(kept.groupBy("__set").count().collect())  # a row a table
        self.cells_ = {name: sizes.get(k, 0) for k, name in enumerate(found)}
        self.tables_ = {name: kept.where(F.col("__set") == k).select(*[F.col(f"`{c}`") for c in t.columns]) for k, (name, t) in enumerate(found.items())}

    def _check_fitted(self) -> None:
        if self.tables_ is None:
            raise NotFittedError(f"{type(self).__name__} has not been fitted")

    def _rows(self, n: int | None) -> DataFrame:
        self._check_fitted()
        if n is not None and (isinstance(n, bool) or not isinstance(n, int)):
            raise TypeError("the number of rows must be a whole number")
        if n is not None and n < 0:
            raise ValueError("the number of rows can't be negative")
        spark = next(iter(self.tables_.values())).sparkSession
        return spark.range(self.n_ if n is None else n).withColumnRenamed("id", "__rid")

    def _restore(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema_])

    def score(self, original: DataFrame, artificial: DataFrame, by_column: bool = False) -> float | dict[str, float]:
        """Mean Jensen-Shannon distance of the columns, or with by_column that of each."""
        found = {r.column: r.distance for r in js_marginal(original, artificial).select("column", "distance").collect()}  # one row a column
        return found if by_column else sum(found.values()) / len(found)

    def copy(self) -> Synthesizer:
        return copy.copy(self)

    def _state(self) -> dict:
        return {"epsilon": self.epsilon if not math.isinf(self.epsilon) else "inf", "max_cells": self.max_cells}

    def save(self, path: str) -> None:
        """A folder: model.json as text and one Parquet table for each distribution; the seed stays out."""
        self._check_fitted()
        spark = next(iter(self.tables_.values())).sparkSession
        state = {"class": type(self).__name__, "schema": self.schema_.jsonValue(), "n": self.n_, "tables": [*self.tables_], "state": self._state()}
        for k, table in enumerate(self.tables_.values()):
            table.write.mode("overwrite").parquet(f"{path}/table-{k}")
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str, seed: str | None = None) -> Synthesizer:
        """A model that save() wrote; nothing in the folder is executed."""
        state = json.loads(spark.read.text(f"{path}/model").first()[0])
        kind = {c.__name__: c for c in (MarginalSynthesizer, UniformSynthesizer, ContingencySynthesizer, BayesNet, BayesNetNonPrivate)}[state["class"]]
        kept = state["state"]
        model = kind(epsilon=float(kept["epsilon"]), seed=seed, max_cells=kept["max_cells"])
        model.schema_, model.n_ = T.StructType.fromJson(state["schema"]), state["n"]
        model.tables_ = {name: spark.read.parquet(f"{path}/table-{k}") for k, name in enumerate(state["tables"])}
        model.release_, model.cells_ = privacy.fresh(seed), {}
        model._load_state(kept)
        return model

    def _load_state(self, state: dict) -> None:
        pass


class MarginalSynthesizer(Synthesizer):
    """Independent noisy marginals, epsilon / d each; all are counted in one pass."""

    def fit(self, df: DataFrame, weight: str | None = None) -> MarginalSynthesizer:
        values, _, _ = self._counted(self._capture(df, weight), [], weight)
        share = self.epsilon / len(values)
        self._keep({c: privacy.noisy_shares(cells, [c], self.ledger_.spend(f"marginal {c}", share), self.release_, "joint", self.n_) for c, cells in values.items()})
        return self

    def sample(self, n: int | None = None) -> DataFrame:
        rows = self._rows(n)
        for c, table in self.tables_.items():
            rows = draw(rows, table, [c], self.release_, "__rid", n_cells=self.cells_.get(c))
        return self._restore(rows)


class UniformSynthesizer(MarginalSynthesizer):
    """Each observed value alike; spends nothing, but shows which values there are."""

    def fit(self, df: DataFrame, weight: str | None = None) -> UniformSynthesizer:
        values, _, _ = self._counted(self._capture(df, weight), [], weight)
        self._keep({c: shares(cells.select(F.col(f"`{c}`"), F.lit(0).alias("zero")), "zero").select(F.col(f"`{c}`"), "p") for c, cells in values.items()})
        return self


class ContingencySynthesizer(Synthesizer):
    """One noisy table over the whole domain; one of more than max_cells is not built, see sparse.noisy_cells."""

    def fit(self, df: DataFrame, weight: str | None = None) -> ContingencySynthesizer:
        df = self._capture(df, weight)
        self.n_ = df.agg(F.count("*") if weight is None else F.coalesce(F.sum(weight), F.lit(0))).first()[0]
        table = tables.keep(privacy.dp_contingency(df, self.schema_.names, self.ledger_.spend("contingency", self.epsilon), self.release_, self.max_cells, weight))
        total, cells = table.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
        self.cells_ = {"contingency": cells}
        log.info("contingency table over %s", df.columns)
        self.tables_ = {"contingency": table.withColumn("p", F.col("count") / max(total, 1))}
        return self

    def sample(self, n: int | None = None) -> DataFrame:
        rows = draw(self._rows(n), self.tables_["contingency"], [f.name for f in self.schema_], self.release_, "__rid", n_cells=self.cells_.get("contingency"))
        return self._restore(rows)


class BayesNet(Synthesizer):
    """A Bayesian network with theta-useful noisy conditional tables.

    Structure: greedily, with the exponential mechanism over maximal useful parent sets (split * epsilon in all);
    tables: Laplace ((1 - split) * epsilon in all). A network may be given in part or whole; the structure
    budget that it leaves unused goes to the tables.
    """

    def __init__(self, epsilon: float = 1.0, theta: float = 4, split: float = 0.3, score_function: str = "R", network: list[Pair] | None = None, seed: str | None = None, max_cells: int = MAX_CELLS) -> None:
        super().__init__(epsilon, seed, max_cells)
        if score_function not in ("R", "MI"):
            raise ValueError("the score function is R or MI")
        self.theta, self.split, self.score_function = theta, split, score_function
        self.network_: list[Pair] = []
        self.network_init = network
        if network is not None:
            self.set_network(network)

    def set_network(self, network: list[Pair]) -> BayesNet:
        """Predefine the first pairs: unique columns, each after its parents."""
        seen: set[str] = set()
        for pair in network:
            if not isinstance(pair, Pair):
                raise TypeError("a network is a list of Pair")
            if pair.attribute in seen or not set(pair.parents) <= seen:
                raise ValueError(f"{pair} comes twice or before its parents")
            seen.add(pair.attribute)
        self.network_init = [*network]
        return self

    def _noise_epsilon(self) -> float:
        return self.epsilon

    def _limit(self, d: int, child: int) -> float:
        return scores.max_domain_size(self.n_, self.epsilon, self.split, d, self.theta, child)

    def fit(self, df: DataFrame, weight: str | None = None) -> BayesNet:
        """The source is read once: for a given network by the counts of all its tables, or else for its distinct rows, from
        which scores and counts are taken."""
        df = self._capture(df, weight)
        columns = self.schema_.names
        network = [*(self.network_init or [])]
        if unknown := {p.attribute for p in network} - set(columns):
            raise ValueError(f"the network names unknown columns: {sorted(unknown)}")
        to_learn = len(columns) - max(1, len(network))
        epsilon = self._noise_epsilon()
        if len(network) < len(columns):
            if weight is None:
                df, weight = tables.keep(scores.collapsed(df)), "count"
            network = self._learned(df.withColumnRenamed(weight, "count"), network, epsilon * self.split / max(1, to_learn))
        self.network_ = network
        share = (1 - self.split if to_learn else 1) * epsilon / len(columns)
        values, cells, sizes = self._counted(df, [(*p.parents, p.attribute) for p in network], weight)
        found = {}
        for pair, seen in zip(network, cells, strict=True):
            if not math.isinf(share):
                self.ledger_.spend(f"table {pair.attribute}", share)
            cols = [*pair.parents, pair.attribute]
            if len(cols) > 1:
                if (n := math.prod(sizes[c] for c in cols)) > self.max_cells:
                    raise ValueError(f"the domain of {cols} has {n} cells; at most {self.max_cells} are allowed")
                whole = reduce(DataFrame.crossJoin, [values[c].select(F.col(f"`{c}`")) for c in cols])  # of checked size
                seen = filled(seen, whole, cols)
            found[pair.attribute] = privacy.noisy_conditional(seen, pair.attribute, [*pair.parents], share, self.release_, self.n_)
        self._keep(found)
        return self

    def _learned(self, base: DataFrame, network: list[Pair], epsilon: float) -> list[Pair]:
        """The network, completed greedily; each candidate set is scored once, when its last parent has come."""
        columns = self.schema_.names
        self.n_ = base.agg(F.sum("count")).first()[0] or 0
        sizes = cardinalities(base, columns)
        network = network or [Pair(min(columns, key=lambda c: root_order(self.release_, c)))]
        known: dict[tuple[str, tuple[str, ...]], float] = {}
        while len(network) < len(columns):
            chosen = {p.attribute: sizes[p.attribute] for p in network}
            sets = [(c, tuple(sorted(s))) for c in columns if c not in chosen for s in (scores.maximal_parent_sets(chosen, self._limit(len(columns), sizes[c])) or {frozenset()})]
            new = [s for s in sets if s not in known]
            known |= dict(zip(new, scores.score_all(base, new, self.score_function), strict=True))
            network = [*network, Pair(*self._choose(base.sparkSession, sets, [known[s] for s in sets], epsilon, len(network)))]
        self.scores_ = known
        return network

    def _choose(self, spark: SparkSession, sets: list[tuple[str, tuple[str, ...]]], found: list[float], epsilon: float, step: int) -> tuple[str, tuple[str, ...]]:
        n = max(self.n_, 2)
        delta = privacy.r_sensitivity(n) if self.score_function == "R" else privacy.mi_sensitivity(n)
        table = spark.createDataFrame([(k, float(s)) for k, s in enumerate(found)], "k long, score double")
        self.ledger_.spend(f"structure {step}", 0.0 if math.isinf(epsilon) else epsilon)
        return sets[privacy.exponential(table, "k", "score", epsilon, delta, f"{self.release_}|{step}").first().k]

    def sample(self, n: int | None = None) -> DataFrame:
        return self._restore(self._chain(self._rows(n), set()))

    def _chain(self, rows: DataFrame, given: set[str]) -> DataFrame:
        """One join a column, in the network's order; no loop over rows."""
        for pair in self.network_:
            if pair.attribute not in given:
                rows = draw(rows, self.tables_[pair.attribute], [pair.attribute], self.release_, "__rid", [*pair.parents], self.cells_.get(pair.attribute))
        return rows

    def sample_remaining(self, fixed: DataFrame, key: str) -> DataFrame:
        """fixed with the network's other columns drawn given its own; key identifies its rows.

        The fixed columns must be some of the network's, not all, and hold each one's parents.
        """
        self._check_fitted()
        given = set(fixed.columns) & {p.attribute for p in self.network_}
        if not given or set(fixed.columns) - given - {key} or len(given) == len(self.network_):
            raise ValueError("the fixed columns must be some, not all, of the network's")
        if bad := [p.attribute for p in self.network_ if p.attribute in given and not set(p.parents) <= given]:
            raise ValueError(f"{bad} are fixed without all their parents")
        rows = self._chain(clean(fixed).withColumn("__rid", F.col(key)), given)
        return rows.select(key, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema_ if f.name != key])

    def _state(self) -> dict:
        return super()._state() | {"theta": self.theta, "split": self.split, "score_function": self.score_function, "network": self._listed(self.network_), "given": self._listed(self.network_init)}

    @staticmethod
    def _listed(network: list[Pair] | None) -> list | None:
        return None if network is None else [[p.attribute, [*p.parents]] for p in network]

    def _load_state(self, state: dict) -> None:
        self.theta, self.split, self.score_function = state["theta"], state["split"], state["score_function"]
        self.network_ = [Pair(a, tuple(p)) for a, p in state["network"]]
        given = state.get("given")
        self.network_init = None if given is None else [Pair(a, tuple(p)) for a, p in given]


class BayesNetNonPrivate(BayesNet):
    """No noise at all; epsilon only bounds the size of the tables."""

    def _noise_epsilon(self) -> float:
        return math.inf

    def _limit(self, d: int, child: int) -> float:
        return self.n_ * self.epsilon / (2 * d * self.theta * child)


def root_order(seed: str, name: str) -> str:
    return hashlib.md5(f"{seed}|root|{name}".encode()).hexdigest()


def experiment(df: DataFrame, models: dict[str, type[Synthesizer]], epsilons: tuple[float, ...] = (0.01, 0.1, 1.0), n: int | None = None, seed: str | None = None, path: str | None = None) -> DataFrame:
    """synthesizer, epsilon, score of the whole grid; with a path, each artificial table is written under it.

    The source is read once, for its distinct rows and their counts: all models are fitted to these. The score, the mean
    Jensen-Shannon distance of the columns, comes from one aggregate over the samples of the whole grid.
    """
    base, columns = tables.keep(scores.collapsed(df)), df.columns
    samples, grid = [], [(name, float(e), kind) for name, kind in models.items() for e in epsilons]
    for k, (name, epsilon, kind) in enumerate(grid):
        sample = kind(epsilon=epsilon, seed=seed).fit(base, "count").sample(n)
        if path:
            folder = f"{path}/synthesizer={name}/epsilon={epsilon}"
            sample.write.mode("overwrite").parquet(folder)
            sample = df.sparkSession.read.schema(sample.schema).parquet(folder)
        samples.append(sample.select(F.lit(k).alias("__at"), F.lit(1).cast("long").alias("count"), *[F.col(f"`{c}`") for c in columns]))
    every = reduce(DataFrame.unionAll, [base.select(F.lit(-1).alias("__at"), "count", *[F.col(f"`{c}`") for c in columns]), *samples])
    found = js_many(every, "__at", "count", len(grid))
    named = df.sparkSession.createDataFrame([(k, name, e) for k, (name, e, _) in enumerate(grid)], "__at int, synthesizer string, epsilon double")
    return named.join(found, "__at").select("synthesizer", "epsilon", "score")
