"""How near an artificial table is to its original: distances, associations, profiles, survival, ranking curves."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import token
from .distributions import cardinalities, cardinality_table, clean, grouped_counts, marginals, rare_categories, same


def both_tables(first: DataFrame, second: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both with __one true in the first; the second in the first's order of columns."""
    cols = [c for c in first.columns if c not in exclude]
    return clean(first.select(*cols)).withColumn("__one", F.lit(True)).unionAll(clean(second.select(*cols)).withColumn("__one", F.lit(False)))


def _js(counts: DataFrame, by: str) -> DataFrame:
    """by, distance from counts(by, c1, c2) of aligned cells: one aggregate, no join of the two tables."""
    w = Window.partitionBy(by)
    p, q = F.col("c1") / F.sum("c1").over(w), F.col("c2") / F.sum("c2").over(w)
    half = lambda x, m: F.when(x > 0, x * F.ln(x / m)).otherwise(0.0)
    cells = counts.select(by, p.alias("p"), q.alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    terms = half(F.col("p"), F.col("m")) + half(F.col("q"), F.col("m"))
    return cells.groupBy(by).agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(terms) / 2)).alias("distance"))


def _count_both(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if("__one").alias("c1"), F.count_if(~F.col("__one")).alias("c2"))


def aligned_counts(first: DataFrame, second: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """column, value, c1, c2: a full outer alignment of value counts, 0 where a table lacks a value."""
    both = both_tables(first, second, exclude)
    cols = [c for c in both.columns if c != "__one"]
    long = both.select("__one", *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(["__one"], cols, "column", "value")
    return _count_both(long, "column", "value")


def js_marginal(first: DataFrame, second: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """column, distance: Jensen-Shannon, natural logarithm."""
    return _js(aligned_counts(first, second, exclude), "column")


def js_many(tables: DataFrame, at: str, weight: str, n: int) -> DataFrame:
    """at, score: the mean distance of the columns of each of n tables (at from 0 on) to the original's (at = -1).

    All tables stand in one, with counts in weight. A value's counts in all of them come together in one row, so there
    is one aggregate, and no table is joined with another.
    """
    cols = [c for c in tables.columns if c not in (at, weight)]
    texts = clean(tables).select(at, weight, *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    long = texts.unpivot([at, weight], cols, "column", "value").groupBy("column", "value", at).agg(F.sum(weight).alias("c"))
    cells = long.groupBy("column", "value").agg(F.map_from_entries(F.collect_list(F.struct(at, "c"))).alias("by"))  # n + 1 entries
    count = lambda k: F.coalesce(F.try_element_at("by", k), F.lit(0))
    cells = cells.select("column", count(F.lit(-1)).alias("c1"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(k.alias("at"), count(k).alias("c2")))).alias("x"))
    both = _js(cells.select(F.struct("x.at", "column").alias("of"), "c1", "x.c2"), "of")
    return both.groupBy(F.col("of.at").alias(at)).agg(F.avg("distance").alias("score"))


def js_joint(first: DataFrame, second: DataFrame, n_variables: int = 2, exclude: tuple[str, ...] = ()) -> DataFrame:
    """columns, distance for each combination of n_variables columns; all are counted in one grouping-sets aggregate."""
    both = both_tables(first, second, exclude)
    sets = [*combinations([c for c in both.columns if c != "__one"], n_variables)]
    counts = grouped_counts(both, sets, counts={"c1": F.count_if("__one"), "c2": F.count_if(~F.col("__one"))})
    name = F.element_at(F.array(*[F.lit(",".join(s)) for s in sets]), F.col("__set") + 1)
    return _js(counts.select(name.alias("columns"), "c1", "c2"), "columns")


def _pair_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    counts = clean(df.select(x, y)).groupBy(token(x).alias("x"), token(y).alias("y")).agg(F.count("*").alias("c"))
    counts = counts.crossJoin(F.broadcast(counts.agg(F.sum("c").alias("n"))))  # one row
    return counts.select("x", "y", "c", F.sum("c").over(Window.partitionBy("x")).alias("cx"), F.sum("c").over(Window.partitionBy("y")).alias("cy"), "n")


def theils_u(df: DataFrame, x: str, y: str) -> DataFrame:
    """value: the uncertainty of x that y removes, (H(x) - H(x|y)) / H(x); 1 if x is constant. NULL is a category."""
    cells = _pair_counts(df, x, y)
    return cells.agg(_theil("cx", "cy").alias("value"))


def cramers_v(df: DataFrame, x: str, y: str, corrected: bool = False) -> DataFrame:
    """value: Cramer's V without bias correction unless asked for; 0 if either is constant."""
    cells = _pair_counts(df, x, y)
    # empty cells add their expected counts: sum of (o - e)^2 / e = sum over observed of o^2 / e - n
    one = cells.agg(F.sum(F.col("c") * F.col("c") * F.col("n") / (F.col("cx") * F.col("cy"))).alias("s"), F.max("n").alias("n"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("k"))
    phi = (F.col("s") - F.col("n")) / F.col("n")
    least = F.least("r", "k") - 1
    if corrected:
        phi = F.greatest(F.lit(0.0), phi - (F.col("r") - 1) * (F.col("k") - 1) / (F.col("n") - 1))
        least = F.least(F.col("r") - F.pow(F.col("r") - 1, 2) / (F.col("n") - 1), F.col("k") - F.pow(F.col("k") - 1, 2) / (F.col("n") - 1)) - 1
    return one.select(F.when(least <= 0, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), phi) / least)).alias("value"))


def correlation_ratio(df: DataFrame, nominal: str, numeric: str) -> DataFrame:
    """value: eta, the root of the share of the variance between groups; rows without a number are left out."""
    rows = clean(df.select(nominal, numeric)).where(F.col(numeric).isNotNull())
    groups = rows.groupBy(token(nominal).alias("g")).agg(F.count("*").alias("n"), F.avg(numeric).alias("m"), F.var_pop(numeric).alias("v"))
    return _eta(groups.withColumn("at", F.lit(0)), ["at"]).select("value")


def _eta(groups: DataFrame, by: list[str]) -> DataFrame:
    """by, value from groups(by, n, m, v) of size, mean and variance: sums of squares about means, none of which cancel."""
    means = groups.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    between, within = F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)), F.sum(F.col("n") * F.col("v"))
    found = groups.join(F.broadcast(means), by).groupBy(*by).agg(between.alias("b"), within.alias("w"))  # a row for each pair of columns
    return found.select(*by, F.when(F.col("b") + F.col("w") <= 0, 0.0).otherwise(F.sqrt(F.col("b") / (F.col("b") + F.col("w")))).alias("value"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """value: Pearson's r of the rows that have both numbers."""
    return clean(df.select(x, y)).dropna().agg(F.corr(x, y).alias("value"))


def associations(df: DataFrame, nominal: list[str] | None = None, kind: str = "theil") -> DataFrame:
    """row, col, value of all pairs of columns; strings and booleans are nominal unless named.

    Three jobs whatever the number of columns: the counts of all pairs of nominal columns, which give both directions;
    the groups of all nominal columns with the moments of all numbers; the correlations. What isn't defined is 0.
    """
    if kind not in ("theil", "cramer"):
        raise ValueError("the association of nominal columns is theil or cramer")
    nominal = [f.name for f in df.schema if f.dataType.typeName() in ("string", "boolean")] if nominal is None else [c for c in df.columns if c in nominal]
    numeric = [c for c in df.columns if c not in nominal]
    df = clean(df).select(*[token(c).alias(f"x{i}") for i, c in enumerate(nominal)], *[F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(numeric)])
    name = lambda names, at: F.element_at(F.array(*map(F.lit, names)), F.col(at) + 1)
    out = df.sparkSession.createDataFrame([(c, c, 1.0) for c in [*nominal, *numeric]], "row string, col string, value double")
    both = lambda found, a, b: found.select(F.explode(F.array(F.struct(a.alias("row"), b.alias("col"), "value"), F.struct(b.alias("row"), a.alias("col"), F.col("back").alias("value")))).alias("p")).select("p.*")
    if len(nominal) > 1:
        base = df.groupBy(*[f"x{i}" for i in range(len(nominal))]).agg(F.count("*").alias("c"))
        pairs = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"x{i}").alias("x"), F.col(f"x{j}").alias("y")) for i, j in combinations(range(len(nominal)), 2)]
        cells = base.select("c", F.explode(F.array(*pairs)).alias("p")).groupBy("p.a", "p.b", "p.x", "p.y").agg(F.sum("c").alias("c"))
        cells = cells.withColumn("cx", F.sum("c").over(Window.partitionBy("a", "b", "x"))).withColumn("cy", F.sum("c").over(Window.partitionBy("a", "b", "y")))
        cells = cells.crossJoin(F.broadcast(base.agg(F.sum("c").alias("n"))))  # one row
        found = cells.groupBy("a", "b").agg(_theil("cx", "cy").alias("value"), _theil("cy", "cx").alias("back")) if kind == "theil" else cells.groupBy("a", "b").agg(_cramer().alias("value")).withColumn("back", F.col("value"))
        out = out.unionByName(both(found, name(nominal, "a"), name(nominal, "b")))
    if nominal and numeric:
        moments = [F.struct(F.lit(k).alias("k"), F.count(f"y{k}").alias("n"), F.avg(f"y{k}").alias("m"), F.var_pop(f"y{k}").alias("v")) for k in range(len(numeric))]
        groups = df.withColumn("g", F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.col(f"x{i}").alias("x")) for i in range(len(nominal))])))
        groups = groups.groupBy("g.a", "g.x").agg(F.array(*moments).alias("moments")).select("a", F.explode("moments").alias("y")).select("a", "y.*").where("n > 0")
        found = _eta(groups, ["a", "k"]).withColumn("back", F.col("value"))
        out = out.unionByName(both(found, name(nominal, "a"), name(numeric, "k")))
    if len(numeric) > 1:
        pairs = [F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.corr(f"y{i}", f"y{j}").alias("value")) for i, j in combinations(range(len(numeric)), 2)]
        found = df.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("p")).select("p.*").withColumn("back", F.col("value"))
        out = out.unionByName(both(found, name(numeric, "a"), name(numeric, "b")))
    return out.withColumn("value", F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))


def _theil(own: str, other: str):
    """Theil's U of own that other removes, as an aggregate of cells c of totals own, other and n."""
    h = F.sum(-F.col("c") / F.col("n") * F.ln(F.col(own) / F.col("n")))  # each row weighs its own count
    left = F.sum(-F.col("c") / F.col("n") * F.ln(F.col("c") / F.col(other)))
    return F.when(h == 0, 1.0).otherwise((h - left) / h)


def _cramer():
    """Cramer's V as an aggregate of cells; a level's cells hold its whole count, so their shares of it count the levels."""
    n = F.max("n")
    phi = (F.sum(F.col("c") * F.col("c") * F.col("n") / (F.col("cx") * F.col("cy"))) - n) / n
    least = F.least(F.round(F.sum(F.col("c") / F.col("cx"))), F.round(F.sum(F.col("c") / F.col("cy")))) - 1
    return F.when(least <= 0, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), phi) / least))


def association_distance(first: DataFrame, second: DataFrame, nominal: list[str] | None = None, kind: str = "theil") -> DataFrame:
    """distance: the Frobenius norm of the difference of both association matrices."""
    a, b = associations(first, nominal, kind), associations(second.select(*first.columns), nominal, kind)
    return a.join(b.withColumnRenamed("value", "other"), ["row", "col"]).agg(F.sqrt(F.sum(F.pow(F.col("value") - F.col("other"), 2))).alias("distance"))


#: Ranges of an order that are summed up apart.
RANGES = 64


def _ranged(df: DataFrame, order: str) -> DataFrame:
    """df with __part, the range of its order: between approximate percentiles, so that no task gets all rows."""
    ends = sorted(set(df.select(F.col(order).cast("double").alias("o")).approxQuantile("o", [k / RANGES for k in range(1, RANGES)], 0.5 / RANGES)))
    part = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e < F.col(order).cast("double"))) if ends else F.lit(0)
    return df.withColumn("__part", part.cast("int"))


def _running(df: DataFrame, values: dict[str, str], order: str, by: list[str], descending: bool = False) -> DataFrame:
    """df of _ranged() with the sum of each value so far in the order: within its range, plus those of the ranges before."""
    turn = F.desc if descending else F.asc
    parts = df.groupBy(*by, "__part").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    before = Window.partitionBy(*by).orderBy(turn("__part")).rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
    parts = parts.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values])
    within = Window.partitionBy(*by, "__part").orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({out: F.sum(v).over(within) for v, out in values.items()})
    on = same([F.col(c) for c in [*by, "__part"]], [F.col(c) for c in [*(f"__by{i}" for i in range(len(by))), "__p"]])
    df = df.join(parts, on).withColumns({out: F.col(out) + F.col(f"__{v}") for v, out in values.items()})
    return df.drop("__p", *(f"__by{i}" for i in range(len(by))), *(f"__{v}" for v in values))


def kaplan_meier(df: DataFrame, time: str, event: str, group: str | None = None) -> DataFrame:
    """group, time, at_risk, events, survival at each time of each group; rows without a time are left out. Times are numbers."""
    g = F.col(group) if group else F.lit(None).cast("string")
    rows = clean(df.select(g.alias("group"), F.col(time).alias("time"), F.col(event).cast("int").alias("event"))).where("time is not null")
    steps = _ranged(rows.groupBy("group", "time").agg(F.count("*").alias("n"), F.sum("event").alias("events")), "time")
    steps = _running(steps, {"n": "at_risk"}, "time", ["group"], descending=True)
    left = 1 - F.col("events") / F.col("at_risk")
    steps = steps.withColumn("end", (left <= 0).cast("int")).withColumn("step", F.when(left > 0, F.ln(left)).otherwise(0.0))
    steps = _running(steps, {"step": "log", "end": "gone"}, "time", ["group"])
    return steps.select("group", "time", "at_risk", "events", F.when(F.col("gone") > 0, 0.0).otherwise(F.exp("log")).alias("survival"))


def _ranked(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, y, tp, fp, p, all at each distinct score."""
    steps = _ranged(df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("y"), F.count("*").alias("n")), "score")
    every = steps.agg(F.sum("y").alias("p"), F.sum("n").alias("all"))
    steps = _running(steps, {"y": "tp", "n": "seen"}, "score", [], descending=True)
    return steps.crossJoin(F.broadcast(every)).select("score", "y", "tp", (F.col("seen") - F.col("tp")).alias("fp"), "p", "all")  # one row


def ranking_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """score, tp, fp, tpr, fpr, precision at each threshold from the highest score on; equal scores are one point."""
    return _ranked(df, score, label).select("score", "tp", "fp", (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / (F.col("all") - F.col("p"))).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """average_precision: the sum of precision times the step of recall, not interpolated."""
    step = F.col("y") / F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    return _ranked(df, score, label).agg(F.sum(step).alias("average_precision"))


class Metric(ABC):
    """fit on both tables, then score; plot_data has the numbers that a figure would show."""

    def __init__(self, exclude: tuple[str, ...] = ()) -> None:
        self.exclude = tuple(exclude)

    def fit(self, original: DataFrame, artificial: DataFrame) -> Metric:
        if missing := set(original.columns) - set(self.exclude) - set(artificial.columns):
            raise ValueError(f"the artificial table lacks {sorted(missing)}")
        cols = [c for c in original.columns if c not in self.exclude]
        self.tables_ = (original.select(*cols), artificial.select(*cols))
        return self

    @abstractmethod
    def score(self) -> float: ...

    def plot_data(self) -> DataFrame:
        raise NotImplementedError


class MarginalComparison(Metric):
    def score(self) -> float:
        return js_marginal(*self.tables_).agg(F.avg("distance")).first()[0]

    def plot_data(self) -> DataFrame:
        w = Window.partitionBy("column")
        return aligned_counts(*self.tables_).select("column", "value", (F.col("c1") / F.sum("c1").over(w)).alias("original"), (F.col("c2") / F.sum("c2").over(w)).alias("artificial"))


class JointComparison(Metric):
    def __init__(self, n_variables: int = 2, exclude: tuple[str, ...] = ()) -> None:
        super().__init__(exclude)
        self.n_variables = n_variables

    def score(self) -> float:
        return self.plot_data().agg(F.avg("distance")).first()[0]

    def plot_data(self) -> DataFrame:
        return js_joint(*self.tables_, self.n_variables)


class AssociationComparison(Metric):
    def __init__(self, kind: str = "theil", nominal: list[str] | None = None, exclude: tuple[str, ...] = ()) -> None:
        super().__init__(exclude)
        self.kind, self.nominal = kind, nominal

    def score(self) -> float:
        return association_distance(*self.tables_, self.nominal, self.kind).first()[0]

    def plot_data(self) -> DataFrame:
        a, b = (associations(t, self.nominal, self.kind) for t in self.tables_)
        return a.join(b.withColumnRenamed("value", "artificial"), ["row", "col"]).withColumnRenamed("value", "original")


class SurvivalComparison(Metric):
    """Survival curves of the groups of both tables, side by side; there is no score."""

    def __init__(self, time: str, event: str, group: str | None = None, exclude: tuple[str, ...] = ()) -> None:
        super().__init__(exclude)
        self.time, self.event, self.group = time, event, group

    def score(self) -> None:
        return None

    def plot_data(self) -> DataFrame:
        return survival_curves(dict(zip(("original", "artificial"), self.tables_, strict=True)), self.time, self.event, self.group)


def survival_curves(tables: dict[str, DataFrame], time: str, event: str, group: str | None = None) -> DataFrame:
    """table and the columns of kaplan_meier for each of several tables."""
    found = [kaplan_meier(df, time, event, group).select(F.lit(name).alias("table"), "*") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, found)


class EqualLength(Metric):
    """1 if both tables have as many rows."""

    def score(self) -> float:
        return float(self.tables_[0].count() == self.tables_[1].count())


class Evaluator:
    """Several metrics over one pair of tables; by default marginal and association comparison, new each time."""

    def __init__(self, metrics: dict[str, Metric] | None = None) -> None:
        self.metrics = {"average_js_distance": MarginalComparison(), "pairwise_correlation_distance": AssociationComparison()} if metrics is None else metrics
        if bad := [k for k, m in self.metrics.items() if not isinstance(m, Metric)]:
            raise TypeError(f"{bad} are no metrics")

    def fit(self, original: DataFrame, artificial: DataFrame) -> Evaluator:
        for m in self.metrics.values():
            m.fit(original, artificial)
        return self

    def score(self) -> dict[str, float]:
        return {k: m.score() for k, m in self.metrics.items()}


def profile(df: DataFrame, cardinality: int = 50, rare: float = 0.05) -> DataFrame:
    """finding, column, value: columns of more distinct values than cardinality, and rare values of the others."""
    high = cardinality_table(df).where(F.col("n_distinct") > cardinality).select(F.lit("high_cardinality").alias("finding"), "column", F.col("n_distinct").cast("string").alias("value"))
    return high.unionAll(rare_categories(df, df.columns, rare).select(F.lit("rare").alias("finding"), "column", "value"))




class OriginalEvaluator:
    """What to know of a table before it is learnt: profile() as stats, and its marginals as numbers of a figure."""

    def __init__(self, cardinality: int = 50, rare: float = 0.05) -> None:
        self.cardinality, self.rare = cardinality, rare

    def fit(self, df: DataFrame) -> OriginalEvaluator:
        self.table_ = df
        return self

    def stats(self) -> DataFrame:
        return profile(self.table_, self.cardinality, self.rare)

    def plot_data(self) -> DataFrame:
        """column, value, count, p of the columns of no more distinct values than cardinality."""
        sizes = cardinalities(self.table_, with_null=False)
        return marginals(self.table_, [c for c in self.table_.columns if sizes[c] <= self.cardinality])
