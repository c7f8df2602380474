"""Reversible and de-identifying transformations."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import normal_cdf, normal_quantile, uniform
from ..sources import tables
from .distributions import NotFittedError, clean, shares
from .ordering import quantiles
from .privacy import Ledger, dp_joint, fresh

#: Edges nearer than this are one.
NEAR = 1e-8


def check_bins(n_bins: int, strategy: str) -> None:
    if isinstance(n_bins, bool) or not isinstance(n_bins, int):
        raise TypeError("n_bins must be a whole number")
    if n_bins < 1:
        raise ValueError("n_bins must be positive")
    if strategy not in ("uniform", "quantile"):
        raise ValueError("the strategy is uniform or quantile")


def check_share(name: str, share: float) -> None:
    if isinstance(share, bool) or not 0 <= share <= 1:
        raise ValueError(f"{name} must be from 0 to 1")


def edges_of(df: DataFrame, column: str, n_bins: int, low: float | None = None, high: float | None = None, strategy: str = "uniform") -> list[float]:
    """Bin edges: equal widths, or exact interpolated percentiles of the values and both bounds, by order statistics."""
    check_bins(n_bins, strategy)
    if low is not None and high is not None and low > high:
        raise ValueError("the lower bound is above the upper one")
    x = clean(df.select(F.col(column).cast("double").alias("x"))).where("x is not null")
    if low is None or high is None:
        found = x.agg(F.min("x"), F.max("x")).first()
        low, high = (found[0] if low is None else low), (found[1] if high is None else high)
    if low is None:
        return []
    if strategy == "uniform":
        edges = [low + (high - low) * k / n_bins for k in range(n_bins)] + [float(high)]
    else:
        ends = df.sparkSession.range(2).select(F.when(F.col("id") == 0, float(low)).otherwise(float(high)).alias("x"))
        edges = quantiles(x.unionAll(ends), "x", [k / n_bins for k in range(n_bins + 1)])
    return merged(edges, column)


def merged(edges: list[float], column: str) -> list[float]:
    """The edges without those that lie NEAR the one before."""
    kept = [edges[0]]
    for e in edges[1:]:
        if e - kept[-1] > NEAR:
            kept.append(e)
    if len(kept) < len(edges):
        warnings.warn(f"bins of {column} that are too small were merged", stacklevel=3)
    return kept


def code_of(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bin of x, clipped to the end bins; NULL stays."""
    if len(edges) < 2:
        return F.when(x.isNotNull(), 0)
    inner = F.array(*[F.lit(float(e)) for e in edges[1:]])
    return F.when(x.isNotNull(), F.least(F.size(F.filter(inner, lambda e: e <= x)), F.lit(len(edges) - 2)))


def bin_numeric(df: DataFrame, column: str, n_bins: int, low: float | None = None, high: float | None = None, strategy: str = "uniform") -> DataFrame:
    """column becomes a struct (left, right), rounded to two digits; NULL and NaN are NULL."""
    edges = edges_of(df, column, n_bins, low, high, strategy)
    df = clean(df)
    code = code_of(F.col(column).cast("double"), edges)
    if len(edges) < 2:
        edges = edges * 2 or [0.0, 0.0]
    spans = F.array(*[F.struct(F.lit(round(a, 2)).alias("left"), F.lit(round(b, 2)).alias("right")) for a, b in zip(edges, edges[1:], strict=False)])
    return df.withColumn(column, F.get(spans, code))


def sample_from_bins(df: DataFrame, column: str, key: str, numeric: str = "int", mean: float | None = None, std: float | None = None, seed: str = "0") -> DataFrame:
    """The inverse of bin_numeric: a number within each bin, uniform or truncated normal; int draws from the truncated bounds."""
    if numeric not in ("int", "float"):
        raise ValueError("the numeric type is int or float")
    left, right, u = F.col(f"{column}.left"), F.col(f"{column}.right"), uniform(seed, key)
    if mean is not None and std is not None:
        if std <= 0:
            raise ValueError("the deviation must be positive")
        low, high = (normal_cdf((x - float(mean)) / float(std)) for x in (left, right))
        df = df.withColumn("__p", F.least(F.greatest(low + u * (high - low), F.lit(1e-12)), F.lit(1 - 1e-12)))
        value = F.least(F.greatest(normal_quantile(F.col("__p")) * float(std) + float(mean), left), right)
        value = F.round(value).cast("int") if numeric == "int" else value
    elif numeric == "int":
        a, b = left.cast("int"), right.cast("int")
        value = (a + F.floor(u * F.greatest(b - a, F.lit(1)))).cast("int")
    else:
        value = left + u * (right - left)
    return df.withColumn(column, F.when(F.col(column).isNotNull(), value)).drop("__p")


def replace_rare(df: DataFrame, column: str, min_support: float | int = 0.01, new_name: str = "other") -> DataFrame:
    """Values of less support (a share if float, else a count) become new_name, or with 'mode' the commonest value. NULL is a value."""
    if isinstance(min_support, bool) or min_support < 0 or isinstance(min_support, float) and min_support > 1:
        raise ValueError("the support is a share from 0 to 1 or a count")
    df = clean(df)
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    # the commonest value, the smaller of two, NULL last
    first = F.min(F.struct(-F.col("__n"), F.col(column).isNull(), F.col(column).alias("v")))["v"].cast("string")
    one = counts.agg(F.sum("__n").alias("__total"), (first if new_name == "mode" else F.first(F.lit(new_name))).alias("__to"))
    counts = counts.crossJoin(F.broadcast(one))  # one row
    rare = F.col("__n") / F.col("__total") < min_support if isinstance(min_support, float) else F.col("__n") < min_support
    counts = counts.select(F.col(column).alias("__v"), rare.alias("__rare"), "__to")
    out = df.join(counts, F.col(column).eqNullSafe(F.col("__v")))
    return out.withColumn(column, F.when(F.col("__rare"), F.col("__to")).otherwise(F.col(column).cast("string"))).select(*df.columns)


class Reversible:
    """What fit(df, ...), transform(df) and inverse_transform(df, key, seed) of a transformer have in common.

    fit keeps the columns' types, and inverse_transform gives them back; both others need fit before.
    """

    def _learn(self, df: DataFrame, columns: list[str]) -> DataFrame:
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"the table lacks {missing}")
        self.types_ = {c: df.schema[c].dataType for c in columns}
        return clean(df)

    def _check_fitted(self, df: DataFrame) -> None:
        if not hasattr(self, "types_"):
            raise NotFittedError(f"{type(self).__name__} has not been fitted")
        if missing := [c for c in self.types_ if c not in df.columns]:
            raise ValueError(f"the table lacks {missing}")

    def _restore(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c).cast(t) for c, t in self.types_.items()})


def group_rare(df: DataFrame, columns: list[str], threshold: float = 0.05, label: str = "other") -> DataFrame:
    """Values below a share of the non-null rows become label in each of columns; NULL stays. One small join a column."""
    return RareCategories(threshold, label).fit(df, columns).transform(df)


@dataclass
class RareCategories(Reversible):
    """The learned form of group_rare: fit finds the frequent values, transform replaces all others; nothing restores them."""

    threshold: float = 0.05
    label: str = "Other"
    kept_: dict[str, DataFrame] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: list[str]) -> RareCategories:
        check_share("threshold", self.threshold)
        df = self._learn(df, columns)
        self.kept_ = {}
        for c in columns:
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("__v")).agg(F.count("*").alias("n"))
            self.kept_[c] = tables.keep(shares(counts, "n").where(F.col("p") >= self.threshold).select("__v", F.lit(True).alias("__kept")))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted(df)
        names, out = df.columns, clean(df)
        for c, kept in self.kept_.items():
            out = out.join(kept, F.col(c).cast("string") == F.col("__v"), "left")
            out = out.withColumn(c, F.when(F.col(c).isNull() | F.col("__kept"), F.col(c).cast("string")).otherwise(self.label)).select(*names)
        return out

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df


@dataclass
class ContinuousBins(Reversible):
    """Ordinal bin codes of numeric columns, and numbers back from them."""

    n_bins: int = 10
    strategy: str = "uniform"
    labelled_missing: dict[str, list[float]] = field(default_factory=dict)
    edges_: dict[str, list[float]] = field(default_factory=dict)
    whole_: dict[str, bool] = field(default_factory=dict)

    def fit(self, df: DataFrame, columns: list[str]) -> ContinuousBins:
        df = self._learn(df, columns)
        check_bins(self.n_bins, self.strategy)
        self.edges_, self.whole_ = {}, {}
        for c in columns:
            own = df.where(~F.col(c).isin(self.labelled_missing[c])) if self.labelled_missing.get(c) else df
            self.edges_[c] = edges_of(own, c, self.n_bins, strategy=self.strategy)
            self.whole_[c] = bool(own.agg(F.bool_and(F.col(c) % 1 == 0)).first()[0])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Values at an edge go to the upper bin, by a nudge of 1e-8 + 1e-5 of the value; labelled codes stay."""
        self._check_fitted(df)
        df = clean(df)
        for c, edges in self.edges_.items():
            x = F.col(c).cast("double")
            code = code_of(x + 1e-8 + 1e-5 * F.abs(x), edges).cast("double")
            marked = self.labelled_missing.get(c)
            df = df.withColumn(c, F.when(x.isin(marked), x).otherwise(code) if marked else code)
        return df

    def inverse_transform(self, df: DataFrame, key: str, seed: str = "0") -> DataFrame:
        self._check_fitted(df)
        for c, edges in self.edges_.items():
            u, code = uniform(seed, F.lit(c), key), F.col(c).cast("int")
            if len(edges) < 2:
                value = F.lit(float(edges[0]) if edges else None)
            else:
                low, high = (F.get(F.array(*[F.lit(float(e)) for e in part]), code) for part in (edges[:-1], edges[1:]))
                value = low + u * (high - low)
                value = F.round(value) if self.whole_[c] else value
            marked = self.labelled_missing.get(c)
            known = F.col(c).isNotNull() & (~F.col(c).isin(marked) if marked else F.lit(True))
            df = df.withColumn(c, F.when(known, value).otherwise(F.col(c)))
        return self._restore(df)


@dataclass
class CategoryBins(Reversible):
    """Categories in sorted order, dealt to n_bins of equal width or, with strategy 'quantile', of about as many rows each;
    back by the learned shares within a bin.

    The shares are marginals with Laplace noise, epsilon / d for each of d columns; an infinite epsilon keeps them exact.
    seed keys the noise; one drawn from secrets is the default. Which categories there are is read without noise, as
    are the edges of quantiles. NULL has no code and stays NULL, unless missing makes it the last category.
    """

    n_bins: int = 5
    epsilon: float = 1.0
    seed: str | None = None
    codes_: dict[str, DataFrame] = field(default_factory=dict)
    strategy: str = "uniform"
    missing: bool = False

    def fit(self, df: DataFrame, columns: list[str]) -> CategoryBins:
        check_bins(self.n_bins, self.strategy)
        df, seed = self._learn(df, columns), fresh(self.seed)
        ledger = Ledger(self.epsilon)
        self.codes_ = {}
        for c in columns:
            share = ledger.spend(f"categories {c}", self.epsilon / len(columns))
            counts = dp_joint(df.select(F.col(c).cast("string").alias(c)), c, share, seed).select(F.col(c).alias("__v"), "p")
            counts = tables.keep(counts if self.missing else counts.where("__v is not null"))
            rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("__v"))) - 1  # one row a category
            ranked = counts.withColumn("__rank", rank)
            if self.strategy == "quantile":
                own = df.select(F.col(c).cast("string").alias("__own")).join(ranked, F.col("__own").eqNullSafe(F.col("__v")))
                edges = quantiles(own, "__rank", [k / self.n_bins for k in range(self.n_bins + 1)])
                x = F.col("__rank").cast("double")
                code = code_of(x + 1e-8 + 1e-5 * x, merged(edges, c) if edges else [])
            else:
                width = max((counts.count() - 1) / self.n_bins, 1e-9)
                code = F.least(F.floor(F.col("__rank") * (1 + 1e-5) / width + 1e-8), F.lit(self.n_bins - 1))
            self.codes_[c] = tables.keep(ranked.withColumn("__code", code.cast("int")).select("__v", "__code", "p"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted(df)
        names, df = df.columns, clean(df)
        for c, codes in self.codes_.items():
            df = df.join(codes.select("__v", "__code"), F.col(c).cast("string").eqNullSafe(F.col("__v")), "left").withColumn(c, F.col("__code")).select(*names)
        return df

    def inverse_transform(self, df: DataFrame, key: str, seed: str = "0") -> DataFrame:
        self._check_fitted(df)
        names = df.columns
        for c, codes in self.codes_.items():
            w = Window.partitionBy("__code")
            cdf = shares(codes.withColumnRenamed("p", "q"), "q", ["__code"]).withColumn("hi", F.sum("p").over(w.orderBy(F.asc_nulls_last("__v")).rowsBetween(Window.unboundedPreceding, 0)))
            cdf = cdf.groupBy("__code").agg(F.array_sort(F.collect_list(F.struct("hi", "__v"))).alias("cdf"))  # the categories of one bin
            u = uniform(seed, F.lit(c), key)
            df = df.withColumn("__u", u).join(cdf, F.col(c) == F.col("__code"), "left")
            hit = F.get(F.filter("cdf", lambda x: x.hi > F.col("__u")), F.lit(0))
            df = df.withColumn(c, F.when(hit.isNotNull(), hit["__v"]).otherwise(F.element_at("cdf", -1)["__v"])).select(*names)
        return self._restore(df)


def generalize(df: DataFrame, column: str, mapping: dict[str, str], label: str | None = None) -> DataFrame:
    """Values by a mapping; with a label, all others (NULL included) become it, else they stay."""
    found = F.lit(None).cast("string") if not mapping else F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col(column)]
    return df.withColumn(column, F.coalesce(found, F.lit(label) if label is not None else F.col(column)))


def specialize(df: DataFrame, column: str, mapping: dict[str, str], key: str, seed: str = "0") -> DataFrame:
    """A value drawn alike from those that map to each general one; others stay."""
    back: dict[str, list[str]] = {}
    for k, v in sorted(mapping.items()):
        back.setdefault(v, []).append(k)
    if not back:
        return df
    options = F.create_map(*[x for v, ks in back.items() for x in (F.lit(v), F.array(*map(F.lit, ks)))])[F.col(column)]
    pick = F.get(options, F.floor(uniform(seed, F.lit(column), key) * F.size(options)).cast("int"))
    return df.withColumn(column, F.coalesce(F.when(options.isNotNull(), pick), F.col(column)))


@dataclass
class Scheme(Reversible):
    """generalize and specialize of several columns, each by a mapping of its own; with label, unmapped values become it."""

    mappings: dict[str, dict[str, str]]
    label: str | None = None

    def fit(self, df: DataFrame) -> Scheme:
        self._learn(df, [*self.mappings])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted(df)
        for c, mapping in self.mappings.items():
            df = generalize(df, c, mapping, self.label)
        return df

    def inverse_transform(self, df: DataFrame, key: str, seed: str = "0") -> DataFrame:
        self._check_fitted(df)
        for c, mapping in self.mappings.items():
            df = specialize(df, c, mapping, key, seed)
        return self._restore(df)


def pseudonyms(df: DataFrame, column: str, order: str, prefix: str = "entity_") -> DataFrame:
    """Each distinct value becomes prefix and its place by first appearance in order; NULL stays NULL but takes a place."""
    places = df.groupBy(F.col(column).alias("__v")).agg(F.min(order).alias("__first"))
    places = numbered(places, "__first").withColumnRenamed("__number", "__at")
    out = df.join(places, F.col(column).eqNullSafe(F.col("__v")))
    return out.withColumn(column, F.when(F.col(column).isNotNull(), F.concat(F.lit(prefix), F.col("__at").cast("string")))).select(*df.columns)


def numbered(df: DataFrame, order: str, ranges: int = 256) -> DataFrame:
    """df with __number, from 0 in the order of a numeric column (NULLs first).

    Ranges between approximate percentiles are numbered apart and offset by the sizes of those before, so no task
    sorts the whole table.
    """
    x = F.col(order).cast("double")
    bounds = df.agg(F.percentile_approx(x, [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    ends = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.expr("cast(array() as array<double>)")
    parts = df.withColumn("__part", F.coalesce(F.size(F.filter(ends, lambda e: e < x)), F.lit(-1)))
    parts = parts.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1)
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"))
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return parts.join(F.broadcast(offsets), "__part").withColumn("__number", F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


def add_ids(df: DataFrame, order: str, column: str = "id", prefix: str = "FAKE_PERSON_") -> DataFrame:
    """Ids from 1 in the order of a column."""
    return numbered(df, order).withColumn(column, F.concat(F.lit(prefix), (F.col("__number") + 1).cast("string"))).drop("__number")


def _date(c: str, date_format: str | None) -> Column:
    return F.to_date(c, date_format) if date_format else F.col(c)


def generalize_dates(df: DataFrame, sequence: list[str], date_format: str | None = None) -> DataFrame:
    """The first date becomes its month, each later one the whole days since the one before; NULLs propagate."""
    out = {sequence[0]: F.date_format(_date(sequence[0], date_format), "yyyy-MM")}
    for before, c in zip(sequence, sequence[1:], strict=False):
        seconds = _date(c, date_format).cast("timestamp").cast("long") - _date(before, date_format).cast("timestamp").cast("long")
        out[c] = F.floor(seconds / 86400).cast("int")
    return df.withColumns(out)


def restore_dates(df: DataFrame, sequence: list[str], key: str, seed: str = "0") -> DataFrame:
    """A random day of the month, then the days added up."""
    first = F.to_date(F.concat(F.col(sequence[0]), F.lit("-01")))
    day = F.floor(uniform(seed, key) * F.dayofmonth(F.last_day(first))).cast("int")
    date = F.date_add(first, day)
    out = {sequence[0]: date}
    for c in sequence[1:]:
        date = F.date_add(date, F.col(c).cast("int"))
        out[c] = date
    return df.withColumns(out)
