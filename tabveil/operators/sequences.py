"""Records of one entity in order: side by side in one row and back, with a check of their order, and dates as steps."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F

from .transformers import Reversible, generalize_dates, restore_dates


def flatten_records(df: DataFrame, key: str, order: str, values: list[str], longest: int) -> DataFrame:
    """One row a key with value1 .. valueN of its records in order; records beyond longest raise at run time."""
    if longest < 1:
        raise ValueError("longest must be positive")
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    ranked = df.withColumn("__at", F.when(at <= longest, at).otherwise(F.raise_error(F.lit("more records than columns"))))
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("__at") == k, F.col(v))).alias(f"{v}{k}") for k in range(1, longest + 1) for v in values])


def unflatten_records(df: DataFrame, keys: list[str], values: list[str], longest: int, order: str = "place", types: dict[str, str] | None = None) -> DataFrame:
    """The way back: keys, order (from 1 on) and values, one row a record, each value in its type or that of types.

    A record of which nothing is known is none. A gap before a later record closes: places count the records that are
    there, so what flatten_records() made comes back as it was but for the values of order.
    """
    if longest < 1:
        raise ValueError("longest must be positive")
    if missing := [f"{v}{k}" for k in range(1, longest + 1) for v in values if f"{v}{k}" not in df.columns]:
        raise ValueError(f"the table lacks {missing}")
    types = types or {}
    part = lambda v, k: F.col(f"`{v}{k}`").cast(types[v]) if v in types else F.col(f"`{v}{k}`")
    records = F.array(*[F.struct(*[part(v, k).alias(v) for v in values]) for k in range(1, longest + 1)])
    there = F.filter(records, lambda r: reduce(or_, [r[v].isNotNull() for v in values]))
    out = df.select(*[F.col(f"`{k}`") for k in keys], F.posexplode(there).alias("__at", "__r"))
    return out.select(*[F.col(f"`{k}`") for k in keys], (F.col("__at") + 1).alias(order), *[F.col("__r")[v].alias(v) for v in values])


def sequence_gap(steps: list[str]):
    """The place of the first step that is missing before one that is there, as a column; NULL if there is none."""
    there = F.array(*[F.col(f"`{s}`").isNotNull() for s in steps])
    last = F.array_max(F.transform(there, lambda x, i: F.when(x, i + 1).otherwise(0)))
    first = F.array_min(F.transform(there, lambda x, i: F.when(~x, i + 1)))
    return F.when(first < last, first)


def consistent_sequences(df: DataFrame, steps: list[str], errors: bool = False) -> DataFrame:
    """The rows whose steps, in order, have none after a missing one; or with errors the others, with gap, the first place."""
    if len(steps) < 2:
        raise ValueError("a sequence needs two steps at least")
    gap = sequence_gap(steps)
    return df.withColumn("gap", gap).where("gap is not null") if errors else df.where(gap.isNull())


@dataclass
class DateSequence(Reversible):
    """Dates of one row in order: the first by its month, each later one as days since the one before; and dates back.

    sequence names the columns in order, all of the table without it. NULLs propagate to the dates behind them.
    """

    sequence: list[str] | None = None
    date_format: str | None = None

    def fit(self, df: DataFrame, columns: list[str] | None = None) -> DateSequence:
        self.sequence_ = [*(columns or self.sequence or df.columns)]
        self._learn(df, self.sequence_)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted(df)
        return generalize_dates(df, self.sequence_, self.date_format)

    def inverse_transform(self, df: DataFrame, key: str, seed: str = "0") -> DataFrame:
        """A day of the first month at random, then the days added up; texts get the given format back."""
        self._check_fitted(df)
        out = restore_dates(df, self.sequence_, key, seed)
        texts = [c for c, t in self.types_.items() if t.typeName() == "string" and self.date_format]
        return self._restore(out.withColumns({c: F.date_format(c, self.date_format) for c in texts}))
