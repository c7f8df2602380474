"""Draws from distributions by alias tables: one keyed lookup a row, whatever the number of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import uniform
from .distributions import same

#: Values that one alias table holds, about; distributions of more values are dealt to several, among which is drawn first.
SLOTS = 1024


def _named(by: list[str]) -> list[str]:
    return [f"__by{i}" for i in range(len(by))]


def _aliases(cells: DataFrame, group: list[str]) -> DataFrame:
    """group, slots, mass from cells(group, v, p): an alias table for each group, its slots in the order of v.

    Each value has a slot of the same size; what a light value (of less than a slot) leaves free, a heavy one fills. Lights
    take their places along the running sum of the free parts and heavies along that of the excess, so a light meets the
    first heavy that ends behind its place; a heavy that is overdrawn is filled by the next. So the table follows
    from running sums within the group.
    """
    own, turn = Window.partitionBy(*group), Window.partitionBy(*group).orderBy("v")
    so_far = turn.rowsBetween(Window.unboundedPreceding, 0)
    s = cells.withColumn("mass", F.sum("p").over(own)).withColumn("s", F.col("p") * F.count("*").over(own) / F.col("mass")).withColumn("slot", F.row_number().over(turn) - 1)
    s = s.withColumn("free", F.greatest(1 - F.col("s"), F.lit(0.0))).withColumn("light", F.col("s") < 1)
    s = s.withColumn("taken", F.sum("free").over(so_far)).withColumn("excess", F.sum(F.greatest(F.col("s") - 1, F.lit(0.0))).over(so_far))
    s = s.withColumn("place", F.when(F.col("light"), F.col("taken") - F.col("free")).otherwise(F.col("excess")))
    along = Window.partitionBy(*group).orderBy("place", "light", "slot")
    other = F.first(F.when(~F.col("light"), F.struct("v")), ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    drawn = F.last(F.when(F.col("light"), F.col("taken")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("other", other).withColumn("drawn", F.coalesce(drawn, F.lit(0.0)))
    left = F.when(F.col("light"), F.col("s")).otherwise(1 - F.greatest(F.lit(0.0), F.col("drawn") - F.col("excess")))
    s = s.select(*group, "mass", F.struct("slot", F.when(F.col("other").isNull(), 1.0).otherwise(left).alias("left"), "v", F.coalesce("other.v", "v").alias("other")).alias("x"))
    return s.groupBy(*group).agg(F.array_sort(F.collect_list("x")).alias("slots"), F.first("mass").alias("mass"))


def _pick(slots: str, u: Column) -> Column:
    """The value of a slot that u falls into, or its alias; slots that are null give null."""
    x = u * F.size(slots)
    slot = F.get(slots, F.least(F.floor(x), F.size(slots) - 1).cast("int"))
    return F.when(x - F.floor(x) < slot["left"], slot["v"]).otherwise(slot["other"])


def draw(rows: DataFrame, dist: DataFrame, values: list[str], seed: str, row_key: str, by: list[str] | None = None, n_cells: int | None = None) -> DataFrame:
    """rows with values drawn from dist(by, values, p) given the columns by, by uniform numbers keyed by row_key.

    A row whose by columns have no distribution is an error, whether or not the drawn columns are read. Each combination
    of by has an alias table, one row that is joined on it; one of more than SLOTS values has several, dealt by a
    hash of the value, so that none grows with the number of values, and a table over these. n_cells is the number of
    rows of dist, if it is known.
    """
    by = by or []
    keys = _named(by)
    cells = dist.where("p > 0").select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.struct(*[F.col(f"`{c}`") for c in values]).alias("v"), F.col("p").cast("double").alias("p"))
    sizes = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    drawn = rows.withColumn("__u", uniform(f"{seed}|{','.join(values)}", row_key))
    sized = cells.crossJoin(F.broadcast(sizes)) if not by else cells.alias("c").join(sizes.alias("z"), same([F.col(f"c.{k}") for k in keys], [F.col(f"z.{k}") for k in keys])).select("c.*", "z.n")
    parts = _aliases(sized.withColumn("__block", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / SLOTS))), [*keys, "__block"])
    if n_cells is not None and n_cells <= SLOTS or sizes.where(F.col("n") > SLOTS).isEmpty():
        found = _joined(drawn, parts, by, keys, values)
    else:
        over = _aliases(parts.select(*keys, F.struct("__block").alias("v"), F.col("mass").alias("p")), keys)
        found = _joined(drawn, over, by, keys, values).withColumn("__at", _pick("__slots", F.col("__u"))["__block"]).drop("__slots")
        found = found.withColumn("__u", uniform(f"{seed}|within|{','.join(values)}", row_key))
        found = _joined(found, parts, [*by, "__at"], [*keys, "__block"], values)
    value = _pick("__slots", F.col("__u"))
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[value[c].alias(c) for c in values])


def _joined(rows: DataFrame, table: DataFrame, by: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """rows with the __slots of their by columns."""
    table = table.select(*[F.col(k).alias(f"__own_{k}") for k in keys], F.col("slots").alias("__slots"))
    if not by:
        return rows.crossJoin(F.broadcast(table))  # one row of SLOTS values
    out = rows.join(table, same([F.col(f"`{c}`") for c in by], [F.col(f"__own_{k}") for k in keys]), "left")
    missing = F.raise_error(F.lit(f"no distribution of {values} for these values of {by}")).cast("boolean")
    # as it reads a column of rows, this is neither pruned nor taken for a reason to drop rows in the join
    return out.where(F.when(F.col("__slots").isNull() & F.col("__u").isNotNull(), missing).otherwise(F.lit(True))).drop(*[f"__own_{k}" for k in keys])
