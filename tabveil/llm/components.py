"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ._shared import room, scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    low = F.least(F.min("v").over(Window.partitionBy("u")), "u")
    return both.withColumn("m", low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    return low.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def _settled(edges: DataFrame) -> bool:
    """Whether each node points at one other at most, and no node that points is pointed at: further rounds change nothing."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to")))
    moving = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count_if(F.col("to").isNull()).alias("into")).where("low <> high or low is not null and into > 0")
    return moving.agg(F.count("*")).first()[0] == 0


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u > v")


def flatter(links: DataFrame) -> DataFrame:
    """(a, b), a > b: one round on links(a, b), with the same components; for uses that need no more than nodes known to be linked."""
    return _small_star(_large_star(_edges(links))).toDF("a", "b")


def connected_components(links: DataFrame, max_rounds: int = 100, folder: str | None = None) -> DataFrame:
    """(node, component) for each node of links(a, b); component is the smallest node that is reachable.

    Edges are rewritten until each node points at its component's smallest one (Kiveris and others,
    2014), in rounds that grow with the logarithm of the nodes and take two shuffles of the edges, whose number never
    grows; more than max_rounds is an error. All state is a table in the shared folder; the driver sees one number a round.
    Self-links and null ends are ignored; repeated links count once; an empty table gives an empty table. Give the folder of
    a room() if the result is needed only until that room ends: the settled edges stay there, and the result is read from them.
    """
    if folder is None:
        with room(links.sparkSession) as own:
            return scratch(connected_components(links, max_rounds, own), "components")
    edges = _edges(links).distinct()
    for _ in range(max_rounds):
        edges = scratch(_small_star(_large_star(edges)), "edges", folder)
        if _settled(edges):
            break
    else:
        raise RuntimeError(f"the components were not settled after {max_rounds} rounds")
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("component"))
    return ends.groupBy("node").agg(F.min("component").alias("component"))
