"""Exact similarity links between sets, found through an inverted join over signature tokens.

Used with two kinds of token: (coordinate, value) of a MinHash signature with a match threshold, and
band keys with a threshold of one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import batches, in_batches, passes, room, scratch, shingle_hashes, shingles_of
from .components import connected_components, flatter


#: Balls that share a token at most before their pairs must also share a rare shingle.
HOT = 8
#: Pivots that a node is measured against in a turn of the spread pass, and turns.
PIVOTS, TURNS = 4, 3
#: Of the shingles before it in its prefix, a posted one carries this many, the last.
PRIOR = 16
#: 64-bit words of a set's map: each of its shingles flips one bit.
MAP = 8


def _measure(rows):
    """Exact sizes of intersection and union of two texts' shingle sets; the b side repeats in runs."""
    last, last_set = None, None
    for batch in batches(rows, 200):
        a, b, dist, linked = [], [], [], []
        cols = batch.to_pydict()
        for na, nb, ta, tb in zip(cols["a"], cols["b"], cols["text_a"], cols["text_b"], strict=True):
            if last is None or last != tb:
                last, last_set = tb, shingles_of(tb)
            sa = shingles_of(ta)
            both = len(sa & last_set)
            union = len(sa) + len(last_set) - both
            a.append(na)
            b.append(nb)
            dist.append(1.0 - both / union if union else 1.0)
            linked.append(union > 0 and 100 * both >= 75 * union)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(dist, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "dist", "linked"])


def measure(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, dist, linked) of each pair, on the full sets of texts(node, text)."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").transform(in_batches, _measure, "a long, b long, dist double, linked boolean")


def _matching(pairs: DataFrame, signatures: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose signatures share at least threshold tokens."""
    left = signatures.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    right = signatures.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= threshold).drop("tokens_a", "tokens_b")


def _shingled(rows):
    for batch in batches(rows, 200):
        nodes, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first, raws in passes(texts):
            hashes, at, _ = shingle_hashes(raws)
            own = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(raws))]
            sizes = [len(x) for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[first : first + len(raws)], sizes), pa.int64()), pa.array(np.concatenate(own).astype(np.int64))], ["node", "shingle"])


def _maps(members: DataFrame, rows: DataFrame) -> DataFrame:
    """(ball, w0, w1, ...): the map of the shingles of each ball that has one member; nulls for others.

    Two sets' maps differ in at most as many bits as the sets in elements, so a pair whose maps differ in more than a
    seventh of both sizes can't have a similarity of 0.75.
    """
    bit = F.expr("shiftleft(1L, cast(shiftright(shingle, 3) & 63 as int))")
    words = [F.bit_xor(F.when(F.col("shingle").bitwiseAND(F.lit(MAP - 1)) == k, bit).otherwise(0)).alias(f"w{k}") for k in range(MAP)]
    maps = members.join(rows.groupBy("node").agg(*words), "node")
    return maps.groupBy("ball").agg(*(F.when(F.count("*") == 1, F.min(f"w{k}")).alias(f"w{k}") for k in range(MAP)))


def _rare_pairs(members: DataFrame, texts: DataFrame, folder: str) -> DataFrame:
    """(a, b): balls of different groups with members(node, ball, group) whose rarest shingles meet.

    Sets of similarity 0.75 or more share a shingle among the rarest floor(n / 4) + 1 of each, in any
    order common to all. So a passage that thousands of texts hold pairs only those that consist of it mostly.

    A posted shingle carries a few of those before it. Two texts with one of these in common have met there, and are
    skipped; at their first common shingle they never are, so each pair is met at least once. A ball posts a
    shingle once, with bounds that hold for each of its members and what they all carry alike.
    """
    rows = texts.join(members.select("node").distinct(), "node", "left_semi").select("node", "text").transform(in_batches, _shingled, "node long, shingle long")
    rows = scratch(rows, "shingles", folder)
    maps = _maps(members, rows)
    df = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    own = Window.partitionBy("node")
    rows = rows.join(df, "shingle").withColumn("n", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("df", "shingle")))
    rows = rows.where((F.col("r") <= F.floor(F.col("n") / 4) + 1) & (F.col("df") > 1)).select("node", "shingle", "n", "r").join(members, "node")
    ends = rows.groupBy("shingle").agg(F.min("group").alias("first"), F.max("group").alias("last")).where("first <> last").select("shingle")
    prior = F.collect_list("shingle").over(own.orderBy("r").rowsBetween(-PRIOR, -1))
    rows = rows.join(ends, "shingle", "left_semi").withColumn("prior", prior)
    least, most = F.min("prior"), F.max("prior")
    rows = rows.groupBy("shingle", "ball").agg(F.min("group").alias("group"), F.min("n").alias("n"), F.max(F.col("n") - F.col("r")).alias("room"), F.when(least == most, least).otherwise(F.array().cast("array<bigint>")).alias("prior"))
    rows = scratch(rows.join(maps, "ball"), "rare", folder)
    # at their first common shingle, what is left of both must hold the whole intersection
    enough = "7 * (1 + least(x.room, y.room)) >= 3 * (x.n + y.n)"
    differ = " + ".join(f"bit_count(x.w{k} ^ y.w{k})" for k in range(MAP))
    both = rows.alias("x").join(rows.alias("y"), F.expr(f"x.shingle = y.shingle and x.ball < y.ball and x.group <> y.group and {enough} and coalesce(7 * ({differ}) <= x.n + y.n, true) and not arrays_overlap(x.prior, y.prior)"))
    return both.select(F.col("x.ball").alias("a"), F.col("y.ball").alias("b"))


def _balls(known: DataFrame) -> DataFrame:
    """(node, ball, dist) of links (a, b, dist): the neighbour of the most links, for nodes that have fewer or as many and a smaller number."""
    both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    rows = both.join(degree, "a").join(degree.toDF("b", "m"), "b").where("m > n or m = n and b > a")
    return rows.groupBy(F.col("a").alias("node")).agg(F.max(F.struct("m", "b", "dist")).alias("top")).select("node", F.col("top.b").alias("ball"), F.col("top.dist").alias("dist"))


def _star_of(found: DataFrame) -> DataFrame:
    """(a, b): found(node, group) as links, fewer and flatter than those it was found from."""
    return found.where(F.col("node") != F.col("group")).select(F.col("node").alias("a"), F.col("group").alias("b"))


def linked_components(signatures: DataFrame, texts: Callable[[DataFrame], DataFrame], threshold: int, given: DataFrame | None = None) -> DataFrame:
    """(node, component) of all nodes that have a link of 0.75 Jaccard similarity or more.

    signatures(node, tokens array<long>) must hold one row for each distinct set; texts gives (node, text) for a table of
    nodes. A node takes part only if threshold of its tokens occur elsewhere at all, so unique texts leave after one
    shuffle of their tokens. given(a, b) are links besides those that are found.

    1. Star pass: each node is measured against one pivot, the smallest node that shares its most frequent
       token. A group of n near copies costs n pairs, not n * n.
    2. Spread pass, in TURNS turns: each node is measured against the pivots of PIVOTS of its tokens (the most
       crowded, in later turns any) whose pivots aren't known to be in its component by then; the links so far go through
       one round of contraction a turn, and are contracted to the end after the last turn. Each token and turn chooses its
       pivot by a hash of its own, so large parts of one group are merged by some pair of them, and most copies
       that are too far from the first pivot join their group, at a number of pairs in proportion to the nodes. Of
       the nodes that it was found linked to, each then joins the ball of the one with the most links, unless it has
       more itself.
    3. Inverted join over balls: a ball posts the tokens of all its members once. Tokens that one component
       alone holds drop out, so those of groups of copies do. The others are ordered from the rarest on; of s
       tokens only the first s - threshold + 1 are posted, as any two balls that share threshold tokens share
       one of these. Only balls of different components are paired. Where more than HOT balls share a token,
       as with a common passage, they are paired by their rarest shingles instead, which loses no link.
    4. Pairs of balls in which members may still be linked by the triangle inequality (Jaccard distance
       is a metric; all distances used are exact) are opened up and their members paired by their rarest
       shingles, unless they are in one component by then. Of these only the pairs are measured whose own distances
       to their centres leave a link possible.
    """
    with room(signatures.sparkSession) as folder:
        return _linked(signatures, texts, threshold, given, folder)


def _linked(signatures: DataFrame, texts_of: Callable[[DataFrame], DataFrame], threshold: int, given: DataFrame | None, folder: str) -> DataFrame:
    postings = signatures.select("node", F.explode("tokens").alias("token"))
    counts = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    shared = scratch(postings.join(counts, "token"), "shared", folder)
    enough = shared.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") >= threshold)
    signatures = scratch(signatures.join(enough, "node", "left_semi"), "signatures", folder)
    taking = signatures.select("node")
    shared = shared.join(taking, "node", "left_semi")
    texts = scratch(texts_of(taking), "texts", folder)

    hottest = shared.groupBy("node").agg(F.max(F.struct("c", "token")).alias("top")).select("node", F.col("top.token").alias("token"))
    pivots = hottest.groupBy("token").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    star = hottest.join(pivots, "token").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    star = scratch(measure(_matching(star, signatures, threshold), texts).where("linked"), "star", folder)
    known = star.select("a", "b", "dist")
    shared = scratch(shared.select("node", "token"), "held", folder)
    links = star.select("a", "b")
    links = links.unionByName(scratch(given, "given", folder)) if given is not None else links
    for turn in range(TURNS):
        links = scratch(flatter(links), "flatter", folder)
        found = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("group"))
        crowd = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("token", F.lit(turn)) if turn else F.desc("n"), "token"))
        now = shared.join(found, "node", "left").select("node", "token", F.coalesce("group", "node").alias("group"))
        low = F.min(F.struct(F.xxhash64("node", "token", F.lit(turn)), "node", "group"))
        ends = now.groupBy("token").agg(low.alias("p"), F.min("group").alias("first"), F.max("group").alias("last"), F.count("*").alias("n")).where((F.col("first") != F.col("last")) & (F.col("n") > HOT))
        ends = ends.select("token", F.col("p.node").alias("pivot"), F.col("p.group").alias("other"), "n")
        spread = now.join(ends, "token").where("group <> other").withColumn("k", crowd).where(F.col("k") <= PIVOTS)
        spread = spread.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
        spread = scratch(measure(_matching(spread, signatures, threshold), texts).where("linked"), "spread", folder)
        if spread.isEmpty():
            break
        known = known.unionByName(spread.select("a", "b", "dist"))
        links = links.unionByName(spread.select("a", "b"))
    found = connected_components(links, folder=folder).withColumnRenamed("component", "group")
    links = _star_of(found)
    balls = scratch(_balls(known), "balls", folder)
    held = scratch(shared.join(balls.select("node", "ball"), "node", "left").select("node", "token", F.coalesce("ball", "node").alias("ball")), "held", folder)

    posted = held.join(found, "node", "left").select("token", "ball", F.coalesce("group", "node").alias("group")).distinct()
    df = posted.groupBy("token").agg(F.count("*").alias("df"), F.min("group").alias("first"), F.max("group").alias("last")).where("first <> last").select("token", "df")
    posted = posted.join(df, "token")
    own = Window.partitionBy("ball")
    posted = posted.withColumn("s", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("df", "token")))
    posted = scratch(posted.where(F.col("r") <= F.col("s") - threshold + 1).select("token", "ball", "group", "df"), "posted", folder)
    crowded = posted.where(F.col("df") > HOT).select("ball", "group").distinct()
    rare = _rare_pairs(held.select("node", "ball").distinct().join(crowded, "ball"), texts, folder)
    posted = posted.where(F.col("df") <= HOT)
    pairs = posted.alias("x").join(posted.alias("y"), F.expr("x.token = y.token and x.ball < y.ball and x.group <> y.group")).select(F.col("x.ball").alias("a"), F.col("y.ball").alias("b"))
    pairs = scratch(pairs.unionByName(rare).distinct(), "pairs", folder)

    radius = balls.groupBy("ball").agg(F.max("dist").alias("radius"))
    ra, rb = radius.select(F.col("ball").alias("a"), F.col("radius").alias("ra")), radius.select(F.col("ball").alias("b"), F.col("radius").alias("rb"))
    sized = pairs.join(ra, "a", "left").join(rb, "b", "left")
    wide = sized.where("ra is not null or rb is not null").select("a", "b")
    lone = _matching(sized.where("ra is null and rb is null").select("a", "b"), signatures, threshold)
    centres = scratch(measure(lone.unionByName(wide), texts), "centres", folder)
    links = links.unionByName(centres.where("linked").select("a", "b"))

    open_ = centres.where("not linked").join(ra, "a", "left").join(rb, "b", "left").where("(ra is not null or rb is not null) and dist <= 0.25 + coalesce(ra, 0) + coalesce(rb, 0) + 1e-9")
    open_ = scratch(open_.select("a", "b", "dist"), "open", folder)
    if not open_.isEmpty():
        found = connected_components(links, folder=folder)
        ca, cb = found.select(F.col("node").alias("a"), F.col("component").alias("ca")), found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        open_ = open_.join(ca, "a", "left").join(cb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b", "dist")
        ends = open_.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
        member = balls.select("node", "ball").join(ends, "ball").select("node").unionByName(ends.select(F.col("ball").alias("node"))).distinct()
        member = member.join(found, "node", "left").select("node", F.col("node").alias("ball"), F.coalesce("component", "node").alias("group"))
        member = scratch(member, "members", folder)
        # by the triangle inequality, what a pair's distances to its centres leave
        off = scratch(member.select("node").join(balls, "node", "left").select("node", F.coalesce("ball", "node").alias("ball"), F.coalesce("dist", F.lit(0.0)).alias("off")), "off", folder)
        oa, ob = off.toDF("a", "ball_a", "off_a"), off.toDF("b", "ball_b", "off_b")
        centre = open_.toDF("low", "high", "dist")
        near = _rare_pairs(member, texts, folder).distinct().join(oa, "a").join(ob, "b")
        near = near.join(centre, F.expr("low = least(ball_a, ball_b) and high = greatest(ball_a, ball_b) and dist <= 0.25 + off_a + off_b + 1e-9"), "left_semi")
        inner = scratch(measure(near.select("a", "b"), texts).where("linked").select("a", "b"), "inner", folder)
        if inner.isEmpty():
            return scratch(found, "components")
        links = _star_of(found.withColumnRenamed("component", "group")).unionByName(inner)
    return connected_components(links)
