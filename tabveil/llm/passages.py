"""Substring dedup: paragraphs that recur nearly word for word, by MinHash banding, and runs of words that recur anywhere."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ._shared import _LOWER, _SPACE_LUT, PASS_BYTES, SHINGLE, batches, in_batches, minhash_parameters, mix64, passes, room, scratch, shingle_hashes
from .linking import linked_components

#: Bands and rows of a band: two paragraphs of similarity 0.75 meet in no band with probability (1 - 0.75 ** 2) ** 12,
#: under 5e-5.
BANDS, ROWS = 12, 2
#: Words of a paragraph at least: shorter ones (headings, set phrases) are no passages.
LEAST_WORDS = 20
#: Shingle hashes that one numpy pass takes, about.
PASS = 1 << 16


def _lines(text: str | None):
    """(number, start, end, line) of the paragraphs of a text, in code points; numbers count blank ones."""
    at = 0
    for k, line in enumerate(text.split("\n") if text else ()):
        yield k, at, at + len(line), line
        at += len(line) + 1


def _node(raw: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(raw.translate(_LOWER)), "big", signed=True)


def _bands(hashes: np.ndarray, at: np.ndarray, params) -> np.ndarray:
    """Band keys of sets hashes[at[i]:at[i + 1]], none of them empty."""
    a, b = params
    out = np.empty((len(at) - 1, BANDS), dtype=np.uint64)
    band = np.arange(BANDS, dtype=np.uint64)
    step = 0
    while step < len(at) - 1:
        end = max(step + 1, int(np.searchsorted(at, at[step] + PASS, "right")) - 1)
        own = hashes[at[step] : at[end]]
        low = np.empty((end - step, BANDS * ROWS), dtype=np.uint64)
        for k in range(BANDS * ROWS):
            low[:, k] = np.minimum.reduceat((own * a[k] + b[k]) >> np.uint64(32), at[step:end] - at[step])
        keys = band
        for r in range(ROWS):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS])
        out[step:end] = keys
        step = end
    return out


def _runs(batch: pa.RecordBatch, least: int):
    """(doc, number, start, end) and bytes of the paragraphs of a batch, in runs of about PASS_BYTES."""
    where, raws, size = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for k, start, end, line in _lines(text):
            if end - start >= 2 * least - 1:
                where.append((doc, k, start, end))
                raws.append(line.encode("utf-8", "replace"))
                size += len(raws[-1])
                if size >= PASS_BYTES:
                    yield where, raws
                    where, raws, size = [], [], 0
    if raws:
        yield where, raws


def _signed(least: int):
    def run(rows):
        params = minhash_parameters(BANDS * ROWS, 3)
        for batch in batches(rows, 1000):
            for where, raws in _runs(batch, least):
                hashes, at, counts = shingle_hashes(raws)
                long = np.flatnonzero(counts >= least)
                if not len(long):
                    continue
                sizes = np.diff(at)[long]
                ends = np.cumsum(sizes)
                own = hashes[np.repeat(at[:-1][long] - (ends - sizes), sizes) + np.arange(ends[-1])]
                tokens = _bands(own, np.concatenate([[0], ends]), params).astype(np.int64)
                where = [where[i] for i in long]
                columns = [pa.array(c, pa.int64()) for c in zip(*where, strict=True)]
                columns += [pa.array(counts[long], pa.int64()), pa.array([_node(raws[i]) for i in long], pa.int64())]
                columns += [pa.ListArray.from_arrays(pa.array(np.arange(0, tokens.size + 1, BANDS), pa.int32()), pa.array(tokens.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "paragraph", "start", "end", "n_words", "node", "tokens"])

    return run


def _texts(least: int):
    def run(rows):
        for batch in batches(rows, 1000):
            lines = [line for text in batch.column(0).to_pylist() for *_, line in _lines(text) if len(line) >= 2 * least - 1]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x.encode("utf-8", "replace")) for x in lines], pa.int64()), pa.array(lines, pa.string())], ["node", "text"])

    return run


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The paragraphs of docs(doc_id, text) that occur more than once, exactly or nearly.

    doc_id, paragraph (from 0, blank ones counted), start, end (code points, end exclusive), n_words,
    keeper_doc_id, keeper_paragraph, kept: one row for each occurrence. Paragraphs are what line feeds separate, of
    least_words words or more. Two are linked if the Jaccard similarity of their five-word shingles is
    0.75 or more, measured exactly; a cluster is a component of links, and its keeper the smallest
    (doc_id, paragraph). Null, empty and short texts give no rows. A null doc_id comes first in that order; of rows that
    repeat a doc_id and text, one occurrence is kept. Other columns are ignored.

    Equal paragraphs are one 64-bit class for all that follows, so copies are not compared with one another; two different
    paragraphs fall into one class with a probability of 2**-64.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.transform(in_batches, _signed(least_words), "doc_id long, paragraph long, start long, end long, n_words long, node long, tokens array<long>")
    found = scratch(found.withColumn("row", F.monotonically_increasing_id()), "paragraphs")  # tells occurrences apart that are alike
    signatures = scratch(found.select("node", "tokens").dropDuplicates(["node"]), "classes")
    lines = docs.select("text").transform(in_batches, _texts(least_words), "node long, text string")
    linked = linked_components(signatures, lambda nodes: lines.join(nodes, "node", "left_semi").dropDuplicates(["node"]), 1)
    rows = found.drop("tokens").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    place = F.struct("doc_id", "paragraph", "start", "row")
    clusters = scratch(rows.groupBy("component").agg(F.min(place).alias("keeper"), F.count("*").alias("n")).where("n > 1"), "clusters")
    rows = rows.join(clusters, "component")
    kept = F.col("keeper.row") == F.col("row")
    return rows.select("doc_id", "paragraph", "start", "end", "n_words", F.col("keeper.doc_id").alias("keeper_doc_id"), F.col("keeper.paragraph").alias("keeper_paragraph"), kept.alias("kept"))


#: Words of a piece, and of a run that holds a whole piece wherever it begins.
PIECE, RUN = 20, 51


def _word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, its start and end in code points, and the number of line feeds before it."""
    data = np.frombuffer(raw, dtype=np.uint8)
    edge = np.diff(_SPACE_LUT[data].astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[len(ends) - len(starts) :]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points[starts], points[ends], np.searchsorted(np.flatnonzero(data == 10), starts)


def _joined(shingles: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of so many words, from those of their shingles."""
    n = max(0, len(shingles) - words + SHINGLE)
    out = np.zeros(n, dtype=np.uint64)
    for k in (*range(0, words - SHINGLE, SHINGLE), words - SHINGLE):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + shingles[k : k + n])
    return out


def pieces(shingles: np.ndarray, piece: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, hash) of the pieces of a text: of each run of so many words, the piece of least hash.

    Which piece it is depends on the run's own words only, so equal runs give equal pieces wherever they stand.
    Equal pieces that overlap, as in a text that repeats a phrase, are one longer piece.
    """
    hashes = _joined(shingles, piece)
    width = run - piece + 1
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes[:0]
    low, span = hashes, 1
    while 2 * span <= width:
        low, span = np.minimum(low[: len(low) - span], low[span:]), 2 * span
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    # a piece is the least of some run if it equals the least of one of the runs that hold it
    most, span = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), 1
    while 2 * span <= width:
        most, span = np.maximum(most[: len(most) - span], most[span:]), 2 * span
    if span < width:
        most = np.maximum(most[: len(most) - (width - span)], most[width - span :])
    at = np.flatnonzero(hashes == most)
    own = hashes[at]
    fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (np.diff(at) > piece)])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] + piece - at[first], own[first]


def _posted(piece: int, run: int):
    def post(rows):
        for batch in batches(rows, 500):
            out = []
            for begin, raws in passes(batch.column(2).to_pylist()):
                hashes, at, counts = shingle_hashes(raws)
                for i in np.flatnonzero(counts >= run):
                    first, words, own = pieces(hashes[at[i] : at[i + 1]], piece, run)
                    starts, ends, lines = _word_bounds(raws[i])
                    out.append((np.full(len(own), begin + i), own.astype(np.int64), first, words, starts[first], ends[first + words - 1], lines[first]))
            if out:
                row, own, *rest = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(own), *(pa.array(c.astype(np.int32)) for c in rest)], PIECES.names)

    return post


PIECES = T.StructType([*(T.StructField(c, T.LongType()) for c in ("doc_id", "text_id", "h")), *(T.StructField(c, T.IntegerType()) for c in ("at", "words", "start", "end", "line"))])


def repeated_spans(docs: DataFrame, piece: int = PIECE, run: int = RUN) -> DataFrame:
    """The runs of words of docs(doc_id, text) that occur more than once word for word, wherever they begin.

    Columns as of repeated_passages; paragraph and keeper_paragraph are the lines where the span and its keeper begin.
    A text is one stream of words, so a run may lie inside a line or cross lines. It is cut into pieces at places that its
    own words choose, one at least in each run of so many words: of two equal runs both have it, and it is found.
    Shorter ones are found if they happen to hold a piece. A piece of two places has as keeper the
    smallest (doc_id, first word) where it is one; a row is a maximal series of such pieces with less than run - piece words
    between them whose keepers lie in one text, keepers apart from others. It reaches from the first piece's start to
    the last one's end, so up to run - piece words of a repeated run may be left at either end. Rows that repeat a doc_id
    and text count once. Pieces are compared by 64-bit digests of their words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.where("text is not null").withColumn("text_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    with room(docs.sparkSession) as folder:
        posted = scratch(docs.select("doc_id", "text_id", "text").transform(in_batches, _posted(piece, run), PIECES), "pieces", folder)
        place = F.xxhash64("text_id", "at")
        twice = posted.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.max("words").alias("w")).where((F.col("a") != F.col("b")) | (F.col("w") > piece))
        twice = scratch(twice.select("h"), "twice", folder)
        found = scratch(posted.join(twice, "h"), "recurring", folder)
        keepers = found.groupBy("h").agg(F.min(F.struct("doc_id", "text_id", "at", "line")).alias("keeper"))
        rows = found.join(scratch(keepers, "keepers", folder), "h").withColumn("keeper_id", F.col("keeper.text_id"))
        rows = rows.withColumn("kept", (F.col("text_id") == F.col("keeper_id")) & (F.col("at") == F.col("keeper.at")))
        own = Window.partitionBy("text_id", "keeper_id", "kept").orderBy("at")
        fresh = F.coalesce(F.col("at") - F.lag(F.col("at") + F.col("words")).over(own) > run - piece, F.lit(True))
        rows = rows.withColumn("fresh", fresh.cast("int")).withColumn("series", F.sum("fresh").over(own))
        first, last = F.min(F.struct("at", "start", "line", "keeper")), F.max(F.struct(F.col("at") + F.col("words"), "end"))
        rows = rows.groupBy("text_id", "doc_id", "keeper_id", "kept", "series").agg(first.alias("first"), last.alias("last"))
        return scratch(
            rows.select(
                "doc_id",
                F.col("first.line").cast("long").alias("paragraph"),
                F.col("first.start").cast("long").alias("start"),
                F.col("last.end").cast("long").alias("end"),
                (F.col("last.col1") - F.col("first.at")).cast("long").alias("n_words"),
                F.col("first.keeper.doc_id").alias("keeper_doc_id"),
                F.col("first.keeper.line").cast("long").alias("keeper_paragraph"),
                "kept",
            ),
            "spans",
        )
