"""Exact removal of repeated byte strings: suffixes sampled by a locally chosen cover, named, and compared.

A string of LENGTH bytes at i is keyed by the sampled position p(i) inside it (the cover), so equal strings are
sampled at the same offset and meet under the name of what surrounds p. Sampled suffixes are named first; names that
occur once drop out with all their strings, and runs of strings that recur as a whole are settled by one name. What is
left, at the ends of repeats, is named again in runs of BLOCK strings, and at last string by string.

Strings of a shorter length can be told beside it: a string of LENGTH bytes that recurs lies in a run of shorter ones
that do, so these are found first and only their runs are searched for the longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._shared import POWERS, batches, in_batches, mix64, prefix_hashes, room, scratch

#: Bytes of a string that counts as repeated; bytes of a gram that the cover compares.
LENGTH, GRAM = 400, 16
#: Bytes of a string that counts as a repeated passage of over 50 words: 51 words take as many in 98 of 100 places of sf0.1.
PASSAGE = 256
#: The cover samples among the grams FIRST to FIRST + RANGE - 1 of a string, at LENGTH 400.
FIRST, RANGE = 60, 240
#: Strings of a run when names are taken again; the last level is of single strings.
BLOCKS = (8, 1)


def cover(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, lo, hi): sampled positions, each with the starts lo..hi of the strings that sample it, in order.

    A string samples the leftmost of its middle grams of least hash, which is a matter of its own bytes only.
    """
    first, width = length * FIRST // LENGTH, max(1, length * RANGE // LENGTH)
    starts = len(raw) - length + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 3
    data = np.frombuffer(raw, dtype=np.uint8)
    prefix = prefix_hashes(data)
    n = starts + width - 1  # grams from first on
    at = np.arange(first, first + n)
    _, down = POWERS.get(len(data) + 1)
    gram = min(GRAM, length - first - width + 1)
    low = (mix64((prefix[at + gram] - prefix[at]) * down[at]) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    p = (low[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(p)) + 1
    lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [starts]]) - 1
    return p[lo], lo, hi


def _raw(text: str | bytes | None) -> bytes:
    if isinstance(text, bytes):
        return text
    return text.encode("utf-8", "surrogatepass") if text else b""


def _states(names: np.ndarray, wholes: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Of each run of one text: 0 if it isn't known to recur, 1 if it is (the first of equal ones), 2 if it equals one before.

    So a text that repeats itself, however often, posts each run once.
    """
    _, first, inverse, n = np.unique(mix64(names ^ mix64(wholes)), return_index=True, return_inverse=True, return_counts=True)
    out = np.where(sure | (n[inverse] > 1), 1, 0)
    out[first[inverse] != np.arange(len(names))] = 2
    return out


def _batch(keys: list[bytes], sizes: list[int], columns: list[np.ndarray]) -> pa.RecordBatch:
    own = pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), sizes)))
    return pa.RecordBatch.from_arrays([own, *(pa.array(c.astype(np.int64)) for c in columns)], ["key", "p", "lo", "hi", "state", "name", "whole"])


def _named(length: int):
    """(key, p, lo, hi, state, name, whole) of each sampled position: name of what all its strings hold, and of all that they hold."""

    def run(rows):
        left, right = length * FIRST // LENGTH, length - (length * FIRST // LENGTH + max(1, length * RANGE // LENGTH) - 1)
        digest = xxhash.xxh3_64_intdigest
        for batch in batches(rows, 200):
            keys, parts = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = _raw(text)
                p, lo, hi = cover(raw, length)
                if not len(p):
                    continue
                keys.append(key)
                names = np.array([digest(raw[x - left : x + right]) for x in p.tolist()], dtype=np.uint64)
                wholes = np.array([digest(raw[a : b + length], x - a) for x, a, b in zip(p.tolist(), lo.tolist(), hi.tolist(), strict=True)], dtype=np.uint64)
                parts.append((p, lo, hi, _states(names, wholes, np.zeros(len(p), bool)), names, wholes))
            if keys:
                yield _batch(keys, [len(x[0]) for x in parts], [np.concatenate(c) for c in zip(*parts, strict=True)])

    return run


def _split(length: int, block: int):
    """The runs of each text cut at multiples of block before p, named like the sampled positions."""

    def run(rows):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches(rows, 100):
            for key, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = _raw(text)
                out = []
                for r in runs:
                    p, lo, hi = r["p"], r["lo"], r["hi"]
                    for k in range((p - hi) // block, (p - lo) // block + 1):
                        first, last = p - k * block - block + 1, p - k * block
                        a, b = max(first, lo), min(last, hi)
                        out.append((p, a, b, r["sure"], digest(raw[last : first + length]), digest(raw[a : b + length], p - a)))
                p, lo, hi, sure, names, wholes = (np.array(c, dtype=np.uint64 if k > 3 else None) for k, c in enumerate(zip(*out, strict=True)))
                yield _batch([key], [len(p)], [p, lo, hi, _states(names, wholes, sure), names, wholes])

    return run


RUNS = "key binary, p long, lo long, hi long, state long, name long, whole long"


def _settle(rows: DataFrame, label: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(settled, open) of named runs: those that recur as a whole, and one of each kind under a name of several kinds.

    A run of state 1 recurs already; it is kept as what others may equal. The keys that go on are tables of their own,
    so that a join on a name that a third of all texts hold can be split.
    """
    known = rows.where("state > 0").select("key", "lo", "hi")
    rows = rows.where("state < 2").withColumn("id", F.xxhash64("key", "lo", "p"))
    again = rows.groupBy("name").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("name")
    rows = scratch(rows.join(scratch(again, f"{label}-names", folder), "name", "left_semi"), label, folder)
    one = F.min(F.struct("id", "key", "p", "lo", "hi")).alias("one")
    kinds = rows.groupBy("name", "whole").agg(one, F.max("id").alias("b"), (F.max("state") > 0).alias("sure"))
    kinds = scratch(kinds.select("name", "whole", "one.key", "one.p", "one.lo", "one.hi", (F.col("sure") | (F.col("one.id") != F.col("b"))).alias("sure")), f"{label}-kinds", folder)
    settled = rows.where("state = 0").join(kinds.where("sure").select("name", "whole"), ["name", "whole"], "left_semi").select("key", "lo", "hi")
    mixed = scratch(kinds.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), f"{label}-mixed", folder)
    return known.unionByName(settled).distinct(), kinds.join(mixed, "name", "left_semi").select("key", "p", "lo", "hi", "sure")


def _search(texts: DataFrame, length: int, label: str, folder: str) -> DataFrame:
    """key, gone array<struct<lo, hi>>: the starts lo..hi of strings that start elsewhere, too, for each of texts(key, text).

    Texts of one key are one text here.
    """
    texts = texts.select("key", "text").where(F.octet_length("text") >= length)
    named = scratch(texts.transform(in_batches, _named(length), RUNS), f"{label}-named", folder)
    gone, left = _settle(named, f"{label}-again", folder)
    for block in BLOCKS:
        runs = left.groupBy("key").agg(F.collect_list(F.struct("p", "lo", "hi", "sure")).alias("runs"))  # of one text
        one = texts.join(runs, "key").dropDuplicates(["key"])
        split = one.select("key", "text", "runs").transform(in_batches, _split(length, block), RUNS)
        settled, left = _settle(scratch(split, f"{label}-split-{block}", folder), f"{label}-again-{block}", folder)
        gone = gone.unionByName(settled)
    return gone.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))  # of one text


def _runs(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lo, hi) of the runs of each row, none for null."""
    lo, hi = (column.values.field(k).to_numpy() for k in ("lo", "hi"))
    ends = column.offsets.to_pylist()
    return [(lo[a:b], hi[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _merged(lo: np.ndarray, hi: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs in order, merged where one begins at most gap after the end of those before."""
    order = np.argsort(lo)
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    cut = lo[1:] > hi[:-1] + gap
    return lo[np.concatenate([[True], cut])[: len(lo)]], hi[np.concatenate([cut, [True]])[: len(hi)]]


def _pieces(shorter: int, length: int):
    """What can hold a string of length bytes that recurs: texts of their own, each under a key of its own."""

    def run(rows):
        for batch in batches(rows, 200):
            out = []
            for key, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _runs(batch.column(2)), strict=True):
                raw = _raw(text)
                lo, hi = _merged(*runs, 1)
                hi += shorter
                for a, b in zip(lo[hi - lo >= length].tolist(), hi[hi - lo >= length].tolist(), strict=True):
                    out.append((xxhash.xxh3_128_digest(key + a.to_bytes(8, "little")), key, a, raw[a:b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)], ["key", "whole", "at", "text"])

    return run


def _search_within(texts: DataFrame, found: DataFrame, shorter: int, length: int, folder: str) -> DataFrame:
    """_search by length, where found is the result by shorter."""
    one = texts.select("key", "text").join(found, "key").dropDuplicates(["key"])
    pieces = scratch(one.select("key", "text", "gone").transform(in_batches, _pieces(shorter, length), "key binary, whole binary, at long, text binary"), "pieces", folder)
    back = pieces.select("key", "whole", "at").join(_search(pieces, length, "long", folder), "key")
    moved = back.select(F.col("whole").alias("key"), F.transform("gone", lambda r: F.struct((r.lo + F.col("at")).alias("lo"), (r.hi + F.col("at")).alias("hi"))).alias("gone"))
    return moved.groupBy("key").agg(F.flatten(F.collect_list("gone")).alias("gone"))  # of one text


def _covered(runs: tuple[np.ndarray, np.ndarray], copied: bool | None, size: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal spans of a text of size bytes that strings of length bytes cover."""
    if copied and size >= length:
        return np.array([0]), np.array([size])
    lo, hi = _merged(*runs, length)
    return lo, hi + length


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(length: int, shorter: int | None):
    """The spans that repeated strings cover, what is left, and the bytes that shorter ones cover."""

    def run(rows):
        for batch in batches(rows, 200):
            spans, kept, passages = [], [], []
            columns = [batch.column(1).to_pylist(), batch.column(3).to_pylist(), _runs(batch.column(4)), _runs(batch.column(5))]
            for text, copied, runs, short in zip(*columns, strict=True):
                raw = _raw(text)
                own = list(zip(*(x.tolist() for x in _covered(runs, copied, len(raw), length)), strict=True))
                spans.append([{"start": a, "end": b} for a, b in own])
                ends = [0, *[x for s in own for x in s], len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
                if shorter:
                    a, b = _covered(short, copied, len(raw), shorter)
                    passages.append(int((b - a).sum()))
                else:
                    passages.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(spans, SPANS), pa.array(kept, pa.binary()), pa.array(passages, pa.int64())], ["doc_id", "n_bytes", "spans", "kept", "n_shorter"])

    return run


def cut_repeats(docs: DataFrame, length: int = LENGTH, shorter: int | None = None) -> DataFrame:
    """doc_id, n_bytes, spans array<struct<start, end>>, kept binary for each row of docs(doc_id, text).

    A byte goes if it is covered by a string of length bytes that also starts anywhere else in the input, the same
    text included; spans are the maximal runs that go, in bytes of the UTF-8 text, and kept is the rest. Null
    texts are empty; texts shorter than length keep all. Repeated rows are copies of each other and go whole. Other
    columns are ignored. length must be 16 or more. Texts are compared by 128-bit digests, strings by 64-bit ones
    under a 64-bit name.

    With shorter (16 to length) there is a column n_shorter: bytes covered by strings of that many bytes that also
    start anywhere else. They stay, unless a repeated string of length bytes covers them, too.
    """
    if shorter is not None and not 16 <= shorter <= length:
        raise ValueError(f"shorter must be 16 to {length}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    with room(docs.sparkSession) as folder:
        copies = texts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("copied"))
        if shorter:
            short = scratch(_search(texts, shorter, "short", folder), "short", folder)
            gone = _search_within(texts, short, shorter, length, folder)
            found = short.withColumnRenamed("gone", "short").join(gone, "key", "left")
        else:
            found = _search(texts, length, "long", folder).withColumn("short", F.lit(None).cast("array<struct<lo: long, hi: long>>"))
        marks = scratch(found.join(copies, "key", "full_outer"), "marks")
    marked = texts.join(marks, "key", "left").select("doc_id", "text", "n_bytes", "copied", "gone", "short")
    out = marked.transform(in_batches, _cut(length, shorter), "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary, n_shorter long")
    return out if shorter else out.drop("n_shorter")
