"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import batches, in_batches, mix64, passes, scratch, shingle_hashes, shingles_of

#: Bytes of item text that one pass over the documents carries.
BLOCK_BYTES = 4 << 20
#: Share of an item's shingles, in per cent, that a document must contain.
CONTAINED = 75
#: Size classes of items: shingles up to which, and minima of their sketch. Smaller sets are their own sketch.
SMALL, CLASSES = 24, ((64, 24), (256, 32), (1 << 62, 48))
#: Chance at most that a document which contains CONTAINED per cent of an item matches too few of its minima.
MISS = 1e-6


def matches_needed(minima: int) -> int:
    """The most matches that such a document has but for a chance of MISS: each minimum is in it with the share CONTAINED."""
    p, below = CONTAINED / 100, 0.0
    for t in range(minima + 1):
        below += math.comb(minima, t) * p**t * (1 - p) ** (minima - t)
        if below > MISS:
            return max(1, t)
    return minima


_BITS = 20


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """The MinHash sketch of a set, by its size class, and the matches a candidate needs.

    Small sets are their own sketch and need CONTAINED per cent exactly; of larger ones the smallest hashes are taken, as
    many as their class says.
    """
    own = np.unique(hashes)
    if len(own) <= SMALL:
        return own, max(1, -(-CONTAINED * len(own) // 100))
    minima = next(m for most, m in CLASSES if len(own) <= most)
    return own[np.argsort(mix64(own ^ np.uint64(0x5851F42D4C957F2D)))[:minima]], matches_needed(minima)


class Index:
    """Inverted sketches of one block of items, with a bitmap before the binary search."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.sets = [shingles_of(t) for _, t in items]
        sketches = [sketch(shingle_hashes([t.encode("utf-8", "replace")])[0]) for _, t in items]
        self.needed = np.array([n for _, n in sketches])
        keys = np.concatenate([k for k, _ in sketches]) if items else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(k) for k, _ in sketches])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.map = np.zeros(1 << _BITS, dtype=bool)
        self.map[(self.keys & np.uint64((1 << _BITS) - 1)).astype(np.int64)] = True

    def candidates(self, hashes: np.ndarray) -> np.ndarray:
        """Indexes of the items whose sketches a document with these shingle hashes matches often enough."""
        near = np.unique(hashes[self.map[(hashes & np.uint64((1 << _BITS) - 1)).astype(np.int64)]])
        low, high = np.searchsorted(self.keys, near, "left"), np.searchsorted(self.keys, near, "right")
        hit = high > low
        if not hit.any():
            return np.zeros(0, dtype=np.int64)
        low, n = low[hit], (high - low)[hit]
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found, matched = np.unique(self.owner[at], return_counts=True)
        return found[matched >= self.needed[found]]

    def contained(self, text: str, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, shared shingles, shingles of the item) of each item that the text contains."""
        found = self.candidates(hashes)
        if not len(found):
            return []
        own = shingles_of(text)
        counted = [(i, len(self.sets[i] & own), len(self.sets[i])) for i in found.tolist()]
        return [(self.ids[i], both, n) for i, both, n in counted if 100 * both >= CONTAINED * n]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """Indexes over the distinct items of benchmark(item_id, text), of about block_bytes of text each.

    Items of equal text are one, under the smallest item_id. Items are dealt to blocks by a hash; a block is
    what the driver holds and broadcasts at a time, however large the table is.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    items = scratch(items.groupBy("text").agg(F.min("item_id").alias("item_id")), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id").collect()
        if part := [(r.item_id, r.text) for r in part if r.text.split()]:
            yield part


def _search(docs: DataFrame, part: list[tuple[int, str]], emit, schema) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(part)  # about block_bytes

    def run(rows):
        index = Index(shared.value)
        for batch in batches(rows, 1000):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            found = []
            for first, raws in passes(texts):
                hashes, at, _ = shingle_hashes(raws)
                found += [index.contained(texts[first + i], hashes[at[i] : at[i + 1]]) for i in range(len(raws))]
            yield emit(batch, found)

    return docs.transform(in_batches, run, schema)


PAIRS = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): the items that each of docs(doc_id, text) contains.

    An item is contained if the document has at least 75 % of its distinct five-word shingles; an item of
    fewer than five words is one shingle, which only a text of the same words has. Items of equal text are
    named by the smallest item_id. Null, empty or blank texts and items, and null item ids, match nothing; a
    null doc_id stays null; a repeated row gives repeated pairs. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], PAIRS)

    def emit(batch, found):
        rows = [(doc, *x) for doc, own in zip(batch.column(0).to_pylist(), found, strict=True) for x in own]
        columns = [[r[0] for r in rows], [r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows], [r[2] / r[3] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if k == 4 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    found = [_search(docs, part, emit, PAIRS) for part in blocks(benchmark)]
    for pairs in found:
        out = out.unionByName(pairs)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that contain no benchmark item; one narrow pass for each block of items."""
    schema = T.StructType([*docs.schema])
    for part in blocks(benchmark):
        docs = _search(docs, part, lambda batch, found: batch.filter(pa.array([not x for x in found], pa.bool_())), schema)
    return docs
