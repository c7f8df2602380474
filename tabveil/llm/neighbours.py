"""Approximate nearest neighbours by an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import batches, hash_sample, in_batches, scratch

#: Centroids of each half, vectors to fit them on, rounds of fitting.
CENTROIDS, TRAIN, ROUNDS = 256, 20_000, 12
#: A query's traversal ends when its cells hold this share of the distinct vectors, whatever their number.
SHARE = 0.4
#: Vectors of one block, queries that meet a block in one task, queries that one numpy pass takes.
BLOCK, QUERIES, PASS = 4096, 4096, 128
#: Queries whose cells one task chooses.
TRAVERSED = 64


def _fit_half(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from distinct random rows; an emptied centroid stays where it was."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        for c in range(len(centres)):
            if (own := x[near == c]).size:
                centres[c] = own.mean(0)
    return centres


class MultiIndex:
    """Centroids of both halves, and of each pair of them (a cell) the distinct vectors and where its blocks are."""

    def __init__(self, sample: np.ndarray, k: int = CENTROIDS) -> None:
        self.half = max(1, sample.shape[1] // 2)
        self.centres = [_fit_half(sample[:, : self.half], k, 1), _fit_half(sample[:, self.half :], k, 2)]
        self.sides = tuple(map(len, self.centres))
        self.distinct = self.first = self.blocks = np.zeros(self.sides[0] * self.sides[1], dtype=np.int64)

    def place(self, cells: list[tuple[int, int, int]]) -> None:
        """Sets what each (cell, vectors, distinct vectors) holds: small cells share a block, large ones take several."""
        self.distinct, self.first, self.blocks = (np.zeros(len(self.distinct), dtype=np.int64) for _ in range(3))
        block, held = 0, 0
        for cell, n, distinct in sorted(cells):
            if held and held + n > BLOCK:
                block, held = block + 1, 0
            self.distinct[cell], self.first[cell], self.blocks[cell] = distinct, block, -(-n // BLOCK)
            block, held = (block, held + n) if n <= BLOCK else (block + self.blocks[cell], 0)

    def distances(self, x: np.ndarray, side: int) -> np.ndarray:
        part, centres = (x[:, : self.half], x[:, self.half :])[side], self.centres[side]
        return np.maximum(0, (part**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * part @ centres.T)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x, 0).argmin(1) * self.sides[1] + self.distances(x, 1).argmin(1)

    def traverse(self, first: np.ndarray, second: np.ndarray, wanted: int) -> tuple[list[int], float]:
        """Non-empty cells in the order of summed distance, until they hold the wanted number of distinct vectors, and the last sum.

        The heap has the next cell of each row of centroid pairs; a row enters when the one before it is taken up.
        """
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        far, near = first[a].tolist(), second[b].tolist()
        counts = self.distinct.reshape(self.sides)[a][:, b].tolist()
        heap, out, held, last = [(far[0] + near[0], 0, 0)], [], 0, 0.0
        while heap and held < wanted:
            last, i, j = heap[0]
            if n := counts[i][j]:
                out.append((i, j))
                held += n
            if j + 1 < len(near):
                heapq.heapreplace(heap, (far[i] + near[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if not j and i + 1 < len(far):
                heapq.heappush(heap, (far[i + 1] + near[0], i + 1, 0))
        i, j = np.array(out, dtype=np.int64).reshape(-1, 2).T
        return (a[i] * self.sides[1] + b[j]).tolist(), last

    def visited(self, cells: list[int]) -> np.ndarray:
        """The blocks that hold these cells."""
        first, n = self.first[cells], self.blocks[cells]
        wide = n > 1
        more = [np.arange(a, a + k) for a, k in zip(first[wide].tolist(), n[wide].tolist(), strict=True)]
        return np.unique(np.concatenate([first, *more]))


def _vectors(column, width: int) -> np.ndarray:
    """The rows of a list column, padded with zeros to width."""
    column = column if isinstance(column, pa.ListArray) else column.combine_chunks()
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy()
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _best(x: np.ndarray, ids: np.ndarray, cells: np.ndarray, asked: np.ndarray, names: np.ndarray, limits: np.ndarray, index: MultiIndex, k: int) -> pd.DataFrame:
    """The k best of one block for each of some queries, among the cells that each visits, by exact distances."""
    a, b = np.divmod(cells, index.sides[1])
    sums = index.distances(asked, 0)[:, a] + index.distances(asked, 1)[:, b]
    norms = (x**2).sum(1)
    rough = norms - 2 * asked @ x.T
    # the last cell's own sum may round otherwise here
    rough[(sums > limits[:, None] * (1 + 1e-9) + 1e-9) | (names[:, None] == ids)] = np.inf
    at = min(k, len(x)) - 1
    limit = np.partition(rough, at, axis=1)[:, at]
    slack = 1e-9 * (1 + np.abs(np.where(np.isinf(limit), 0, limit)) + norms.max())
    query, near = np.nonzero((rough <= (limit + slack)[:, None]) & np.isfinite(rough))
    exact = np.sqrt(((x[near] - asked[query]) ** 2).sum(1))
    order = np.lexsort((ids[near], exact, query))
    query, near, exact = query[order], near[order], exact[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    own = rank < k
    return pd.DataFrame({"query_id": names[query[own]], "vec_id": ids[near[own]], "score": exact[own]})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each of queries, k near vectors by Euclidean distance, nearest first.

    Both tables hold vec_id and embedding (an array of numbers). Vectors that are null, empty, zero, or hold a null
    or non-finite component take no part. A vector shorter than the longest counts as padded with zeros. Rows that repeat
    a vec_id count once, with the smallest embedding; null ids are left out. A query's own id is no candidate; if
    fewer than k are left, all are returned. Ties go to the smaller vec_id. Other columns are ignored.

    Centroids are fitted on a bounded sample (TRAIN), but every vector is posted. Blocks hold whole cells, or parts of a large
    one, up to a bounded size, so a cell with a third of all vectors is many tasks. A query is sent once to each block that
    holds one of its cells, with the sum at which its traversal ended; there many queries are measured at once, and each
    returns its k best only. Queries of one block are dealt to tasks of bounded size.
    """
    good = "vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"
    take = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    spark = vectors.sparkSession
    rows, asked = scratch(take(vectors), "vectors"), scratch(take(queries), "queries")
    size = rows.agg(F.max(F.size("embedding"))).first()[0]
    asked_size, n_asked = asked.agg(F.max(F.size("embedding")), F.count("*")).first()
    if size is None or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = max(size, asked_size)
    sample = hash_sample(rows, "vec_id", TRAIN).select("embedding").toArrow()["embedding"]
    index = MultiIndex(_vectors(sample, width))

    def post(batches_):
        for batch in batches(batches_, 5000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index.cells(_vectors(batch.column(1), width)), pa.int32()), batch.column(1)], ["vec_id", "cell", "embedding"])

    posted = scratch(rows.transform(in_batches, post, "vec_id long, cell int, embedding array<double>"), "posted")
    cells = posted.groupBy("cell", F.xxhash64("embedding").alias("h")).agg(F.count("*").alias("n")).groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()
    index.place([(r.cell, r.n, r.distinct) for r in cells])  # centroids squared at most; copies don't end a traversal early
    wanted = max(k + 1, int(share * index.distinct.sum()))
    slices = -(-n_asked // QUERIES)

    def ask(batches_):
        for batch in batches(batches_, 500):
            x = _vectors(batch.column(1), width)
            first, second = index.distances(x, 0), index.distances(x, 1)
            at, blocks, limits = [], [], []
            for i in range(len(x)):
                cells, limit = index.traverse(first[i], second[i], wanted)
                visited = index.visited(cells)
                at.append(np.full(len(visited), i))
                blocks.append(visited)
                limits.append(np.full(len(visited), limit))
            at = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(blocks)), pa.array(np.concatenate(limits)), batch.column(1).take(at)], ["query_id", "block", "limit", "embedding"])

    def deal(batches_):
        """Each vector's block, and a copy for each slice of the queries."""
        for batch in batches(batches_, 5000):
            cells, ids = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            block = index.first[cells] + ids % index.blocks[cells]
            at = pa.array(np.repeat(np.arange(len(ids)), slices))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.repeat(block, slices)), pa.array(np.tile(np.arange(slices), len(ids))), batch.column(1).take(at), batch.column(2).take(at)], ["vec_id", "block", "slice", "cell", "embedding"])

    spread = asked.repartition(max(1, min(n_asked // TRAVERSED, 10_000)))  # a traversal takes some 20 ms
    asking = spread.transform(in_batches, ask, "query_id long, block long, limit double, embedding array<double>")
    asking = asking.withColumn("slice", F.pmod(F.xxhash64("query_id"), F.lit(slices)))
    dealt = posted.transform(in_batches, deal, "vec_id long, block long, slice long, cell int, embedding array<double>")

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        stack = lambda c: np.stack([np.pad(v, (0, width - len(v))) for v in c])
        x, queries_ = stack(right["embedding"]), stack(left["embedding"])
        ids, cells, names, limits = right["vec_id"].to_numpy(), right["cell"].to_numpy(), left["query_id"].to_numpy(), left["limit"].to_numpy()
        return pd.concat([_best(x, ids, cells, queries_[i : i + PASS], names[i : i + PASS], limits[i : i + PASS], index, k) for i in range(0, len(names), PASS)])

    scored = asking.groupBy("block", "slice").cogroup(dealt.groupBy("block", "slice")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
