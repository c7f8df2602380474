"""Byte-level BPE in padded numpy matrices, one row for each distinct piece of text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import batches, in_batches

#: No such pair.
NONE = np.int64(1 << 40)
#: Cells of one matrix, and pieces whose ids a task remembers.
CELLS, REMEMBERED = 1 << 18, 100_000
#: Ids of a row beyond which equal pairs that come next to one another in turn are merged in one round.
LONG = 2048
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Ranks of pairs of ids by open addressing: (left << 24 | right) hashed into four times as many slots or more."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, NONE, dtype=np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MULTIPLIER) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 24) | right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.ranks[slot], NONE)
        more = np.flatnonzero((found != keys) & (found != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            found = self.keys[slot[more]]
            hit = found == keys[more]
            out[more[hit]] = self.ranks[slot[more[hit]]]
            more = more[~hit & (found != -1)]
        return out


class Vocabulary:
    """Tokens and ranks of a rank file, whose lines hold a base64 token and its rank."""

    def __init__(self, raw: bytes) -> None:
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self.pairs = PairTable(np.array([*pairs], dtype=np.int64), np.array([*pairs.values()], dtype=np.int64))

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; empty pieces have none."""
        out: list[list[int]] = [[] for _ in pieces]
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[i] = [whole]
            elif piece:
                buckets.setdefault((len(piece) - 1).bit_length(), []).append(i)
        for bits, rows in buckets.items():
            step = max(1, CELLS >> bits)
            for at in range(0, len(rows), step):
                self._merge_rows(pieces, rows[at : at + step], 1 << bits, out)
        return out

    def _merge_rows(self, pieces: list[bytes], rows: list[int], width: int, out: list[list[int]]) -> None:
        """One bucket: each round every row merges its leftmost pair of least rank and is compacted.

        If a row of more than LONG ids has several such pairs and no pair that a merge would make ranks lower, they are merged in
        the same round: one at a time would take them next, in this order. This bounds the rounds of long rows by
        the ranks they hold rather than by their length.
        """
        rows_at = np.array(rows)
        lengths = np.array([len(pieces[i]) for i in rows])
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), dtype=np.uint8).reshape(len(rows), width)
        ids = np.where(np.arange(width) < lengths[:, None], self.bytes[raw], -1)
        ranks = np.full((len(rows), width), NONE, dtype=np.int64)  # of the pair that starts here
        both = ids[:, 1:] >= 0
        ranks[:, :-1][both] = self.pairs.get(ids[:, :-1][both], ids[:, 1:][both])
        while len(rows_at):
            least = ranks.min(axis=1)
            done = least == NONE
            if done.any():
                for i, row, n in zip(rows_at[done], ids[done], lengths[done], strict=True):
                    out[i] = row[:n].tolist()
                live = ~done
                rows_at, ids, ranks, lengths, least = rows_at[live], ids[live], ranks[live], lengths[live], least[live]
                if not len(rows_at):
                    return
            first = (ranks == least[:, None]).argmax(axis=1)
            if ids.shape[1] > LONG:
                self._merge_all(ids, ranks, lengths, least, first)
            else:
                self._merge_first(ids, ranks, least, first)
                lengths = lengths - 1
            width = int(lengths.max())
            ids, ranks = ids[:, :width], ranks[:, :width]

    def _merge_first(self, ids: np.ndarray, ranks: np.ndarray, least: np.ndarray, first: np.ndarray) -> None:
        n, width = ids.shape
        every, columns = np.arange(n), np.arange(width)
        source = np.minimum(columns + (columns > first[:, None]), width - 1)
        ids[:] = np.take_along_axis(ids, source, 1)
        ranks[:] = np.take_along_axis(ranks, source, 1)
        ids[every, first] = least
        if (full := ids[:, -1] >= 0).any():  # the last column has moved left
            ids[full, -1] = -1
        ranks[:, -1] = NONE
        for at in (first - 1, first):
            known = (at >= 0) & (at + 1 < width)
            rows, at = every[known], at[known]
            left, right = ids[rows, at], ids[rows, at + 1]
            pair = (left >= 0) & (right >= 0)
            new = np.full(len(rows), NONE, dtype=np.int64)
            new[pair] = self.pairs.get(left[pair], right[pair])
            ranks[rows, at] = new

    def _merge_all(self, ids: np.ndarray, ranks: np.ndarray, lengths: np.ndarray, least: np.ndarray, first: np.ndarray) -> None:
        for i in range(len(ids)):
            n, row = lengths[i], ids[i]
            at = np.flatnonzero(ranks[i, : n - 1] == least[i])
            run = np.cumsum(np.diff(at, prepend=-2) != 1)  # overlapping pairs: every second one of a run
            start = at[np.flatnonzero(np.diff(run, prepend=0))]
            at = at[(at - start[run - 1]) % 2 == 0]
            new, fresh = self._merged(row[:n], at, least[i])
            if len(at) > 1 and (fresh < least[i]).any():
                new, fresh = self._merged(row[:n], at[:1], least[i])
            row[:] = -1
            row[: len(new)] = new
            ranks[i] = NONE
            ranks[i, : len(new) - 1] = self.pairs.get(new[:-1], new[1:])
            lengths[i] = len(new)

    def _merged(self, row: np.ndarray, at: np.ndarray, rank: np.int64) -> tuple[np.ndarray, np.ndarray]:
        keep = np.ones(len(row), dtype=bool)
        keep[at + 1] = False
        new = row.copy()
        new[at] = rank
        new = new[keep]
        where = at - np.arange(len(at))
        left, right = where[where > 0], where[where + 1 < len(new)]
        # a merge may also meet its right neighbour while that is still unmerged
        raw = at[at + 2 < len(row)]
        return new, np.concatenate([self.pairs.get(new[left - 1], new[left]), self.pairs.get(new[right], new[right + 1]), self.pairs.get(np.full(len(raw), rank), row[raw + 2])])


@lru_cache(maxsize=4)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


class Encoder:
    """Splits texts by a pattern and encodes the pieces, remembering those seen last."""

    def __init__(self, words: Vocabulary, pattern: str) -> None:
        self.words, self.find = words, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}  # of a piece, in the arrays below
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        lists = self.words.merge([p.encode("utf-8", "surrogatepass") for p in pieces])
        length = np.array([len(x) for x in lists], dtype=np.int64)
        start = len(self.flat) + np.cumsum(length) - length
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(lists), np.int32, int(length.sum()))])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])
        self.place.update(zip(pieces, range(len(self.place), len(self.place) + len(pieces)), strict=True))

    def encode(self, texts: list[str | None], pass_chars: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts end to end, number of ids of each), in the texts' order."""
        run: list[list[str]] = []
        size = 0
        for text in texts:
            run.append(self.find(text) if text else [])
            size += len(text or "")
            if size >= pass_chars:
                yield self._run(run)
                run, size = [], 0
        yield self._run(run)

    def _run(self, run: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.place) > REMEMBERED:
            self._forget()
        if new := [*set(chain.from_iterable(run)).difference(self.place)]:
            self._learn(new)
        pieces = np.array([len(p) for p in run], dtype=np.int64)
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(run)), np.int64, int(pieces.sum()))
        length = self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = self.flat[np.repeat(self.start[at] - ends[:-1], length) + np.arange(ends[-1])]
        bounds = ends[np.concatenate([[0], np.cumsum(pieces)])]
        return flat, np.diff(bounds)


def read_ranks(path: str) -> bytes:
    """A rank file as bytes; the driver reads it and the tasks get it with their code."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array<int> column ids in place of text: each match of pattern is encoded separately.

    There are no special tokens: their strings are ordinary text. A null or empty text has no ids. Other
    columns pass through, whatever their names (a column named as ids is replaced); repeated rows stay.
    A rank file must hold all 256 bytes.
    """
    spark = docs.sparkSession
    if ids != text:
        docs = docs.drop(ids)
    shared = spark.sparkContext.broadcast(ranks)  # the file's size, whatever the input's
    others = [c for c in docs.columns if c != text]
    schema = T.StructType([*docs.select(*others).schema, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(rows):
        encoder = Encoder(vocabulary(shared.value), pattern)
        for batch in batches(rows, 400):
            flats, lengths = zip(*encoder.encode(batch.column(batch.schema.get_field_index(text)).to_pylist()), strict=True)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flats)))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), found], [*others, ids])

    return docs.withColumn(text, F.col(text).cast("string")).transform(in_batches, run, schema)


def decode(docs: DataFrame, ranks: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with a binary column out: the bytes of the tokens in ids; null ids give no bytes, an unknown id fails."""
    docs = docs.drop(out) if out != ids else docs
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([*docs.schema, T.StructField(out, T.BinaryType())])

    def run(rows):
        tokens = vocabulary(shared.value).tokens
        for batch in batches(rows, 400):
            lists = batch.column(batch.schema.get_field_index(ids))
            flat, lengths = lists.flatten().to_pylist() if lists.flatten().null_count else lists.flatten().to_numpy().tolist(), lists.value_lengths().fill_null(0).to_numpy()
            ends = np.cumsum(lengths)
            found = pa.array([b"".join(map(tokens.__getitem__, flat[a:b])) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    return docs.transform(in_batches, run, schema)
