"""Phrase collocations: candidates from a count sketch, counted by Aho-Corasick automata, scored exactly."""

from __future__ import annotations

from operator import itemgetter
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import _LOWER_LUT, POWERS, in_batches, mix64, prefix_hashes, room, scratch

#: Words of a phrase at most, and the occurrences that a candidate needs.
LONGEST, LEAST = 3, 10
#: A candidate goes if a longer one around it has this share of its occurrences, in per cent.
COVERED = 50
#: Phrases of a language that are reported.
TOP = 2000
#: Cells of a range of the sketch: one task sums up one range, a byte a cell.
RANGE_BITS = 21
#: Bits of the map of heavy cells at most; cells of larger sketches are folded into it, which only adds candidates.
MAP_BITS = 28
#: Phrases that a task gathers before it sorts and counts their cells.
RUN = 1 << 23
#: Bytes of normalised text that one automaton scans.
SHARD_BYTES = 2 << 20
#: Phrases that a task tallies before it hands their counts on.
TALLY = 500_000

_KIND = np.zeros(256, np.uint8)  # 1: between words, 2: between pieces
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2


def _fragments(text: bytes, limit: int = 1 << 18):
    """A text in parts of about limit bytes, cut where a piece ends, as no phrase crosses that."""
    at = 0
    while len(text) - at > limit:
        ends = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, limit, at)] == 2)
        if not len(ends):  # a piece of that length is one part
            ends = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, len(text) - at, at)] == 2)[:1]
            if not len(ends):
                break
        yield text[at : at + int(ends[-1]) + 1]
        at += int(ends[-1]) + 1
    yield text[at:]


def _runs(batch: pa.RecordBatch):
    """(lang, texts) of a batch, the texts of a language in runs of bounded size."""
    by: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if text:
            by.setdefault(lang, []).extend(_fragments(text.encode("utf-8", "replace")))
    for lang, texts in by.items():
        run, size = [], 0
        for text in texts:
            if run and size + len(text) > 1 << 18:
                yield lang, run
                run, size = [], 0
            run.append(text)
            size += len(text)
        if run:
            yield lang, run


class Words:
    """The words of a run of texts: lower-cased bytes, where each begins and ends, its piece and its hash."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        self.data = _LOWER_LUT[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = _KIND[self.data]
        edge = np.diff((kind == 0).astype(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        _, down = POWERS.get(len(self.data) + 1)
        prefix = prefix_hashes(self.data)
        own = (prefix[self.ends] - prefix[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64)
        self.hashes = mix64(own ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the first words of all phrases of k words, and the phrases' 64-bit hashes."""
        n = len(self.starts) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:n] == self.piece[k - 1 :])
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) ^ self.hashes[at + j])
        return at, h

    def normal(self) -> tuple[bytes, np.ndarray]:
        """The pieces as ' word word ' and a line feed each, and where each word's leading blank is."""
        last = np.append(self.piece[1:] != self.piece[:-1], True) if len(self.piece) else np.zeros(0, bool)
        size = self.ends - self.starts
        at = np.cumsum(1 + size + 2 * last) - (1 + size + 2 * last)
        out = np.full(int(at[-1] + 3 + size[-1]) if len(at) else 0, 32, np.uint8)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at + 1, size) + step] = self.data[np.repeat(self.starts, size) + step]
        out[(at + size + 2)[last]] = 10
        return out.tobytes(), at


def _packed(cells: np.ndarray):
    """(range, cells, counts) of a run of cells: sorted, counted up to LEAST, gaps in byte planes."""
    cells = np.sort(cells)
    begins = np.append(0, np.flatnonzero(cells[1:] != cells[:-1]) + 1)
    counts = np.minimum(np.diff(begins, append=len(cells)), LEAST).astype(np.uint8)
    cells = cells[begins]
    ranges = (cells >> RANGE_BITS).astype(np.int64)
    ends = np.append(np.flatnonzero(np.diff(ranges)) + 1, len(ranges))
    low = 0
    for high in ends.tolist():
        inner = (cells[low:high] & ((1 << RANGE_BITS) - 1)).astype(np.uint32)
        gaps = np.diff(inner, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        yield int(ranges[low]), zstandard.compress(gaps.T.tobytes()), zstandard.compress(counts[low:high].tobytes())
        low = high


def _sketched(bits: int):
    def emit(cells):
        found = list(_packed(np.concatenate(cells)))
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["range", "cells", "counts"])

    kind = np.uint32 if bits <= 32 else np.uint64

    def run(rows):
        cells, n = [], 0
        for batch in rows:
            for lang, texts in _runs(batch):
                words = Words(lang, texts)
                for k in range(1, LONGEST + 1):
                    _, h = words.phrases(k)
                    cells.append((h >> np.uint64(64 - bits)).astype(kind))
                    n += len(h)
                if n > RUN:
                    yield emit(cells)
                    cells, n = [], 0
        if n:
            yield emit(cells)

    return run


def _heavy(fold: int):
    """The map of the cells of a range that reach LEAST, 2 ** fold cells a bit."""

    def run(table: pa.Table) -> pa.Table:
        sums = np.zeros(1 << RANGE_BITS, np.uint8)
        for gaps, counts in zip(table.column("cells"), table.column("counts"), strict=True):
            planes = np.frombuffer(zstandard.decompress(gaps.as_py()), np.uint8).reshape(3, -1).astype(np.int64)
            at = np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16)
            sums[at] = np.minimum(sums[at] + np.frombuffer(zstandard.decompress(counts.as_py()), np.uint8), LEAST)
        bits = (sums >= LEAST).reshape(-1, 1 << fold).any(axis=1)
        return pa.table({"range": table.column("range")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    return run


def heavy_cells(plain: DataFrame, bits: int) -> np.ndarray:
    """The map of the cells of a sketch of 2 ** bits that LEAST phrases or more fall into: 2 ** MAP_BITS bits at most.

    A cell's count is an upper bound of that of each phrase in it. Counts stop at LEAST; parts are summed up range by
    range, so no task and no shuffle holds more than the cells that occur.
    """
    fold = max(0, bits - MAP_BITS)
    parts = plain.transform(in_batches, _sketched(bits), "range long, cells binary, counts binary")
    found = parts.groupBy("range").applyInArrow(_heavy(fold), "range long, bits binary")
    size = 1 << (RANGE_BITS - 3 - fold)
    out = np.zeros(size << (bits - RANGE_BITS), np.uint8)
    for r in found.collect():
        out[r.range * size : (r.range + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


class Shard:
    """Normalised text of one language, and the candidates in it."""

    def __init__(self) -> None:
        self.text, self.size, self.words, self.found = [], 0, 0, []

    def add(self, words: Words, heavy: np.ndarray, shift: int) -> None:
        text, at = words.normal()
        self.words += len(at)
        for k in range(1, LONGEST + 1):
            first, h = words.phrases(k)
            bit = (h >> np.uint64(shift)).astype(np.int64)
            kept = heavy[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0
            first = first[kept]
            end = at[first + k - 1] + 1 + (words.ends - words.starts)[first + k - 1] + 1  # with the blank behind
            self.found.append((h[kept], at[first] + self.size, end + self.size))
        self.text.append(text)
        self.size += len(text)

    def counts(self):
        """(phrase, occurrences) of the candidates: an automaton of blank-guarded phrases scans the text."""
        text = b"".join(self.text)
        h, begin, end = (np.concatenate(x) for x in zip(*self.found, strict=True))
        _, one = np.unique(h, return_index=True)
        phrases = [text[a:b] for a, b in zip(begin[one].tolist(), end[one].tolist(), strict=True)]
        if not phrases:
            return
        automaton = ahocorasick.Automaton()
        for i, phrase in enumerate(phrases):
            automaton.add_word(phrase.decode(), i)
        automaton.make_automaton()
        hits = np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text.decode())), np.int64), minlength=len(phrases))
        for phrase, n in zip(phrases, hits.tolist(), strict=True):
            yield phrase[1:-1], n


class Tally:
    """Counts of phrases by language that a task has gathered."""

    def __init__(self) -> None:
        self.of: dict[str, dict[bytes, int]] = {}
        self.size = 0

    def add(self, shards: dict[str, Shard]) -> None:
        for lang, shard in shards.items():
            own = self.of.setdefault(lang, {})
            self.size -= len(own)
            own[b""] = own.get(b"", 0) + shard.words
            for phrase, n in shard.counts():
                own[phrase] = own.get(phrase, 0) + n
            self.size += len(own)

    def packed(self, ranges: int) -> pa.RecordBatch:
        """(lang, range, phrases, counts): the phrases of a range in order, a line feed between, as sorted text is small."""
        rows = []
        for lang, own in self.of.items():
            dealt = [[] for _ in range(ranges)]
            for phrase in sorted(own):
                dealt[crc32(phrase) % ranges].append(phrase)
            rows += [(lang, r, zstandard.compress(b"\n".join(part)), zstandard.compress(np.array([own[p] for p in part], np.uint32).tobytes())) for r, part in enumerate(dealt) if part]
        types = (pa.string(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], ["lang", "range", "phrases", "counts"])


def _scanned(heavy, bits: int, ranges: int):
    shift = 64 - min(bits, MAP_BITS)

    def run(rows):
        shards, tally = {}, Tally()
        for batch in rows:
            for lang, texts in _runs(batch):
                shards.setdefault(lang, Shard()).add(Words(lang, texts), heavy.value, shift)
                if sum(s.size for s in shards.values()) > SHARD_BYTES:
                    tally.add(shards)
                    shards = {}
                    if tally.size > TALLY:
                        yield tally.packed(ranges)
                        tally = Tally()
        tally.add(shards)
        yield tally.packed(ranges)

    return run


def _summed(table: pa.Table) -> pa.Table:
    """The phrases of a range and language that reach LEAST; with k = 0 the language's words, under the empty phrase."""
    sums: dict[bytes, int] = {}
    for phrases, counts in zip(table.column("phrases"), table.column("counts"), strict=True):
        for phrase, n in zip(zstandard.decompress(phrases.as_py()).split(b"\n"), np.frombuffer(zstandard.decompress(counts.as_py()), np.uint32).tolist(), strict=True):
            sums[phrase] = sums.get(phrase, 0) + n
    kept = [p for p, n in sums.items() if n >= LEAST or not p]
    lang = pa.array([table.column("lang")[0].as_py()] * len(kept), pa.string())
    return pa.table({"lang": lang, "phrase": pa.array([p.decode() for p in kept], pa.string()), "k": pa.array([p.count(b" ") + 1 if p else 0 for p in kept], pa.int32()), "n": pa.array([sums[p] for p in kept], pa.int64())})


def phrase_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, k, n of all phrases of 1 to LONGEST words that occur LEAST times or more in a language; and with k = 0
    the number of all its words."""
    plain = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(RANGE_BITS, (size // 2).bit_length())  # about two cells a phrase
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_cells(plain, bits))
    found = plain.transform(in_batches, _scanned(heavy, bits, 1 << max(4, bits - RANGE_BITS - 2)), "lang string, range int, phrases binary, counts binary")
    return found.groupBy("lang", "range").applyInArrow(_summed, "lang string, phrase string, k int, n long")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the top phrases of each language of docs(text, lang).

    a is the number of a phrase's occurrences, l and r those of both parts at its lowest-scoring cut, n all words of the
    language, and score floor(1000000 * a * a / (l * r)). Phrases that lie in a longer candidate of COVERED per cent of their
    occurrences are left out. A null lang is 'und'; null, empty and blank texts have no words; repeated rows count each
    time; other columns are ignored; an empty table gives an empty table.
    """
    with room(docs.sparkSession) as folder:
        counts = scratch(phrase_counts(docs), "phrases", folder)
        words = F.split("phrase", " ", -1)
        part = lambda a, b: F.array_join(F.slice("words", a, b), " ")
        known = counts.where("k > 0").select("lang", "phrase", F.col("n").alias("f"))
        some = counts.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), F.col("k").alias("size"), words.alias("words"))
        cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
        cuts = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
        cuts = cuts.join(known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        wide = lambda c: f"cast({c} as decimal(19,0))"
        score = F.expr(f"(cast(1000000 as decimal(7,0)) * cast({wide('a')} * {wide('a')} as decimal(31,0))) div cast({wide('l')} * {wide('r')} as decimal(38,0))")
        least = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
        inner = some.where("size > 2").withColumn("at", F.explode(F.sequence(F.lit(1), F.lit(LONGEST - 1))))
        inner = inner.groupBy("lang", part(F.col("at"), F.lit(2)).alias("phrase")).agg(F.max("a").alias("around"))
        kept = least.join(inner, ["lang", "phrase"], "left").where(F.expr(f"around is null or 100 * around < {COVERED} * a"))
        order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
        kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        every = counts.where("k = 0").select("lang", "n")  # one row a language
        out = kept.join(every, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
        return scratch(out, "collocations")
