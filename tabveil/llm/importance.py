"""Target-distribution importance resampling over hashed words and word pairs, by an external sort-count."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._shared import in_batches, passes, room, scratch

#: Buckets of features; a bucket is a uint16.
BUCKETS = 10_000
#: Words that a document needs to be drawn.
LEAST_WORDS = 20
#: Drawn share of those documents, in per cent, and the seed of the draw.
SHARE, SEED = 25, 7

# A-Z lower-cased, all other ASCII but digits and letters a blank
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Words of more bytes have the hashes of their pairs computed one by one.
_SHORT = 64


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k of a CRC-32 of value b becomes when n zero bytes follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    out = [np.arange(256, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)]
    for _ in range(_SHORT):
        out.append((out[-1] >> 8) ^ table[out[-1] & 255])
    return np.stack(out)


_SHIFTS = _shifts()


def _followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The CRC-32 values after n zero bytes each."""
    return _SHIFTS[n, 0, crc & 255] ^ _SHIFTS[n, 1, crc >> 8 & 255] ^ _SHIFTS[n, 2, crc >> 16 & 255] ^ _SHIFTS[n, 3, crc >> 24]


def features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of the texts, one text after the other, and the words of each text.

    A text of n words has 2 * n - 1 features: word, pair, word, pair, and so on. The CRC-32 of a pair follows from those of
    its words, as the function is linear.
    """
    split = [raw.translate(_WORD).split() for raw in raws]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    words = list(chain.from_iterable(split))
    if not words:
        return np.zeros(0, np.uint16), counts
    crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    first = np.zeros(len(words), bool)  # pairs end at words that begin no text
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    second = np.flatnonzero(~first)
    blank = np.uint32(zlib.crc32(b" "))
    before = _followed(crc[second - 1], np.ones(len(second), np.int64)) ^ blank
    pair = _followed(before, np.minimum(size[second], _SHORT)) ^ crc[second]
    for k in np.flatnonzero(size[second] > _SHORT):
        pair[k] = zlib.crc32(words[second[k]], int(before[k]))
    out = np.empty(len(words) + len(second), np.uint16)
    at = 2 * np.arange(len(words)) - (np.cumsum(first) - 1)  # each text has one pair less than words
    out[at] = crc % BUCKETS
    out[at[second] - 1] = pair % BUCKETS
    return out, counts


def _streamed(rows):
    """Packed streams: the ids and word counts of a run of texts, where each begins, and all their buckets as uint16."""
    longs = pa.list_(pa.int64())
    for batch in rows:
        ids = batch.column(0).to_pylist()
        found = [[], [], [], []]
        for first, raws in passes(batch.column(1).to_pylist()):
            stream, counts = features(raws)
            sizes = np.maximum(2 * counts - 1, 0)
            for out, x in zip(found, (ids[first : first + len(raws)], counts.tolist(), (np.cumsum(sizes) - sizes).tolist(), stream.tobytes()), strict=True):
                out.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (longs, longs, longs, pa.binary()), strict=True)], ["ids", "words", "starts", "stream"])


def streams(rows: DataFrame, key: str | None) -> DataFrame:
    """ids, words, starts, stream of rows(text) in runs; see _streamed."""
    own = F.col(key).cast("long") if key else F.lit(None).cast("long")
    return rows.select(own.alias("id"), F.col("text").cast("string").alias("text")).transform(in_batches, _streamed, "ids array<long>, words array<long>, starts array<long>, stream binary")


def _counted(rows):
    """Sorts the buckets of a batch and gives each run's value and length."""
    for batch in rows:
        stream = np.sort(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16))
        begins = np.flatnonzero(np.diff(stream.astype(np.int32), prepend=-1))
        yield pa.RecordBatch.from_arrays([pa.array(stream[begins].astype(np.int32)), pa.array(np.diff(begins, append=len(stream)))], ["bucket", "n"])


def bucket_counts(table: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all streams: BUCKETS numbers."""
    runs = table.select("stream").transform(in_batches, _counted, "bucket int, n long")
    out = np.zeros(BUCKETS, np.int64)
    for r in runs.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds: floor(1000 * ln of the ratio of both smoothed shares)."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weighed(gain: np.ndarray):
    """The floored mean of the gains of each text: gathered by bucket, summed up between the texts' starts."""

    def run(rows):
        for batch in rows:
            out = [[], [], [], []]
            for r in batch.to_pylist():
                words, starts = np.array(r["words"], np.int64), np.array(r["starts"], np.int64)
                some, sums = words > 0, np.zeros(len(words), np.int64)
                if some.any():
                    sums[some] = np.add.reduceat(gain[np.frombuffer(r["stream"], np.uint16)], starts[some])
                sizes = np.maximum(2 * words - 1, 0)
                for o, x in zip(out, (r["ids"], words.tolist(), sizes.tolist(), (sums // np.maximum(sizes, 1)).tolist()), strict=True):
                    o.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "n_words", "n_features", "weight"])

    return run


def importance_resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs(doc_id, text), drawn to resemble target(text).

    weight is the floored mean over the features of how much commoner each is in the target; score adds Gumbel noise keyed by
    seed and doc_id, so the share per cent of the highest scores are a draw without replacement in proportion to
    exp(weight / 1000). Documents of fewer than least_words words aren't drawn; rank, from 1 on, is null where a row
    isn't drawn. Ties go to the smaller doc_id; a null id is last and has the noise of an empty text.
    Null and empty texts have no features and the weight 0. Rows that repeat an id are drawn one by one. An empty target
    makes rarer features the better ones; empty docs give an empty table. Other columns are ignored.
    """
    with room(docs.sparkSession) as folder:
        packed = scratch(streams(docs, "doc_id"), "streams", folder)
        gain = gains(bucket_counts(packed), bucket_counts(streams(target, None)))
        rows = packed.transform(in_batches, _weighed(gain), "doc_id long, n_words long, n_features long, weight long")
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        h = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
        noise = F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
        rows = scratch(rows.withColumn("score", F.col("weight") + noise.cast("long")), "weighed")
    able = F.col("n_words") >= least_words
    # whole numbers between the least gain and the highest plus 23,000: their number doesn't grow with the rows
    sizes = rows.where(able).groupBy("score").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = rows.where(able).count()
    drawn = share * total // 100
    sizes = sizes.select("score", above.alias("above")).where(F.col("above") < drawn)
    place = F.row_number().over(Window.partitionBy("score", "able").orderBy(F.asc_nulls_last("doc_id"))) + F.col("above")
    ranked = rows.withColumn("able", able).join(F.broadcast(sizes), "score", "left").withColumn("place", F.when(F.col("able"), place))
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).cast("long").alias("rank"))
