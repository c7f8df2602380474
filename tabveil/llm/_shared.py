"""Helpers that several training-data operators share: scratch tables, word and shingle rules, hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words of a shingle.
SHINGLE = 5
#: Bytes of text that one numpy pass takes at most, unless a single text is longer.
PASS_BYTES = 1 << 18
#: Rows and bytes of a batch that a Python task gets at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: Deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LOWER_LUT = np.frombuffer(_LOWER, dtype=np.uint8)
_SPACE_LUT = np.zeros(256, dtype=bool)
_SPACE_LUT[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else a folder in the warehouse.

    A machine's own temporary folder is taken only where everything runs in the driver's process, as in tests.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root and re.match(r"local(\[|$)", spark.sparkContext.master):
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def scratch(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and lost executors lose nothing.

    Give the folder of a room() for what is needed only until that room ends. The shuffle files of the write go when it
    ends: Spark keeps them otherwise until the driver's garbage collection finds them unused, and operators of many
    short jobs pile them up.
    """
    path = f"{folder or scratch_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession) -> bool:
    """Returns what the driver's JVM has freed to the system; False where the JVM can't (Java before 17.0.9, not the GNU C library).

    Plans of many short jobs leave garbage, and of what its compiler threads free, the C library keeps hundreds of MB.
    """
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    lang = jvm.java.lang
    lang.System.gc()
    # by the interface, as Py4J finds no method of the server's own class
    kinds = ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    types, values = new(lang.Class, len(kinds)), new(lang.Object, len(kinds))
    for i, (kind, value) in enumerate(zip(kinds, (command, "systemTrimNativeHeap", new(lang.Object, 0), new(lang.String, 0)), strict=True)):
        types[i], values[i] = lang.Class.forName(kind), value
    try:
        lang.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        return False
    return True


@contextmanager
def room(spark: SparkSession) -> Iterator[str]:
    """A folder for scratch tables, deleted at the end: whatever outlives it must be written elsewhere before.

    What the driver freed meanwhile goes back to the system.
    """
    folder = f"{scratch_root(spark)}/room-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        _delete(spark, folder)
        give_back(spark)


def _give_back() -> None:
    """Returns what a task took to the system: Python workers live on, and what one keeps adds to the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def _tidy(run):
    """run, and afterwards its memory given back."""

    def tidied(rows):
        try:
            yield from run(rows)
        finally:
            _give_back()

    return tidied


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with Arrow batches of BATCH_ROWS rows and BATCH_BYTES bytes at most, set for the session.

    Texts of any length come in batches that fit a worker; a text longer than that is a batch of its own. A task that ends
    gives its memory back.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}", None)
        if now is None or not 0 < int(re.match(r"-?\d+", now)[0]) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df.mapInArrow(_tidy(run), schema)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, split at ASCII white space."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def shingles_of(text: str | None) -> set[tuple[bytes, ...]]:
    """Distinct word shingles; the whole sequence as one if it is shorter; empty without words."""
    words = words_of(text)
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE)), strict=False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _BASE_INV)):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[i] the polynomial of the first i bytes; (h[j] - h[i]) * base**-i names the bytes i to j."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def passes(texts: list[str | None], limit: int = PASS_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) in runs of at most limit bytes, or of one text."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "replace") if text else b""
        if run and size + len(raw) > limit:
            yield first, run
            first, run, size = i, [], 0
        run.append(raw)
        size += len(raw) + 1
    if run:
        yield first, run


def shingle_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text, in order: 64-bit hashes of its shingles by position, where each text's begin, and words per text."""
    buffer = b"\n".join(raws) + b"\n"
    data = _LOWER_LUT[np.frombuffer(buffer, dtype=np.uint8)]
    space = _SPACE_LUT[data]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[-len(starts) :] if len(starts) else starts
    _, down = POWERS.get(len(data) + 1)
    prefix = prefix_hashes(data)
    words = mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.array([len(r) + 1 for r in raws])
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    counts = np.diff(bounds)
    n = len(words) - SHINGLE + 1
    if n > 0:
        every = words[:n] * np.uint64(0x8CB92BA72F3D8DD7)
        for k, c in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F), 1):
            every = (every + words[k : k + n]) * np.uint64(c)
        every = mix64(every)
    else:
        every = np.zeros(0, dtype=np.uint64)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], dtype=np.uint64)
    long = counts >= SHINGLE
    if long.any():
        total = sizes[long]
        base = np.repeat(bounds[:-1][long] - np.concatenate([[0], np.cumsum(total)[:-1]]), total)
        target = np.repeat(at[:-1][long] - np.concatenate([[0], np.cumsum(total)[:-1]]), total)
        run = np.arange(total.sum())
        out[target + run] = every[base + run]
    for i in np.flatnonzero((counts > 0) & ~long):
        h = np.uint64(counts[i])
        for w in words[bounds[i] : bounds[i + 1]]:
            h = mix64(np.array([(h ^ w)], dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))[0]
        out[at[i]] = h
    return out, at, counts


def minhash_parameters(k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def minhash(hashes: np.ndarray, params: tuple[np.ndarray, np.ndarray], block: int = 8192) -> np.ndarray:
    """k minima of 32-bit values of a non-empty set of 64-bit hashes."""
    a, b = params
    out = None
    for i in range(0, len(hashes), block):
        low = ((hashes[i : i + block, None] * a + b) >> np.uint64(32)).min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def batches(rows: Iterable[pa.RecordBatch], limit: int = 2000) -> Iterator[pa.RecordBatch]:
    """Smaller slices of what Spark hands over."""
    for batch in rows:
        for i in range(0, batch.num_rows, limit):
            yield batch.slice(i, limit)


def hash_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About n rows of df (2 * n at most), the same for the same rows: those of the lowest hashes of key."""
    total = df.count()
    share = 1.0 if total <= n else n / total
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * n)
