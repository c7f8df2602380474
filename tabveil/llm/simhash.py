"""SimHash near-duplicates by an inverted index over the positional bytes of 64-bit fingerprints."""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._shared import batches, in_batches, room, scratch, words_of
from .components import connected_components

#: Words of a shingle, and the seed of its XXH64.
WORDS, SEED = 3, 42
#: Bits in which linked fingerprints differ at most, so they share BYTES - BITS positional bytes at least.
BITS, BYTES = 2, 8
#: Fingerprints of one list that meet directly; those of longer lists are posted again under six bytes.
LIST = 256
#: Fingerprints of a six-byte list that one task pairs with all the others.
CHUNK = 1024
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def _shingles(words: list[bytes]):
    if len(words) < WORDS:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))


def fingerprint(text: str | None) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; 0 without words."""
    hashes, votes, n = (xxhash.xxh64_intdigest(s, SEED) for s in _shingles(words_of(text))), np.zeros(64, np.int64), 0
    while len(part := np.fromiter(islice(hashes, BLOCK), np.uint64)):
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.int64)[0])


def _printed(rows):
    for batch in batches(rows, 500):
        prints = [fingerprint(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (64 bits as a signed long) of each row of docs(doc_id, text)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.transform(in_batches, _printed, "doc_id long, print long")


def _byte(p: str, k: int):
    return F.shiftrightunsigned(p, 8 * k).bitwiseAND(F.lit(255).cast("long"))


#: Sets of four positional bytes: two of the four pairs of neighbouring bytes. Two bytes that differ spoil two pairs at
#: most, so fingerprints that share six bytes have one of the six sets in common.
FOURS = [(*a, *b) for a, b in combinations([(k, k + 1) for k in range(0, BYTES, 2)], 2)]
#: All sets of six positional bytes, by the two that are left out.
SIXES = [*combinations(range(BYTES), BITS)]


def _linked(pairs_on: str) -> str:
    """Of a pair x, y: equal keys, then the tally of shared positional bytes, then the bits themselves."""
    shared = " + ".join(f"cast((shiftrightunsigned(x.print ^ y.print, {8 * k}) & 255) = 0 as int)" for k in range(BYTES))
    return f"{pairs_on} and x.print < y.print and {shared} >= {BYTES - BITS} and bit_count(x.print ^ y.print) <= {BITS}"


def links(prints: DataFrame, folder: str) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in BITS bits at most.

    prints(print) holds each fingerprint once. It is posted under each set of four positional bytes; the fingerprints of
    a list tally their shared bytes, and pairs that reach the guaranteed minimum are verified. A list of more than LIST
    fingerprints, which all share four bytes, is resolved by lists of six bytes, of 65,536 fingerprints at most by
    their nature; these are dealt in chunks, so that no task meets a whole one. Nothing is dropped either way.
    """
    keys = [F.struct(F.lit(i).alias("set"), sum((F.shiftleft(_byte("print", k), 8 * j) for j, k in enumerate(s)), F.lit(0).cast("long")).alias("bytes")) for i, s in enumerate(FOURS)]
    posted = prints.select("print", F.explode(F.array(*keys)).alias("key")).select("print", "key.set", "key.bytes")
    sizes = posted.groupBy("set", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    posted = scratch(posted.join(sizes, ["set", "bytes"]), "posted", folder)
    few = posted.where(F.col("n") <= LIST)
    found = few.alias("x").join(few.alias("y"), F.expr(_linked("x.set = y.set and x.bytes = y.bytes")))

    crowded = posted.where(F.col("n") > LIST).select("print").distinct()
    sixes = [F.struct(F.lit(i).alias("set"), F.expr(f"print & {_signed(~sum(255 << 8 * k for k in out))}").alias("bytes")) for i, out in enumerate(SIXES)]
    again = crowded.select("print", F.explode(F.array(*sixes)).alias("key")).select("print", "key.set", "key.bytes")
    sizes = again.groupBy("set", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    again = scratch(again.join(sizes, ["set", "bytes"]).withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int")), "again", folder)
    one = again.withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    all_ = again.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    more = one.alias("x").join(all_.alias("y"), F.expr(_linked("x.set = y.set and x.bytes = y.bytes and x.part = y.part")))
    both = [f.select(F.col("x.print").alias("a"), F.col("y.print").alias("b")) for f in (found, more)]
    return both[0].unionByName(both[1]).distinct()


def _signed(x: int) -> str:
    """A 64-bit pattern as a literal of SQL."""
    x &= (1 << 64) - 1
    return f"cast('{x - (1 << 64) if x >> 63 else x}' as bigint)"


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, print, component_id for each row of docs(doc_id long, text string).

    Rows whose fingerprints differ in BITS bits at most are linked; component_id is the smallest doc_id that is reachable.
    Null, empty and blank texts have the fingerprint zero and are linked like any other. Equal fingerprints are one node, so
    copies cost one posting however many they are. Rows that repeat a doc_id are linked by their fingerprints only; a row
    with a null id gets the smallest id of its component, or null if there is none. Other columns are ignored; an empty
    table gives an empty table.
    """
    with room(docs.sparkSession) as folder:
        prints = scratch(fingerprints(docs), "prints", folder)
        classes = scratch(prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes", folder)
        found = connected_components(scratch(links(classes.select("print"), folder), "links", folder))
        named = classes.join(found.withColumnRenamed("node", "print"), "print", "left")
        named = named.withColumn("component", F.coalesce("component", "print"))
        least = named.groupBy("component").agg(F.min("first").alias("component_id"))
        named = scratch(named.join(least, "component").select("print", "n", "component_id"), "named", folder)
        # fingerprints of more than a thousandth of all rows are a thousand at most: their rows stay where they are
        total = prints.count()
        crowded = F.col("n") * 1000 > total
        own = named.where(crowded).select("print", F.struct("component_id").alias("of"))
        rows = prints.join(F.broadcast(own), "print", "left")
        rest = rows.where("of is null").drop("of").join(named.where(~crowded).drop("n"), "print")
        out = rows.where("of is not null").select("doc_id", "print", "of.component_id").unionByName(rest.select("doc_id", "print", "component_id"))
        return scratch(out, "simhash")
