"""MinHash near-duplicate removal by an inverted join over signature coordinates."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import batches, in_batches, minhash, minhash_parameters, passes, scratch, shingle_hashes
from .linking import linked_components

#: Coordinates of a signature, and matches that a pair needs to be retained. Two sets of similarity 0.75
#: or more share fewer than 11 of 32 coordinates with a probability under 3e-7.
COORDINATES, MATCHES = 32, 11


def _key(own: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None


def _keyed(name: str):
    """Each row with the digest of its set beside it."""

    def run(rows):
        for batch in batches(rows, 500):
            keys = []
            for _, raws in passes(batch.column(batch.schema.get_field_index("text")).cast(pa.string()).to_pylist()):
                hashes, at, _ = shingle_hashes(raws)
                keys += [_key(np.unique(hashes[at[i] : at[i + 1]])) for i in range(len(raws))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, name])

    return run


def _signed(rows):
    params = minhash_parameters(COORDINATES)
    coordinate = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)
    for batch in batches(rows, 500):
        texts = batch.column(2).to_pylist()
        sizes, keys, tokens = [], [], []
        for _, raws in passes(texts):
            hashes, at, _ = shingle_hashes(raws)
            for i in range(len(raws)):
                own = np.unique(hashes[at[i] : at[i + 1]])
                sizes.append(len(own))
                keys.append(_key(own))
                tokens.append((minhash(own, params) | coordinate).astype(np.int64) if len(own) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "set_key", "tokens"])


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed, found): a row for each of docs(doc_id, text), and (set_key, component) for each set that an id has.

    A set is a node of its own; sets that rows of one doc_id have are linked, as they are one document.
    """
    hashed = F.xxhash64("text")  # with the id, tells rows apart that repeat an id
    signed = docs.select("doc_id", hashed.alias("text_hash"), "text").transform(in_batches, _signed, "doc_id long, text_hash long, n_shingles long, set_key binary, tokens array<long>")
    signed = scratch(signed, "signed")
    named = signed.where("set_key is not null and doc_id is not null")
    classes = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash", "tokens")).alias("one"))
    classes = classes.select("set_key", F.col("one.doc_id").alias("first"), "one.text_hash", "one.tokens").withColumn("node", F.monotonically_increasing_id())
    classes = scratch(classes, "classes")
    shown = classes.select("node", F.col("first").alias("doc_id"), "text_hash", "tokens")
    of_id = named.select("doc_id", "set_key").groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).where("low <> high").select("doc_id")
    same = named.select("doc_id", "set_key").distinct().join(of_id, "doc_id").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
    same = same.join(same.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")

    def texts(nodes: DataFrame) -> DataFrame:
        wanted = shown.select("node", "doc_id", "text_hash").join(nodes, "node")
        return docs.select("doc_id", hashed.alias("text_hash"), "text").join(wanted, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"])

    components = linked_components(shown.select("node", "tokens"), texts, MATCHES, same)
    components = classes.select("set_key", "node", "first").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = components.groupBy("component").agg(F.min("first").alias("least"))
    return signed, components.join(least, "component").select("set_key", F.col("least").alias("component"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id long, text string).

    Documents whose shingle sets have a Jaccard similarity of 0.75 or more are linked; component_id is the
    smallest doc_id that is reachable. Equal sets are joined first by a 128-bit digest and take part once.
    Null, empty or blank texts have no shingles and stay alone. Rows that repeat a doc_id are one document,
    whatever their texts: the links of each count for all. A null doc_id takes the component of its set, if an id has
    that set too, or else stays null and kept. Other columns are ignored.
    """
    signed, found = _linked(_plain(docs))
    rows = signed.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates() keeps: one document of each component.

    Rows that repeat a doc_id are one document and stay or go together. A row with a null id goes if an id has its
    set of shingles, and stays otherwise. Columns may have any names.
    """
    signed, found = _linked(_plain(docs))
    key = f"gone_{uuid.uuid4().hex}"  # no column of docs has this name
    gone = signed.where("doc_id is not null").join(found, "set_key").where("doc_id <> component").select(F.col("doc_id").alias(key)).distinct()
    gone = scratch(gone, "gone")
    kept = docs.where("doc_id is not null").join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")
    keyed = T.StructType([*docs.schema, T.StructField(key, T.BinaryType())])
    alone = docs.where("doc_id is null").transform(in_batches, _keyed(key), keyed)
    alone = alone.join(found.select(F.col("set_key").alias(key)), key, "left_anti").drop(key)
    return kept.unionByName(alone.select(*docs.columns))
