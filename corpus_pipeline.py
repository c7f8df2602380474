"""From raw documents to token ids: five stages, each over all that the one before kept.

For every stage: a null or empty text has nothing to find, so its row stays; rows with a null doc_id are documents of their
own; rows that repeat a doc_id share its fate; an empty table gives an empty table; further columns, whatever their
names, pass through to the last stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabveil.llm import bpe, containment, near_dedup, pii, toxicity
from tabveil.llm._shared import scratch

#: Documents of this toxicity score and more go.
REJECT = 0.3
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by passages; the labels of the documents at hand train the scorer and are not looked up to decide.

    Without labels of both classes nothing is toxic, and all documents stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs.select("doc_id", "text").join(labels, "doc_id"))
    prefix = f"tox_{uuid.uuid4().hex}"  # no column of docs has such a name
    return toxicity.score(docs, model, prefix).where(F.col(f"{prefix}_score") < REJECT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group of near copies."""
    return near_dedup.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item; without items all stay."""
    return containment.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text."""
    return pii.redact(docs, pii.train(spark, docs)).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    ranks = bpe.read_ranks(RANKS)
    kept = docs.select("doc_id", "lang", "source", "text", F.sha2("text", 256).alias("digest"))
    # written between, so that one stage of Python workers does both in turn
    coded = bpe.decode(scratch(bpe.encode(kept, ranks, public_tokenizers.PATTERN), "ids"), ranks)
    same = F.sha2("decoded", 256).eqNullSafe(F.coalesce("digest", F.sha2(F.lit(""), 256)))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("lossless"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("pii", redact_personal_data), ("bpe", encode)]

#: Learned scores and merges are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of the documents of sf_dir that pass all stages; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return docs
