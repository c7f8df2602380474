"""The training-data queries: thin, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat, collocations, containment, importance, language_id, neighbours, passages, pii, repeats, simhash, toxicity
from .near_dedup import near_duplicates

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out():
    return F.expr("crc32(cast(doc_id as string)) % 4 = 2")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(RANKS)
    both = bpe.decode(bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN), ranks)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(spark, docs))
    counts = [F.size(F.filter("pii_base", lambda x: x.kind == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(pii.BASE)]
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("pii_base")), 256).alias("base_sha256"), pii.listed(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    made = chat.format_conversations(turns.unionByName(extra)).select("conv_id", "formatted", "mask").withColumn("turns", chat.read_back(F.col("formatted")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.coalesce(t.role, F.lit("")), F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(chat.read_loss(F.col("formatted"), F.col("mask")), "")
    made = made.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), text.alias("said"), loss.alias("loss"))
    return made.select(
        "conv_id",
        "n_turns",
        F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labelled = docs.join(_read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").where(~_held_out())
    scored = toxicity.score(docs, toxicity.learn(labelled))
    score = F.col("tox_score")
    return scored.select("doc_id", _held_out().alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), F.size("tox_passages").alias("n_passages"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return passages.repeated_passages(docs).unionByName(passages.repeated_spans(docs))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(_read(spark, sf_dir, "documents"), shorter=repeats.PASSAGE)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("n_shorter").alias("n_passage_bytes"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.learn(docs.where(~_held_out())))
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_copies(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.importance_resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_neighbours, op3_decontamination, op4_bpe, op5_pii, op6_chat, op7_toxicity, op8_passages, op9_suffix_dedup, op10_language, op11_simhash, op12_importance, op13_collocations)}


def _chat_sql() -> str:
    """op6 in DuckDB: texts are escaped, marks counted by role, digests taken of the turns in order."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    t = chat.DEFAULT

    def escaped(text: str) -> str:
        text = f"replace({text}, '{chat.ESCAPE}', '{chat.ESCAPE}0')"
        for c in t.controls:
            text = f"replace({text}, {quote(c)}, {quote(c[0] + chat.ESCAPE + '1' + c[1:])})"
        return text

    marks = " ".join(f"WHEN {quote(r)} THEN {len(a) + len(b)}" for r, (a, b) in t.marks.items())
    marks += f" ELSE {sum(map(len, t.other))} + coalesce(1 + length({escaped('role')}), 1)"
    loss = ", ".join(map(quote, t.loss))
    said = "'</s>[INST] ok [/INST]'"
    return f"""
WITH turns AS (
  SELECT conv_id, turn::int AS turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said}))
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role IN ({loss})), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role IN ({loss})), '')) AS loss_sha256,
  sum(length({escaped('text')}) + CASE role {marks} END)::bigint AS formatted_chars
FROM turns GROUP BY conv_id"""


_COLLOCATIONS = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*)::bigint AS f FROM places, range(1, 4) ks(k) WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3),
total AS (SELECT lang, sum(f)::bigint AS n FROM f WHERE k = 1 GROUP BY 1),
cand AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, size, unnest(range(1, size)) AS k, w FROM cand),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, (1000000::hugeint * c.a * c.a // (l.f::hugeint * r.f))::bigint AS score FROM cuts c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : c.k], ' ') AND l.k = c.k
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ') AND r.k = c.size - c.k),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE size = 3) GROUP BY 1, 2),
kept AS (SELECT s.* FROM least s LEFT JOIN longer g USING (lang, phrase) WHERE g.a IS NULL OR 100 * g.a < 50 * s.a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, kept.a DESC, phrase)::bigint AS rank, phrase, kept.a AS a, l, r, n, score FROM kept JOIN total USING (lang)) WHERE rank <= 2000"""


ORACLE_SQL: dict[str, str] = {"op6_chat": _chat_sql(), "op13_collocations": _COLLOCATIONS}
