"""Toxic passages by maximum-scoring segments over token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import batches, hash_sample, in_batches

#: Labelled documents to learn from, tokens of the lexicon at most.
TRAIN_DOCS, LEXICON = 16_000, 20_000
#: Least |z| of a token of the lexicon: the one of these that predicts best across folds of the training rows.
LEAST_Z, FOLDS = (4.0, 3.0, 2.5, 2.0, 1.5), 4
#: Weight of the Dirichlet prior as a share of the counts, cost of a token outside the lexicon, bound of a token's score.
PRIOR, DRIFT, BOUND = 0.1, 0.25, 6.0
#: Expected number of chance segments of a passage's score in a document, at most.
SIGNIFICANT = 0.05

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def segments(at: np.ndarray, score: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in linear time.

    at and score are the positions and scores of the tokens that have one; each other token costs drift.
    Ruzzo and Tompa's scan: candidates are kept with the totals left and right of them, and merged with the
    nearest one that starts lower and ends lower.
    """
    out: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    below: list[int] = []  # of each candidate, the last earlier one whose total before is lower
    total, before = 0.0, -1
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        left = total - drift * (i - before - 1)
        total, before = left + s, i
        if s <= 0:
            continue
        first, right = i, total
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= left:
                j = below[j]
            if j < 0 or out[j][3] >= right:
                break
            first, left = out[j][0], out[j][2]
            del out[j:], below[j:]
            j = len(out) - 1
        out.append((first, i, left, right))
        below.append(j)
    return [(a, b, r - x) for a, b, x, r in out]


@dataclass
class Model:
    """A lexicon of token scores, the extreme-value parameters and the last logistic step."""

    lexicon: dict[str, float]
    rate: float = 1.0  # lambda
    scale: float = 1.0  # K
    slope: float = 1.0
    offset: float = -2.0

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = tokens(text)
        get = self.lexicon.get
        scores = np.array([get(w, 0.0) for w in words])
        at = np.flatnonzero(scores)
        return len(words), segments(at, scores[at] - DRIFT, DRIFT) if (scores > DRIFT).any() else []

    def surprise(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """ln(1 + the sum of the passages' scores above the level that chance reaches once in such a text)."""
        level = np.log(max(self.scale * n, 1e-9)) - np.log(SIGNIFICANT)
        return float(np.log1p(sum(max(0.0, self.rate * s - level) for _, _, s in found)))

    def probability(self, n: int, found: list[tuple[int, int, float]]) -> float:
        x = self.offset + self.slope * self.surprise(n, found)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _decay(scores: np.ndarray, share: np.ndarray, rest: float) -> float:
    """The positive root of sum(share * exp(rate * score)) + rest * exp(-rate * DRIFT) = 1."""
    f = lambda x: float((share * np.exp(x * (scores - DRIFT))).sum() + rest * np.exp(-x * DRIFT) - 1)
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _words(rows):
    """(fold, label, word) for each distinct word of each document."""
    for batch in batches(rows, 500):
        folds, labels, words = [], [], []
        for fold, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = set(tokens(text))
            words += own
            folds += [fold] * len(own)
            labels += [toxic] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array(labels, pa.int32()), pa.array(words, pa.string())], ["fold", "toxic", "word"])


def _lexicons(counts: DataFrame, without: int) -> list[Model]:
    """One uncalibrated model for each of LEAST_Z, from the counts of all folds but one (-1: of all)."""
    folds = [f for f in range(FOLDS) if f != without]
    counts = counts.select("word", *(sum((F.col(f"{y}_{f}") for f in folds[1:]), F.col(f"{y}_{folds[0]}")).alias(y) for y in ("y1", "y0"))).where("y1 + y0 > 0")
    n1, n0 = counts.agg(F.sum("y1"), F.sum("y0")).first()
    if not n1 or not n0:
        return [Model({}) for _ in LEAST_Z]
    prior = F.col("a")
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + PRIOR * (n1 + n0) - F.col(y) - prior))
    scored = counts.withColumn("a", PRIOR * (F.col("y1") + F.col("y0")))
    scored = scored.withColumn("d", odds("y1", n1) - odds("y0", n0)).withColumn("z", F.abs(F.col("d") / F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))))
    found = scored.where(F.col("z") >= min(LEAST_Z)).orderBy(F.desc("z"), "word").limit(LEXICON).select("word", "d", "y0", "z").collect()
    out = []
    for least in LEAST_Z:
        own = [x for x in found if x.z >= least]
        model = Model({x.word: float(np.clip(x.d, -BOUND, BOUND)) for x in own})
        if not any(s > DRIFT for s in model.lexicon.values()):
            model = Model({})
        else:
            share = np.array([x.y0 for x in own]) / n0
            model.rate = _decay(np.array([*model.lexicon.values()]), share, 1 - share.sum())
        out.append(model)
    return out


def _calibrate(model: Model, seen: list) -> float:
    """Sets scale, offset and slope from rows (toxic, n, scores in units of the rate); the log loss that is left."""
    clean = [r for r in seen if r.toxic == 0 and r.n]
    chance = sum(r.n * np.exp(-max(r.s, default=0.0)) for r in clean)
    model.scale = len(clean) / chance if chance else 1.0
    unit = Model({}, scale=model.scale)
    x = np.array([unit.surprise(r.n, [(0, 0, s) for s in r.s]) for r in seen])
    y = np.array([float(r.toxic) for r in seen])
    weights = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(40):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        weights += np.clip(np.linalg.solve(h, design.T @ (y - p) - 1e-2 * weights), -3, 3)
    model.offset, model.slope = map(float, weights)
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ weights, -30, 30))), 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on labelled(doc_id, text, toxic 0/1), about train_docs rows of it, chosen by a hash of doc_id.

    Equal texts count once. A token's score is its log-odds ratio between the classes' counts of documents,
    with a Dirichlet prior in proportion to the counts of both; tokens whose ratio is too few standard
    deviations from zero have none. How many is chosen by cross-validation within these rows (LEAST_Z), and the scale
    of the extreme-value law and the logistic step are fitted to scores of rows that the lexicon behind them
    hasn't seen. Rows with a null text or label don't count. Without rows of both classes, no text is toxic.
    """
    rows = hash_sample(labelled.where("text is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text"), "doc_id", train_docs)
    rows = rows.withColumn("h", F.xxhash64("text")).repartition("h")  # the sample's bound brings it to one task
    rows = rows.groupBy("h").agg(F.max("toxic").alias("toxic"), F.first("text").alias("text")).select(F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"), "toxic", "text").persist()
    counts = rows.transform(in_batches, _words, "fold int, toxic int, word string").groupBy("word").agg(*(F.count_if(F.expr(f"fold = {f} and toxic = {y}")).cast("double").alias(f"y{y}_{f}") for y in (1, 0) for f in range(FOLDS))).persist()
    try:
        models = _lexicons(counts, -1)
        if not any(m.lexicon for m in models):
            return Model({})
        folded = [_lexicons(counts, f) for f in range(FOLDS)]

        def features(rows):
            for batch in batches(rows, 500):
                toxic, at, n, s = [], [], [], []
                for fold, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for k, model in enumerate(folded[fold]):
                        size, found = model.scan(text)
                        toxic.append(label)
                        at.append(k)
                        n.append(size)
                        s.append([model.rate * x for *_, x in found])
                yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(at, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64()))], ["toxic", "k", "n", "s"])

        seen = rows.transform(in_batches, features, "toxic int, k int, n long, s array<double>").collect()
    finally:
        rows.unpersist()
        counts.unpersist()
    losses = [_calibrate(m, [r for r in seen if r.k == k]) if m.lexicon else np.inf for k, m in enumerate(models)]
    return models[int(np.argmin(losses))]


PASSAGES = T.ArrayType(T.StructType([T.StructField("first_token", T.IntegerType()), T.StructField("last_token", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))


def score(docs: DataFrame, model: Model, prefix: str = "tox") -> DataFrame:
    """docs with tox_score (0 to 1) and tox_passages (or another prefix) added.

    A passage is a maximal scoring segment of tokens whose score chance reaches less than SIGNIFICANT times in a
    text of this length. A text without tokens, null texts included, has no passage and the lowest score. Columns
    of these names are replaced, others pass through; repeated rows stay.
    """
    names = [f"{prefix}_score", f"{prefix}_passages"]
    docs = docs.drop(*names).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], PASSAGES)])
    arrow = pa.list_(pa.struct([("first_token", pa.int32()), ("last_token", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(rows):
        for batch in batches(rows, 1000):
            scores, passages = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                n, found = model.scan(text)
                scores.append(model.probability(n, found))
                told = [{"first_token": a, "last_token": b, "score": s, "expected": float(model.scale * n * np.exp(-model.rate * s))} for a, b, s in found]
                passages.append([x for x in told if x["expected"] <= SIGNIFICANT])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, arrow)], [*batch.schema.names, *names])

    return docs.transform(in_batches, run, schema)
