"""Language identification: a bidirectional gated recurrent network over bytes that labels every position."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import POWERS, batches, hash_sample, in_batches, mix64, passes, prefix_hashes

#: Units of each direction, bytes of a sequence at most (longer words are cut into several), documents and words to learn from.
UNITS, REACH, TRAIN_DOCS, TRAIN_WORDS = 12, 48, 3000, 60_000
STEPS, BATCH, RATE = 900, 256, 0.02

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Network:
    """Weights of both directions and of the label layer; 3 * UNITS columns: update gate, reset gate, candidate."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @staticmethod
    def new(langs: list[str], seed: int = 5) -> Network:
        rng, h = np.random.default_rng(seed), UNITS
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
        w["v"] = rng.normal(0, 0.3, (2 * h, len(langs))).astype(np.float32)
        w["c"] = np.zeros(len(langs), dtype=np.float32)
        return Network(langs, w)

    def states(self, data: np.ndarray, d: str, kept: list | None = None) -> np.ndarray:
        """States after each column of data (sequences, steps); kept collects what the backward pass needs."""
        n, steps = data.shape
        h, table, u = UNITS, self.w[f"x{d}"], self.w[f"u{d}"]
        state = np.zeros((n, h), dtype=np.float32)
        out = np.empty((n, steps, h), dtype=np.float32)
        for t in range(steps):
            x, rec = table[data[:, t]], state @ u
            gates = _sigmoid(x[:, : 2 * h] + rec[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(x[:, 2 * h :] + r * rec[:, 2 * h :])
            if kept is not None:
                kept.append((state, z, r, c, rec[:, 2 * h :]))
            state = c + z * (state - c)
            out[:, t] = state
        return out

    def positions(self, data: np.ndarray, lengths: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Language probabilities at every position of left-aligned sequences."""
        steps = data.shape[1]
        back = np.clip(lengths[:, None] - 1 - np.arange(steps), 0, None)
        turned = np.take_along_axis(data, back, 1)
        forward = self.states(data, "f", None if kept is None else kept.setdefault("f", []))
        backward = self.states(turned, "b", None if kept is None else kept.setdefault("b", []))
        both = np.concatenate([forward, np.take_along_axis(backward, back[:, :, None], 1)], axis=2)
        logits = both @ self.w["v"] + self.w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        if kept is not None:
            kept |= {"both": both, "turned": turned, "back": back}
        return p

    def gradients(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradients, by backpropagation through time."""
        kept: dict = {}
        p = self.positions(data, lengths, kept)
        n, steps, _ = p.shape
        h = UNITS
        weight = ((np.arange(steps) < lengths[:, None]) / (lengths[:, None] * n)).astype(np.float32)
        loss = float(-(np.log(np.take_along_axis(p, labels[:, None, None], 2)[:, :, 0] + 1e-9) * weight).sum())
        dl = p * weight[:, :, None]
        dl[np.arange(n), :, labels] -= weight
        flat = dl.reshape(-1, dl.shape[2])
        g = {"v": kept["both"].reshape(-1, 2 * h).T @ flat, "c": flat.sum(axis=0)}
        db = dl @ self.w["v"].T
        turned = np.zeros_like(db[:, :, h:])
        inside = np.arange(steps) < lengths[:, None]
        rows = np.nonzero(inside)
        turned[rows[0], kept["back"][rows]] = db[:, :, h:][rows]
        for d, seq, grad in (("f", data, db[:, :, :h]), ("b", kept["turned"], turned)):
            u = self.w[f"u{d}"]
            gu, gx = np.zeros_like(u), np.zeros_like(self.w[f"x{d}"])
            dh = np.zeros((n, h), dtype=np.float32)
            for t in range(steps - 1, -1, -1):
                state, z, r, c, rec = kept[d][t]
                dh = dh + grad[:, t]
                da = np.empty((n, 3 * h), dtype=np.float32)
                da[:, :h] = dh * (state - c) * z * (1 - z)
                dc = dh * (1 - z) * (1 - c * c)
                da[:, h : 2 * h] = dc * rec * r * (1 - r)
                da[:, 2 * h :] = dc
                np.add.at(gx, seq[:, t], da)
                da[:, 2 * h :] = dc * r
                gu += state.T @ da
                dh = dh * z + da @ u.T
            g[f"u{d}"], g[f"x{d}"] = gu, gx
        return loss, g

    def train(self, words: list[bytes], labels: np.ndarray, counts: np.ndarray, seed: int = 7) -> Network:
        """Adam over batches of words drawn by count."""
        rng = np.random.default_rng(seed)
        draw = np.sqrt(counts.astype(np.float64))
        draw /= draw.sum()
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        for step in range(1, STEPS + 1):
            chosen = rng.choice(len(words), min(BATCH, 4 * len(words)), p=draw)
            data, lengths = matrix([words[i] for i in chosen])
            _, g = self.gradients(data, lengths, labels[chosen])
            rate = RATE * min(1, 4 * (1 - step / (STEPS + 1)))
            for k, (m, v) in moments.items():
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] * g[k] - v)
                self.w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Left-aligned bytes of words of 1 to REACH bytes, and their lengths."""
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max())
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), dtype=np.uint8).reshape(len(words), width), lengths


def label_texts(network: Network, raws: list[bytes]) -> np.ndarray:
    """Sum over the positions of each text of the probabilities of the languages.

    A sequence is a word with its punctuation, cut into pieces of REACH bytes if longer. Each distinct one is
    run once for a pass, whatever the number of its occurrences.
    """
    data = np.frombuffer(b" ".join(raws) + b" ", dtype=np.uint8)
    edge = np.diff(_SPACE[data].astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[len(ends) - len(starts) :]
    sums = np.zeros((len(raws), len(network.langs)))
    if not len(starts):
        return sums
    bounds = np.cumsum([len(r) + 1 for r in raws])
    pieces = -(-(ends - starts) // REACH)
    if (pieces > 1).any():
        k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        last = np.repeat(ends, pieces)
        starts = np.repeat(starts, pieces) + k * REACH
        ends = np.minimum(starts + REACH, last)
    _, down = POWERS.get(len(data) + 1)
    prefix = prefix_hashes(data)
    lengths = ends - starts
    keys = mix64((prefix[ends] - prefix[starts]) * down[starts] + lengths.astype(np.uint64))
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    start, length = starts[first], lengths[first]
    found = np.empty((len(first), len(network.langs)))
    order = np.argsort(length, kind="stable")
    bucket = np.where(length <= 16, length, -(-length // 8) * 8)[order]
    for part in np.split(order, np.flatnonzero(np.diff(bucket)) + 1):
        width = int(length[part].max())
        for at in range(0, len(part), 4096):
            rows = part[at : at + 4096]
            inside = np.arange(width) < length[rows][:, None]
            block = np.where(inside, data[np.minimum(start[rows][:, None] + np.arange(width), len(data) - 1)], 0)
            found[rows] = np.where(inside[:, :, None], network.positions(block, length[rows]), 0).sum(axis=1)
    doc = np.searchsorted(bounds, starts, side="right")
    for k in range(found.shape[1]):
        sums[:, k] = np.bincount(doc, weights=found[inverse, k], minlength=len(raws))
    return sums


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_words: int = TRAIN_WORDS) -> Network | None:
    """Fit on docs(doc_id, text, lang): words of train_docs documents at most, chosen by a hash of doc_id.

    Of their distinct (word, lang) at most train_words are taken, again by hash. Both bounds are the
    classifier's training sample; a word over REACH bytes is learnt in pieces, as it is read in identify(). Rows without text or lang don't count. None if nothing is left.
    """
    chosen = hash_sample(docs.where("text is not null and lang is not null").select("doc_id", "text", "lang"), "doc_id", train_docs)
    words = chosen.select("lang", F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("word")).where("word <> ''")
    counted = words.groupBy("word", "lang").agg(F.count("*").alias("n"))
    found = hash_sample(counted, "word", train_words).orderBy("word", "lang").collect()
    if not found:
        return None
    langs = sorted({r.lang for r in found})
    at = {x: i for i, x in enumerate(langs)}
    cut = [(raw[i : i + REACH], at[r.lang], r.n) for r in found if (raw := r.word.encode("utf-8", "replace")) for i in range(0, len(raw), REACH)]
    pieces, labels, counts = zip(*cut, strict=True)
    return Network.new(langs).train([*pieces], np.array(labels), np.array(counts))


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """docs with lang_pred and score in place of text.

    The label of a text is the language of the highest mean probability over its positions, and score that
    mean. A text that is null or has no letter is 'und' with a score of 0, as is every text without a
    network. Other columns pass through (columns named as the new ones are replaced); repeated rows stay.
    """
    docs = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    others = [c for c in docs.columns if c != "text"]

    def run(rows):
        for batch in batches(rows, 4000):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            pred, score = [], []
            for first, raws in passes(texts, 4 << 20):
                sums = label_texts(network, raws) if network else np.zeros((len(raws), 1))
                for i, row in enumerate(sums):
                    text = texts[first + i]
                    ok = network is not None and text is not None and any(map(str.isalpha, text))
                    best = int(row.argmax())
                    pred.append(network.langs[best] if ok else "und")
                    score.append(min(1.0, float(row[best] / row.sum())) if ok else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*others, "lang_pred", "score"])

    return docs.transform(in_batches, run, T.StructType([*docs.select(*others).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
