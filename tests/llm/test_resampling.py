"""SimHash, importance resampling and collocations against plain versions over the same rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabveil.llm import collocations, importance, queries, simhash

SF = "/root/testdata/sf0.001"
ROWS = [
    (100_001, "", "en"), (100_002, None, "en"), (None, "a b c d", None), (100_003, " \t ", "de"), (100_004, "ONE two", None), (100_004, "one TWO", None),
    (100_005, "Ünï " * 30, "xx"), (None, None, None), (100_006, "w " * 5000 + "end", "en"), (100_007, "x" * 300 + " y" * 40 + " " + "é" * 90, "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    return own.unionByName(spark.createDataFrame(ROWS, "doc_id long, text string, lang string")).withColumns({c: F.lit("x") for c in ("print", "n", "score", "k")})


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    """The least id of each fingerprint's component, by comparing all pairs."""
    x = np.array(sorted(set(prints)), np.uint64)
    root = {v: v for v in x.tolist()}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, v in enumerate(x):
        for w in x[i + 1 :][np.bitwise_count(x[i + 1 :] ^ v) <= 2].tolist():
            root[find(w)] = find(int(v))
    least = {}
    for p, i in zip(prints, ids, strict=True):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for p in prints]


def test_simhash_equals_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_print(r.text) for r in rows]
    want = Counter((r.doc_id, p, c) for r, p, c in zip(rows, prints, plain_components(prints, [r.doc_id for r in rows]), strict=True))
    got = Counter((r.doc_id, r.print & (1 << 64) - 1, r.component_id) for r in simhash.near_copies(docs).collect())
    assert got == want
    out = queries.op11_simhash(spark, SF).collect()
    assert all(re.fullmatch("[0-9a-f]{16}", r.fingerprint) for r in out) and len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert simhash.near_copies(docs.limit(0)).collect() == []


def test_crowded_lists_lose_no_link(spark, monkeypatch):
    """Fingerprints that share many bytes: lists beyond LIST and CHUNK give the same pairs."""
    rng = np.random.default_rng(5)
    x = (rng.integers(0, 1 << 62, 3, dtype=np.uint64)[rng.integers(0, 3, 1500)]) ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64))
    x = np.unique(np.concatenate([x, rng.integers(0, 1 << 63, 500, dtype=np.uint64)])).view(np.int64)
    far = np.bitwise_count(x[:, None].view(np.uint64) ^ x[None, :].view(np.uint64))
    want = {(int(min(x[i], x[j])), int(max(x[i], x[j]))) for i, j in zip(*np.nonzero(np.triu(far <= 2, 1)), strict=True)}
    prints = spark.createDataFrame([(v,) for v in x.tolist()], "print long")
    for most, chunk in ((256, 1024), (8, 16)):
        monkeypatch.setattr(simhash, "LIST", most)
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        with simhash.room(spark) as folder:
            found = [tuple(r) for r in simhash.links(prints, folder).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return words, [zlib.crc32(f.encode()) % 10000 for f in (*words, *map(" ".join, zip(words, words[1:], strict=False)))]


def plain_resampling(rows, target):
    own = [(i, *plain_features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in s}
    out, able = [], []
    for k, (i, words, f) in enumerate(own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words) >= 20:
            able.append(k)
    able.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(able[: 25 * len(able) // 100], 1):
        out[k][4] = rank
    return sorted(map(tuple, out), key=repr)


def test_importance_equals_brute_force(spark, docs):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = importance.importance_resample(docs, target)
    got = sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found.collect()), key=repr)
    assert got == plain_resampling([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    out = queries.op12_importance(spark, SF)
    assert dict(out.dtypes) == dict.fromkeys(("doc_id", "n_features", "weight", "score", "rank"), "bigint")
    assert importance.importance_resample(docs.limit(0), target).collect() == []
    twice = [r["rank"] for r in importance.importance_resample(spark.createDataFrame([(1, "a b " * 20)] * 8, "doc_id long, text string"), target.limit(0)).collect()]
    assert sorted(r for r in twice if r) == [1, 2]


def plain_collocations(rows, top):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= 10}
        kept = []
        for p, a in cand.items():
            if any(100 * b >= 50 * a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return out


def test_collocations_equal_brute_force(spark, docs, monkeypatch):
    noisy = spark.createDataFrame([("a b c\ta b.A B! c  a b\x0bb c" * 7, None), ("not\x00a \x1c b " * 12, "en"), ("Q R S " * 15 + "q r t " * 20, "zz"), ("p " * 40, "zz")], "text string, lang string")
    rows = docs.select("text", "lang").unionByName(noisy)
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    own = [(r.text, r.lang) for r in rows.collect()]
    got = [tuple(r[c] for c in names) for r in collocations.collocations(rows.withColumn("phrase", F.lit(1))).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_collocations(own, 2000)
    for name, value in (("SHARD_BYTES", 5000), ("RUN", 3000)):  # shards, runs and cuts of texts change nothing
        monkeypatch.setattr(collocations, name, value)
    cut = collocations._fragments
    monkeypatch.setattr(collocations, "_fragments", lambda text: cut(text, 500))
    assert {tuple(r[c] for c in names) for r in collocations.collocations(rows, 3).collect()} == plain_collocations(own, 3)
    assert collocations.collocations(rows.limit(0)).collect() == []


def test_collocations_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    found = queries.op13_collocations(spark, "/root/testdata/sf0.01")
    cur = con.execute(queries.ORACLE_SQL["op13_collocations"])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(found.columns)
    assert {tuple(r) for r in found.select(*names).collect()} == set(cur.fetchall())
