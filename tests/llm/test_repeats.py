import random

from tabveil.llm.queries import op9_suffix_dedup
from tabveil.llm.repeats import PASSAGE, cut_repeats


def brute_force(rows, length):
    raws = [(t or "").encode() for _, t in rows]
    seen = {}
    for k, r in enumerate(raws):
        for i in range(len(r) - length + 1):
            seen.setdefault(r[i : i + length], []).append((k, i))
    gone = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    out = []
    for (doc, _), r, g in zip(rows, raws, gone, strict=True):
        spans, at = [], 0
        while at < len(g):
            if g[at]:
                end = g.find(0, at)
                end = len(g) if end < 0 else end
                spans.append((at, end))
                at = end
            else:
                at += 1
        out.append((doc, len(r), tuple(spans), bytes(x for x, y in zip(r, g, strict=True) if not y)))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in df.collect())


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert result(cut_repeats(docs)) == brute_force([(r.doc_id, r.text) for r in docs.collect()], 400)


def test_ends_of_repeats_at_every_offset(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    core = letters(160)
    rows = [(i, letters(rng.randrange(60)) + core[rng.randrange(40) : 160 - rng.randrange(60)] + letters(rng.randrange(60))) for i in range(120)]
    rows += [(200, "ab" * 150), (201, "a" * 90), (202, "x" * 63), (203, "y" * 65), (204, "b" + "a" * 70), (205, core), (206, core), (207, core + core)]
    rows += [(300, None), (301, ""), (302, "short")]
    for length in (64, 65, 100):
        assert result(cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length)) == brute_force(rows, length)


def test_edges(spark):
    long = "".join(chr(97 + (i * i // 7) % 26) for i in range(120_000))
    df = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (2, "t" * 399, None), (2, "t" * 399, None)], "doc_id long, text string, key string")
    assert [(r.doc_id, r.n_bytes, len(r.kept)) for r in cut_repeats(df).orderBy("doc_id").collect()] == [(1, 120_000, 0)] * 2 + [(2, 399, 399)] * 2
    assert cut_repeats(df.limit(0)).collect() == []


def covered(rows, length):
    return {doc: sum(b - a for a, b in spans) for doc, _, spans, _ in brute_force(rows, length)}


def test_shorter_repeats_are_told_and_stay(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    core = letters(160)
    rows = [(i, letters(rng.randrange(60)) + core[rng.randrange(80) : 160 - rng.randrange(79)] + letters(rng.randrange(60))) for i in range(120)]
    rows += [(200, "ab" * 150), (201, "a" * 90), (202, "x" * 63), (203, letters(70)), (204, core), (205, core), (206, core[:70] + core[:110] + letters(9) + core[:110])]
    rows += [(207, "y" * 50), (208, "z" * 50), (209, "z" * 50), (300, None), (301, ""), (302, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for length, shorter in ((64, 40), (100, 40), (64, 64)):
        found = cut_repeats(df, length, shorter)
        assert result(found) == brute_force(rows, length)
        assert {r.doc_id: r.n_shorter for r in found.collect()} == covered(rows, shorter)


def test_query_tells_passages_of_fifty_words(spark, tmp_path):
    """A passage of 55 words and 329 bytes in two documents, too short for the contract's 400."""
    word = lambda k, n: " ".join(f"{k}{i:04d}" for i in range(n))
    passage = word("w", 55)
    rows = [(1, f"{word('a', 200)} {passage} {word('b', 200)}"), (2, f"{word('c', 90)} {passage} {word('d', 90)}"), (3, word("e", 300))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_removed, r.n_passage_bytes) for r in op9_suffix_dedup(spark, str(tmp_path)).collect()}
    assert found == {doc: (0, n) for doc, n in covered(rows, PASSAGE).items()}
    assert found[1][1] >= len(passage) and found[2][1] >= len(passage) and found[3] == (0, 0)
