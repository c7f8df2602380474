import itertools
import random
import re

from tabveil.llm._shared import shingles_of, words_of
from tabveil.llm.passages import PIECE, RUN, repeated_passages, repeated_spans

LEAST = 20


def brute_force(rows):
    places = [(d, k, line) for d, t in rows for k, line in enumerate((t or "").split("\n")) if len(words_of(line)) >= LEAST]
    sets = [shingles_of(x) for *_, x in places]
    root = list(range(len(places)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    inverted = {}
    for i, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(i)
    for a, b in {p for ids in inverted.values() for p in itertools.combinations(ids, 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    groups = {}
    for i, (d, k, _) in enumerate(places):
        groups.setdefault(find(i), []).append((d, k))
    return sorted((d, k, *min(g)) for g in groups.values() if len(g) > 1 for d, k in g)


def result(df):
    return sorted((r.doc_id, r.paragraph, r.keeper_doc_id, r.keeper_paragraph) for r in df.collect())


def test_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(repeated_passages(docs)) == brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_inserted_passages_and_positions(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(60)
    rows = []
    for i in range(30):
        own = passage.split()
        if i % 3 == 1:
            own[rng.randrange(60)] = "changed"
        rows.append((i, "\n".join([words(25), "", " ".join(own), words(8)])))
    df = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert result(df) == brute_force(rows)
    texts = dict(rows)
    assert all(texts[r.doc_id][r.start : r.end] == texts[r.doc_id].split("\n")[2] for r in df.collect())


def test_edges(spark):
    long = "word " * 30_000
    rows = [(1, None, "a"), (2, "", "b"), (3, long, "c"), (4, long, None), (4, long, "d"), (5, "short line\nshort line", "e"), (None, long, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r.doc_id or 0), r.keeper_doc_id, r.kept) for r in repeated_passages(df).collect())
    assert got == [(0, None, True), (3, None, False), (4, None, False), (4, None, False)]
    assert repeated_passages(df.limit(0)).collect() == []


def occurrences(rows, n):
    """The places (doc, first word) of each run of n words."""
    places = {}
    for d, t in rows:
        words = words_of(t)
        for i in range(len(words) - n + 1):
            places.setdefault(tuple(words[i : i + n]), set()).add((d, i))
    return places


def check_spans(rows, df):
    """A row's first and last piece occur elsewhere, the first one in its keeper's line; each repeated run of RUN words has a piece in a row."""
    short, texts = occurrences(rows, PIECE), dict(rows)
    covered = {}
    for r in df.collect():
        text = texts[r.doc_id]
        at, words = len(words_of(text[: r.start])), words_of(text[r.start : r.end])
        assert len(words) == r.n_words >= PIECE and r.paragraph == text[: r.start].count("\n")
        for x in (words[:PIECE], words[-PIECE:]):
            assert len(short[tuple(x)]) > 1
        own = short[tuple(words[:PIECE])]
        keepers = sorted(x for x in own if x[0] == r.keeper_doc_id)[:20]  # of its places, the least where it is a piece
        assert r.keeper_paragraph in {line(texts[d], i) for d, i in keepers} and (not r.kept or (r.doc_id, at) in own)
        covered.setdefault(r.doc_id, []).append((at, at + len(words)))
    runs = [p for own in occurrences(rows, RUN).values() if len(own) > 1 for p in own]
    for d, i in runs:
        assert any(min(b, i + RUN) - max(a, i) >= PIECE for a, b in covered[d]), (d, i)
    return runs


def line(text, word):
    at = [m.start() for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text)][word]
    return text[:at].count("\n")


def test_spans_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert check_spans([(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()], repeated_spans(docs))


def test_spans_in_mid_line_and_over_short_lines(spark):
    rng = random.Random(6)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    inside, across = words(RUN), words(60).split()
    rows = [(i, f"{words(50 + i)} \u00e9\U0001f600 {inside.upper() if i % 2 else inside} {words(40)}") for i in range(6)]
    rows += [(10 + i, "\n".join([words(9), *(" ".join(across[j : j + 4 + i]) for j in range(0, 60, 4 + i)), words(7)])) for i in range(6)]
    rows += [(20, words(400)), (21, "again " * 3_000), (22, "once more " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_spans(rows, repeated_spans(df))
    found = {}
    for r in repeated_spans(df).collect():
        found.setdefault(r.doc_id, []).append((r.n_words, r.keeper_doc_id, r.kept))
    assert {*found} == {*range(6), *range(10, 16), 21, 22} and found[21] == [(3_000, 21, True)]
    assert all((0, k, d == k) in [(0, *x[1:]) for x in found[d]] for d in found if d < 20 for k in (10 * (d // 10),))
    assert not repeated_passages(df).where("doc_id < 20").count()


def test_spans_edges(spark):
    inside = " ".join(f"x{k}" for k in range(70))
    df = spark.createDataFrame([(None, inside, "a"), (1, inside, "b"), (1, inside, None), (2, None, "c"), (3, "", "d")], "doc_id long, text string, h string")
    got = sorted(((r.doc_id or 0), r.keeper_doc_id, r.kept) for r in repeated_spans(df).collect())
    assert got == [(0, None, True), (1, None, False)]
    assert repeated_spans(df.limit(0)).collect() == []


def test_one_keeper_among_rows_that_are_alike(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), (7, text), (7, text), (8, text + " x")]
    kept = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 5 and [r.doc_id for r in kept if r.kept] == [None]
    kept = repeated_passages(spark.createDataFrame(rows[2:], "doc_id long, text string")).collect()
    assert len(kept) == 3 and [r.doc_id for r in kept if r.kept] == [7]
