import itertools
import random

from tabveil.llm import linking
from tabveil.llm._shared import shingles_of
from tabveil.llm.linking import _rare_pairs
from tabveil.llm.near_dedup import deduplicate, near_duplicates

SF = "/root/testdata/sf0.001/documents.parquet"


def brute_force(rows):
    sets = {i: shingles_of(t) for i, t in rows}
    inverted = {}
    for i, s in sets.items():
        for x in s:
            inverted.setdefault(x, set()).add(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = {p for ids in inverted.values() if len(ids) > 1 for p in itertools.combinations(sorted(ids), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table_equals_brute_force(spark):
    docs = spark.read.parquet(SF)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == brute_force(rows)


def test_chains_and_groups_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows, text = [], list(base)
    for i in range(40):  # each a little further from the first: ends aren't similar, the chain links them
        rows.append((i, " ".join(text)))
        text[rng.randrange(120)] = f"x{i}"
    for i in range(60):  # copies around one centre at a similarity near the limit
        copy = [f"c{k}" for k in range(100)]
        for k in rng.sample(range(100), rng.choice([1, 2, 3])):
            copy[k] = f"y{i}_{k}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(300 + i, f"unrelated text number {i} of the series with words {i * 7} {i * 11}") for i in range(30)]
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)


def test_spread_turns_settle_no_components(spark, monkeypatch):
    rng = random.Random(21)
    rows = []
    for i in range(150):  # variants of one text, half of the pairs too far from each other
        own = [f"c{k}" for k in range(90)]
        for k in rng.sample(range(90), rng.choice([1, 2, 3])):
            own[k] = f"y{i}_{k}"
        rows.append((i, " ".join(own)))
    turns, settled = [], []
    scratch, components = linking.scratch, linking.connected_components
    monkeypatch.setattr(linking, "scratch", lambda df, label, folder=None: turns.append(label) or scratch(df, label, folder))
    monkeypatch.setattr(linking, "connected_components", lambda *a, **b: settled.append(1) or components(*a, **b))
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)
    assert turns.count("spread") > 1 and len(settled) <= 3


def test_a_common_passage_pairs_no_others(spark):
    rng = random.Random(9)
    words = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(80)
    rows = [(i, " ".join(words(rng.randrange(10, 80)) + passage + words(rng.randrange(10)))) for i in range(250)]
    rows += [(1000 + i, " ".join(passage + words(rng.randrange(1, 12)))) for i in range(40)]
    assert result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_force(rows)


def test_defined_edges(spark):
    rows = [(1, None, "x", 9), (2, "", "x", 9), (3, " \t\n ", "x", 9), (4, "Two WORDS", "x", 9), (5, "two words", "x", 9), (6, "a b c d e f", None, None), (6, "a b c d e f", None, None), (7, "w " * 50_000, "x", 9), (8, "w w w w w", "x", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, component long")
    got = sorted(tuple(r) for r in near_duplicates(df).collect())
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (6, 2, 6, True), (7, 1, 7, True), (8, 1, 7, False)]
    assert near_duplicates(df.limit(0)).collect() == []


def test_null_ids_take_their_class(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (3, "a b c d e f g"), (None, "other text")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {(3, 3): (3, True), (None, 3): (3, False), (None, 1): (None, True)}


def test_rare_pairs_lose_no_linked_pair_of_balls(spark, tmp_path):
    rng = random.Random(11)
    bases = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (12, 40, 150)]
    shared = [f"s{i}" for i in range(30)]
    texts = []
    for k in range(90):
        words = list(bases[k % 3])
        for _ in range(rng.randrange(1 + len(words) // 25)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(words + shared * (k % 4 == 0)))
    nodes = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    # balls of one to several members, at random; a ball is its own group
    ball = [rng.choice([k, k % 20]) for k in range(len(texts))]
    members = spark.createDataFrame([(k, b, b) for k, b in enumerate(ball)], "node long, ball long, group long")
    sets = [shingles_of(t) for t in texts]
    expected = {
        (min(ball[x], ball[y]), max(ball[x], ball[y]))
        for x in range(len(sets))
        for y in range(x)
        if ball[x] != ball[y] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])
    }
    found = {(r.a, r.b) for r in _rare_pairs(members, nodes, str(tmp_path)).distinct().collect()}
    assert expected and expected <= found


def test_many_far_variants_make_few_pairs(spark, tmp_path):
    """Variants of one text, mostly too far from each other: their maps tell it before they are paired."""
    rng = random.Random(12)
    rows = []
    for i in range(400):
        own = [f"c{k}" for k in range(90)]
        for k in rng.sample(range(90), rng.choice([2, 3])):
            own[k] = f"y{rng.randrange(2000)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "node long, text string")
    members = df.select("node", df.node.alias("ball"), df.node.alias("group"))
    sets = [shingles_of(t) for _, t in rows]
    near = {(x, y) for x, y in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y])}
    found = {(r.a, r.b) for r in _rare_pairs(members, df, str(tmp_path)).collect()}
    assert near <= found and len(found) < 0.35 * 400 * 399 / 2
    assert result(near_duplicates(df.withColumnRenamed("node", "doc_id"))) == brute_force(rows)


def test_rows_of_one_id_are_one_document(spark):
    one, two = [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    near = lambda t: t.replace("7 ", "7q ", 1)
    df = spark.createDataFrame([(5, one), (5, two), (2, near(two)), (3, near(one)), (9, "alone")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(2, 2), (3, 2), (5, 2), (9, 9)}


def test_deduplicate_null_ids_and_clashing_names(spark):
    x = " ".join(f"w{k}" for k in range(40))
    rows = [(None, x, 1), (3, x, 2), (None, "other", 3), (None, None, 4), (7, x + " more", 5), (8, None, 6), (8, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone long")
    assert sorted(r.gone for r in deduplicate(df).collect()) == [2, 3, 4, 6, 7]
    assert deduplicate(df).columns == df.columns and deduplicate(df.limit(0)).collect() == []
