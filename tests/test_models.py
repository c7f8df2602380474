"""Fitted models, alias tables, noisy tables of large domains, order statistics and counts of many sets at once."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabveil.operators import distributions as dist, ordering, privacy, sampling, scores, sparse, synthesizers as syn, transformers as tr


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def people(spark, path, n=400):
    rows = [(f"r{i % 4}", f"n{i % 12}", None if i % 7 == 0 else "abc"[i % 3]) for i in range(n)]
    spark.createDataFrame(rows, "r string, n string, m string").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


CHAIN = [syn.Pair("r"), syn.Pair("n", ("r",)), syn.Pair("m", ("r", "n"))]
MODELS = {
    "marginal": lambda **kw: syn.MarginalSynthesizer(1.0, **kw),
    "uniform": lambda **kw: syn.UniformSynthesizer(1.0, **kw),
    "contingency": lambda **kw: syn.ContingencySynthesizer(1.0, **kw),
    "network": lambda **kw: syn.BayesNet(1.0, network=CHAIN, **kw),
    "learnt": lambda **kw: syn.BayesNet(50.0, **kw),
}


@pytest.mark.parametrize("kind", MODELS)
def test_a_fitted_model_needs_its_source_no_more(spark, tmp_path, kind):
    path = str(tmp_path / "t")
    model = MODELS[kind](seed="s").fit(people(spark, path))
    before = {k: sorted(map(repr, t.collect())) for k, t in model.tables_.items()}
    for f in (tmp_path / "t").iterdir():
        f.unlink()
    assert {k: sorted(map(repr, t.collect())) for k, t in model.tables_.items()} == before
    assert model.sample().count() == 400 and model.sample(30).columns == ["r", "n", "m"]


def test_each_fit_has_noise_of_its_own(spark, tmp_path):
    df = people(spark, str(tmp_path / "t"))
    cells = lambda m: {(r.r, r.n, r.m): r["count"] for r in m.tables_["contingency"].collect()}
    model = syn.ContingencySynthesizer(0.1)
    one, two = cells(model.fit(df)), cells(model.fit(df))
    assert one.keys() == two.keys() and one != two
    kept = syn.ContingencySynthesizer(0.1, seed="s")
    assert cells(kept.fit(df)) == cells(kept.fit(df))
    assert [r.p for r in privacy.dp_joint(df, "r", 1.0).orderBy("r").collect()] != [r.p for r in privacy.dp_joint(df, "r", 1.0).orderBy("r").collect()]


def test_counts_of_many_sets_take_one_scan(spark, tmp_path):
    df = people(spark, str(tmp_path / "t"))
    sets = [("r",), ("n", "r"), ("r", "n"), ("m",), ("r", "n", "m")]
    found = dist.grouped_counts(df, sets)
    assert plan(found).count("parquet") == 1 and plan(found).count("Aggregate") == 1
    for k, s in enumerate(sets):
        own = Counter({tuple(r[c] for c in s): r["count"] for r in found.where(F.col("__set") == k).collect()})
        assert own == Counter(tuple(r[c] for c in s) for r in df.collect())
    weighed = dist.grouped_counts(scores.collapsed(df), sets, "count")
    assert sorted(map(repr, weighed.collect())) == sorted(map(repr, found.collect()))
    wide = spark.range(5).select(*[(F.col("id") % (k + 1)).alias(f"c{k}") for k in range(130)])
    counts = dist.grouped_counts(wide, [(f"c{k}",) for k in range(130)])
    assert {(r["__set"], r.n) for r in counts.groupBy("__set").agg(F.sum("count").alias("n")).collect()} == {(k, 5) for k in range(130)}


def test_a_set_is_scored_once(spark, tmp_path, monkeypatch):
    asked = Counter()
    own = scores.score_all

    def counted(base, sets, function):
        asked.update(sets)
        return own(base, sets, function)

    monkeypatch.setattr(scores, "score_all", counted)
    rows = [(i % 2, i % 3, i % 2 + i % 3, i % 5, i * 7 % 4) for i in range(300)]
    model = syn.BayesNet(200.0, seed="s").fit(spark.createDataFrame(rows, "a int, b int, c int, d int, e int"))
    assert len(model.network_) == 5 and set(asked.values()) == {1} and set(asked) == set(model.scores_)


def masses(tables, keys):
    """The share of each value of each group, from the slots of the alias tables."""
    out = {}
    for r in tables.collect():
        own = out.setdefault(tuple(r[k] for k in keys), Counter())
        for s in r.slots:
            assert -1e-12 <= s.left <= 1 + 1e-12
            own[tuple(s.v)] += s.left * r.mass / len(r.slots)
            own[tuple(s.other)] += (1 - s.left) * r.mass / len(r.slots)
    return out


@pytest.mark.parametrize("shape", ["even", "one", "steep", "random", "ties"])
def test_alias_tables_hold_the_shares(spark, shape):
    rng, rows = random.Random(shape), []
    for g in range(6):
        n = rng.randrange(1, 60)
        p = {"even": lambda k: 1.0, "one": lambda k: 1.0 if k == n // 2 else 1e-9, "steep": lambda k: 2.0**-k, "random": lambda k: rng.random(), "ties": lambda k: rng.choice([1.0, 3.0])}[shape]
        weights = [p(k) for k in range(n)]
        rows += [(g, None if k == 0 else f"v{k:02}", w / sum(weights)) for k, w in enumerate(weights)]
    cells = spark.createDataFrame(rows, "g int, v string, p double").select("g", F.struct("v").alias("v"), "p")
    found = masses(sampling._aliases(cells, ["g"]), ["g"])
    for g, v, p in rows:
        assert abs(found[(g,)][(v,)] - p) < 1e-9


def test_draws_follow_the_distribution_in_one_table_and_in_several(spark, monkeypatch):
    p = [2.0 ** -(k % 9) for k in range(200)]
    table = spark.createDataFrame([(g, k, w * ((g or 0) + 1)) for g in (None, 1, 2) for k, w in enumerate(p)], "g int, v int, p double")
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int")).alias("g"))
    for slots in (1024, 16):
        monkeypatch.setattr(sampling, "SLOTS", slots)
        drawn = sampling.draw(rows, table, ["v"], "s", "id", ["g"])
        assert drawn.columns == ["id", "g", "v"]
        found = Counter((r.g, r.v) for r in drawn.collect())
        assert sum(found.values()) == 60_000
        for g in (None, 1, 2):
            for k, w in enumerate(p):
                want = 20_000 * w / sum(p)
                assert abs(found[g, k] - want) < 6 * math.sqrt(want) + 1
        alone = Counter(r.v for r in sampling.draw(spark.range(20_000), table.where("g = 1").select("v", "p"), ["v"], "s", "id").collect())
        assert all(abs(alone[k] - 20_000 * w / sum(p)) < 6 * math.sqrt(20_000 * w / sum(p)) + 1 for k, w in enumerate(p))
    lost = sampling.draw(spark.createDataFrame([(1, 9)], "id long, g int"), table, ["v"], "s", "id", ["g"])
    with pytest.raises(Exception, match="no distribution"):  # though nobody reads v
        lost.select("id").collect()


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(4)
    shapes = {
        "distinct": rng.permutation(60_000).astype(float),
        "ties": np.repeat([3.0, 7.0, 7.5], [30_000, 20_000, 100]),
        "third": np.concatenate([np.full(20_000, -1.0), rng.standard_normal(40_000)]),
        "steep": np.exp(rng.standard_normal(50_000) * 100),
        "few": np.array([2.0, 2.0, -5.0]),
    }
    for name, x in shapes.items():
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
        ranks = sorted({0, len(x) - 1, len(x) // 2, len(x) // 3, len(x) // 3 + 1})
        assert ordering.order_statistics(df, "x", ranks) == [np.sort(x)[r] for r in ranks], name
        shares = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
        assert np.allclose(ordering.quantiles(df, "x", shares), np.quantile(x, shares), rtol=1e-12), name
    empty = spark.createDataFrame([(None,)], "x double")
    assert ordering.quantiles(empty, "x", [0.5]) == [] and tr.edges_of(empty, "x", 3, strategy="quantile") == []
    with pytest.raises(ValueError):
        ordering.order_statistics(empty, "x", [0])


def test_order_statistics_of_ten_million_distinct_values(spark):
    n = 10_000_019  # a prime, so the products are a permutation
    df = spark.range(1, n).select(((F.col("id") * 7_654_321) % n).cast("double").alias("x"))
    ranks = [0, 1, 2_500_000, 5_000_000, n - 2]
    assert ordering.order_statistics(df, "x", ranks, n - 1) == [r + 1.0 for r in ranks]


def test_large_domains_are_drawn_not_built(spark):
    """10 ** 12 cells: observed cells of a large count stay, about max_cells others pass, all beyond the threshold."""
    df = spark.range(3000).select(*[F.concat(F.lit(f"{k}-"), (F.col("id") * (1, 3, 7, 9)[k] % 1000).cast("string")).alias(f"c{k}") for k in range(4)])
    df = df.unionAll(spark.range(500).select(*[F.lit(f"{k}-7").alias(f"c{k}") for k in range(4)]))
    found = privacy.dp_contingency(df, df.columns, 0.5, "s", max_cells=2000).collect()
    assert len({tuple(r)[:4] for r in found}) == len(found) and 1500 < len(found) < 2600
    own = {tuple(r)[:4]: r["count"] for r in found}
    assert abs(own[tuple(f"{k}-7" for k in range(4))] - 500) < 40
    least, chance = sparse.threshold(10**12, 2.0, 2000)
    assert min(own.values()) >= least and chance == 2e-9
    exact = privacy.dp_contingency(df, df.columns, math.inf, "s", max_cells=2000)
    assert Counter(map(tuple, exact.collect())) == Counter(map(tuple, dist.contingency(df, df.columns).collect()))
    joint = privacy.dp_joint(df, df.columns, 1.0, "s", max_cells=2000)
    assert abs(joint.agg(F.sum("p")).first()[0] - 1) < 1e-9
    wide = spark.range(400).select(*[(F.col("id") * (k + 3) % 100).alias(f"c{k}") for k in range(15)])  # 10 ** 30 cells
    assert 300 < privacy.dp_contingency(wide, wide.columns, 1.0, "s", max_cells=500).count() < 700
    model = syn.ContingencySynthesizer(1.0, seed="s", max_cells=2000).fit(df)
    assert model.sample(50).count() == 50


def test_drawn_cells_agree_in_law_with_dense_ones(spark):
    """The same small table both ways, many times: as many cells above 0, the same mean, nothing twice."""
    df = spark.createDataFrame([(i % 30, i * i % 20) for i in range(600)], "a int, b int")
    sizes = dist.cardinalities(df)
    cells = math.prod(sizes.values())
    seen, values = dist.contingency(df, ["a", "b"]), {c: df.select(c).distinct() for c in ("a", "b")}
    dense, drawn = [], []
    for k in range(6):
        dense += [max(0, r["count"]) for r in privacy.dp_contingency(df, ["a", "b"], 0.5, f"d{k}").collect()]
        rows = sparse.noisy_cells(seen, values, sizes, "count", 2.0, cells, f"d{k}").collect()
        assert len({(r.a, r.b) for r in rows}) == len(rows)
        drawn += [math.ceil(r["count"]) for r in rows] + [0] * (cells - len(rows))
    assert len(dense) == len(drawn) == 6 * cells
    for test in (lambda v: v > 0, lambda v: v > 2, lambda v: v > 5, lambda v: v):
        a, b = (np.array([test(v) for v in x], float) for x in (dense, drawn))
        assert abs(a.mean() - b.mean()) < 5 * math.sqrt((a.var() + b.var()) / len(a))


def test_an_experiment_reads_its_source_once(spark, tmp_path, monkeypatch):
    df = people(spark, str(tmp_path / "t"))
    read = Counter()
    own = scores.collapsed
    monkeypatch.setattr(scores, "collapsed", lambda x: (read.update(["source"]), own(x))[1])
    kinds = {"marginal": syn.MarginalSynthesizer, "uniform": syn.UniformSynthesizer, "contingency": syn.ContingencySynthesizer}
    found = syn.experiment(df, kinds, (0.5, 5.0), seed="s", path=str(tmp_path / "out"))
    for f in (tmp_path / "t").iterdir():
        f.unlink()
    got = {(r.synthesizer, r.epsilon): r.score for r in found.collect()}
    assert read == {"source": 1} and len(got) == 6
    again = people(spark, str(tmp_path / "t2"))
    for (name, epsilon), score in got.items():
        sample = spark.read.parquet(str(tmp_path / "out" / f"synthesizer={name}" / f"epsilon={epsilon}"))
        assert sample.count() == 400
        assert abs(kinds[name](epsilon, seed="s").fit(again).score(again, sample) - score) < 1e-12


def test_weights_stand_for_rows(spark, tmp_path):
    df = people(spark, str(tmp_path / "t"))
    for kind, made in MODELS.items():
        one, two = made(seed="s").fit(df), made(seed="s").fit(scores.collapsed(df), "count")
        assert one.n_ == two.n_ == 400 and one.schema_ == two.schema_, kind
        for name in one.tables_:
            near = lambda t: sorted(([*map(str, r[:-1])], round(r[-1], 9)) for r in t.collect())
            assert near(one.tables_[name]) == near(two.tables_[name]), kind
