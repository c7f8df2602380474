"""Hand-computed cases, properties, and every query against its SQL twin."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tabveil.operators import distributions as dist, efficacy, metrics, privacy, scores, synthesizers as syn, transformers as tr
from tabveil.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(found):
    return sorted([tuple(round(v, 6) if isinstance(v, float) else v if isinstance(v, (int, str, type(None))) else str(v) for v in r) for r in found], key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = duck.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    assert rows(df.select(*[F.col(f"`{c}`") for c in cols]).collect()) == rows([tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()])


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_quantile_bins_and_their_inverse(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, 15.0, 33.0, None, 44.0, 14.0, 50.0])], "k long, x double")
    edges = tr.edges_of(df, "x", 3, 0, 50, "quantile")
    assert [round(e, 2) for e in edges] == [0, 14.33, 40.33, 50]
    binned = tr.bin_numeric(df, "x", 3, 0, 50, "quantile")
    spans = {(0.0, 14.33): (0, 13), (14.33, 40.33): (14, 39), (40.33, 50.0): (40, 49)}
    found = {r.k: r.x for r in binned.collect()}
    back = {r.k: r.x for r in tr.sample_from_bins(binned, "x", "k").collect()}
    assert sum(v is None for v in back.values()) == 1 and found[3] is None
    assert all(spans[tuple(found[k])][0] <= v <= spans[tuple(found[k])][1] for k, v in back.items() if v is not None)
    normal = lambda: [r.x for r in tr.sample_from_bins(binned, "x", "k", mean=25.0, std=10.0, seed="a").orderBy("k").collect()]
    assert normal() == normal()


def test_grouping_codes_of_the_alphabet(spark):
    letters = spark.createDataFrame([(i, chr(97 + i)) for i in range(26)], "k long, x string")
    codes = [r.x for r in tr.CategoryBins(10).fit(letters, ["x"]).transform(letters).orderBy("k").collect()]
    assert codes == [0, 0, 0, 1, 1, 2, 2, 2, 3, 3, 4, 4, 4, 5, 5, 6, 6, 6, 7, 7, 8, 8, 8, 9, 9, 9]


def test_distances_scores_and_survival(spark):
    a = spark.createDataFrame([("x",), ("y",)], "c string")
    b = spark.createDataFrame([("x",), ("x",)], "c string")
    assert round(metrics.js_marginal(a, b).first().distance, 6) == 0.464501
    two = scores.collapsed(spark.createDataFrame([(0, 0), (1, 1)], "a int, b int"))
    r = scores.scores(two, [("a", ("b",))]).first()
    assert round(r.r, 6) == 0.5 and round(r.mi, 6) == round(math.log(2), 6)
    assert round(privacy.r_sensitivity(1500), 9) == 0.002000889 and round(privacy.mi_sensitivity(1500), 9) == 0.010160098
    km = metrics.kaplan_meier(spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 1), (5, 0)], "t int, e int"), "t", "e").orderBy("time").collect()
    assert [round(x.survival, 6) for x in km] == [0.8, 0.8, 0.266667, 0.266667]


def test_parent_sets_budget_and_guards(spark):
    assert scores.maximal_parent_sets({"a": 2, "b": 3, "c": 5}, 6) == {frozenset("ab"), frozenset("c")}
    assert scores.maximal_parent_sets({"a": 2}, 0.5) == set()
    ledger = privacy.Ledger(1.0)
    ledger.spend("x", 0.7)
    with pytest.raises(ValueError):
        ledger.spend("y", 0.4)
    with pytest.raises(ValueError):
        syn.BayesNet(network=[syn.Pair("b", ("a",)), syn.Pair("a")])
    with pytest.raises(syn.NotFittedError):
        syn.MarginalSynthesizer().sample(3)
    with pytest.raises(ValueError):
        dist.domain(spark.range(100).withColumn("b", F.col("id")), ["id", "b"], 1000)


def test_models_restore_schema_nulls_and_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", True), (2, None, False), (1, "b", None)] * 40, "x int, y string, z boolean")
    for model in (syn.MarginalSynthesizer(math.inf, seed="s"), syn.ContingencySynthesizer(math.inf, seed="s"), syn.BayesNetNonPrivate(50.0, seed="s")):
        out = model.fit(df).sample(300)
        assert out.schema.simpleString() == df.schema.simpleString() and out.count() == 300
        assert {r.y for r in out.collect()} == {"a", "b", None}
    model.save(str(tmp_path / "m"))
    again = syn.Synthesizer.load(spark, str(tmp_path / "m"), "s")
    assert sorted(map(repr, again.sample(50).collect())) == sorted(map(repr, model.sample(50).collect()))


def test_releases_share_no_noise(spark):
    df = spark.createDataFrame([("Y", "N"), ("N", "Y"), ("Y", "Y")] * 20, "a string, b string")
    noisy = lambda c, e=1.0: {r[0]: r.p for r in privacy.dp_joint(df.select(F.col(c)), c, e, "s").collect()}
    one, two = noisy("a"), {r[0]: r.p for r in privacy.dp_joint(df.select(F.col("a").alias("b")), "b", 1.0, "s").collect()}
    assert all(one[k] != two[k] for k in one)
    assert [r.p for r in privacy.dp_conditional(df, "b", [], 1.0, "s").orderBy("b").collect()] != [r.p for r in privacy.dp_joint(df, "b", 1.0, "s").orderBy("b").collect()]
    counts = {e: {r.a: r["count"] for r in privacy.dp_contingency(df, "a", e, "s").collect()} for e in (0.01, 0.02)}
    assert (counts[0.01]["Y"] - 40) != 2 * (counts[0.02]["Y"] - 40)
    assert privacy.mi_sensitivity(1) == 0 and privacy.r_sensitivity(1) == 5
    with pytest.raises(ValueError):
        privacy.r_sensitivity(0)


def test_grouping_shares_are_noisy_and_spend_the_budget(spark):
    df = spark.createDataFrame([(i, "ab"[i % 4 == 0]) for i in range(40)] + [(99, None)], "k long, x string")
    shares = lambda **kw: {r["__v"]: round(r.p, 9) for r in tr.CategoryBins(2, **kw).fit(df, ["x"]).codes_["x"].collect()}
    assert shares(epsilon=math.inf) == {"a": round(30 / 41, 9), "b": round(10 / 41, 9)}
    assert shares(seed="s") == shares(seed="s") != shares(seed="t") and shares(seed="s") != shares(epsilon=math.inf)
    with pytest.raises(ValueError):
        shares(epsilon=0)


def test_an_unseen_parent_is_an_error(spark):
    df = spark.createDataFrame([("x", "p"), ("y", "q")] * 30, "a string, b string")
    model = syn.BayesNetNonPrivate(50.0, network=[syn.Pair("a"), syn.Pair("b", ("a",))], seed="s").fit(df)
    good = model.sample_remaining(spark.createDataFrame([(1, "x")], "k long, a string"), "k")
    assert [tuple(r) for r in good.collect()] == [(1, "x", "p")]
    with pytest.raises(Exception, match="no distribution"):
        model.sample_remaining(spark.createDataFrame([(1, "z")], "k long, a string"), "k").collect()


def test_dates_with_an_explicit_format(spark):
    df = spark.createDataFrame([("01/02/14", "02/07/14"), ("08/01/14", None), (None, None)], "d1 string, d2 string")
    got = [tuple(r) for r in tr.generalize_dates(df, ["d1", "d2"], "MM/dd/yy").collect()]
    assert got == [("2014-01", 36), ("2014-08", None), (None, None)]


def test_fitted_transformers_run_on_streams(spark, tmp_path):
    from tabveil.streaming.transforms import transform_stream

    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_retailprice")
    part.write.parquet(str(tmp_path / "in"))
    bins = tr.ContinuousBins(4).fit(part, ["p_retailprice"])
    transform_stream(spark, str(tmp_path / "in"), part.schema, bins.transform, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(bins.transform(part)).count() == 0


def test_transformers_know_whether_they_are_fitted(spark):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, 7.0, "b")], "k long, x double, c string")
    for t in (tr.ContinuousBins(2), tr.CategoryBins(2, seed="s"), tr.RareCategories(), tr.Scheme({"c": {"a": "z"}})):
        with pytest.raises(syn.NotFittedError):
            t.transform(df)
    with pytest.raises(ValueError):
        tr.ContinuousBins(2).fit(df, ["no"])
    whole = spark.createDataFrame([(1, 3), (2, 9)], "k long, x int")
    bins = tr.ContinuousBins(2).fit(whole, ["x"])
    assert bins.inverse_transform(bins.transform(whole), "k").schema["x"].dataType == whole.schema["x"].dataType
    scheme = tr.Scheme({"c": {"a": "z", "b": "z"}}).fit(df)
    assert {r.c for r in scheme.transform(df).collect()} == {"z"} and {r.c for r in scheme.inverse_transform(scheme.transform(df), "k").collect()} <= {"a", "b"}


def test_tuned_classifiers_and_the_last_column(spark):
    rows = [(float(i % 17), i % 3 == 0, "ab"[i % 2], int(i % 17 > 8)) for i in range(240)]
    df = spark.createDataFrame(rows, "x double, flag boolean, c string, y int")
    found = efficacy.ClassifierComparison(tune=True, grid={"c": [0.01, 1.0]}).fit(df, df)
    assert found.y == "y" and found.score(df)["original"] > 0.95
    names = {r.feature for r in efficacy.FeatureImportanceComparison().fit(df, df).aligned().collect()}
    assert any("flag" in n and "true" in n for n in names) and any(n.startswith("c") for n in names)
    assert efficacy.tuned("rf", 100).getNumFolds() == 3 and len(efficacy.tuned("rf", 100).getEstimatorParamMaps()) == 18


def test_survival_of_two_tables_and_the_original_evaluator(spark):
    df = spark.createDataFrame([(1.0, 1, "g"), (2.0, 0, "g"), (3.0, 1, "h"), (3.0, 1, "h"), (5.0, 0, "h")], "t double, e int, g string")
    curves = metrics.SurvivalComparison("t", "e", "g").fit(df, df.where("t < 3")).plot_data().collect()
    assert {(r.table, r.group) for r in curves} == {("original", "g"), ("original", "h"), ("artificial", "g")}
    assert [round(r.survival, 6) for r in sorted(curves, key=lambda r: r.time) if (r.table, r.group) == ("original", "h")] == [0.333333, 0.333333]
    seen = metrics.OriginalEvaluator(2).fit(df)
    assert {r["column"] for r in seen.stats().collect() if r.finding == "high_cardinality"} == {"t"} and {r["column"] for r in seen.plot_data().collect()} == {"e", "g"}
    big = spark.range(5000).select(((F.col("id") * 37) % 4001).cast("double").alias("t"), (F.col("id") % 3 == 0).cast("int").alias("e"))
    own = metrics.kaplan_meier(big, "t", "e").orderBy("time").collect()
    times, left, s = Counter((i * 37) % 4001 for i in range(5000)), 5000, 1.0
    for r in own:
        assert r.at_risk == left
        s *= 1 - r.events / left
        left -= times[int(r.time)]
        assert abs(r.survival - s) < 1e-9
