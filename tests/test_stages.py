"""Transformers in pipelines, steps for frames, sequences and the normal distribution as columns."""

import math
from statistics import NormalDist

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, functions as F

from tabveil.functions import normal_cdf, normal_quantile
from tabveil.operators import frames, sequences as seq, stages, synthesizers as syn, transformers as tr


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, float(k * k % 37), "abcde"[k % 5] if k % 11 else None, "xy"[k % 9 == 0], f"{1 + k % 12:02}/{1 + k % 28:02}/14", f"{1 + k % 12:02}/{2 + k % 27:02}/15") for k in range(200)]
    return spark.createDataFrame(data, "k long, x double, c string, d string, d1 string, d2 string")


def kinds():
    return [
        (tr.ContinuousBins(4, "quantile", {"x": [0.0]}), ["x"]),
        (tr.CategoryBins(3, seed="s"), ["c", "d"]),
        (tr.CategoryBins(2, math.inf, strategy="quantile", missing=True), ["c"]),
        (tr.RareCategories(0.2, "few"), ["c", "d"]),
        (tr.Scheme({"c": {"a": "v", "e": "v"}}, "w"), None),
        (seq.DateSequence(["d1", "d2"], "MM/dd/yy"), None),
    ]


def same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.schema == b.schema


def test_stages_survive_saving_in_a_pipeline_without_their_source(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    source = spark.read.parquet(str(tmp_path / "t"))
    for k, (transformer, columns) in enumerate(kinds()):
        path = str(tmp_path / f"p{k}")
        Pipeline(stages=[stages.TableTransform(transformer, columns)]).write().save(path + "-new")
        fitted = Pipeline.load(path + "-new").fit(source)
        fitted.write().save(path)
        back = PipelineModel.load(path)
        own = fitted.stages[0]
        assert back.stages[0].uid == own.uid and type(back.stages[0].transformer) is type(transformer)
        assert same(back.transform(rows), own.transformer.transform(rows)), transformer
        if not isinstance(transformer, tr.RareCategories):
            coded = own.transform(rows)
            assert same(back.stages[0].inverse_transform(coded, "k", "z"), own.inverse_transform(coded, "k", "z"))
        assert not hasattr(transformer, "types_")  # a stage fits a copy
    for f in (tmp_path / "t").iterdir():
        f.unlink()
    assert PipelineModel.load(str(tmp_path / "p1")).transform(rows).count() == 200
    with pytest.raises(syn.NotFittedError):
        stages.TableModel(tr.ContinuousBins(2))
    both = Pipeline(stages=[stages.TableTransform(t, c) for t, c in (kinds()[0], kinds()[1])]).fit(rows).transform(rows)
    assert both.where("x > 3 or d not in (0, 1, 2)").count() == 0


def test_categories_by_quantiles_and_missing_ones(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate("a" * 60 + "b" * 20 + "c" * 15 + "d" * 5)] + [(100, None)], "k long, x string")
    codes = lambda **kw: {r.x: r.y for r in tr.CategoryBins(2, math.inf, **kw).fit(df, ["x"]).transform(df.withColumn("y", F.col("x"))).select(F.col("y").alias("x"), F.col("x").alias("y")).distinct().collect()}
    assert codes() == {"a": 0, "b": 0, "c": 1, "d": 1, None: None}
    with pytest.warns(UserWarning, match="merged"):  # the median is the least code
        assert codes(strategy="quantile") == {"a": 0, "b": 0, "c": 0, "d": 0, None: None}
    assert codes(missing=True) == {"a": 0, "b": 0, "c": 1, "d": 1, None: 1}
    bins = tr.CategoryBins(1, math.inf, missing=True).fit(df, ["x"])
    back = [r.x for r in bins.inverse_transform(bins.transform(df), "k", "s").collect()]
    assert len(back) == 101 and set(back) <= {"a", "b", "c", "d", None}


def test_steps_and_methods_of_frames(spark, rows):
    chain = rows.transform(frames.STEPS["replace_rare"]("c", 0.19)).transform(frames.STEPS["pseudonyms"]("d", "k", "who"))
    assert same(chain, tr.pseudonyms(tr.replace_rare(rows, "c", 0.19), "d", "k", "who"))

    @frames.register
    def doubled_for_a_test(df, column):
        return df.withColumn(column, F.col(column) * 2)

    try:
        with pytest.raises(ValueError):
            frames.register(doubled_for_a_test)
        frames.attach("bin_numeric", "sample_from_bins", "replace_rare", "group_rare", "specialize", "pseudonyms", "add_ids", "doubled_for_a_test")
        made = rows.bin_numeric("x", 4).sample_from_bins("x", "k").replace_rare("c", 3).group_rare(["d"], 0.2).specialize("d", {"z": "x"}, "k").pseudonyms("c", "k").add_ids("k").doubled_for_a_test("k")
        assert made.columns == [*rows.columns, "id"] and made.agg(F.sum("k")).first()[0] == 2 * sum(range(200))
        frames.FUNCTIONS["select"] = doubled_for_a_test
        with pytest.raises(ValueError):
            frames.attach("select")
    finally:
        for name in ("select", "doubled_for_a_test"):
            frames.FUNCTIONS.pop(name, None)
            frames.STEPS.pop(name, None)
        for name in [*frames.FUNCTIONS, "doubled_for_a_test"]:
            if name in vars(DataFrame):
                delattr(DataFrame, name)


def test_records_side_by_side_and_back(spark):
    df = spark.createDataFrame([("p", 5, "r", 1.5), ("p", 2, "s", None), ("q", 1, None, 2.0), ("q", 9, "t", 3.0)], "k string, at int, a string, b double")
    flat = seq.flatten_records(df, "k", "at", ["a", "b"], 3)
    back = seq.unflatten_records(flat, ["k"], ["a", "b"], 3)
    assert {tuple(r) for r in back.collect()} == {("p", 1, "s", None), ("p", 2, "r", 1.5), ("q", 1, None, 2.0), ("q", 2, "t", 3.0)}
    assert back.schema["b"].dataType == df.schema["b"].dataType
    texts = spark.createDataFrame([("p", "1", None, "3")], "k string, v1 string, v2 string, v3 string")
    typed = seq.unflatten_records(texts, ["k"], ["v"], 3, "n", {"v": "int"})
    assert [tuple(r) for r in typed.orderBy("n").collect()] == [("p", 1, 1), ("p", 2, 3)] and dict(typed.dtypes)["v"] == "int"
    steps = spark.createDataFrame([(1, "a", "b", "c"), (2, "a", None, "c"), (3, "a", None, None), (4, None, None, None), (5, None, "b", None)], "id int, s1 string, s2 string, s3 string")
    assert {r.id for r in seq.consistent_sequences(steps, ["s1", "s2", "s3"]).collect()} == {1, 3, 4}
    assert {(r.id, r.gap) for r in seq.consistent_sequences(steps, ["s1", "s2", "s3"], errors=True).collect()} == {(2, 2), (5, 1)}
    for bad in (lambda: seq.consistent_sequences(steps, ["s1"]), lambda: seq.unflatten_records(texts, ["k"], ["w"], 3), lambda: seq.flatten_records(df, "k", "at", ["a"], 0)):
        with pytest.raises(ValueError):
            bad()
    dates = seq.DateSequence(date_format="MM/dd/yy").fit(spark.createDataFrame([("01/02/14", "02/07/14"), (None, "03/04/14")], "d1 string, d2 string"))
    coded = dates.transform(spark.createDataFrame([(7, "01/02/14", "02/07/14"), (8, None, "03/04/14")], "k int, d1 string, d2 string"))
    assert [tuple(r) for r in coded.orderBy("k").collect()] == [(7, "2014-01", 36), (8, None, None)]
    out = dates.inverse_transform(coded, "k").orderBy("k").collect()
    assert out[0].d1.startswith("01/") and out[0].d1.endswith("/14") and tuple(out[1]) == (8, None, None)


def test_the_normal_distribution_as_columns(spark):
    z = [k / 16 for k in range(-16 * 36, 16 * 36 + 1)] + [-400.0, 400.0]
    p = [10.0**-k for k in range(1, 300, 7)] + [k / 500 for k in range(1, 500)] + [1 - 2.0**-k for k in range(2, 50)]
    normal = NormalDist()
    for r in spark.createDataFrame([(x,) for x in z], "x double").select("x", normal_cdf(F.col("x")).alias("y")).collect():
        want = math.erfc(-r.x / math.sqrt(2)) / 2
        assert abs(r.y - want) <= 2e-14 and (want == 0 or r.x > 0 or abs(r.y / want - 1) < 2e-6)
    for r in spark.createDataFrame([(x,) for x in p], "x double").select("x", normal_quantile(F.col("x")).alias("y")).collect():
        assert math.isclose(r.y, normal.inv_cdf(r.x), rel_tol=1e-12, abs_tol=1e-15)
    assert spark.range(1).select(normal_cdf(F.lit(None).cast("double")).alias("a"), normal_quantile(F.lit(None).cast("double")).alias("b")).first() == (None, None)


def test_truncated_normal_draws_follow_their_law(spark):
    rows = tr.bin_numeric(spark.range(30_000).select("id", F.lit(12.0).alias("x")), "x", 2, 10, 30)
    drawn = sorted(r.x for r in tr.sample_from_bins(rows, "x", "id", "float", 14.0, 5.0, "s").collect())
    own = NormalDist(14.0, 5.0)
    low, high = own.cdf(10.0), own.cdf(20.0)
    assert 10 <= drawn[0] and drawn[-1] <= 20
    assert max(abs((own.cdf(x) - low) / (high - low) - (k + 0.5) / len(drawn)) for k, x in enumerate(drawn)) < 0.015


def test_arguments_are_guarded(spark, rows):
    for bad in (
        lambda: tr.bin_numeric(rows, "x", 0), lambda: tr.bin_numeric(rows, "x", 3, 9, 1), lambda: tr.bin_numeric(rows, "x", 3, strategy="other"),
        lambda: tr.ContinuousBins(0).fit(rows, ["x"]), lambda: tr.CategoryBins(3, strategy="other").fit(rows, ["c"]), lambda: tr.RareCategories(1.5).fit(rows, ["c"]),
        lambda: tr.replace_rare(rows, "c", 1.5), lambda: tr.replace_rare(rows, "c", -1), lambda: tr.sample_from_bins(tr.bin_numeric(rows, "x", 2), "x", "k", mean=1.0, std=0.0),
        lambda: syn.MarginalSynthesizer(1.0, seed="s").fit(rows.select("c")).sample(-1),
    ):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: tr.bin_numeric(rows, "x", 2.5), lambda: syn.MarginalSynthesizer(1.0, seed="s").fit(rows.select("c")).sample(2.5)):
        with pytest.raises(TypeError):
            bad()
