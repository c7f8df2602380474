import os
import random
import time

from pyspark.sql import functions as F

from tabveil.llm import components
from tabveil.llm._shared import scratch
from tabveil.llm.components import _large_star, _small_star, connected_components, flatter


def expected(links):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted((i, find(i)) for i in list(root))


def test_equals_union_find(spark):
    rng = random.Random(5)
    order = rng.sample(range(300), 300)
    links = list(zip(order, order[1:]))  # a chain in no order
    links += [(999, i) for i in range(500, 560)] + [(700, i) for i in range(701, 760)]  # a hub above its nodes, one below
    links += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(110)] * 2
    links += [(5000, 5000), (None, 3), (5001, None)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert sorted(tuple(r) for r in got.collect()) == expected(links)


def test_a_round_shuffles_the_edges_twice(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "u long, v long")
    plan = _small_star(_large_star(edges))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2


def test_a_scratch_table_leaves_no_shuffle_files(spark):
    tops = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    seen = lambda: {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), seen()
    table = scratch(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().orderBy("k"), "counts")
    for _ in range(20):  # they go in the background
        if not (left := seen() - before):
            break
        time.sleep(0.5)
    assert not left and spark.conf.get(key) == setting and table.count() == 7


def test_a_settled_star_takes_one_table(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(components, "scratch", lambda df, label, folder=None: written.append(label) or scratch(df, label, folder))
    links = [(i, 1) for i in range(2, 40)] + [(i, 1) for i in range(2, 9)]
    got = connected_components(spark.createDataFrame(links, "a long, b long"), folder=str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == expected(links) and written == ["edges"]


def test_one_round_keeps_the_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(5000, 5000), (None, 3)]
    got = [tuple(r) for r in flatter(spark.createDataFrame(links, "a long, b long")).collect()]
    assert expected(got) == expected(links) and len(got) <= len(links) and all(a > b for a, b in got)
