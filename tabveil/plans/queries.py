"""One query for each operator over the driver's tables, and its twin in DuckDB's SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import gumbel, laplace, normal, uniform
from ..operators import distributions as dist, efficacy, frames, metrics, ordering, privacy, sampling, scores, sequences as seq, stages, synthesizers as syn, transformers as tr
from ..sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = "s"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is some."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles rounded to six digits, for comparison."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in cols})


def token_sql(c: str) -> str:
    return f"coalesce('=' || {c}::varchar, '-')"


def uniform_sql(seed: str, *keys: str) -> str:
    """The twin of functions.uniform; keys are SQL expressions."""
    text = " || '|' || ".join([f"'{seed}'", *map(token_sql, keys)])
    return f"((('0x' || substr(md5({text}), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double)"


def laplace_sql(u: str, scale: float | str) -> str:
    return f"(-({scale})::double * sign({u} - 0.5::double) * ln(1 - 2 * abs({u} - 0.5::double)))"


# --- distributions


@query("SELECT o_orderpriority, count(*) AS count, round(count(*) / (SELECT count(*) FROM orders)::double, 6) AS p FROM orders GROUP BY 1")
def marginal_distribution(spark, d):
    return r6(dist.joint(read(spark, d, "orders"), "o_orderpriority"), "p")


@query("SELECT quality, count(*) AS count, round(count(*) / (SELECT count(*) FROM documents)::double, 6) AS p FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def marginal_distribution_with_null(spark, d):
    rows = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    return r6(dist.joint(rows, "quality"), "p")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::varchar AS value, count(*) AS count, round(count(*) / (SELECT count(*) FROM lineitem)::double, 6) AS p FROM lineitem GROUP BY {c}" for c in ("l_returnflag", "l_linestatus", "l_linenumber")
    )
)
def all_marginals_unpivot(spark, d):
    return r6(dist.marginals(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]), "p")


@query("SELECT p_type, round(1 / count(*) OVER ()::double, 6) AS p FROM (SELECT DISTINCT p_type FROM part)")
def uniform_distribution(spark, d):
    return r6(dist.uniform_distribution(read(spark, d, "part"), "p_type"), "p")


@query("SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2")
def contingency_table(spark, d):
    return dist.contingency(read(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


DENSE = """dense AS (SELECT b.p_brand, s.p_size, coalesce(c.n, 0) AS count FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT DISTINCT p_size FROM part) s
  LEFT JOIN (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) c ON c.p_brand = b.p_brand AND c.p_size = s.p_size)"""


@query(f"WITH {DENSE} SELECT * FROM dense")
def contingency_table_full_domain(spark, d):
    return dist.dense(read(spark, d, "part"), ["p_brand", "p_size"])


@query("SELECT p_brand, p_size, count(*) AS count, round(count(*) / (SELECT count(*) FROM part)::double, 6) AS p FROM part GROUP BY 1, 2")
def joint_distribution(spark, d):
    return r6(dist.joint(read(spark, d, "part"), ["p_brand", "p_size"]), "p")


@query(f"WITH {DENSE} SELECT p_brand, p_size, count, round(count / sum(count) OVER (PARTITION BY p_brand)::double, 6) AS p FROM dense")
def conditional_distribution(spark, d):
    return r6(dist.conditional(dist.dense(read(spark, d, "part"), ["p_brand", "p_size"]), ["p_brand"]), "p")


@query(
    f"""WITH {DENSE}, cut AS (SELECT p_brand, p_size, CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 0 ELSE count END AS count FROM dense)
SELECT p_brand, p_size, count, round(CASE WHEN sum(count) OVER w = 0 THEN 1 / count(*) OVER w::double ELSE count / sum(count) OVER w::double END, 6) AS p FROM cut WINDOW w AS (PARTITION BY p_brand)"""
)
def conditional_distribution_uniform_fill(spark, d):
    part = read(spark, d, "part")
    least = part.agg(F.min("p_brand")).first()[0]
    cut = dist.dense(part, ["p_brand", "p_size"]).withColumn("count", F.when(F.col("p_brand") == least, 0).otherwise(F.col("count")).cast("long"))
    return r6(dist.conditional(cut, ["p_brand"]), "p")


@query("SELECT p_type, 0::bigint AS v, round(1 / count(*) OVER ()::double, 6) AS p FROM (SELECT DISTINCT p_type FROM part)")
def normalize_all_zero(spark, d):
    return r6(dist.shares(read(spark, d, "part").select("p_type").distinct().withColumn("v", F.lit(0).cast("long")), "v"), "p")


PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
CARD = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM part" for c in PART)


@query("SELECT count(DISTINCT p_brand) * count(DISTINCT p_type) * count(DISTINCT p_size) AS cardinality FROM part")
def cardinality(spark, d):
    return spark.createDataFrame([(math.prod(dist.cardinalities(read(spark, d, "part"), ["p_brand", "p_type", "p_size"]).values()),)], "cardinality long")


@query(f"SELECT *, row_number() OVER (ORDER BY n_distinct DESC, \"column\")::int AS rank FROM ({CARD})")
def rank_columns_on_cardinality(spark, d):
    return dist.cardinality_table(read(spark, d, "part"))


@query(f"SELECT * FROM ({CARD}) WHERE n_distinct > 50")
def high_cardinality_columns(spark, d):
    return dist.high_cardinality(read(spark, d, "part"), 50)


def _rare_sql(table: str, cols: tuple[str, ...], limit: float) -> str:
    return " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", {c}::varchar AS value, round(count(*) / (SELECT count({c}) FROM {table})::double, 6) AS p FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE p < {limit}" for c in cols)


@query(_rare_sql("orders", ("o_orderpriority", "o_orderstatus"), 0.2))
def rare_column_categories(spark, d):
    return r6(dist.rare_categories(read(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], 0.2), "p")


# --- privacy


@query(f"SELECT o_orderkey, round({laplace_sql(uniform_sql(SEED, 'o_orderkey'), 2.0)}, 6) AS noise FROM orders")
def laplace_noise(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(laplace(uniform(SEED, "o_orderkey"), 2.0), 6).alias("noise"))


def _dp_joint_sql(table: str, cols: tuple[str, ...], epsilon: float, seed: str = SEED, mechanism: str = "joint") -> str:
    """A chain of CTEs ending in noisy(cols, p)."""
    doms = " CROSS JOIN ".join(f"(SELECT DISTINCT {c} FROM {table}) d_{c}" for c in cols)
    on = " AND ".join(f"d_{c}.{c} IS NOT DISTINCT FROM s.{c}" for c in cols)
    keys = ", ".join(cols)
    noise = laplace_sql(uniform_sql(privacy.noise_seed(seed, mechanism, [*cols], epsilon), *cols), f"2 / (n * {epsilon}::double)")
    return f"""total AS (SELECT count(*)::double AS n FROM {table}),
seen AS (SELECT {keys}, count(*) AS c FROM {table} GROUP BY {keys}),
cells AS (SELECT {", ".join(f"d_{c}.{c}" for c in cols)}, coalesce(s.c, 0) AS count FROM {doms} LEFT JOIN seen s ON {on}),
clamped AS (SELECT {keys}, greatest(0::double, count / n + {noise}) AS v FROM cells, total),
noisy AS (SELECT {keys}, v / sum(v) OVER () AS p FROM clamped)"""


FLAGS = ("l_returnflag", "l_linestatus")


@query(f"WITH {_dp_joint_sql('orders', ('o_orderpriority',), 0.5)} SELECT o_orderpriority, round(p, 6) AS p FROM noisy")
def dp_marginal(spark, d):
    return r6(privacy.dp_joint(read(spark, d, "orders"), "o_orderpriority", 0.5, SEED), "p")


@query(f"WITH {_dp_joint_sql('lineitem', FLAGS, 0.1)} SELECT l_returnflag, l_linestatus, round(p, 6) AS p FROM noisy")
def dp_joint(spark, d):
    return r6(privacy.dp_joint(read(spark, d, "lineitem"), [*FLAGS], 0.1, SEED), "p")


@query(
    f"""WITH {_dp_joint_sql("lineitem", FLAGS, 0.1)} SELECT l_returnflag, l_linestatus, ceil(greatest(0::double, count + {laplace_sql(uniform_sql(privacy.noise_seed(SEED, 'contingency', [*FLAGS], 0.2), *FLAGS), 5.0)}))::bigint AS count FROM cells"""
)
def dp_contingency(spark, d):
    return privacy.dp_contingency(read(spark, d, "lineitem"), [*FLAGS], 0.2, SEED)


@query(f"WITH {_dp_joint_sql('lineitem', FLAGS, 0.1, mechanism='conditional')} SELECT l_returnflag, l_linestatus, round(p / sum(p) OVER (PARTITION BY l_returnflag), 6) AS p FROM noisy")
def dp_conditional(spark, d):
    return r6(privacy.dp_conditional(read(spark, d, "lineitem"), "l_linestatus", ["l_returnflag"], 0.1, SEED), "p")


@query("SELECT o_orderpriority, round(count(*) / (SELECT count(*) FROM orders)::double, 6) AS p FROM orders GROUP BY 1")
def dp_marginal_eps_inf(spark, d):
    return r6(privacy.dp_joint(read(spark, d, "orders"), "o_orderpriority", math.inf, SEED), "p")


@query(
    f"""SELECT p_brand, score FROM (SELECT p_brand, round(avg(p_size), 6) AS score FROM part GROUP BY 1)
ORDER BY score * (2.0::double / (2 * 0.5)) + -ln(-ln({uniform_sql(SEED, "p_brand")})) DESC, p_brand LIMIT 1"""
)
def exponential_mechanism(spark, d):
    options = read(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_size"), 6).alias("score"))
    return privacy.exponential(options, "p_brand", "score", 2.0, 0.5, SEED)


@query(f"SELECT o_orderkey, round(-ln(-ln({uniform_sql(SEED, 'o_orderkey')})), 6) AS noise FROM orders")
def gumbel_noise(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.round(gumbel(uniform(SEED, "o_orderkey")), 6).alias("noise"))


@query("SELECT round(3 / n + 2 / (n * n), 9) AS r, round(2 / n * ln((n + 1) / 2) + (n - 1) / n * ln((n + 1) / (n - 1)), 9) AS mi FROM (SELECT count(*)::double AS n FROM lineitem)")
def score_sensitivity(spark, d):
    n = read(spark, d, "lineitem").count()
    return spark.createDataFrame([(round(privacy.r_sensitivity(n), 9), round(privacy.mi_sensitivity(n), 9))], "r double, mi double")


# --- scores and networks


def _score_sql(table: str, child: str, parents: tuple[str, ...], k: int) -> str:
    b = " || '|' || ".join(token_sql(p) for p in parents)
    return f"""SELECT {k} AS set, round((sum(abs(p - q)) + 1 - sum(q)) / 2, 6) AS r, round(sum(p * ln(p / q)), 6) AS mi FROM (
  SELECT c / n AS p, sum(c) OVER (PARTITION BY a) / n * (sum(c) OVER (PARTITION BY b) / n) AS q FROM (
    SELECT {token_sql(child)} AS a, {b} AS b, count(*)::double AS c FROM {table} GROUP BY 1, 2), (SELECT count(*)::double AS n FROM {table}))"""


SETS = [("l_returnflag", ("l_linestatus",)), ("l_linenumber", ("l_returnflag", "l_linestatus")), ("l_linestatus", ("l_quantity",))]


@query(" UNION ALL ".join(_score_sql("lineitem", c, p, k) for k, (c, p) in enumerate(SETS)))
def dependence_scores(spark, d):
    base = scores.collapsed(read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"))
    return r6(scores.scores(base, SETS), "r", "mi")


@query("SELECT round(n * 0.7 * 1.0 / (2 * 4 * 4 * k), 6) AS cells FROM (SELECT count(*)::double AS n, count(DISTINCT p_brand) AS k FROM part)")
def max_domain_size(spark, d):
    part = read(spark, d, "part")
    return spark.createDataFrame([(round(scores.max_domain_size(part.count(), 1.0, 0.3, 4, 4, dist.cardinalities(part, ["p_brand"])["p_brand"]), 6),)], "cells double")


@query()
def maximal_parent_sets(spark, d):
    sizes = dist.cardinalities(read(spark, d, "part"), ["p_brand", "p_type", "p_size"])
    return spark.createDataFrame([(",".join(sorted(s)),) for s in scores.maximal_parent_sets(sizes, 200)], "parents string")


def _alias_sql(name: str, table: str, child: tuple[str, ...], parents: tuple[str, ...] = (), value: str = "p") -> str:
    """CTEs ending in name: the alias tables of child by parents, as sampling.draw() builds them, one row a slot."""
    by = f"PARTITION BY {', '.join(parents)}" if parents else ""
    order, row = ", ".join(f"{c} NULLS FIRST" for c in child), f"row({', '.join(child)})"
    keys = ", ".join([*parents, *child])
    other = ", ".join(f"CASE WHEN o IS NULL THEN {c} ELSE o.v{i} END AS other_{c}" for i, c in enumerate(child))
    packed = ", ".join(f"v{i} := {c}" for i, c in enumerate(child))
    return f"""{name}_s AS (SELECT {keys}, row_number() OVER ({by} ORDER BY {order}) - 1 AS slot, count(*) OVER ({by}) AS k, {value} * count(*) OVER ({by}) / sum({value}) OVER ({by})::double AS s FROM ({table}) WHERE {value} > 0),
{name}_c AS (SELECT *, s < 1 AS light, greatest(1 - s, 0) AS free, sum(greatest(1 - s, 0)) OVER w AS taken, sum(greatest(s - 1, 0)) OVER w AS excess FROM {name}_s WINDOW w AS ({by} ORDER BY slot ROWS UNBOUNDED PRECEDING)),
{name}_o AS (SELECT *, CASE WHEN light THEN taken - free ELSE excess END AS place FROM {name}_c),
{name}_a AS (SELECT *, first_value(CASE WHEN NOT light THEN struct_pack({packed}) END IGNORE NULLS) OVER ({by} ORDER BY place, light, slot ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS o,
  coalesce(last_value(CASE WHEN light THEN taken END IGNORE NULLS) OVER ({by} ORDER BY place, light, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS drawn FROM {name}_o),
{name} AS (SELECT {keys}, slot, k, {other}, CASE WHEN o IS NULL THEN 1 WHEN light THEN s ELSE 1 - greatest(0, drawn - excess) END AS part FROM {name}_a)"""


def _drawn_sql(columns: str, rows: str, table: str, child: tuple[str, ...], parents: tuple[str, ...] = (), key: str = "id") -> str:
    """rows with child drawn from the alias tables of _alias_sql, as sampling.draw() does."""
    x = f"({uniform_sql(f'{SEED}|{",".join(child)}', f'r.{key}')} * c.k)"
    on = " AND ".join([f"c.slot = least(floor({x}), c.k - 1)", *(f"r.{p} IS NOT DISTINCT FROM c.{p}" for p in parents)])
    out = ", ".join(f"CASE WHEN {x} - floor({x}) < c.part THEN c.{c} ELSE c.other_{c} END AS {c}" for c in child)
    return f"SELECT {columns}, {out} FROM {rows} r JOIN {table} c ON {on}"


_PRIORITY = ("o_orderpriority",)


@query(
    f"""WITH {_dp_joint_sql("orders", _PRIORITY, 0.5)}, {_alias_sql("a", "SELECT * FROM noisy", _PRIORITY)}, ids AS (SELECT o_orderkey AS id FROM orders)
SELECT * FROM ({_drawn_sql("r.id", "ids", "a", _PRIORITY)})"""
)
def marginal_sample(spark, d):
    orders = read(spark, d, "orders")
    noisy = privacy.dp_joint(orders, "o_orderpriority", 0.5, SEED)
    return sampling.draw(orders.select(F.col("o_orderkey").alias("id")), noisy, ["o_orderpriority"], SEED, "id")


def _flags(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select("l_returnflag", "l_linestatus")


def _noisy_sql(table: str, cols: tuple[str, ...], epsilon: float, mechanism: str = "joint") -> str:
    return f"WITH {_dp_joint_sql(table, cols, epsilon, mechanism=mechanism)} SELECT * FROM noisy"


_IDS = "ids AS (SELECT row_number() OVER () - 1 AS id FROM lineitem)"
_FLAG_CELLS = f"""WITH {_dp_joint_sql("lineitem", FLAGS, 1.0)} SELECT l_returnflag, l_linestatus,
  ceil(greatest(0::double, count + {laplace_sql(uniform_sql(privacy.noise_seed(SEED, "contingency", [*FLAGS], 1.0), *FLAGS), 1.0)}))::bigint AS p FROM cells"""


@query(
    f"""WITH {_IDS}, {_alias_sql("f", _noisy_sql("lineitem", FLAGS[:1], 0.5), FLAGS[:1])}, {_alias_sql("s", _noisy_sql("lineitem", FLAGS[1:], 0.5), FLAGS[1:])},
one AS ({_drawn_sql("r.*", "ids", "f", FLAGS[:1])}), two AS ({_drawn_sql("r.*", "one", "s", FLAGS[1:])}) SELECT l_returnflag, l_linestatus FROM two"""
)
def marginal_synthesizer(spark, d):
    return syn.MarginalSynthesizer(1.0, seed=SEED).fit(_flags(spark, d)).sample()


@query(
    f"""WITH {_IDS}, {", ".join(_alias_sql(n, f"SELECT DISTINCT {c}, 1 AS p FROM lineitem", (c,)) for n, c in zip("fs", FLAGS))},
one AS ({_drawn_sql("r.*", "ids", "f", FLAGS[:1])}), two AS ({_drawn_sql("r.*", "one", "s", FLAGS[1:])}) SELECT l_returnflag, l_linestatus FROM two"""
)
def uniform_synthesizer(spark, d):
    return syn.UniformSynthesizer(1.0, seed=SEED).fit(_flags(spark, d)).sample()


@query(f"WITH {_IDS}, {_alias_sql('f', _FLAG_CELLS, FLAGS)}, one AS ({_drawn_sql('r.*', 'ids', 'f', FLAGS)}) SELECT l_returnflag, l_linestatus FROM one")
def contingency_synthesizer(spark, d):
    return syn.ContingencySynthesizer(1.0, seed=SEED).fit(_flags(spark, d)).sample()


def _people(spark, d) -> DataFrame:
    joined = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("r_name", "n_name", "c_mktsegment")


CHAIN = [syn.Pair("r_name"), syn.Pair("n_name", ("r_name",)), syn.Pair("c_mktsegment", ("n_name",))]


@query()
def bayesnet_structure(spark, d):
    model = syn.BayesNet(10.0, seed=SEED).fit(_people(spark, d))
    return spark.createDataFrame([(p.attribute, ",".join(p.parents)) for p in model.network_], "attribute string, parents string")


@query(
    """WITH t AS (SELECT r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cells AS (SELECT n.n_name, m.c_mktsegment, coalesce(s.c, 0)::double AS c FROM (SELECT DISTINCT n_name FROM t) n CROSS JOIN (SELECT DISTINCT c_mktsegment FROM t) m LEFT JOIN (SELECT n_name, c_mktsegment, count(*) AS c FROM t GROUP BY 1, 2) s USING (n_name, c_mktsegment))
SELECT n_name, c_mktsegment, round(c / sum(c) OVER (PARTITION BY n_name), 6) AS p FROM cells"""
)
def bayesnet_tables(spark, d):
    model = syn.BayesNetNonPrivate(1.0, network=CHAIN, seed=SEED).fit(_people(spark, d))
    return r6(model.tables_["c_mktsegment"], "p").select("n_name", "c_mktsegment", "p")


#: What a network of three given pairs leaves for each table of a budget of 5.
_SHARE = 1 * 5.0 / 3
_PEOPLE = "t AS (SELECT c_custkey, r_name, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_CHAIN_CDFS = ", ".join(_alias_sql(f"cdf_{p.attribute}", _noisy_sql("t", (*p.parents, p.attribute), _SHARE, "conditional"), (p.attribute,), p.parents) for p in CHAIN)


@query(
    f"""WITH {_PEOPLE}, ids AS (SELECT row_number() OVER () - 1 AS id FROM t), {_CHAIN_CDFS},
one AS ({_drawn_sql("r.*", "ids", "cdf_r_name", ("r_name",))}), two AS ({_drawn_sql("r.*", "one", "cdf_n_name", ("n_name",), ("r_name",))}),
three AS ({_drawn_sql("r.*", "two", "cdf_c_mktsegment", ("c_mktsegment",), ("n_name",))}) SELECT r_name, n_name, c_mktsegment FROM three"""
)
def bayesnet_sample(spark, d):
    return syn.BayesNet(5.0, network=CHAIN, seed=SEED).fit(_people(spark, d)).sample()


@query(
    f"""WITH {_PEOPLE}, {_CHAIN_CDFS}, two AS ({_drawn_sql("r.c_custkey, r.r_name", "t", "cdf_n_name", ("n_name",), ("r_name",), "c_custkey")}),
three AS ({_drawn_sql("r.*", "two", "cdf_c_mktsegment", ("c_mktsegment",), ("n_name",), "c_custkey")}) SELECT c_custkey, r_name, n_name, c_mktsegment FROM three"""
)
def bayesnet_sample_remaining(spark, d):
    model = syn.BayesNet(5.0, network=CHAIN, seed=SEED).fit(_people(spark, d))
    fixed = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return model.sample_remaining(fixed.select("c_custkey", "r_name"), "c_custkey")


@query()
def bayesnet_nonprivate(spark, d):
    return syn.BayesNetNonPrivate(1.0, seed=SEED).fit(_people(spark, d)).sample()


# --- transformers


def _code_sql(x: str, edges: str) -> str:
    return f"least(len(list_filter({edges}[2:], lambda e: e <= {x})), len({edges}) - 2)"


@query(
    f"""WITH e AS (SELECT [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]::double[] AS e)
SELECT l_orderkey, l_linenumber, e[{_code_sql("l_quantity", "e")} + 1] AS lo, e[{_code_sql("l_quantity", "e")} + 2] AS hi FROM lineitem, e"""
)
def bin_uniform(spark, d):
    out = tr.bin_numeric(read(spark, d, "lineitem"), "l_quantity", 5, 0, 50)
    return out.select("l_orderkey", "l_linenumber", F.col("l_quantity.left").alias("lo"), F.col("l_quantity.right").alias("hi"))


@query(
    f"""WITH t AS (SELECT o_totalprice AS x FROM orders UNION ALL SELECT min(o_totalprice) FROM orders UNION ALL SELECT max(o_totalprice) FROM orders),
e AS (SELECT quantile_cont(x, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM t)
SELECT o_orderkey, round(e[{_code_sql("o_totalprice", "e")} + 1], 2) AS lo, round(e[{_code_sql("o_totalprice", "e")} + 2], 2) AS hi FROM orders, e"""
)
def bin_quantile(spark, d):
    out = tr.bin_numeric(read(spark, d, "orders"), "o_totalprice", 5, strategy="quantile")
    return out.select("o_orderkey", F.col("o_totalprice.left").alias("lo"), F.col("o_totalprice.right").alias("hi"))


_BINNED = f"b AS (SELECT p_partkey, least(floor((p_size - 0.0) / 10), 4) * 10 AS lo, {uniform_sql(SEED, 'p_partkey')} AS u FROM part)"


@query(f"WITH {_BINNED} SELECT p_partkey, (lo + floor(u * 10))::int AS p_size FROM b")
def sample_from_bins_int(spark, d):
    return tr.sample_from_bins(tr.bin_numeric(read(spark, d, "part"), "p_size", 5, 0, 50), "p_size", "p_partkey", seed=SEED).select("p_partkey", "p_size")


@query(f"WITH {_BINNED} SELECT p_partkey, round(lo + u * 10, 6) AS p_size FROM b")
def sample_from_bins_float(spark, d):
    return r6(tr.sample_from_bins(tr.bin_numeric(read(spark, d, "part"), "p_size", 5, 0, 50), "p_size", "p_partkey", "float", seed=SEED), "p_size").select("p_partkey", "p_size")


def _ratio_sql(parts, x: str) -> str:
    up, down = (f"{p[0]!r}::double" for p in parts)
    for c in parts[0][1:]:
        up = f"({up} * {x} + {c!r}::double)"
    for c in parts[1][1:]:
        down = f"({down} * {x} + {c!r}::double)"
    return f"({up} / {down})"


def normal_cdf_sql(x: str) -> str:
    """The twin of functions.normal_cdf up to a distance of normal.ENDS."""
    tail = f"(exp(-abs({x}) * abs({x}) / 2) * {_ratio_sql(normal.HART, f'abs({x})')})"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_quantile_sql(p: str) -> str:
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {r} <= 5 THEN {_ratio_sql(normal.NEAR, f'({r} - 1.6)')} ELSE {_ratio_sql(normal.FAR, f'({r} - 5)')} END"
    return f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {_ratio_sql(normal.CENTRE, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} ELSE sign({p} - 0.5) * ({tail}) END)"


@query(
    f"""WITH {_BINNED}, z AS (SELECT *, {normal_cdf_sql("((lo - 25) / 10::double)")} AS a, {normal_cdf_sql("((lo + 10 - 25) / 10::double)")} AS z FROM b),
q AS (SELECT *, least(greatest(a + u * (z - a), 1e-12), 1 - 1e-12)::double AS p FROM z)
SELECT p_partkey, round(least(greatest(25 + 10 * {normal_quantile_sql("p")}, lo), lo + 10), 6) AS p_size FROM q"""
)
def sample_from_bins_truncnorm(spark, d):
    return r6(tr.sample_from_bins(tr.bin_numeric(read(spark, d, "part"), "p_size", 5, 0, 50), "p_size", "p_partkey", "float", 25.0, 10.0, SEED), "p_size").select("p_partkey", "p_size")


_NUDGED = "(p_retailprice + 1e-8 + 1e-5 * abs(p_retailprice))"


@query(
    f"""WITH m AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part), e AS (SELECT list_append([a + (b - a) * k / 10 FOR k IN range(10)], b) AS e FROM m)
SELECT p_partkey, {_code_sql(_NUDGED, "e")}::double AS p_retailprice FROM part, e"""
)
def generalize_continuous(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_retailprice")
    return tr.ContinuousBins(10).fit(part, ["p_retailprice"]).transform(part)


@query(
    f"""WITH m AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, bool_and(p_retailprice % 1 = 0) AS w FROM part), e AS (SELECT w, list_append([a + (b - a) * k / 10 FOR k IN range(10)], b) AS e FROM m),
c AS (SELECT p_partkey, w, e, {_code_sql(_NUDGED, "e")} AS c, (('0x' || substr(md5('{SEED}|=p_retailprice|' || {token_sql("p_partkey")}), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double AS u FROM part, e)
SELECT p_partkey, round(CASE WHEN w THEN round(e[c + 1] + u * (e[c + 2] - e[c + 1])) ELSE e[c + 1] + u * (e[c + 2] - e[c + 1]) END, 6) AS p_retailprice FROM c"""
)
def generalize_continuous_inverse(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_retailprice")
    bins = tr.ContinuousBins(10).fit(part, ["p_retailprice"])
    return r6(bins.inverse_transform(bins.transform(part), "p_partkey", SEED), "p_retailprice")


_BRANDS = f"""{_dp_joint_sql("part", ("p_brand",), 1.0)}, b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS r, count(*) OVER () AS k, p FROM noisy),
c AS (SELECT p_brand, p, least(floor(r * (1 + 1e-5) / greatest((k - 1) / 5.0, 1e-9) + 1e-8), 4)::int AS code FROM b)"""


@query(f"WITH {_BRANDS} SELECT p_partkey, code AS p_brand FROM part JOIN c USING (p_brand)")
def generalize_categorical(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    return tr.CategoryBins(5, seed=SEED).fit(part, ["p_brand"]).transform(part)


@query(
    f"""WITH {_BRANDS}, cdf AS (SELECT code, p_brand, sum(p) OVER (PARTITION BY code ORDER BY p_brand ROWS UNBOUNDED PRECEDING) / sum(p) OVER (PARTITION BY code) AS hi FROM c),
u AS (SELECT p_partkey, code, (('0x' || substr(md5('{SEED}|=p_brand|' || {token_sql("p_partkey")}), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double AS u FROM part JOIN c USING (p_brand))
SELECT p_partkey, min(cdf.p_brand) AS p_brand FROM u JOIN cdf ON u.code = cdf.code AND cdf.hi > u.u GROUP BY p_partkey"""
)
def generalize_categorical_inverse(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    bins = tr.CategoryBins(5, seed=SEED).fit(part, ["p_brand"])
    return bins.inverse_transform(bins.transform(part), "p_partkey", SEED)


def _regions(spark, d) -> dict[str, str]:
    both = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return {r.n_name: r.r_name for r in both.select("n_name", "r_name").collect()}  # 25 nations


@query(
    f"""WITH l AS (SELECT r_name, list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT c_custkey, names[floor({uniform_sql(SEED, "'nation'", "c_custkey")} * len(names))::int + 1] AS nation,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN ['BUILDING', 'MACHINERY'][floor({uniform_sql(SEED, "'c_mktsegment'", "c_custkey")} * 2)::int + 1] ELSE c_mktsegment END AS c_mktsegment
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN l USING (r_name)"""
)
def sample_from_reversed_dict(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"), "c_mktsegment")
    scheme = tr.Scheme({"nation": _regions(spark, d), "c_mktsegment": {"BUILDING": "works", "MACHINERY": "works"}}).fit(rows)
    return scheme.inverse_transform(scheme.transform(rows), "c_custkey", SEED)


@query("SELECT c_custkey, r_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def generalize_schematic(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))
    return tr.generalize(rows, "nation", _regions(spark, d), "unknown")


@query(
    f"""WITH l AS (SELECT r_name, list(n_name ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT c_custkey, names[floor((('0x' || substr(md5('{SEED}|=nation|' || {token_sql("c_custkey")}), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double * len(names))::int + 1] AS nation
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN l USING (r_name)"""
)
def generalize_schematic_inverse(spark, d):
    return tr.specialize(generalize_schematic(spark, d), "nation", _regions(spark, d), "c_custkey", SEED)


_PRIO = "c AS (SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY 1)"


@query(f"WITH {_PRIO} SELECT o_orderkey, CASE WHEN n / t::double < 0.2 THEN 'other' ELSE o_orderpriority END AS o_orderpriority FROM orders JOIN c USING (o_orderpriority)")
def replace_rare_share(spark, d):
    return tr.replace_rare(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 0.2)


@query(f"WITH {_PRIO} SELECT o_orderkey, CASE WHEN n < 3000 THEN 'few' ELSE o_orderpriority END AS o_orderpriority FROM orders JOIN c USING (o_orderpriority)")
def replace_rare_count(spark, d):
    return tr.replace_rare(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 3000, "few")


@query(f"WITH {_PRIO} SELECT o_orderkey, CASE WHEN n / t::double < 0.2 THEN (SELECT o_orderpriority FROM c ORDER BY n DESC, o_orderpriority LIMIT 1) ELSE o_orderpriority END AS o_orderpriority FROM orders JOIN c USING (o_orderpriority)")
def replace_rare_mode(spark, d):
    return tr.replace_rare(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", 0.2, "mode")


_QUALITY = "t AS (SELECT doc_id, quality::varchar AS quality FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT quality, count(*) / sum(count(*)) OVER ()::double AS p FROM t WHERE quality IS NOT NULL GROUP BY 1)"


@query(f"WITH {_QUALITY} SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN p < 0.2 THEN 'other' ELSE quality END AS quality FROM t LEFT JOIN c USING (quality)")
def group_rare_values(spark, d):
    rows = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return tr.group_rare(rows, ["quality"], 0.2)


@query("WITH c AS (SELECT event_type, count(*) / (SELECT count(*) FROM events)::double AS p FROM events GROUP BY 1) SELECT event_id, CASE WHEN p < 0.2 THEN 'Other' ELSE event_type END AS event_type FROM events JOIN c USING (event_type)")
def group_rare_categories(spark, d):
    rows = read(spark, d, "events").select("event_id", "event_type")
    return tr.RareCategories(0.2).fit(rows, ["event_type"]).transform(rows)


@query("SELECT s_suppkey, 'entity_' || (dense_rank() OVER (ORDER BY f) - 1) AS s_name FROM (SELECT s_name, min(s_suppkey) AS f FROM supplier GROUP BY 1) JOIN supplier USING (s_name)")
def replace_unique_values(spark, d):
    return tr.pseudonyms(read(spark, d, "supplier").select("s_suppkey", "s_name"), "s_name", "s_suppkey")


@query("SELECT c_custkey, 'FAKE_PERSON_' || row_number() OVER (ORDER BY c_custkey) AS id FROM customer")
def add_fake_identifiers(spark, d):
    return tr.add_ids(read(spark, d, "customer").select("c_custkey"), "c_custkey")


_DATES = "SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _dates(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


@query(f"SELECT l_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m') AS o_orderdate, date_diff('day', o_orderdate, l_shipdate)::int AS l_shipdate FROM ({_DATES})")
def date_sequence_generalize(spark, d):
    return tr.generalize_dates(_dates(spark, d), ["o_orderdate", "l_shipdate"])


@query(
    f"""WITH t AS (SELECT *, date_trunc('month', o_orderdate)::date AS m, {uniform_sql(SEED, "(l_orderkey * 10 + l_linenumber)")} AS u FROM ({_DATES})),
f AS (SELECT *, m + floor(u * day(last_day(m)))::int AS d0 FROM t)
SELECT l_orderkey, l_linenumber, strftime(d0, '%Y-%m-%d') AS o_orderdate, strftime(d0 + date_diff('day', o_orderdate, l_shipdate)::int, '%Y-%m-%d') AS l_shipdate FROM f"""
)
def date_sequence_inverse(spark, d):
    rows = tr.generalize_dates(_dates(spark, d), ["o_orderdate", "l_shipdate"]).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out = tr.restore_dates(rows, ["o_orderdate", "l_shipdate"], "k", SEED)
    return out.select("l_orderkey", "l_linenumber", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("o_orderdate", "l_shipdate")])


@query(
    "SELECT l_orderkey, "
    + ", ".join(f"max(CASE WHEN r = {k} THEN {c} END) AS {c}{k}" for k in range(1, 8) for c in ("l_returnflag", "l_quantity"))
    + " FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity)) GROUP BY 1"
)
def flatten_sequences(spark, d):
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_returnflag", "l_quantity")).alias("x")
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "x.l_returnflag", "x.l_quantity")
    return seq.flatten_records(rows, "l_orderkey", "l_linenumber", ["l_returnflag", "l_quantity"], 7)


# --- evaluation


def _halves(spark, d, table: str, key: str, cols: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    df = read(spark, d, table)
    return df.where(F.col(key) % 2 == 0).select(*cols), df.where(F.col(key) % 2 == 1).select(*cols)


COLS = ("l_returnflag", "l_linestatus", "l_linenumber")


def _js_sql(keys: dict[str, str], name: str) -> str:
    """name, distance of the halves of lineitem for each key expression."""
    parts = " UNION ALL ".join(f"SELECT '{k}' AS {name}, {e} AS v, count(*) FILTER (l_orderkey % 2 = 0) AS c1, count(*) FILTER (l_orderkey % 2 = 1) AS c2 FROM lineitem GROUP BY 2" for k, e in keys.items())
    return f"""WITH c AS ({parts}), s AS (SELECT {name}, c1 / sum(c1) OVER w AS p, c2 / sum(c2) OVER w AS q FROM c WINDOW w AS (PARTITION BY {name}))
SELECT {name}, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2)), 6) AS distance FROM s GROUP BY 1"""


@query(_js_sql({c: f"{c}::varchar" for c in COLS}, '"column"').replace("'\"column\"'", "'column'"))
def js_marginal(spark, d):
    return r6(metrics.js_marginal(*_halves(spark, d, "lineitem", "l_orderkey", COLS)), "distance")


@query(_js_sql({f"{a},{b}": f"{token_sql(a)} || '|' || {token_sql(b)}" for a, b in (("l_returnflag", "l_linestatus"), ("l_returnflag", "l_linenumber"), ("l_linestatus", "l_linenumber"))}, "columns"))
def js_joint(spark, d):
    return r6(metrics.js_joint(*_halves(spark, d, "lineitem", "l_orderkey", COLS)), "distance")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c}::varchar AS value, count(*) FILTER (l_orderkey % 2 = 0) AS c1, count(*) FILTER (l_orderkey % 2 = 1) AS c2 FROM lineitem GROUP BY {c}" for c in COLS
    )
)
def outer_align(spark, d):
    return metrics.aligned_counts(*_halves(spark, d, "lineitem", "l_orderkey", COLS))


_PAIRS = "WITH c AS (SELECT {x} AS x, {y} AS y, count(*)::double AS c FROM part GROUP BY 1, 2), m AS (SELECT *, sum(c) OVER (PARTITION BY x) AS cx, sum(c) OVER (PARTITION BY y) AS cy, sum(c) OVER () AS n FROM c)"


def theil_sql(x: str, y: str, table: str = "part") -> str:
    return f"{_PAIRS.format(x=x, y=y).replace('part', table)} SELECT (sum(-c / n * ln(cx / n)) - sum(-c / n * ln(c / cy))) / sum(-c / n * ln(cx / n)) AS value FROM m"


@query(f"SELECT round(value, 6) AS value FROM ({theil_sql('p_brand', 'p_type')})")
def assoc_theil(spark, d):
    return r6(metrics.theils_u(read(spark, d, "part"), "p_brand", "p_type"), "value")


@query(f"{_PAIRS.format(x='p_brand', y='p_type')} SELECT round(sqrt((sum(c * c * n / (cx * cy)) - max(n)) / max(n) / (least(count(DISTINCT x), count(DISTINCT y)) - 1)), 6) AS value FROM m")
def assoc_cramer(spark, d):
    return r6(metrics.cramers_v(read(spark, d, "part"), "p_brand", "p_type"), "value")


ETA = "SELECT sqrt(sum(n * (m - g) * (m - g)) / (SELECT sum((p_retailprice - g) * (p_retailprice - g)) FROM part, a)) AS value FROM (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS m FROM part GROUP BY 1), a"


@query(f"WITH a AS (SELECT avg(p_retailprice) AS g FROM part) SELECT round(value, 6) AS value FROM ({ETA})")
def assoc_corr_ratio(spark, d):
    return r6(metrics.correlation_ratio(read(spark, d, "part"), "p_brand", "p_retailprice"), "value")


@query("SELECT round(corr(p_size, p_retailprice), 6) AS value FROM part")
def assoc_pearson(spark, d):
    return r6(metrics.pearson(read(spark, d, "part"), "p_size", "p_retailprice"), "value")


def _assoc_sql(half: str, nominal: tuple[str, ...], numeric: tuple[str, ...]) -> str:
    """i, v: the associations of all pairs of different columns of the rows half, in a fixed order."""
    theil = lambda a, b: theil_sql(a, b, "part").replace("FROM part", f"FROM ({half}) h")
    number = lambda y: f"CASE WHEN NOT isnan({y}::double) THEN {y}::double END"

    def eta(a: str, y: str) -> str:
        rows = f"SELECT {a} AS g, {number(y)} AS y FROM ({half}) h WHERE {number(y)} IS NOT NULL"
        return f"""SELECT sqrt(sum(n * (m - a) * (m - a)) / sum(n * v + n * (m - a) * (m - a))) FROM (SELECT *, sum(n * m) OVER () / sum(n) OVER () AS a
          FROM (SELECT g, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM ({rows}) GROUP BY 1))"""

    corr = lambda x, y: f"SELECT corr({number(x)}, {number(y)}) FROM ({half}) h WHERE {number(x)} IS NOT NULL AND {number(y)} IS NOT NULL"
    pairs = [*(theil(a, b) for a in nominal for b in nominal if a != b), *(eta(a, y) for a in nominal for y in numeric for _ in range(2)), *(corr(x, y) for x in numeric for y in numeric if x != y)]
    return " UNION ALL ".join(f"SELECT {i} AS i, ({p}) AS v" for i, p in enumerate(pairs))


def _assoc_distance_sql(first: str, second: str, nominal: tuple[str, ...], numeric: tuple[str, ...]) -> str:
    return f"SELECT sqrt(sum(power(a.v - b.v, 2))) AS distance FROM ({_assoc_sql(first, nominal, numeric)}) a JOIN ({_assoc_sql(second, nominal, numeric)}) b USING (i)"


_PARTS = [f"SELECT *, CASE WHEN p_partkey % 7 = 0 THEN 'nan'::double WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS x FROM part WHERE p_partkey % 2 = {k}" for k in (0, 1)]


@query(f"SELECT round(distance, 6) AS distance FROM ({_assoc_distance_sql(*_PARTS, ('p_brand', 'p_type'), ('p_size', 'x'))})")
def association_distance(spark, d):
    part = read(spark, d, "part").withColumn("x", F.when(F.col("p_partkey") % 7 == 0, float("nan")).when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")))
    halves = [part.where(f"p_partkey % 2 = {k}").select("p_brand", "p_type", "p_size", "x") for k in (0, 1)]
    return r6(metrics.association_distance(*halves), "distance")


_LINES = [f"SELECT * FROM lineitem WHERE l_orderkey % 2 = {k}" for k in (0, 1)]
_JS = _js_sql({c: f"{c}::varchar" for c in COLS}, "name").replace(", 6) AS distance", ", 15) AS distance")


@query(
    f"""SELECT 'average_js_distance' AS metric, round(avg(distance), 6) AS score FROM ({_JS})
UNION ALL SELECT 'pairwise_correlation_distance', round(distance, 6) FROM ({_assoc_distance_sql(*_LINES, COLS[:2], COLS[2:])})"""
)
def evaluator_scores(spark, d):
    found = metrics.Evaluator().fit(*_halves(spark, d, "lineitem", "l_orderkey", COLS)).score()
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in found.items()], "metric string, score double")


@query("SELECT (count(*) FILTER (l_orderkey % 2 = 0) = count(*) FILTER (l_orderkey % 2 = 1))::int::double AS score FROM lineitem")
def equal_length_metric(spark, d):
    return spark.createDataFrame([(metrics.EqualLength().fit(*_halves(spark, d, "lineitem", "l_orderkey", COLS)).score(),)], "score double")


@query(f"SELECT 'high_cardinality' AS finding, \"column\", n_distinct::varchar AS value FROM ({CARD}) WHERE n_distinct > 50 UNION ALL SELECT 'rare', \"column\", value FROM ({_rare_sql('part', ('p_brand', 'p_type', 'p_size'), 0.03)})")
def original_data_profile(spark, d):
    part = read(spark, d, "part")
    high = metrics.profile(part, 50, 0.03).where("finding = 'high_cardinality'")
    return high.unionAll(metrics.profile(part.select("p_brand", "p_type", "p_size"), 10**9, 0.03))


@query(
    """WITH t AS (SELECT p_size <= 3 AS g, date_diff('day', DATE '1995-01-01', l_shipdate::date) AS time, (l_returnflag = 'R')::int AS event FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT g, time, count(*) AS n, sum(event)::bigint AS events FROM t GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY time DESC ROWS UNBOUNDED PRECEDING)::bigint AS at_risk FROM s),
l AS (SELECT *, sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w AS x, max((events = at_risk)::int) OVER w AS z FROM r WINDOW w AS (PARTITION BY g ORDER BY time ROWS UNBOUNDED PRECEDING))
SELECT g::varchar AS "group", time::int AS time, at_risk, events, round(CASE WHEN z = 1 THEN 0 ELSE exp(x) END, 6) AS survival FROM l"""
)
def kaplan_meier_curve(spark, d):
    rows = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select((F.col("p_size") <= 3).cast("string").alias("g"), F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).alias("time"), (F.col("l_returnflag") == "R").alias("event"))
    return r6(metrics.kaplan_meier(rows, "time", "event", "g"), "survival")


_RANKED = """s AS (SELECT round(o_totalprice, -2) AS score, sum((o_orderstatus = 'F')::int) AS y, count(*) AS n FROM orders GROUP BY 1),
k AS (SELECT score, sum(y) OVER w AS tp, sum(n - y) OVER w AS fp, sum(y) OVER () AS p, sum(n - y) OVER () AS q FROM s WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def _ranked(spark, d) -> DataFrame:
    return read(spark, d, "orders").select(F.round("o_totalprice", -2).alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label"))


@query(f"WITH {_RANKED} SELECT round(sum((tp / p - coalesce(prev, 0)) * tp / (tp + fp)), 6) AS average_precision FROM (SELECT *, lag(tp / p) OVER (ORDER BY score DESC) AS prev FROM k)")
def average_precision(spark, d):
    return r6(metrics.average_precision(_ranked(spark, d), "score", "label"), "average_precision")


@query(f"WITH {_RANKED} SELECT score, round(tp / p, 6) AS tpr, round(fp / q, 6) AS fpr FROM k")
def roc_points(spark, d):
    return r6(metrics.ranking_points(_ranked(spark, d), "score", "label").select("score", "tpr", "fpr"), "tpr", "fpr")


@query(f"WITH {_RANKED} SELECT score, round(tp / p, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM k")
def pr_points(spark, d):
    return r6(metrics.ranking_points(_ranked(spark, d), "score", "label").select("score", F.col("tpr").alias("recall"), "precision"), "recall", "precision")


def _target(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return rows.where("o_orderkey % 2 = 0").drop("o_orderkey"), rows.where("o_orderkey % 2 = 1").drop("o_orderkey")


@query()
def classifier_comparison(spark, d):
    a, b = _target(spark, d)
    found = efficacy.ClassifierComparison("y", "lr").fit(a, b).score(b)
    return spark.createDataFrame([(k, float(v)) for k, v in found.items()], "model string, average_precision double")


@query()
def feature_importance(spark, d):
    return efficacy.FeatureImportanceComparison("y", "lr").fit(*_target(spark, d)).top()


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_roundtrip(spark, d):
    path = f"{tables.shared_folder(spark)}/csv"
    tables.write_csv(read(spark, d, "orders"), path)
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    return tables.read_csv(spark, path, schema, ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query(ORACLE_SQL["marginal_synthesizer"])
def model_save_load(spark, d):
    path = f"{tables.shared_folder(spark)}/model"
    syn.MarginalSynthesizer(1.0, seed=SEED).fit(_flags(spark, d)).save(path)
    return syn.Synthesizer.load(spark, path, SEED).sample()


_GRID = (0.01, 0.1, 1.0)


def _grid_sql(model: str, epsilon: float) -> str:
    """The row of experiment_grid of a model and an epsilon."""
    if model == "marginal":
        parts = ", ".join(_alias_sql(n, _noisy_sql("lineitem", (c,), epsilon / 2), (c,)) for n, c in zip("fs", FLAGS, strict=True))
        drawn = f"WITH {_IDS}, {parts}, one AS ({_drawn_sql('r.*', 'ids', 'f', FLAGS[:1])}), two AS ({_drawn_sql('r.*', 'one', 's', FLAGS[1:])}) SELECT * FROM two"
    else:
        noise = laplace_sql(uniform_sql(privacy.noise_seed(SEED, "contingency", [*FLAGS], epsilon), *FLAGS), 1 / epsilon)
        cells = f"WITH {_dp_joint_sql('lineitem', FLAGS, epsilon)} SELECT l_returnflag, l_linestatus, ceil(greatest(0::double, count + {noise}))::bigint AS p FROM cells"
        drawn = f"WITH {_IDS}, {_alias_sql('f', cells, FLAGS)} {_drawn_sql('r.*', 'ids', 'f', FLAGS)}"
    counts = " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::varchar AS v, count(*) FILTER (o) AS c1, count(*) FILTER (NOT o) AS c2 FROM both_ GROUP BY {c}" for c in FLAGS)
    return f"""SELECT '{model}' AS synthesizer, {epsilon}::double AS epsilon, round(avg(distance), 6) AS score FROM (
  WITH both_ AS (SELECT l_returnflag, l_linestatus, true AS o FROM lineitem UNION ALL SELECT l_returnflag, l_linestatus, false FROM ({drawn})),
  c AS ({counts}), s AS (SELECT name, c1 / sum(c1) OVER w AS p, c2 / sum(c2) OVER w AS q FROM c WINDOW w AS (PARTITION BY name))
  SELECT name, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2)) AS distance FROM s GROUP BY 1)"""


@query(" UNION ALL ".join(_grid_sql(m, e) for m in ("marginal", "contingency") for e in _GRID))
def experiment_grid(spark, d):
    return r6(syn.experiment(_flags(spark, d), {"marginal": syn.MarginalSynthesizer, "contingency": syn.ContingencySynthesizer}, _GRID, seed=SEED), "score")


@query("SELECT feature, \"table\", importance::double AS importance FROM (VALUES ('a', 'original', 3.0), ('a', 'artificial', 1.0), ('c', 'original', 0.0), ('c', 'artificial', 2.0), ('b', 'original', -2.0), ('b', 'artificial', 0.0)) v(feature, \"table\", importance)")
def melt_importances(spark, d):
    a, b = tables.literal(spark, [("a", 3.0), ("b", -2.0)], "feature string, original double"), tables.literal(spark, [("a", 1.0), ("c", 2.0)], "feature string, artificial double")
    return a.join(b, "feature", "full_outer").na.fill(0.0).unpivot(["feature"], ["original", "artificial"], "table", "importance")


# --- counts, order and large domains


_PARTS4 = ("p_brand", "p_type", "p_size", "p_name")


@query(
    """SELECT rank::int AS rank, x AS value FROM (SELECT l_extendedprice AS x, row_number() OVER (ORDER BY l_extendedprice) - 1 AS r, count(*) OVER () AS n FROM lineitem)
JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS rank) ON r = rank * (n - 1) // 4"""
)
def order_statistics(spark, d):
    rows = read(spark, d, "lineitem").select("l_extendedprice")
    n = rows.count()
    found = ordering.order_statistics(rows, "l_extendedprice", [k * (n - 1) // 4 for k in range(5)], n)
    return spark.createDataFrame([*enumerate(found)], "rank int, value double")


_LINE_SETS = [("l_returnflag",), ("l_returnflag", "l_linestatus"), ("l_linestatus", "l_linenumber"), ("l_returnflag", "l_linestatus", "l_linenumber")]


@query(
    " UNION ALL ".join(
        f"SELECT {k}::int AS \"set\", {', '.join(c if c in s else f'NULL AS {c}' for c in COLS)}, count(*) AS count FROM lineitem GROUP BY {', '.join(s)}" for k, s in enumerate(_LINE_SETS)
    )
)
def grouped_counts(spark, d):
    return dist.grouped_counts(read(spark, d, "lineitem"), _LINE_SETS).select(F.col("__set").alias("set"), *COLS, "count")


@query(f"SELECT {', '.join(_PARTS4)}, count(*) AS count FROM part GROUP BY {', '.join(_PARTS4)}")
def contingency_large_domain(spark, d):
    """Without noise the sparse form is the table of what was observed, however many cells the domain has."""
    return privacy.dp_contingency(read(spark, d, "part"), [*_PARTS4], math.inf, SEED, max_cells=1000)


_LINE4 = ("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
_LINE_NOISE = laplace_sql(uniform_sql(privacy.noise_seed(SEED, "contingency", [*_LINE4], 0.5), *_LINE4), 2.0)


@query()
def dp_contingency_large_domain(spark, d):
    return privacy.dp_contingency(read(spark, d, "lineitem"), [*_LINE4], 0.5, SEED, max_cells=500)


@query(
    f"""WITH seen AS (SELECT {', '.join(_LINE4)}, count(*) AS c FROM lineitem GROUP BY {', '.join(_LINE4)}), size AS (SELECT {' * '.join(f'count(DISTINCT {c})::double' for c in _LINE4)} AS cells FROM lineitem),
n AS (SELECT {', '.join(_LINE4)}, c + {_LINE_NOISE} AS v FROM seen), t AS (SELECT greatest(0, -2 * ln(2 * least(0.5, 500 / cells))) AS least FROM size)
SELECT {', '.join(_LINE4)}, ceil(v)::bigint AS count FROM n, t WHERE v > least"""
)
def dp_contingency_large_domain_observed(spark, d):
    """The observed cells of dp_contingency_large_domain, whose noise is keyed by the cell."""
    lines = read(spark, d, "lineitem")
    return dp_contingency_large_domain(spark, d).join(lines.select(*_LINE4).distinct(), [*_LINE4], "left_semi")


_SCORED = [("n_name", ("r_name",)), ("c_mktsegment", ("r_name",)), ("c_mktsegment", ("n_name", "r_name"))]


@query(
    f"WITH {_PEOPLE}, f AS ("
    + " UNION ALL ".join(_score_sql("t", c, p, k) for k, (c, p) in enumerate(_SCORED))
    + ") SELECT attribute, parents, r AS score FROM f JOIN (VALUES "
    + ", ".join(f"({k}, '{c}', '{','.join(p)}')" for k, (c, p) in enumerate(_SCORED))
    + ") v(set, attribute, parents) USING (set)"
)
def bayesnet_scores(spark, d):
    """All sets that the greedy search scores, each once, from a given root on."""
    model = syn.BayesNetNonPrivate(10_000.0, network=CHAIN[:1], seed=SEED).fit(_people(spark, d))
    return r6(spark.createDataFrame([(c, ",".join(p), s) for (c, p), s in model.scores_.items()], "attribute string, parents string, score double"), "score")


# --- transformers in pipelines, as methods and over sequences


def _through(spark, transformer, rows: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, stages.TableModel]:
    """rows as a pipeline of the transformer has them after it was fitted, saved and loaded; and the loaded stage."""
    from pyspark.ml import Pipeline, PipelineModel

    path = f"{tables.shared_folder(spark)}/pipeline"
    Pipeline(stages=[stages.TableTransform(transformer, columns)]).fit(rows).write().save(path)
    model = PipelineModel.load(path)
    return model.transform(rows), model.stages[0]


@query(ORACLE_SQL["generalize_continuous"])
def pipeline_continuous(spark, d):
    return _through(spark, tr.ContinuousBins(10), read(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"])[0]


@query(ORACLE_SQL["generalize_categorical_inverse"])
def pipeline_categorical_inverse(spark, d):
    out, stage = _through(spark, tr.CategoryBins(5, seed=SEED), read(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"])
    return stage.inverse_transform(out, "p_partkey", SEED)


@query(ORACLE_SQL["sample_from_reversed_dict"])
def pipeline_scheme_inverse(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"), "c_mktsegment")
    out, stage = _through(spark, tr.Scheme({"nation": _regions(spark, d), "c_mktsegment": {"BUILDING": "works", "MACHINERY": "works"}}), rows)
    return stage.inverse_transform(out, "c_custkey", SEED)


@query(ORACLE_SQL["group_rare_categories"])
def pipeline_rare(spark, d):
    return _through(spark, tr.RareCategories(0.2), read(spark, d, "events").select("event_id", "event_type"), ["event_type"])[0]


@query(ORACLE_SQL["date_sequence_inverse"])
def pipeline_dates_inverse(spark, d):
    rows = _dates(spark, d).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    out, stage = _through(spark, seq.DateSequence(["o_orderdate", "l_shipdate"]), rows)
    out = stage.inverse_transform(out, "k", SEED)
    return out.select("l_orderkey", "l_linenumber", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("o_orderdate", "l_shipdate")])


@query(
    f"""WITH t AS (SELECT p_partkey, p_brand, (rank() OVER (ORDER BY p_brand) - 1)::double AS e0 FROM part), r AS (SELECT *, (dense_rank() OVER (ORDER BY p_brand) - 1)::double AS r FROM t),
q AS (SELECT quantile_cont(r, [0, 0.25, 0.5, 0.75, 1]) AS e FROM r)
SELECT p_partkey, {_code_sql("(r + 1e-8 + 1e-5 * r)", "e")}::int AS p_brand FROM r, q"""
)
def generalize_categorical_quantile(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_brand")
    return tr.CategoryBins(4, seed=SEED, strategy="quantile").fit(part, ["p_brand"]).transform(part)


@query(
    """WITH m AS (SELECT min(p_size) AS a, max(p_size) AS b FROM part WHERE p_size NOT IN (1, 2)), e AS (SELECT list_append([a + (b - a) * k / 4::double FOR k IN range(4)], b::double) AS e FROM m)
SELECT p_partkey, CASE WHEN p_size IN (1, 2) THEN p_size ELSE least(len(list_filter(e[2:], lambda x: x <= p_size + 1e-8 + 1e-5 * p_size)), len(e) - 2) END::double AS p_size FROM part, e"""
)
def generalize_labelled_missing(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_size")
    return tr.ContinuousBins(4, labelled_missing={"p_size": [1, 2]}).fit(part, ["p_size"]).transform(part)


@query(
    f"""WITH c AS (SELECT p_brand, count(*) / (SELECT count(*) FROM part)::double AS p FROM part GROUP BY 1), e AS (SELECT [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]::double[] AS e),
t AS (SELECT p_partkey, CASE WHEN p < 0.04 THEN 'few' ELSE p_brand END AS p_brand, e[{_code_sql("p_size", "e")} + 1]::int AS lo, {uniform_sql(SEED, "p_partkey")} AS u FROM part JOIN c USING (p_brand), e)
SELECT p_partkey, p_brand, (lo + floor(u * 10))::int AS p_size, 'P' || row_number() OVER (ORDER BY p_partkey) AS id FROM t"""
)
def frame_methods(spark, d):
    """A chain of steps, each a function of the library in its curried form."""
    step = frames.STEPS
    rows = read(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    rows = rows.transform(step["replace_rare"]("p_brand", 0.04, "few")).transform(step["bin_numeric"]("p_size", 5, 0, 50))
    return rows.transform(step["sample_from_bins"]("p_size", "p_partkey", seed=SEED)).transform(step["add_ids"]("p_partkey", "id", "P"))


#: The records of each order in one row; those that were returned are missing.
_STEPS = [f"l_quantity{k}" for k in range(1, 8)]
_FLAT = ORACLE_SQL["flatten_sequences"]
_KNOWN = ", ".join(f"CASE WHEN l_returnflag{k} <> 'R' THEN l_quantity{k} END AS l_quantity{k}" for k in range(1, 8))
_GAP = "least(" + ", ".join(f"CASE WHEN l_quantity{k} IS NULL AND coalesce({', '.join(_STEPS[k:])}) IS NOT NULL THEN {k} END" for k in range(1, 7)) + ")"


def _steps(spark, d) -> DataFrame:
    flat = flatten_sequences(spark, d)
    return flat.select("l_orderkey", *[F.when(F.col(f"l_returnflag{k}") != "R", F.col(f"l_quantity{k}")).alias(f"l_quantity{k}") for k in range(1, 8)])


@query(f"SELECT l_orderkey, {', '.join(_STEPS)} FROM (SELECT l_orderkey, {_KNOWN} FROM ({_FLAT})) WHERE {_GAP} IS NULL")
def sequence_consistency(spark, d):
    return seq.consistent_sequences(_steps(spark, d), _STEPS)


@query(f"SELECT l_orderkey, ({_GAP})::int AS gap FROM (SELECT l_orderkey, {_KNOWN} FROM ({_FLAT})) WHERE {_GAP} IS NOT NULL")
def sequence_gaps(spark, d):
    return seq.consistent_sequences(_steps(spark, d), _STEPS, errors=True).select("l_orderkey", "gap")


@query(
    """SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)::int AS place, l_returnflag, l_quantity
FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_quantity)"""
)
def unflatten_sequences(spark, d):
    return seq.unflatten_records(flatten_sequences(spark, d), ["l_orderkey"], ["l_returnflag", "l_quantity"], 7)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit a marginal model to orders, draw as many rows, and measure each column's distance."""
    rows = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority")
    model = syn.MarginalSynthesizer(1.0, seed=SEED).fit(rows)
    return metrics.js_marginal(rows, model.sample())
