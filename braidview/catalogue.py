"""Named queries over the test tables, each through an operator of this package, with SQL for those that SQL can express.

Views for numeric queries: dimensions of ``embeddings`` (``lo``: 0-7, ``hi``: 32-39), order and line statistics of customers, event counts of users.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import linalg
from .functions.gram import Moments, Score, energy, only
from .operators import columns, moments, neighbors, prep, relational
from .plans import embed, explain, harness, linear, metrics, neural
from .sources import generators
from .sources.scratch import stored
from .sources.tables import load, long_records
from .streaming import whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LO, HI = list(range(8)), list(range(32, 40))
TYPES = ["click", "error", "purchase", "signup", "view"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _dims(spark: SparkSession, d: str, dims: list[int], holes: bool = False) -> DataFrame:
    """``vec_id e0 e1 ...``; with ``holes`` some cells are null."""
    e = load(spark, d, "embeddings")
    cell = lambda i: F.element_at("embedding", i + 1).cast("double")
    return e.select("vec_id", *[(F.when((F.col("vec_id") + i) % 7 != 0, cell(i)) if holes else cell(i)).alias(f"e{i}") for i in dims])


def _sql_dims(dims: list[int], holes: bool = False) -> str:
    cell = lambda i: f"CAST(embedding[{i + 1}] AS DOUBLE)"
    return "SELECT vec_id, " + ", ".join((f"CASE WHEN (vec_id + {i}) % 7 <> 0 THEN {cell(i)} END" if holes else cell(i)) + f" AS e{i}" for i in dims) + " FROM embeddings"


def _e(dims: list[int]) -> list[str]:
    return [f"e{i}" for i in dims]


def _r(names: list[str], digits: int = 6) -> list:
    return [F.round(F.col(n), digits).alias(n) for n in names]


def _weight(i: int, j: int) -> float:
    return round(math.sin(1.0 + 0.7 * i * (j + 1)), 6)


def _weighted_sql(dims: list[int], j: int, alias: str = "") -> str:
    return " + ".join(f"{alias}e{i} * ({_weight(i, j)})" for i in dims)


def _one(spark: SparkSession, **values: float) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in values.values())], ", ".join(f"{k} double" for k in values))


# -- joins, filters, sets, groupings -------------------------------------------------------------------------------------------------------------

_ORDER_STATS = "SELECT o_custkey AS c_custkey, COUNT(*) AS n_orders, SUM(o_totalprice) AS sum_price FROM orders GROUP BY o_custkey"
_LINE_STATS = "SELECT o_custkey AS c_custkey, SUM(l_quantity) AS sum_quantity, SUM(l_discount) AS sum_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey"


def _customer_views(spark: SparkSession, d: str) -> DataFrame:
    # lines shrink to a row an order before they meet the orders, which are read once for both views
    parts = {"quantity": "l_quantity", "discount": "l_discount", "extended": "l_extendedprice", "tax": "l_tax"}
    lines = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), *[f(c).alias(f"{k}_{n}") for n, c in parts.items() for k, f in (("s", F.sum), ("n", F.count))])
    both = load(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("mean_price"), F.sum("o_totalprice").alias("sum_price"),
        F.max(F.datediff(F.to_date(F.lit("1999-01-01")), "o_orderdate")).cast("double").alias("days"),
        *[F.try_divide(F.sum(f"s_{n}"), F.sum(f"n_{n}")).alias(f"mean_{n}") for n in parts], F.sum("s_quantity").alias("sum_quantity"), F.sum("s_discount").alias("sum_discount"), F.sum("lines").alias("lines"),
    )
    return relational.align_views([load(spark, d, "customer").select("c_custkey"), both.where("lines > 0").drop("lines")], "c_custkey")


CUSTOMER_VIEWS = {"orders": ["n_orders", "mean_price", "sum_price", "days"], "lines": ["mean_quantity", "mean_discount", "mean_extended", "mean_tax"]}


@query("view_join_inner", f"SELECT c.c_custkey, n_orders, ROUND(sum_price, 2) AS sum_price, ROUND(sum_quantity, 2) AS sum_quantity, ROUND(sum_discount, 4) AS sum_discount FROM customer c JOIN ({_ORDER_STATS}) a ON c.c_custkey = a.c_custkey JOIN ({_LINE_STATS}) b ON c.c_custkey = b.c_custkey")
def _(spark, d):
    v = _customer_views(spark, d)
    return v.select("c_custkey", "n_orders", *_r(["sum_price", "sum_quantity"], 2), F.round("sum_discount", 4).alias("sum_discount"))


@query("clinical_merge", "SELECT o_orderkey, c_mktsegment, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS priority FROM orders JOIN customer ON o_custkey = c_custkey WHERE TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) IS NOT NULL")
def _(spark, d):
    o = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return relational.clean_numbers(o.select("o_orderkey", "c_mktsegment", F.substring("o_orderpriority", 1, 1).alias("priority")), ["priority"])


@query("pivot_mean", "SELECT user_id, " + ", ".join(f"ROUND(AVG(value) FILTER (WHERE event_type = '{t}'), 6) AS \"{t}\"" for t in TYPES) + " FROM events GROUP BY user_id")
def _(spark, d):
    p = relational.pivot_means(load(spark, d, "events"), "user_id", "event_type", "value", TYPES)
    return p.select("user_id", *_r(TYPES))


@query("ids_intersect", "SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def _(spark, d):
    return load(spark, d, "orders").select(F.col("o_custkey").alias("id")).intersect(load(spark, d, "events").select(F.col("user_id").alias("id")))


@query("ids_except", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    ids = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return relational.lacking(ids, load(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("ids_overlap", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    ids = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return relational.overlap(ids, load(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("results_union", "SELECT 'click' AS kind, COUNT(*) AS n, CAST(NULL AS DOUBLE) AS top FROM events WHERE event_type = 'click' UNION ALL SELECT 'view', COUNT(*), MAX(value) FROM events WHERE event_type = 'view'")
def _(spark, d):
    e = load(spark, d, "events")
    a = e.where("event_type = 'click'").agg(F.lit("click").alias("kind"), F.count("*").alias("n"))
    b = e.where("event_type = 'view'").agg(F.lit("view").alias("kind"), F.count("*").alias("n"), F.max("value").alias("top"))
    return relational.union_rows([a, b])


@query("agg_mean_sd_ci", "SELECT l_returnflag, l_linestatus, " + ", ".join(f"ROUND(AVG({m}), 6) AS {m}, ROUND(STDDEV_SAMP({m}), 6) AS {m}_sd, ROUND(1.96 * STDDEV_SAMP({m}), 6) AS {m}_ci95" for m in ("l_quantity", "l_discount")) + " FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(spark, d):
    out = relational.summarise(load(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])
    return out.select("l_returnflag", "l_linestatus", *_r(out.columns[2:]))


@query("agg_mean_interval", "SELECT event_type, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_SAMP(value), 6) AS sd, COUNT(value) AS n, ROUND(1.96 * STDDEV_SAMP(value) / SQRT(COUNT(value)), 6) AS half_width FROM events GROUP BY event_type")
def _(spark, d):
    return relational.summarise_mean_interval(load(spark, d, "events"), ["event_type"], "value").select("event_type", *_r(["mean", "sd"]), "n", *_r(["half_width"]))


@query("best_per_group_ties", "WITH m AS (SELECT p_brand, p_size, AVG(p_retailprice) AS p_retailprice FROM part GROUP BY p_brand, p_size) SELECT p_brand, p_size, ROUND(p_retailprice, 4) AS p_retailprice FROM m QUALIFY p_retailprice = MAX(p_retailprice) OVER (PARTITION BY p_brand)")
def _(spark, d):
    return relational.best_of_groups(load(spark, d, "part"), "p_brand", "p_size", "p_retailprice").select("p_brand", "p_size", F.round("p_retailprice", 4).alias("p_retailprice"))


@query("group_median", "SELECT o_orderpriority, ROUND(MEDIAN(o_totalprice), 4) AS median_price FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return load(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("median_price"))


@query("top_groups", "SELECT p_brand, p_type, p_size, ROUND(AVG(p_retailprice), 4) AS p_retailprice FROM part GROUP BY p_brand, p_type, p_size ORDER BY AVG(p_retailprice) DESC, p_brand, p_type, p_size LIMIT 10")
def _(spark, d):
    return relational.top_groups(load(spark, d, "part"), ["p_brand", "p_type", "p_size"], "p_retailprice").withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("distinct_in_order", "SELECT event_type, MIN(event_id) AS first_position FROM events GROUP BY event_type")
def _(spark, d):
    return relational.distinct_in_order(load(spark, d, "events"), "event_type", "event_id")


@query("last_five_mean", "SELECT user_id, ROUND(AVG(value), 6) AS value FROM (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY user_id")
def _(spark, d):
    return relational.last_mean(load(spark, d, "events"), "user_id", "event_id", "value").withColumn("value", F.round("value", 6))


@query("extremes", "SELECT event_type, ROUND(MAX(value), 6) AS top, ROUND(MIN(value), 6) AS low, ARG_MAX(event_id, value * 1000000 + event_id / 1000000.0) AS at_top FROM events GROUP BY event_type")
def _(spark, d):
    e = load(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.max("value"), 6).alias("top"), F.round(F.min("value"), 6).alias("low"), F.max_by("event_id", F.col("value") * 1000000 + F.col("event_id") / F.lit(1000000.0)).alias("at_top"))


@query("split_60_20_20", "WITH r AS (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) AS i, COUNT(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN i <= FLOOR(n * 0.6) THEN 'train' WHEN i <= FLOOR(n * 0.6) + FLOOR(n * 0.2) THEN 'val' ELSE 'test' END AS part FROM r")
def _(spark, d):
    return relational.split_rows(load(spark, d, "orders").select("o_orderkey"), "o_orderkey", [0.6, 0.2, 0.2], ["train", "val", "test"]).select("o_orderkey", "part")


# -- columns by name -----------------------------------------------------------------------------------------------------------------------------


@query("name_match_any", "SELECT p_partkey, p_name FROM part WHERE (regexp_matches(p_name, '^red') OR regexp_matches(p_name, 'bolt$')) AND NOT regexp_matches(p_name, 'small')")
def _(spark, d):
    return load(spark, d, "part").where(columns.matching("p_name", ["^red", "bolt$"], exclude="small")).select("p_partkey", "p_name")


@query("name_match_all", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'e') AND regexp_matches(p_name, 't')")
def _(spark, d):
    return load(spark, d, "part").where(columns.matching("p_name", ["e", "t"], every=True)).select("p_partkey", "p_name")


def _shorten_sql(x: str) -> str:
    out = f"replace(lower({x}), '_', '.')"
    for step in columns.SHORTER:
        out = f"regexp_replace({out}, '\\.{{2,}}', '.', 'g')" if step is None else f"replace({out}, '{step[0]}', '{step[1]}')"
    return out


@query("shorten_names", f"SELECT p_partkey, {_shorten_sql(chr(39) + 'T1Hier_volume__' + chr(39) + ' || p_type || ' + chr(39) + '_superior_' + chr(39) + ' || p_name')} AS short FROM part")
def _(spark, d):
    return load(spark, d, "part").select("p_partkey", columns.shorten(F.concat(F.lit("T1Hier_volume__"), "p_type", F.lit("_superior_"), "p_name")).alias("short"))


@query("asym_and_average", "SELECT vec_id, " + ", ".join(f"ROUND(ABS(CAST(embedding[{j + 1}] AS DOUBLE) - CAST(embedding[{j + 33}] AS DOUBLE)), 6) AS \"Asym_{j}\", ROUND(0.5 * (CAST(embedding[{j + 1}] AS DOUBLE) + CAST(embedding[{j + 33}] AS DOUBLE)), 6) AS \"LRAVG_{j}\"" for j in range(4)) + " FROM embeddings")
def _(spark, d):
    e = _dims(spark, d, list(range(4)) + list(range(32, 36)))
    e = e.toDF("vec_id", *[f"left_{j}" for j in range(4)], *[f"right_{j}" for j in range(4)])
    left = [f"left_{j}" for j in range(4)]
    out = columns.add_side_average(columns.add_asymmetry(e, left), left)
    return out.select("vec_id", *_r([f"{t}_{j}" for j in range(4) for t in ("Asym", "LRAVG")]))


@query("quality_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 102.5 AND c_mktsegment <> 'BUILDING'")
def _(spark, d):
    return columns.quality_rows(load(spark, d, "customer"), "c_acctbal", 102.5, F.col("c_mktsegment") != "BUILDING").select("c_custkey", "c_acctbal")


@query("drop_constant_columns", "SELECT c_custkey, ROUND(COALESCE((c_acctbal - AVG(c_acctbal) OVER ()) / STDDEV_SAMP(c_acctbal) OVER (), 0), 6) AS c_acctbal FROM customer")
def _(spark, d):
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(3.0).alias("same"), F.lit(None).cast("double").alias("none"))
    out, kept = prep.standardise_block(c, ["c_acctbal", "same", "none"])
    return out.select("c_custkey", *_r(kept))


@query("long_records", "SELECT vec_id, name, ROUND(value, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT vec_id, 'e{i}' AS name, CAST(embedding[{i + 1}] AS DOUBLE) AS value FROM embeddings" for i in range(3)) + ")")
def _(spark, d):
    return long_records(_dims(spark, d, [0, 1, 2]), "vec_id", ["e0", "e1", "e2"]).select("vec_id", "name", F.round("value", 6).alias("value"))


# -- scaling -------------------------------------------------------------------------------------------------------------------------------------

_FOUR = list(range(4))
_CELLS = " UNION ALL ".join(f"SELECT e{i} AS x FROM h" for i in _FOUR)


def _scaling_sql(cell: Callable[[int], str]) -> str:
    filled = ", ".join(f"COALESCE(h.e{i}, f.m) AS e{i}" for i in _FOUR)
    return f"WITH h AS ({_sql_dims(_FOUR, True)}), f AS (SELECT AVG(x) AS m FROM ({_CELLS})), x AS (SELECT h.vec_id, {filled} FROM h, f) SELECT vec_id, " + ", ".join(f"ROUND({cell(i)}, 8) AS e{i}" for i in _FOUR) + " FROM x"


def _scaled_query(methods: list[str]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        h = _dims(spark, d, _FOUR, True)
        return prep.fit_scaling(h, _e(_FOUR), methods).apply(h).select("vec_id", *_r(_e(_FOUR), 8))

    return run


_SQUARES = "SQRT(" + " + ".join(f"SUM(e{i} * e{i}) OVER ()" for i in _FOUR) + ")"
for _name, _methods, _cell in (
    ("nan_fill_global", ["none"], lambda i: f"e{i}"),
    ("scale_center", ["center"], lambda i: f"e{i} - AVG(e{i}) OVER ()"),
    ("scale_zscore", ["centerAndScale"], lambda i: f"(e{i} - AVG(e{i}) OVER ()) / STDDEV_SAMP(e{i}) OVER ()"),
    ("scale_np", ["np"], lambda i: f"e{i} / (COUNT(*) OVER () * 4)"),
    ("scale_sqrtnp", ["sqrtnp"], lambda i: f"e{i} / SQRT(COUNT(*) OVER () * 4)"),
    ("scale_norm", ["norm"], lambda i: f"e{i} / ({_SQUARES} + 1e-10)"),
    ("scale_zscore_np", ["centerAndScale", "np"], lambda i: f"(e{i} - AVG(e{i}) OVER ()) / STDDEV_SAMP(e{i}) OVER () / (COUNT(*) OVER () * 4)"),
):
    QUERIES[_name], SQL[_name] = _scaled_query(_methods), _scaling_sql(_cell)


@query("scale_eigenvalue", f"WITH x AS ({_sql_dims([0, 1])}), g AS (SELECT SUM(e0 * e0) AS a, SUM(e0 * e1) AS b, SUM(e1 * e1) AS c FROM x) SELECT vec_id, " + ", ".join(f"ROUND(e{i} / (SQRT(a + c + 2 * SQRT(a * c - b * b)) + 1e-10), 8) AS e{i}" for i in (0, 1)) + " FROM x, g")
def _(spark, d):
    x = _dims(spark, d, [0, 1])
    return prep.fit_scaling(x, ["e0", "e1"], ["eigenvalue"]).apply(x).select("vec_id", *_r(["e0", "e1"], 8))


@query("impute_column_mean", f"WITH h AS ({_sql_dims(_FOUR, True)}) SELECT vec_id, " + ", ".join(f"ROUND(COALESCE(e{i}, AVG(e{i}) OVER ()), 6) AS e{i}" for i in _FOUR) + " FROM h")
def _(spark, d):
    return prep.impute_column_means(_dims(spark, d, _FOUR, True), _e(_FOUR)).select("vec_id", *_r(_e(_FOUR)))


@query("residualize_one_covariate", "WITH r AS (SELECT o_orderkey, o_totalprice AS y, CAST(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS DOUBLE) AS x FROM orders), s AS (SELECT REGR_SLOPE(y, x) AS b, REGR_INTERCEPT(y, x) AS a FROM r) SELECT o_orderkey, ROUND(y - a - b * x, 3) AS o_totalprice FROM r, s")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", F.datediff("o_orderdate", F.to_date(F.lit("1990-01-01"))).cast("double").alias("day"))
    return prep.residualise(o, ["o_totalprice"], "day").select("o_orderkey", F.round("o_totalprice", 3).alias("o_totalprice"))


@query("rank_transform", f"WITH x AS ({_sql_dims(_FOUR)}), c AS (" + " UNION ALL ".join(f"SELECT vec_id, 'e{i}' AS name, e{i} AS v FROM x" for i in _FOUR) + ") SELECT vec_id, name, ROW_NUMBER() OVER (PARTITION BY name ORDER BY v, vec_id) - 1 AS rank FROM c")
def _(spark, d):
    return relational.rank_positions(_dims(spark, d, _FOUR), _e(_FOUR), "vec_id").withColumn("rank", F.col("rank").cast("long"))


# -- moments, similarity, orthogonality ------------------------------------------------------------------------------------------------------------

_BOTH = LO + HI
_X = f"x AS ({_sql_dims(_BOTH)})"
_CENTRED = "c AS (SELECT vec_id, " + ", ".join(f"e{i} - AVG(e{i}) OVER () AS e{i}" for i in _BOTH) + " FROM x)"


@query("gram_long", f"WITH {_X} " + " UNION ALL ".join(f"SELECT {a} AS i, {b} AS j, ROUND(SUM(e{i} * e{j}), 6) AS value FROM x" for a, i in enumerate(LO) for b, j in enumerate(HI)))
def _(spark, d):
    return moments.gram_long(_dims(spark, d, _BOTH), "vec_id", _e(LO), _e(HI)).select("i", "j", F.round("value", 6).alias("value"))


@query("gram_moments", f"WITH {_X} " + " UNION ALL ".join(f"SELECT {a} AS i, {b} AS j, ROUND(SUM(e{i} * e{j}), 6) AS value FROM x" for a, i in enumerate(LO) for b, j in enumerate(LO)))
def _(spark, d):
    g, _, _ = moments.second_moments(_dims(spark, d, LO), _e(LO))
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(8) for j in range(8)], "i int, j int, value double").select("i", "j", F.round("value", 6).alias("value"))


@query("corr_adjacency", f"WITH {_X} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, " + ("1.0" if i == j else f"ROUND(CASE WHEN ABS(CORR(e{i}, e{j})) >= 0.02 THEN CORR(e{i}, e{j}) ELSE 0 END, 6)") + " AS r" + (" FROM x" if i != j else "") for i in _FOUR for j in _FOUR))
def _(spark, d):
    a = moments.correlation_adjacency(_dims(spark, d, _FOUR), _e(_FOUR), 0.02)
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(4) for j in range(4)], "i int, j int, r double").select("i", "j", F.round("r", 6).alias("r"))


def _sum_squares(a: list[int], b: list[int]) -> str:
    return " + ".join(f"POWER(SUM(e{i} * e{j}), 2)" for i in a for j in b)


@query("rv_coefficient", f"WITH {_X}, {_CENTRED} SELECT ROUND(({_sum_squares(LO, HI)}) / SQRT(({_sum_squares(LO, LO)}) * ({_sum_squares(HI, HI)})), 8) AS rv FROM c")
def _(spark, d):
    return _one(spark, rv=metrics.rv_columns(_dims(spark, d, _BOTH), _e(LO), _e(HI))).select(F.round("rv", 8).alias("rv"))


def _defect_sql() -> str:
    off = " + ".join(f"POWER(SUM(e{i} * e{j}), 2)" for i in _FOUR for j in _FOUR if i != j)
    norm = " + ".join(f"SUM(e{i} * e{i})" for i in _FOUR)
    stiefel = " + ".join(f"POWER(SUM(e{i} * e{j}) - {int(i == j)}, 2)" for i in _FOUR for j in _FOUR)
    cosine = " + ".join(f"POWER(SUM(e{i} * e{j}), 2) / (SUM(e{i} * e{i}) * SUM(e{j} * e{j}))" for i in _FOUR for j in _FOUR if i != j)
    return f"WITH {_X} SELECT ROUND(({off}) / POWER({norm}, 2), 8) AS invariant, ROUND(SQRT({stiefel}), 6) AS stiefel, ROUND(({cosine}) / 12, 8) AS mean FROM x"


@query("orthogonality_defects", _defect_sql())
def _(spark, d):
    g, _, _ = moments.second_moments(_dims(spark, d, _FOUR), _e(_FOUR))
    # the defects only depend on the Gram matrix: any root of it will do
    a = np.linalg.cholesky(g).T
    out = _one(spark, invariant=linalg.orthogonality_defect(a), stiefel=linalg.stiefel_defect(a), mean=linalg.mean_defect(a))
    return out.select(F.round("invariant", 8).alias("invariant"), F.round("stiefel", 6).alias("stiefel"), F.round("mean", 8).alias("mean"))


@query("procrustes_k2", f"WITH {_X}, {_CENTRED}, m AS (SELECT SUM(e0*e32) AS a, SUM(e0*e33) AS b, SUM(e1*e32) AS c, SUM(e1*e33) AS d, SUM(e0*e0+e1*e1) AS x, SUM(e32*e32+e33*e33) AS y FROM c) SELECT ROUND((a*a+b*b+c*c+d*d + 2*ABS(a*d-b*c)) / (x*y), 8) AS r2 FROM m")
def _(spark, d):
    return _one(spark, r2=metrics.latent_recovery(_dims(spark, d, _BOTH), ["e32", "e33"], ["e0", "e1"])).select(F.round("r2", 8).alias("r2"))


@query("latent_std_diagnostics", f"WITH {_X}, s AS (SELECT [" + ", ".join(f"STDDEV_SAMP(e{i})" for i in LO) + "] AS s FROM x) SELECT ROUND(list_avg(s), 6) AS u_std_mean, ROUND(list_min(s), 6) AS u_std_min, ROUND(list_max(s), 6) AS u_std_max, ROUND(list_max(s) / (list_min(s) + 1e-8), 6) AS u_std_ratio, CAST(len(list_filter(s, lambda z: z < 1e-4)) AS DOUBLE) AS collapsed_dims FROM s")
def _(spark, d):
    out = metrics.spread(_dims(spark, d, LO), _e(LO))
    return _one(spark, **out).select(*_r(["u_std_mean", "u_std_min", "u_std_max", "u_std_ratio"]), "collapsed_dims")


@query("ols_r2_one", "SELECT ROUND(REGR_R2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def _(spark, d):
    return _one(spark, r2=metrics.outcome_r2(load(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")).select(F.round("r2", 8).alias("r2"))


@query("view_consistency", f"WITH {_X} SELECT ROUND((" + " + ".join(f"ABS(CORR(e{i}, e{i + 32}))" for i in _FOUR) + ") / 4, 8) AS consistency FROM x")
def _(spark, d):
    return _one(spark, consistency=metrics.consistency(_dims(spark, d, _BOTH), _e(_FOUR), _e([i + 32 for i in _FOUR]))).select(F.round("consistency", 8).alias("consistency"))


@query("conditional_gaussian_k1", f"WITH {_X}, s AS (SELECT AVG(e0) AS a, AVG(e32) AS b, COVAR_SAMP(e0, e32) / (VAR_SAMP(e0) + 1e-4) AS g FROM x) SELECT vec_id, ROUND(b + g * (e0 - a), 8) AS c_e32 FROM x, s")
def _(spark, d):
    x = _dims(spark, d, _BOTH)
    return neural.JointGaussian.fit(x, ["e0", "e32"]).predict(x, ["e0"], ["e32"]).select("vec_id", F.round("c_e32", 8).alias("c_e32"))


@query("linear_map_one", f"WITH {_X} SELECT ROUND(COVAR_POP(e0, e32) * COUNT(*) / (VAR_POP(e0) * COUNT(*) + 1e-6), 8) AS slope FROM x")
def _(spark, d):
    x = _dims(spark, d, _BOTH)
    row = x.agg(F.avg("e0"), F.avg("e32")).first()
    g, _, _ = moments.second_moments(x, ["e0", "e32"], list(row))
    return _one(spark, slope=linalg.ridge(g[:1, :1], g[:1, 1:])[0, 0]).select(F.round("slope", 8).alias("slope"))


# -- neighbours ------------------------------------------------------------------------------------------------------------------------------------

_DISTANCE = "SQRT(" + " + ".join(f"POWER(a.e{i} - b.e{i}, 2)" for i in LO) + ")"


def _knn_sql(k: int, left: str = "", right: str = "", kernel: str = "d") -> str:
    return f"WITH x AS ({_sql_dims(LO)}), p AS (SELECT a.vec_id AS i, b.vec_id AS j, {_DISTANCE} AS d FROM x a, x b WHERE true {left} {right}) SELECT i, j, ROUND({kernel}, 6) AS d FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY i ORDER BY d, j) <= {k}"


@query("knn_self", _knn_sql(4))
def _(spark, d):
    return neighbors.nearest_self(_dims(spark, d, LO), "vec_id", _e(LO), 3).withColumn("d", F.round("d", 6))


@query("knn_by_cells", SQL["knn_self"])
def _(spark, d):
    rows = _dims(spark, d, LO)
    return neighbors.nearest_by_cells(rows, rows, "vec_id", _e(LO), 4, cell_rows=200)[0].withColumn("d", F.round("d", 6))


@query("knn_gaussian", _knn_sql(4, kernel="EXP(-d * d / 0.5)"))
def _(spark, d):
    return neighbors.nearest_self(_dims(spark, d, LO), "vec_id", _e(LO), 3, sigma=0.5).withColumn("d", F.round("d", 6))


@query("knn_xy", f"WITH a AS ({_sql_dims(LO)}), y AS ({_sql_dims(HI)}), b AS (SELECT vec_id, " + ", ".join(f"e{i + 32} AS e{i}" for i in LO) + f" FROM y), p AS (SELECT a.vec_id AS i, b.vec_id AS j, {_DISTANCE} AS d FROM a, b) SELECT i, j, ROUND(d, 6) AS d FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY i ORDER BY d, j) <= 2")
def _(spark, d):
    other = _dims(spark, d, HI).toDF("vec_id", *_e(LO))
    return neighbors.nearest(_dims(spark, d, LO), other, "vec_id", _e(LO), 2).withColumn("d", F.round("d", 6))


# -- bases in long form ----------------------------------------------------------------------------------------------------------------------------

_V = " UNION ALL ".join(f"SELECT 'e' AS view, vec_id AS feature, {i} AS component, CAST(embedding[{i + 1}] AS DOUBLE) AS loading FROM embeddings" for i in _FOUR)


def _loadings(spark: SparkSession, d: str) -> DataFrame:
    x = _dims(spark, d, _FOUR)
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("component"), F.col(f"e{i}").alias("loading")) for i in _FOUR])).alias("c")
    return x.select(F.lit("e").alias("view"), F.col("vec_id").alias("feature"), cell).select("view", "feature", "c.component", "c.loading")


@query("topk_loadings", f"SELECT view, feature, component, ROUND(loading, 6) AS loading, ROW_NUMBER() OVER (PARTITION BY view, component ORDER BY ABS(loading) DESC, feature) AS place FROM ({_V}) QUALIFY place <= 5")
def _(spark, d):
    return relational.top_loadings(_loadings(spark, d), 5).select("view", "feature", "component", F.round("loading", 6).alias("loading"), F.col("place").cast("long"))


@query("loading_norms", f"SELECT view, component, COUNT(*) FILTER (WHERE ABS(loading) > 1e-8) AS l0, ROUND(SUM(ABS(loading)), 6) AS l1, ROUND(SQRT(SUM(loading * loading)), 6) AS l2, ROUND(AVG(CASE WHEN ABS(loading) > 1e-8 THEN 1.0 ELSE 0.0 END), 6) AS density FROM ({_V}) GROUP BY view, component")
def _(spark, d):
    return relational.loading_norms(_loadings(spark, d)).select("view", "component", "l0", *_r(["l1", "l2", "density"]))


@query("soft_threshold_quantile", f"WITH v AS ({_V}), q AS (SELECT view, component, QUANTILE_CONT(ABS(loading), 0.3) AS cut FROM v GROUP BY view, component) SELECT v.view, feature, v.component, ROUND(SIGN(loading) * GREATEST(ABS(loading) - cut, 0), 6) + 0.0 AS loading FROM v JOIN q ON v.view = q.view AND v.component = q.component")
def _(spark, d):
    return relational.soft_thresholded(_loadings(spark, d), 0.3).withColumn("loading", F.round("loading", 6) + F.lit(0.0))


@query("feature_importance", f"SELECT view, feature, ROUND(SUM(ABS(loading) * (component + 1)), 6) AS importance FROM ({_V}) GROUP BY view, feature")
def _(spark, d):
    weights = spark.createDataFrame([("e", i, float(i + 1)) for i in _FOUR], "view string, component int, importance double")
    return relational.feature_importance(_loadings(spark, d), weights).withColumn("importance", F.round("importance", 6))


@query("l1_normalised", f"SELECT view, feature, component, ROUND(loading / SUM(ABS(loading)) OVER (PARTITION BY view, component), 8) AS loading FROM ({_V})")
def _(spark, d):
    v = _loadings(spark, d)
    unit = lambda part: part.assign(loading=prep.l1_normalise(part[["loading"]].to_numpy())[:, 0])  # noqa: E731  # a column of a basis
    return v.groupBy("view", "component").applyInPandas(unit, v.schema).withColumn("loading", F.round("loading", 8))


@query("cumvar_rank", f"WITH v AS (SELECT view, component, SQRT(SUM(loading * loading)) AS value FROM ({_V}) GROUP BY view, component) SELECT view, component, ROUND(SUM(value * value) OVER (PARTITION BY view ORDER BY component) / SUM(value * value) OVER (PARTITION BY view), 8) AS share FROM v")
def _(spark, d):
    v = _loadings(spark, d).groupBy("view", "component").agg(F.sqrt(F.sum(F.col("loading") ** 2)).alias("value"))
    return relational.variance_shares(v, 0.9).select("view", "component", F.round("share", 8).alias("share"))


# -- fixed bases: scores, reconstructions, energies --------------------------------------------------------------------------------------------------


def _basis(dims: list[int], k: int) -> np.ndarray:
    return np.array([[_weight(i, j) for j in range(k)] for i in dims])


@query("project_fixed_basis", f"WITH {_X} SELECT vec_id, " + ", ".join(f"ROUND({_weighted_sql(LO, j)}, 6) AS \"lo_PC{j + 1}\"" for j in range(2)) + ", " + ", ".join(f"ROUND({_weighted_sql(HI, j)}, 6) AS \"hi_PC{j + 1}\"" for j in range(2)) + " FROM x")
def _(spark, d):
    out, added = columns.apply_bases(_dims(spark, d, _BOTH), {"lo": _basis(LO, 2), "hi": _basis(HI, 2)}, {"lo": _e(LO), "hi": _e(HI)})
    return out.select("vec_id", *_r(added))


@query("reconstruct_fixed_maps", f"WITH {_X}, u AS (SELECT vec_id, {_weighted_sql(LO, 0)} AS u1, {_weighted_sql(LO, 1)} AS u2 FROM x) SELECT vec_id, " + ", ".join(f"ROUND(u1 * ({_weight(i, 2)}) + u2 * ({_weight(i, 3)}), 6) AS r_e{i}" for i in HI[:3]) + " FROM u")
def _(spark, d):
    scored, us = columns.apply_bases(_dims(spark, d, _BOTH), {"u": _basis(LO, 2)}, {"u": _e(LO)})
    made = {f"r_e{i}": columns.weighted_sum(us, [_weight(i, 2), _weight(i, 3)]) for i in HI[:3]}
    return scored.withColumns(made).select("vec_id", *_r(list(made)))


@query("counterfactual_shift", f"WITH {_X} SELECT vec_id, " + ", ".join(f"ROUND(e{i} + 0.5 * ({_weight(i, 0)}) - 0.25 * ({_weight(i, 1)}), 6) AS e{i}" for i in LO) + " FROM x")
def _(spark, d):
    change = explain.counterfactual(_basis(LO, 2), np.array([[0.5, -0.25]]))[0]
    x = _dims(spark, d, LO)
    return x.select("vec_id", *[F.round(F.col(f"e{i}") + F.lit(float(c)), 6).alias(f"e{i}") for i, c in zip(LO, change)])


def _two_views(spark: SparkSession, d: str) -> Moments:
    x = _dims(spark, d, _BOTH)
    _, m = prep.fit_scalings(x, {"lo": _e(LO), "hi": _e(HI)}, ["center"], moments=True)
    return m


def _energy_sql(value: str) -> str:
    return f"WITH {_X}, {_CENTRED}, s AS (SELECT *, {_weighted_sql(LO, 0)} AS p, {_weighted_sql(HI, 0)} AS u FROM c) SELECT ROUND({value}, 8) AS energy FROM s"


_V0 = sum(_weight(i, 0) ** 2 for i in LO)
for _name, _value in (
    ("acc", "-ABS(SUM(u * p)) / (COUNT(*) - 1)"),
    ("nc", "-SUM(u * p) / (SQRT(SUM(u * u)) * SQRT(SUM(p * p)) + 1e-10)"),
    ("regression", "SUM(" + " + ".join(f"POWER(e{i} - u * ({_weight(i, 0)}), 2)" for i in LO) + ")"),
    ("logcosh", "-(ABS(SUM(u * p)) - LN(2) + LN(1 + EXP(-2 * ABS(SUM(u * p))))) / COUNT(*)"),
    ("exp", "EXP(-POWER(SUM(u * p), 2) / 2) / COUNT(*)"),
    ("gauss", "0.5 * EXP(-POWER(SUM(u * p), 2)) / COUNT(*)"),
    ("kurtosis", "-POWER(SUM(u * p), 4) / 4 / COUNT(*)"),
):

    def _energy(spark: SparkSession, d: str, kind: str = _name) -> DataFrame:
        m = _two_views(spark, d)
        return _one(spark, energy=energy(m, 0, _basis(LO, 1), only(m, 1, _basis(HI, 1)), kind)).select(F.round("energy", 8).alias("energy"))

    QUERIES[f"energy_{_name}"], SQL[f"energy_{_name}"] = _energy, _energy_sql(_value)


@query("consensus_avg_fixed", f"WITH {_X}, {_CENTRED}, p AS (SELECT vec_id, {_weighted_sql(LO, 0)} AS a, {_weighted_sql(HI, 0)} AS b FROM c), n AS (SELECT SQRT(SUM(a * a) / COUNT(*)) + 1e-8 AS ra, SQRT(SUM(b * b) / COUNT(*)) + 1e-8 AS rb FROM p), u AS (SELECT vec_id, (a / ra + b / rb) / 2 AS u FROM p, n) SELECT vec_id, ROUND(u / (STDDEV_SAMP(u) OVER () + 1e-6), 6) AS u_1 FROM u")
def _(spark, d):
    from .functions.gram import consensus

    x = _dims(spark, d, _BOTH)
    scalings, m = prep.fit_scalings(x, {"lo": _e(LO), "hi": _e(HI)}, ["center"], moments=True)
    u: Score = consensus(m, [_basis(LO, 1), _basis(HI, 1)], "avg")[0]
    return prep.apply_all(x, scalings).select("vec_id", F.round(columns.weighted_sum(_e(_BOTH), u.stacked()[:, 0]), 6).alias("u_1"))


@query("relative_error_fixed", f"WITH {_X}, {_CENTRED}, s AS (SELECT *, {_weighted_sql(HI, 0)} AS u FROM c) SELECT ROUND(SQRT(SUM(" + " + ".join(f"POWER(e{i} - u * ({_weight(i, 1)}), 2)" for i in LO) + ") / SUM(" + " + ".join(f"e{i} * e{i}" for i in LO) + ")), 8) AS error FROM s")
def _(spark, d):
    from .functions.gram import reconstruction_error

    m = _two_views(spark, d)
    return _one(spark, error=reconstruction_error(m, 0, only(m, 1, _basis(HI, 1)), _basis(LO, 2)[:, 1:].T)).select(F.round("error", 8).alias("error"))


@query("reconstruction_mse", f"WITH {_X} SELECT ROUND((" + " + ".join(f"AVG(POWER(e{i} - e{i + 32}, 2))" for i in _FOUR) + ") / 4, 8) AS mse FROM x")
def _(spark, d):
    x = _dims(spark, d, _BOTH)
    x = x.withColumns({f"r_e{i}": F.col(f"e{i + 32}") for i in _FOUR})
    return _one(spark, mse=metrics.reconstruction_mse(x, {"lo": _e(_FOUR)})).select(F.round("mse", 8).alias("mse"))


@query("event_windows", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS start, event_type, COUNT(*) AS n, ROUND(AVG(value), 6) AS mean_value FROM events GROUP BY ALL")
def _(spark, d):
    w = whitening.event_windows(load(spark, d, "events"), "ts", "1 hour", "10 minutes", ["event_type"])
    return w.select(F.unix_timestamp("window.start").cast("double").alias("start"), "event_type", "n", F.round("mean_value", 6).alias("mean_value"))


# -- whole models: their values are held by tests; here they run over whole tables -----------------------------------------------------------------


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Customers' two views, standardised, their consensus of two components: c_custkey, u_1, u_2."""
    v = _customer_views(spark, d)
    f = linear.canonical(linear.fit(v, CUSTOMER_VIEWS, linear.Spec(k=2, mixer="avg", iterations=20)))
    return linear.add_scores(v, f).select("c_custkey", "u_1", "u_2")


query("embed_customers")(flagship)


@query("predict_customers")
def _(spark, d):
    v = _customer_views(spark, d)
    f = linear.canonical(linear.fit(v, CUSTOMER_VIEWS, linear.Spec(k=2, iterations=20)))
    out, _ = linear.predict(v, f)
    return out.select("c_custkey", *[c for c in out.columns if c[:2] in ("u_", "z_", "r_")])


@query("predict_transductive")
def _(spark, d):
    v = _customer_views(spark, d)
    f = linear.canonical(linear.fit(v, CUSTOMER_VIEWS, linear.Spec(k=2, mixer="newton", topology="loo", iterations=5)))
    return linear.add_scores(v, f, transductive=True).select("c_custkey", "u_orders_1", "u_orders_2", "u_lines_1", "u_lines_2")


@query("rank_estimate")
def _(spark, d):
    return _one(spark, k=linear.estimate_rank(_customer_views(spark, d), "c_custkey", CUSTOMER_VIEWS))


@query("alignment_permutations")
def _(spark, d):
    out = linear.alignment_test(_customer_views(spark, d), "c_custkey", CUSTOMER_VIEWS, linear.Spec(k=2))
    return _one(spark, observed=out["observed"], p=out["p"])


@query("refit_permutations")
def _(spark, d):
    out = linear.refit_test(_customer_views(spark, d), "c_custkey", CUSTOMER_VIEWS, linear.Spec(k=2))
    return _one(spark, observed=out["observed"], t=out["t"], p=out["p"])


@query("path_of_views")
def _(spark, d):
    steps = linear.path(_customer_views(spark, d), CUSTOMER_VIEWS, [[0], [0, 1]], linear.Spec(k=2, iterations=5))
    return spark.createDataFrame([(str(s["views"]), float(s["rv_with_last"])) for s in steps], "views string, rv double")


@query("energy_by_feature")
def _(spark, d):
    f = linear.fit(_customer_views(spark, d), CUSTOMER_VIEWS, linear.Spec(k=2, iterations=5))
    rows = [(v, c, float(x)) for v, part in linear.decompose(f).items() for c, x in part["features"].items()]
    return spark.createDataFrame(rows, "view string, feature string, importance double")


@query("attribution_report")
def _(spark, d):
    f = linear.fit(_customer_views(spark, d), CUSTOMER_VIEWS, linear.Spec(k=2, iterations=5))
    return _one(spark, **explain.report_metrics(explain.report(f)))


@query("multiscale_spectrum")
def _(spark, d):
    return neighbors.multiscale_spectrum(_dims(spark, d, LO), "vec_id", _e(LO), [1.0, 2.0], 3, 3)


@query("neural_scores")
def _(spark, d):
    v = stored(_customer_views(spark, d), "customers")
    f = neural.fit_neural(v, CUSTOMER_VIEWS, neural.NeuralSpec(kind="lend", k=2, batch=256, hidden=(16, 8)))
    return neural.score_neural(v, f, reconstruct=False).select("c_custkey", "u_orders_1", "u_orders_2", "u_lines_1", "u_lines_2")


@query("flow_roundtrip")
def _(spark, d):
    v = stored(_customer_views(spark, d), "customers")
    f = neural.fit_neural(v, CUSTOMER_VIEWS, neural.NeuralSpec(kind="flow", k=2, batch=256, flow_hidden=16))
    return neural.score_neural(v, f).select("c_custkey", "u_1", "u_2", "r_mean_price")


@query("flow_imputation")
def _(spark, d):
    v = stored(_customer_views(spark, d), "customers")
    f = neural.fit_neural(v, CUSTOMER_VIEWS, neural.NeuralSpec(kind="flow_v", k=2, batch=256, flow_hidden=16))
    return neural.impute_view(v, f, "orders", "lines").select("c_custkey", "i_mean_quantity")


@query("synthetic_case")
def _(spark, d):
    return generators.build(spark, "shared_plus_private", n=200, widths=(5, 4)).df.select("row_id", "y", "t_1", "t_2", "x1_0", "x2_0")


@query("benchmark_one")
def _(spark, d):
    case = generators.build(spark, "linear_footprint", n=200, k=2, widths=(6, 5), noise=0.2)
    out = harness.run_one(case, "linear", 2, iterations=5)
    return _one(spark, **{k: v for k, v in out.items() if isinstance(v, (int, float)) and k != "fit_seconds"})


@query("embed_named_table")
def _(spark, d):
    v = _customer_views(spark, d)
    f, rows = embed.embed_table(v, linear.Spec(k=2, iterations=5), CUSTOMER_VIEWS, covariates="days")
    return linear.add_scores(rows, linear.canonical(f)).select("c_custkey", "u_1", "u_2")


@query("extend_embedding")
def _(spark, d):
    v = _customer_views(spark, d)
    bases = {"orders": np.eye(4)[:, :2]}
    out, info = embed.extend_embedding(v, bases, {"orders": CUSTOMER_VIEWS["orders"]}, {"lines": CUSTOMER_VIEWS["lines"]})
    return out.select("c_custkey", *info["scored"], *info["added"])


from . import forms  # noqa: E402, F401  # registers the forms with fixed parameters
