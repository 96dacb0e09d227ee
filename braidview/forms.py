"""Queries in which an operator's parameters are fixed, so that SQL can say what it gives: fits of one column a view, fixed bases, closed forms of two columns, literal matrices."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import _BOTH, _CENTRED, _FOUR, _X, HI, LO, _basis, _customer_views, _dims, _e, _one, _ORDER_STATS, _r, _sql_dims, _two_views, _weight, _weighted_sql, SQL, query
from .functions import constraints, gram, linalg, steps
from .functions.autodiff import Var, var
from .operators import columns, moments, permutations, prep, relational, wide
from .plans import embed, explain, linear, metrics, neural
from .sources import study, tables
from .sources.scratch import stored
from .streaming import stateful, whitening


def _table(spark: SparkSession, rows: list, schema: str, *rounded: str, digits: int = 8) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return df.select(*[F.round(c, digits).alias(c) if c in rounded else F.col(c) for c in df.columns])


def _values(v: np.ndarray, names: str) -> str:
    """A small matrix as a VALUES list of (i, columns)."""
    rows = ", ".join("(" + ", ".join([str(i), *[f"CAST({float(x)!r} AS DOUBLE)" for x in row]]) + ")" for i, row in enumerate(np.atleast_2d(v.T).T))
    return f"(VALUES {rows}) AS v(i, {names})"


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the warehouse's tables, which executors can write to."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_{name}-{uuid.uuid4().hex}"


# -- sources -------------------------------------------------------------------------------------------------------------------------------------


@query("csv_roundtrip", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def _(spark, d):
    path = _scratch(spark, "csv")
    o = tables.load(spark, d, "orders")
    done = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    for name, part in (("a", done), ("b", ~done)):
        tables.write_delimited(o.where(part).select("o_orderkey", "o_orderpriority", "o_totalprice"), f"{path}/{name}")
    return tables.read_delimited(spark, [f"{path}/a", f"{path}/b"], "o_orderkey long, o_orderpriority string, o_totalprice double")


@query("artifact_roundtrip", "SELECT s_suppkey, s_name, s_acctbal * 2.0 AS twice FROM supplier")
def _(spark, d):
    path = tables.write_artifact({"t": tables.load(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "scale": np.array([[2.0]]), "list": [np.ones(1), {"a": 1}]}, _scratch(spark, "artifact"), clear=True)
    got = tables.read_artifact(path, spark)
    return got["t"].select("s_suppkey", "s_name", (F.col("s_acctbal") * float(got["scale"][0, 0])).alias("twice"))


def _study(spark: SparkSession, d: str) -> str:
    """A study in a new folder: what users did (``activity``, two thirds of them), how often (``counts``), and their highest value, which isn't a number for some."""
    path, e = _scratch(spark, "study"), tables.load(spark, d, "events")
    e.where("user_id % 3 <> 0").groupBy("user_id", "event_type").agg(F.avg("value").alias("v")).select(F.col("user_id").alias("sampleId"), F.col("event_type").alias("entrezGeneId"), F.col("v").alias("value")).write.csv(f"{path}/activity", header=True)
    e.groupBy("user_id", "event_type").count().select(F.col("user_id").alias("sampleId"), F.col("event_type").alias("entrezGeneId"), F.col("count").alias("value")).write.csv(f"{path}/counts", header=True)
    top = F.when(F.col("sampleId") % 5 == 0, F.lit("[Not Available]")).otherwise(F.col("m").cast("string"))
    e.groupBy(F.col("user_id").alias("sampleId")).agg(F.max("value").alias("m")).select("sampleId", top.alias("months")).write.csv(f"{path}/clinical", header=True)
    return path


@query("study_views", "SELECT user_id AS sample, ROUND(MAX(value), 6) AS outcome, ROUND(COALESCE(AVG(value) FILTER (WHERE event_type = 'click'), 0), 6) AS activity_click, ROUND(COALESCE(AVG(value) FILTER (WHERE event_type = 'view'), 0), 6) AS activity_view, "
       "CAST(COUNT(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS counts_error FROM events WHERE user_id % 3 <> 0 AND user_id % 5 <> 0 GROUP BY user_id HAVING MAX(value) IS NOT NULL")
def _(spark, d):
    out, _ = study.study_views(spark, _study(spark, d), {"activity": ["click", "view"], "counts": ["error"]}, "months", sample="sampleId", feature="entrezGeneId")
    return out.select("sample", *_r(["outcome", "activity_click", "activity_view"]), F.col("counts_error").cast("double").alias("counts_error"))


@query("matrix_source", "SELECT n_nationkey AS row_id, CASE WHEN n_nationkey % 3 <> 0 THEN a END AS x0, CASE WHEN n_nationkey % 2 = 0 THEN b END AS x1 FROM (SELECT n_nationkey, CAST(COUNT(c_custkey) AS DOUBLE) AS a, ROUND(COALESCE(SUM(c_acctbal), 0), 2) AS b FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_nationkey)")
def _(spark, d):
    c = tables.load(spark, d, "nation").join(tables.load(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    rows = c.groupBy("n_nationkey").agg(F.count("c_custkey").cast("double").alias("a"), F.round(F.coalesce(F.sum("c_acctbal"), F.lit(0.0)), 2).alias("b")).orderBy("n_nationkey").collect()
    nan = float("nan")
    return tables.from_matrix(spark, [[r["a"] if r["n_nationkey"] % 3 else nan, nan if r["n_nationkey"] % 2 else r["b"]] for r in rows])


_MARKED = ["T1Hier_a_vol", "DTI_b", "x_mean_fa_c", "x_mean_md_d", "rsfMRI_e", "perf_cbf_f", "T1Hier_DTI_g", "unrelated"]


@query("assemble_views", "WITH n AS (SELECT [" + ", ".join(f"'{n}'" for n in _MARKED) + "][s_suppkey % 8 + 1] || '_' || s_suppkey AS name FROM supplier) " + " UNION ALL ".join(f"SELECT '{v}' AS view, name FROM n WHERE " + " OR ".join(f"contains(name, '{m}')" for m in ms) for v, ms in columns.VIEW_MARKS.items()))
def _(spark, d):
    name = F.concat_ws("_", F.get(F.array(*[F.lit(n) for n in _MARKED]), (F.col("s_suppkey") % 8).cast("int")), F.col("s_suppkey").cast("string"))
    names = [r[0] for r in tables.load(spark, d, "supplier").select(name).collect()]  # as names of columns
    return spark.createDataFrame([(v, n) for v, ns in columns.assemble_views(names).items() for n in ns], "view string, name string")


_IMAGING = ["T1w_thk_a", "T1w_SNR", "mtl_x", "mtl_mask", "cerebellum_y", "DTI_fa_left", "DTI_evr", "perf_cbf_b", "perf_area", "unrelated"]


@query("imaging_predictors", "SELECT * FROM (VALUES (1, 'T1w_thk_a'), (2, 'mtl_x'), (3, 'cerebellum_y'), (4, 'perf_cbf_b'), (5, 'DTI_fa_left')) AS t(place, name)")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(columns.imaging_predictors(_IMAGING), 1)), "place int, name string")


@query("lower_sides", "SELECT c_custkey AS \"left_custkey\", c_acctbal AS \"right_acctbal\" FROM customer")
def _(spark, d):
    c = tables.load(spark, d, "customer").select(F.col("c_custkey").alias("Left_custkey"), F.col("c_acctbal").alias("Right_acctbal"))
    return columns.lower_sides(c)


@query("project_shortened", f"WITH x AS ({_sql_dims([0, 1])}) SELECT vec_id, ROUND(e0 * ({_weight(0, 0)}) + e1 * ({_weight(1, 0)}), 6) AS \"b_PC1\" FROM x")
def _(spark, d):
    x = _dims(spark, d, [0, 1]).toDF("vec_id", "T1Hier_Volume_a", "T1Hier_Volume__b")
    out, added = columns.apply_bases_shortened(x, {"b": _basis([0, 1], 1)}, {"b": ["t1.vol.a", "t1.vol.b"]})
    return out.select("vec_id", *_r(added))


@query("zero_constant_columns", "SELECT c_custkey, ROUND((c_acctbal - AVG(c_acctbal) OVER ()) / STDDEV_SAMP(c_acctbal) OVER (), 6) AS c_acctbal, CAST(0 AS DOUBLE) AS same, CAST(0 AS DOUBLE) AS none FROM customer")
def _(spark, d):
    c = tables.load(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(3.0).alias("same"), F.lit(None).cast("double").alias("none"))
    out, kept = prep.standardise_block(c, ["c_acctbal", "same", "none"], "zero")
    return out.select("c_custkey", *_r(kept))


@query("sigmoid_softplus", "SELECT event_id, ROUND(1 / (1 + EXP(-value)), 8) AS sigmoid, ROUND(GREATEST(value, 0) + LN(1 + EXP(-ABS(value))), 8) AS softplus FROM events")
def _(spark, d):
    v = F.col("value")
    return tables.load(spark, d, "events").select("event_id", F.round(relational.sigmoid(v), 8).alias("sigmoid"), F.round(relational.softplus(v), 8).alias("softplus"))


# -- fits of one column a view --------------------------------------------------------------------------------------------------------------------

_PAIR = {"orders": ["mean_price"], "lines": ["mean_quantity"]}
_PAIR_SQL = """v AS (SELECT c.c_custkey, a.mean_price AS x, b.mean_quantity AS y FROM customer c JOIN (SELECT o_custkey, AVG(o_totalprice) AS mean_price FROM orders GROUP BY 1) a ON c.c_custkey = a.o_custkey
JOIN (SELECT o_custkey, AVG(l_quantity) AS mean_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) b ON c.c_custkey = b.o_custkey),
z AS (SELECT c_custkey, (x - AVG(x) OVER ()) / STDDEV_SAMP(x) OVER () AS zx, (y - AVG(y) OVER ()) / STDDEV_SAMP(y) OVER () AS zy FROM v),
m AS (SELECT *, zx / (SQRT(AVG(zx * zx) OVER ()) + 1e-8) / 2 + zy / (SQRT(AVG(zy * zy) OVER ()) + 1e-8) / 2 AS w FROM z),
u AS (SELECT c_custkey, zx, zy, w / (STDDEV_SAMP(w) OVER () + 1e-6) AS u FROM m)"""


def _pair_fit(spark: SparkSession, d: str) -> tuple[DataFrame, linear.Fit]:
    v = _customer_views(spark, d)
    return v, linear.fit(v, _PAIR, linear.Spec(k=1, mixer="avg", quantile=0.0, scale=("centerAndScale",), iterations=5))


@query("fit_single_columns", f"WITH {_PAIR_SQL} SELECT c_custkey, ROUND(ABS(u), 2) AS size FROM u")
def _(spark, d):
    v, f = _pair_fit(spark, d)
    return linear.add_scores(v, f).select("c_custkey", F.round(F.abs("u_1"), 2).alias("size"))


@query("predict_single_columns", f"WITH {_PAIR_SQL}, f AS (SELECT SUM(u * zx) / SUM(u * u) AS fx, SUM(u * zy) / SUM(u * u) AS fy FROM u) SELECT c_custkey, ROUND(u * fx, 2) + 0.0 AS r_mean_price, ROUND(u * fy, 2) + 0.0 AS r_mean_quantity FROM u, f")
def _(spark, d):
    v, f = _pair_fit(spark, d)
    out, _ = linear.predict(v, f)
    return out.select("c_custkey", *[(F.round(c, 2) + F.lit(0.0)).alias(c) for c in ("r_mean_price", "r_mean_quantity")])


@query("transductive_single_columns", f"WITH {_PAIR_SQL}, s AS (SELECT c_custkey, zx - AVG(zx) OVER () AS a, zy - AVG(zy) OVER () AS b FROM z), t AS (SELECT c_custkey, a / (SQRT(AVG(a * a) OVER ()) + 1e-8) / 2 + b / (SQRT(AVG(b * b) OVER ()) + 1e-8) / 2 AS t FROM s) SELECT c_custkey, ROUND(ABS(t) / (STDDEV_SAMP(t) OVER () + 1e-6), 2) AS size FROM t")
def _(spark, d):
    v, f = _pair_fit(spark, d)
    return linear.add_scores(v, f, transductive=True).select("c_custkey", F.round(F.abs("u_1"), 2).alias("size"))


@query("path_single_columns", f"WITH {_PAIR_SQL} SELECT '[0]' AS views, ROUND(POWER(CORR(zx, u), 2), 5) AS rv FROM u UNION ALL SELECT '[0, 1]', 1.0")
def _(spark, d):
    found = linear.path(_customer_views(spark, d), _PAIR, [[0], [0, 1]], linear.Spec(k=1, mixer="avg", quantile=0.0, scale=("centerAndScale",), iterations=5))
    return _table(spark, [(str(s["views"]), float(s["rv_with_last"])) for s in found], "views string, rv double", "rv", digits=5)


@query("attribution_single_columns", f"WITH {_PAIR_SQL} SELECT 'orders' AS view, ROUND(POWER(CORR(zx, u), 2), 5) AS r2 FROM u UNION ALL SELECT 'lines', ROUND(POWER(CORR(zy, u), 2), 5) FROM u UNION ALL SELECT 'combined', 1.0")
def _(spark, d):
    _, f = _pair_fit(spark, d)
    found = explain.attribute_scores(f)
    rows = [(v, x["global_r2"]) for v, x in found["per_view"].items()] + [("combined", found["combined"]["global_r2"])]
    return _table(spark, rows, "view string, r2 double", "r2", digits=5)


@query("report_single_columns", f"WITH {_PAIR_SQL}, r AS (SELECT POWER(CORR(zx, u), 2) AS x, POWER(CORR(zy, u), 2) AS y FROM u) SELECT 1.0 AS mean_density, 0.0 AS mean_defect, ROUND((x + y) / 2, 5) AS mean_alignment_r2, ROUND(GREATEST(x, y), 5) AS best_alignment_r2, 1.0 AS combined_r2 FROM r")
def _(spark, d):
    out = explain.report_metrics(explain.report(_pair_fit(spark, d)[1]))
    return _one(spark, **out).select(*_r(list(out), 5))


@query("outcome_single_columns", f"WITH {_PAIR_SQL}, y AS (SELECT u.*, s FROM u JOIN (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY 1) o ON o_custkey = c_custkey) SELECT 'orders' AS part, ROUND(POWER(CORR(zx, s), 2), 5) AS r2 FROM y UNION ALL SELECT 'lines', ROUND(POWER(CORR(zy, s), 2), 5) FROM y UNION ALL SELECT 'score', ROUND(POWER(CORR(u, s), 2), 5) FROM y")
def _(spark, d):
    v, f = _pair_fit(spark, d)
    found = explain.attribute_outcome(v, f, "sum_price")
    rows = [(k, float(x["global_r2"])) for k, x in found["per_view"].items()] + [("score", float(found["score"]["global_r2"]))]
    return _table(spark, rows, "part string, r2 double", "r2", digits=5)


_DAYS = "(SELECT o_custkey, CAST(MAX(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01')) AS DOUBLE) AS t FROM orders GROUP BY 1)"


@query("embed_residual_columns", "WITH " + _PAIR_SQL.replace("z AS (SELECT c_custkey, (x - AVG", f"w AS (SELECT c_custkey, x - REGR_INTERCEPT(x, t) OVER () - REGR_SLOPE(x, t) OVER () * t AS x, y - REGR_INTERCEPT(y, t) OVER () - REGR_SLOPE(y, t) OVER () * t AS y FROM v JOIN {_DAYS} ON o_custkey = c_custkey),\nz AS (SELECT c_custkey, (x - AVG", 1).replace("AS zy FROM v)", "AS zy FROM w)", 1) + " SELECT c_custkey, ROUND(ABS(u), 2) AS size FROM u")
def _(spark, d):
    spec = linear.Spec(k=1, mixer="avg", quantile=0.0, scale=("centerAndScale",), iterations=5)
    f, rows = embed.embed_table(_customer_views(spark, d), spec, _PAIR, covariates="days")
    return linear.add_scores(rows, f).select("c_custkey", F.round(F.abs("u_1"), 2).alias("size"))


# -- permutations --------------------------------------------------------------------------------------------------------------------------------


def _permuted_sql(seed: int) -> str:
    order = lambda view: f"CAST(('0x' || substr(md5('{seed}:{view}:' || vec_id), 1, 15)) AS BIGINT)"
    return f"x AS ({_sql_dims([0, 32])}), a AS (SELECT vec_id, e0, ROW_NUMBER() OVER (ORDER BY {order(0)}, vec_id) AS p FROM x), b AS (SELECT e32, ROW_NUMBER() OVER (ORDER BY {order(1)}, vec_id) AS p FROM x)"


@query("hash_permutation", f"WITH {_permuted_sql(7)} SELECT vec_id, ROUND(e0, 6) AS e0, ROUND(e32, 6) AS e32 FROM a JOIN b USING (p)")
def _(spark, d):
    out = linear.shuffled(_dims(spark, d, [0, 32]), "vec_id", {"lo": ["e0"], "hi": ["e32"]}, 7)
    return out.select("vec_id", *_r(["e0", "e32"]))


@query("permutation_null_rv", " UNION ALL ".join(f"(WITH {_permuted_sql(s)} SELECT {s} AS seed, ROUND(POWER(CORR(e0, e32), 2), 8) AS rv FROM a JOIN b USING (p))" for s in (1, 2, 3)))
def _(spark, d):
    x, views = _dims(spark, d, [0, 32]), {"lo": ["e0"], "hi": ["e32"]}
    scalings, _ = prep.fit_scalings(x, views, ["center"])
    rows = []
    for seed in (1, 2, 3):
        m = linear.permutation_moments(x, "vec_id", scalings, views, seed)
        rows.append((seed, gram.rv_of(m, gram.only(m, 0, np.eye(1)), gram.only(m, 1, np.eye(1)))))
    return _table(spark, rows, "seed int, rv double", "rv")


#: Permutations, seed and rows of a stratum of the query below.
_MANY, _MANY_SEED, _STRATUM = 100, 11, 300
_MOVES = ", ".join(f"({t}, {a}, {b})" for t, (a, b) in enumerate(permutations.affine(_MANY_SEED, _MANY, 2)[:, 1].tolist()))
_PLACED = f"""x AS ({_sql_dims([0, 1, 32, 33])}), h AS (SELECT *, CAST(('0x' || substr(md5('{_MANY_SEED}:0:' || vec_id), 1, 15)) AS BIGINT) AS h FROM x),
s AS (SELECT *, h % (SELECT greatest(1, CAST(ceil(count(*) / {_STRATUM}.0) AS BIGINT)) FROM x) AS s FROM h),
p AS (SELECT s, ROW_NUMBER() OVER (PARTITION BY s ORDER BY h, vec_id) - 1 AS q, COUNT(*) OVER (PARTITION BY s) AS m, {", ".join(f"e{i} - AVG(e{i}) OVER () AS e{i}" for i in (0, 1, 32, 33))} FROM s)"""


@query("permutation_null_of_two_columns", f"""WITH {_PLACED}, k AS (SELECT * FROM (VALUES {_MOVES}) AS k(t, a, b)),
y AS (SELECT t, s, (a * q + b) % m AS q, e32, e33 FROM p, k),
c AS (SELECT t, SUM(e0 * y.e32) AS c00, SUM(e0 * y.e33) AS c01, SUM(e1 * y.e32) AS c10, SUM(e1 * y.e33) AS c11 FROM p JOIN y USING (s, q) GROUP BY t),
o AS (SELECT SUM(e0 * e0) AS a, SUM(e0 * e1) AS b, SUM(e1 * e1) AS d, SUM(e32 * e32) AS e, SUM(e32 * e33) AS f, SUM(e33 * e33) AS g FROM p)
SELECT t AS permutation, ROUND((c00 * c00 + c01 * c01 + c10 * c10 + c11 * c11) / sqrt((a * a + 2 * b * b + d * d) * (e * e + 2 * f * f + g * g)), 8) AS rv,
ROUND(sqrt((c00 * c00 + c01 * c01 + c10 * c10 + c11 * c11 + sqrt(greatest(power(c00 * c00 + c01 * c01 + c10 * c10 + c11 * c11, 2) - 4 * power(c00 * c11 - c01 * c10, 2), 0))) / 2), 4) AS strongest FROM c, o""")
def _(spark, d):
    x, views = _dims(spark, d, [0, 1, 32, 33]), {"lo": ["e0", "e1"], "hi": ["e32", "e33"]}
    scalings, m = prep.fit_scalings(x, views, ["center"], moments=True)

    def asked(p: gram.Moments) -> list[float]:
        return [gram.rv_of(p, gram.only(p, 0, np.eye(2)), gram.only(p, 1, np.eye(2))), np.linalg.svd(p.block(0, 1), compute_uv=False)[0]]

    null = linear.null_values(x, "vec_id", scalings, m, _MANY, _MANY_SEED, asked, 2, stratum_rows=_STRATUM)
    rows = [(t, round(float(rv), 8), round(float(top), 4)) for t, (rv, top) in enumerate(null)]
    return spark.createDataFrame(rows, "permutation int, rv double, strongest double")


# -- cases ---------------------------------------------------------------------------------------------------------------------------------------

_CASE_VIEWS = {"orders": ["n_orders", "mean_price"], "lines": ["mean_quantity", "mean_discount"]}


@query("rv_by_case", f"""WITH v AS (SELECT c_nationkey, n_orders, sum_price / n_orders AS a2, sum_quantity / n AS b1, sum_discount / n AS b2 FROM customer c JOIN ({_ORDER_STATS}) a ON c.c_custkey = a.c_custkey
JOIN (SELECT o_custkey AS c_custkey, COUNT(*) AS n, SUM(l_quantity) AS sum_quantity, SUM(l_discount) AS sum_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) b ON c.c_custkey = b.c_custkey),
g AS (SELECT c_nationkey, COUNT(*) AS n, CORR(n_orders, b1) AS c11, CORR(n_orders, b2) AS c12, CORR(a2, b1) AS c21, CORR(a2, b2) AS c22, CORR(n_orders, a2) AS a, CORR(b1, b2) AS b FROM v GROUP BY c_nationkey)
SELECT CAST(c_nationkey AS VARCHAR) AS nation, n, ROUND((c11 * c11 + c12 * c12 + c21 * c21 + c22 * c22) / sqrt((2 + 2 * a * a) * (2 + 2 * b * b)), 6) AS rv FROM g WHERE n > 3""")
def _(spark, d):
    rows = _customer_views(spark, d).join(tables.load(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    asked = lambda m, _: {"rv": float(gram.rv_of(m, gram.only(m, 0, np.eye(2)), gram.only(m, 1, np.eye(2))))}
    out = linear.by_case(rows, "c_nationkey", _CASE_VIEWS, ["centerAndScale"], asked, "rv double")
    return out.where("n > 3").select(F.col("case").alias("nation"), "n", F.round("rv", 6).alias("rv"))


@query("fits_by_case")
def _(spark, d):
    rows = _customer_views(spark, d).join(tables.load(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    out = linear.fit_by_case(rows, "c_nationkey", _CASE_VIEWS, linear.Spec(k=1))
    return out.select(F.col("case").alias("nation"), "n", "rounds", F.element_at("energies", -1).alias("energy"))


# -- wide views ----------------------------------------------------------------------------------------------------------------------------------


def _bought(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, int]]:
    """A row a customer: how much of each part, and from each supplier, they bought; and how many columns that makes."""
    lines = tables.load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity").join(tables.load(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = stored(wide.sparse_views(lines, "o_custkey", {"parts": "l_partkey", "suppliers": "l_suppkey"}, "l_quantity"), "bought")
    top = rows.agg(*[F.max(F.array_max(f"{v}.at")).alias(v) for v in ("parts", "suppliers")]).first()
    return rows, {v: top[v] + 1 for v in ("parts", "suppliers")}


@query("wide_range_pass", """WITH c AS (SELECT o_custkey AS r, l_partkey AS c, SUM(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL), n AS (SELECT COUNT(DISTINCT r) AS n FROM c),
m AS (SELECT c, SUM(v) / n AS m FROM c, n GROUP BY c, n), o AS (SELECT SUM(m * sin(c)) AS o0, SUM(m * cos(c)) AS o1 FROM m),
y AS (SELECT r, SUM(v * sin(c)) - o0 AS y0, SUM(v * cos(c)) - o1 AS y1 FROM c, o GROUP BY r, o0, o1), w AS (SELECT SUM(y0) AS w0, SUM(y1) AS w1 FROM y),
z AS (SELECT c, SUM(v * y0) AS z0, SUM(v * y1) AS z1 FROM c JOIN y USING (r) GROUP BY c)
SELECT c AS part, ROUND(z0 - m * w0, 3) AS z0, ROUND(z1 - m * w1, 3) AS z1 FROM z JOIN m USING (c), w""")
def _(spark, d):
    rows, widths = _bought(spark, d)
    scalings, _ = wide.fit_wide_scalings(rows, {"parts": widths["parts"]}, scale=False, divide=False)
    at = np.arange(widths["parts"], dtype=float)
    z = wide.range_pass(rows, scalings, np.column_stack([np.sin(at), np.cos(at)]))
    seen = np.flatnonzero(scalings["parts"].shift != 0.0)
    return spark.createDataFrame([(int(i), round(float(z[i, 0]), 3), round(float(z[i, 1]), 3)) for i in seen], "part long, z0 double, z1 double")


@query("wide_singular_values")
def _(spark, d):
    rows, widths = _bought(spark, d)
    scalings, n = wide.fit_wide_scalings(rows, widths, divide=False)
    found = wide.wide_range(rows, scalings, n, 10, passes=3).singular_values(3)
    return spark.createDataFrame([(v, j, float(x)) for v, s in zip(widths, found) for j, x in enumerate(s)], "view string, place int, value double")


@query("wide_scores")
def _(spark, d):
    rows, widths = _bought(spark, d)
    f = linear.fit_wide(rows, widths, linear.Spec(k=2, iterations=20))
    return linear.add_wide_scores(rows, f).select("o_custkey", "u_1", "u_2")


# -- fixed bases ---------------------------------------------------------------------------------------------------------------------------------

_VIEWS = {"lo": _e(LO), "hi": _e(HI)}
_SCORES = f"s AS (SELECT *, {_weighted_sql(LO, 0)} AS p, {_weighted_sql(HI, 0)} AS u FROM c)"


def _fixed_fit(spark: SparkSession, d: str) -> linear.Fit:
    """Both views with a fixed basis of one component; the score is the second view's."""
    m = _two_views(spark, d)
    bases = [_basis(LO, 1), _basis(HI, 1)]
    return linear.Fit(linear.Spec(k=1), _VIEWS, {}, bases, [gram.only(m, 1, bases[1])], [], [], 0, m.n, m)


def _slopes_sql(view: str, dims: list[int]) -> str:
    return " UNION ALL ".join(f"SELECT '{view}' AS view, 'e{i}' AS feature, ROUND(ABS(SUM(e{i} * u)) / (COUNT(*) - 1), 8) AS importance FROM s" for i in dims)


@query("energy_by_feature_fixed", f"WITH {_X}, {_CENTRED}, {_SCORES} {_slopes_sql('lo', LO)} UNION ALL {_slopes_sql('hi', HI)}")
def _(spark, d):
    found = linear.decompose(_fixed_fit(spark, d), "acc")
    return _table(spark, [(v, c, float(x)) for v, part in found.items() for c, x in part["features"].items()], "view string, feature string, importance double", "importance")


@query("pair_similarity_fixed", f"WITH {_X}, {_CENTRED}, {_SCORES} SELECT 'lo' AS a, 'hi' AS b, ROUND(POWER(CORR(p, u), 2), 8) AS rv FROM s")
def _(spark, d):
    return _table(spark, [(*k, float(v)) for k, v in linear.pair_similarity(_fixed_fit(spark, d)).items()], "a string, b string, rv double", "rv")


@query("reconstruction_map_fixed", f"WITH {_X}, {_CENTRED}, {_SCORES} " + " UNION ALL ".join(f"SELECT 'e{i}' AS feature, ROUND(SUM(e{i} * u) / SUM(u * u), 8) AS weight FROM s" for i in LO))
def _(spark, d):
    f = _fixed_fit(spark, d)
    w = gram.reconstruction_map(f.moments, 0, f.scores[0])
    return _table(spark, [(c, float(x)) for c, x in zip(_e(LO), w[0])], "feature string, weight double", "weight")


@query("attribute_scores_fixed", f"WITH {_X}, {_CENTRED}, {_SCORES}, g AS (SELECT SUM(p * p) AS pp, SUM(p * u) AS pu, SUM(u * u) AS uu FROM s) SELECT 'lo' AS view, ROUND(pu / (pp + 1e-6), 8) AS coefficient, ROUND(1 - (uu - 2 * pu / (pp + 1e-6) * pu + POWER(pu / (pp + 1e-6), 2) * pp) / uu, 8) AS r2 FROM g UNION ALL SELECT 'hi', ROUND(uu / (uu + 1e-6), 8), ROUND(1 - (uu - 2 * uu / (uu + 1e-6) * uu + POWER(uu / (uu + 1e-6), 2) * uu) / uu, 8) FROM g")
def _(spark, d):
    found = explain.attribute_scores(_fixed_fit(spark, d))["per_view"]
    return _table(spark, [(v, float(x["coefficients"][0, 0]), x["global_r2"]) for v, x in found.items()], "view string, coefficient double, r2 double", "coefficient", "r2")


def _consensus(spark: SparkSession, d: str, *names: str, **options) -> DataFrame:
    x = _dims(spark, d, _BOTH)
    scalings, m = prep.fit_scalings(x, _VIEWS, ["center"], moments=True)
    found = gram.consensus(m, [_basis(LO, 1), _basis(HI, 1)], **options)
    sizes = [F.round(F.abs(columns.weighted_sum(_e(_BOTH), u.stacked()[:, 0])), 4).alias(n) for u, n in zip(found, names)]
    return prep.apply_all(x, scalings).select("vec_id", *sizes)


_UNIT = f"WITH {_X}, {_CENTRED}, p AS (SELECT vec_id, {_weighted_sql(LO, 0)} AS a, {_weighted_sql(HI, 0)} AS b FROM c), n AS (SELECT vec_id, a / (SQRT(AVG(a * a) OVER ()) + 1e-8) AS a, b / (SQRT(AVG(b * b) OVER ()) + 1e-8) AS b FROM p)"
# the larger of two eigenvalues l, and its vector (y, l - x)
_BY_SVD = f"{_UNIT}, k AS (SELECT SUM(a * a) AS x, SUM(a * b) AS y, SUM(b * b) AS z FROM n), l AS (SELECT y, (z - x) / 2 + SQRT(POWER((x - z) / 2, 2) + y * y) AS h FROM k), u AS (SELECT vec_id, (a * y + b * h) / SQRT(y * y + h * h) AS u FROM n, l) SELECT vec_id, ROUND(ABS(u) / (STDDEV_SAMP(u) OVER () + 1e-6), 4) AS size FROM u"
for _mixer in ("svd", "pca"):
    query(f"consensus_{_mixer}_fixed", _BY_SVD)(lambda spark, d, mixer=_mixer: _consensus(spark, d, "size", mixer=mixer))
_BY_NEWTON = f"{_UNIT}, u AS (SELECT vec_id, (a + b) / SQRT(SUM((a + b) * (a + b)) OVER ()) AS u FROM n) SELECT vec_id, ROUND(ABS(u) / (STDDEV_SAMP(u) OVER () + 1e-6), 4) AS size FROM u"
query("consensus_newton_fixed", _BY_NEWTON)(lambda spark, d: _consensus(spark, d, "size", mixer="newton"))
_OTHERS = f"{_UNIT} SELECT vec_id, ROUND(ABS(b) / (STDDEV_SAMP(b) OVER () + 1e-6), 4) AS lo, ROUND(ABS(a) / (STDDEV_SAMP(a) OVER () + 1e-6), 4) AS hi FROM n"
query("consensus_loo_fixed", _OTHERS)(lambda spark, d: _consensus(spark, d, "lo", "hi", mixer="avg", topology="loo"))
query("consensus_graph_fixed", _OTHERS)(lambda spark, d: _consensus(spark, d, "lo", "hi", mixer="avg", topology="graph", graph=linear.path_graph([(0, 1)], 2)))


# -- closed forms of two columns --------------------------------------------------------------------------------------------------------------------

_GRAM = f"WITH x AS ({_sql_dims([0, 1])}), g AS (SELECT SUM(e0 * e0) AS a, SUM(e0 * e1) AS b, SUM(e1 * e1) AS c FROM x)"
_ROOT = "SQRT(POWER((a - c) / 2, 2) + b * b)"


@query("singular_values_two", f"{_GRAM} SELECT 1 AS place, ROUND(SQRT((a + c) / 2 + {_ROOT}), 6) AS value FROM g UNION ALL SELECT 2, ROUND(SQRT((a + c) / 2 - {_ROOT}), 6) FROM g")
def _(spark, d):
    g, _, _ = moments.second_moments(_dims(spark, d, [0, 1]), ["e0", "e1"])
    s, _ = linalg.gram_svd(g, 2)
    return _table(spark, [(i + 1, float(x)) for i, x in enumerate(s)], "place int, value double", "value", digits=6)


@query("initial_basis_two", f"WITH x AS ({_sql_dims([0, 1])}), y AS (SELECT e0 - AVG(e0) OVER () AS e0, e1 - AVG(e1) OVER () AS e1 FROM x), g AS (SELECT SUM(e0 * e0) AS a, SUM(e0 * e1) AS b, SUM(e1 * e1) AS c FROM y), l AS (SELECT *, (a + c) / 2 + {_ROOT} AS l FROM g) SELECT 0 AS i, ROUND(ABS(b) / SQRT(b * b + POWER(l - a, 2)), 6) AS size FROM l UNION ALL SELECT 1, ROUND(ABS(l - a) / SQRT(b * b + POWER(l - a, 2)), 6) FROM l")
def _(spark, d):
    _, m = prep.fit_scalings(_dims(spark, d, [0, 1]), {"v": ["e0", "e1"]}, ["center"], moments=True)
    return _table(spark, [(i, float(abs(x))) for i, x in enumerate(linear.initial_bases(m, 1)[0][:, 0])], "i int, size double", "size", digits=6)


@query("correlation_table", f"WITH {_X} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, " + (f"ROUND(CORR(e{i}, e{j}), 6)" if i != j else "1.0") + " AS r" + (" FROM x" if i != j else "") for i in _FOUR for j in _FOUR))
def _(spark, d):
    a = moments.correlation_adjacency(_dims(spark, d, _FOUR), _e(_FOUR), 0.0)
    return _table(spark, [(i, j, float(a[i, j])) for i in _FOUR for j in _FOUR], "i int, j int, r double", "r", digits=6)


_THREE = {"a": [0, 1], "b": [2, 3], "c": [32, 33]}


def _rv_sql(a: str, b: str) -> str:
    squares = lambda x, y: " + ".join(f"POWER(SUM(e{i} * e{j}), 2)" for i in _THREE[x] for j in _THREE[y])
    return f"SELECT '{a}' AS a, '{b}' AS b, ROUND(({squares(a, b)}) / SQRT(({squares(a, a)}) * ({squares(b, b)})), 8) AS rv FROM c"


@query("rv_table", f"WITH {_X}, {_CENTRED} " + " UNION ALL ".join(_rv_sql(a, b) for a in _THREE for b in _THREE if a < b))
def _(spark, d):
    _, m = prep.fit_scalings(_dims(spark, d, _BOTH), {v: _e(dims) for v, dims in _THREE.items()}, ["center"], moments=True)
    own = [gram.only(m, i, np.eye(2)) for i in range(3)]
    return _table(spark, [(a, b, gram.rv_of(m, own[i], own[j])) for i, a in enumerate(_THREE) for j, b in enumerate(_THREE) if i < j], "a string, b string, rv double", "rv")


# -- metrics -------------------------------------------------------------------------------------------------------------------------------------


@query("held_out_r2", "WITH t AS (SELECT REGR_SLOPE(l_extendedprice, l_quantity) AS s, REGR_INTERCEPT(l_extendedprice, l_quantity) AS i FROM lineitem WHERE l_returnflag <> 'R'), h AS (SELECT l_extendedprice AS y, i + s * l_quantity AS f FROM lineitem, t WHERE l_returnflag = 'R') SELECT ROUND(1 - SUM(POWER(y - f, 2)) / REGR_SYY(y, y), 8) AS r2 FROM h")
def _(spark, d):
    rows = tables.load(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return _one(spark, r2=metrics.held_out_r2(rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag = 'R'"), ["l_quantity"], "l_extendedprice")).select(F.round("r2", 8).alias("r2"))


@query("all_metrics_fixed", f"WITH {_X}, {_CENTRED}, m AS (SELECT SUM(e0*e32) AS a, SUM(e0*e33) AS b, SUM(e1*e32) AS c, SUM(e1*e33) AS d, SUM(e0*e0+e1*e1) AS x, SUM(e32*e32+e33*e33) AS y, CORR(e0, e2) AS r1, CORR(e1, e2) AS r2, CORR(e0, e1) AS r12, STDDEV_SAMP(e0) AS s0, STDDEV_SAMP(e1) AS s1 FROM c) SELECT ROUND((a*a+b*b+c*c+d*d + 2*ABS(a*d-b*c)) / (x*y), 8) AS recovery, ROUND((r1*r1 + r2*r2 - 2*r1*r2*r12) / (1 - r12*r12), 8) AS outcome_r2, ROUND((s0 + s1) / 2, 8) AS u_std_mean, ROUND(LEAST(s0, s1), 8) AS u_std_min FROM m")
def _(spark, d):
    out = metrics.all_metrics(_dims(spark, d, _BOTH), ["e0", "e1"], ["e32", "e33"], "e2")
    return _one(spark, **{k: out[k] for k in ("recovery", "outcome_r2", "u_std_mean", "u_std_min")}).select(*_r(["recovery", "outcome_r2", "u_std_mean", "u_std_min"], 8))


@query("shared_private_spread", f"WITH {_X} SELECT ROUND((POWER(CORR(e0, e1), 2) + POWER(CORR(e32, e33), 2)) / 2, 8) AS shared_private_overlap, ROUND(VAR_SAMP(e0) + VAR_SAMP(e32), 8) AS shared_variance, ROUND(VAR_SAMP(e1) + VAR_SAMP(e33), 8) AS private_variance FROM x")
def _(spark, d):
    out = metrics.shared_private(_dims(spark, d, _BOTH), {"lo": ["e0"], "hi": ["e32"]}, {"lo": ["e1"], "hi": ["e33"]})
    return _one(spark, **out).select(*_r(list(out), 8))


@query("welch_and_cohen", "WITH g AS (SELECT COUNT(value) FILTER (WHERE event_type = 'click') AS na, AVG(value) FILTER (WHERE event_type = 'click') AS ma, VAR_SAMP(value) FILTER (WHERE event_type = 'click') AS va, COUNT(value) FILTER (WHERE event_type = 'view') AS nb, AVG(value) FILTER (WHERE event_type = 'view') AS mb, VAR_SAMP(value) FILTER (WHERE event_type = 'view') AS vb FROM events) SELECT ROUND((ma - mb) / SQRT(va / na + vb / nb), 8) AS t, ROUND(POWER(va / na + vb / nb, 2) / (POWER(va / na, 2) / (na - 1) + POWER(vb / nb, 2) / (nb - 1)), 5) AS df, ROUND((ma - mb) / SQRT(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 8) AS d FROM g")
def _(spark, d):
    rows = tables.load(spark, d, "events").groupBy("event_type").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")).collect()
    of = {r["event_type"]: (r["n"], r["m"], r["v"]) for r in rows}
    t, df, _ = linalg.welch_of_moments(*of["click"], *of["view"])
    return _one(spark, t=t, df=df, d=linalg.cohens_d_of_moments(*of["click"], *of["view"])).select(F.round("t", 8).alias("t"), F.round("df", 5).alias("df"), F.round("d", 8).alias("d"))


@query("anova_one_covariate", "SELECT ROUND(REGR_R2(l_tax, l_quantity) / (1 - REGR_R2(l_tax, l_quantity)) * (COUNT(*) - 2), 5) AS f, ROUND(REGR_R2(l_tax, l_quantity), 8) AS partial_eta2 FROM lineitem")
def _(spark, d):
    rows = tables.load(spark, d, "lineitem")
    mean = rows.agg(F.avg("l_quantity"), F.avg("l_tax")).first()
    g, _, n = moments.second_moments(rows, ["l_quantity", "l_tax"], list(mean))
    out = linalg.anova_of_sums(g[1, 1] - g[0, 1] ** 2 / g[0, 0], g[1, 1], 1, n - 2)
    return _one(spark, f=out["f"], partial_eta2=out["partial_eta2"]).select(F.round("f", 5).alias("f"), F.round("partial_eta2", 8).alias("partial_eta2"))


#: Four columns of eight numbers, measured on the first dimensions of both halves of ``embeddings``: mean squares, means of either half's sizes, and covariances of neighbours.
_MEASURED = [(f"AVG(e{i} * e{i})", f"AVG(ABS(e{i + 32}))", f"AVG(e{i + 32} * e{i + 32})", f"COVAR_POP(e{i}, e{(i + 1) % 8}) / (STDDEV_POP(e{i}) * STDDEV_POP(e{(i + 1) % 8}))") for i in LO]
_V2 = f"x AS ({_sql_dims(_BOTH)}), v AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {a} AS a, {b} AS b, {c} AS c, {w} AS w FROM x" for i, (a, b, c, w) in enumerate(_MEASURED)) + ")"


def _measured(spark: SparkSession, d: str) -> tuple[np.ndarray, np.ndarray]:
    """The first three columns, and the last one."""
    x = _dims(spark, d, _BOTH)
    row = x.agg(*[F.expr(e).alias(f"m{i}_{j}") for i, four in enumerate(_MEASURED) for j, e in enumerate(four)]).first()
    m = np.array([[row[f"m{i}_{j}"] for j in range(4)] for i in range(8)])
    return m[:, :3], m[:, 3:]


@query("basis_metrics", f"WITH {_V2}, n AS (SELECT SUM(a * a) + SUM(b * b) AS n FROM v) SELECT ROUND(2 * POWER(SUM(a * b) / ANY_VALUE(n), 2), 8) AS orthogonality, ROUND(POWER(CORR(a, c), 2), 8) AS recovery FROM v, n")
def _(spark, d):
    m, _ = _measured(spark, d)
    return _one(spark, orthogonality=metrics.basis_orthogonality([m[:, :2]]), recovery=metrics.basis_recovery([m[:, 2:]], [m[:, :1]])).select(*_r(["orthogonality", "recovery"], 8))


# -- constraints and step rules on measured matrices ------------------------------------------------------------------------------------------------

_L = _V2.replace("v AS (", "m AS (", 1) + ", v AS (SELECT i, a AS v, w FROM m)"
_NORM = "SQRT(SUM(v * v) OVER ())"


@query("constraint_forms", f"WITH {_L}, p AS (SELECT i, v / {_NORM} AS v, GREATEST(v, 0) AS g FROM v), q AS (SELECT QUANTILE_CONT(ABS(v), 0.3) AS cut FROM v) "
    "SELECT 'polar' AS rule, i, ROUND(v, 8) AS value FROM p UNION ALL SELECT 'newton_schulz', i, ROUND(v, 8) FROM p "
    "UNION ALL SELECT 'partly', i, ROUND(GREATEST(v, 0), 8) FROM p UNION ALL SELECT 'nonnegative', i, ROUND(g / SQRT(SUM(g * g) OVER ()), 8) FROM p "
    "UNION ALL SELECT 'soft_positive', i, ROUND(GREATEST(ABS(v) - cut, 0), 8) FROM v, q UNION ALL SELECT 'hard', i, ROUND(CASE WHEN ABS(v) < cut THEN 0 ELSE v END, 8) FROM v, q "
    "UNION ALL SELECT 'basic_ranks', i, ROUND(CASE WHEN ROW_NUMBER() OVER (ORDER BY ABS(v) DESC, i) <= 6 THEN v ELSE 0 END, 8) FROM v "
    "UNION ALL SELECT 'grassmann', i, ROUND(w - v * SUM(v * w) OVER (), 8) FROM (SELECT v.i, p.v, w FROM v JOIN p ON v.i = p.i) "
    "UNION ALL SELECT 'unit_rows', i, ROUND(v / (SQRT(v * v + w * w) + 1e-8), 8) FROM v UNION ALL SELECT 'l1', i, ROUND(v / SUM(ABS(v)) OVER (), 8) FROM v "
    "UNION ALL SELECT 'indicator', i, CASE WHEN ROW_NUMBER() OVER (ORDER BY ABS(v) DESC, i) = 1 THEN 1.0 ELSE 0.0 END FROM v")
def _(spark, d):
    m, w = _measured(spark, d)
    v = m[:, :1]
    found = {
        "polar": linalg.polar(v), "newton_schulz": linalg.newton_schulz(v, 60, 1e-15), "partly": constraints.partly_orthonormal(v, 1), "nonnegative": constraints.orthonormal_nonnegative(v, tol=1e-14),
        "soft_positive": constraints.constrain(v, constraints.parse_constraint("none"), 0.3, "positive"), "hard": constraints.threshold_columns(v, 0.3, soft=False),
        "basic_ranks": constraints.segment_by_rank(v, 0.3, basic=True, sign="either", by_column=True), "grassmann": constraints.tangent(w, linalg.polar(v), "Grassmann"),
        "unit_rows": linalg.unit_rows(np.hstack([v, w]))[:, :1], "l1": linalg.l1_columns(v), "indicator": constraints.indicator(v),
    }
    rows = [(k, i, float(x)) for k, m in found.items() for i, x in enumerate(m[:, 0])]
    return spark.createDataFrame(rows, "rule string, i int, value double").select("rule", "i", (F.round("value", 8) + F.lit(0.0)).alias("value"))


_TEXT = "CASE WHEN c_custkey % 5 = 0 THEN 'Stiefel' WHEN c_custkey % 5 = 1 THEN c_mktsegment || 'xnone' ELSE c_mktsegment || 'x' || (c_nationkey * 0.5) || 'x' || (c_custkey % 7) END"


@query("parse_constraints", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'Stiefel' ELSE c_mktsegment END AS kind, CAST(CASE WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 5 = 1 THEN 0 ELSE c_nationkey * 0.5 END AS DOUBLE) AS weight, CAST(CASE WHEN c_custkey % 5 < 2 THEN 1 ELSE c_custkey % 7 END AS INT) AS iterations FROM customer")
def _(spark, d):
    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [constraints.parse_constraint(t) for t in f["text"]]
            yield pd.DataFrame({"c_custkey": f["c_custkey"], "kind": [c.kind for c in found], "weight": [c.weight for c in found], "iterations": [c.iterations for c in found]})

    return tables.load(spark, d, "customer").select("c_custkey", F.expr(_TEXT).alias("text")).mapInPandas(parsed, "c_custkey long, kind string, weight double, iterations int")


_FIRST = {
    "gd": "0.01 * w", "adam": "0.01 * w / (ABS(w) + 1e-8)", "nadam": "0.01 * (0.9 * (0.1 * w / 0.1) + 0.1 * w / 0.1) / (ABS(w) + 1e-8)", "rmsprop": "0.01 * w / (SQRT(0.1 * w * w) + 1e-8)",
    "torch_adagrad": "0.01 * w / (ABS(w) + 1e-10)", "torch_adamw": "-0.01 * 0.01 * v + 0.01 * w / (ABS(w) + 1e-8)", "torch_nadam": "0.01 * (0.9 * (0.1 * w / 0.1) + 0.1 * w / 0.1) / (ABS(w) + 1e-8)",
    "hybrid_adam": "0.01 * 0.1 * w / (SQRT(0.001 * w * w) + 1e-8)", "lookahead": "0.01 * 0.1 * w / (SQRT(0.001 * w * w) + 1e-8)", "armijo_gradient": "0.1 * 1.01 * w", "bidirectional_armijo_gradient": "0.1 * 1.01 * w", "bidirectional_lookahead": "0.1 * 1.01 * w",
    "lars": "0.01 * SQRT(SUM(v * v) OVER ()) / (SQRT(SUM(w * w) OVER ()) + 0.001 * SQRT(SUM(v * v) OVER ()) + 1e-10) * (w - 0.001 * v)", "nsa_flow": "(v + 0.01 * w) / SQRT(SUM(POWER(v + 0.01 * w, 2)) OVER ()) - v",
    "sgd_momentum": "0.01 * 0.1 * w", "amsgrad": "0.01 * 0.1 * w / (SQRT(0.001 * w * w) + 1e-8)", "adadelta": "SQRT(1e-6 / (0.05 * w * w + 1e-6)) * w", "psgd": "0.01 * 0.1 * w / (0.99 + 0.01 * w * w + 1e-8)",
    "torch_lbfgs": "0.01 * w", "ranger": "0.01 * w", "ls_adam": "0.01 * w / (ABS(w) + 1e-8)", "ls_rmsprop": "0.01 * w / (SQRT(0.1 * w * w) + 1e-8)",
}


@query("step_rules_first_move", f"WITH {_L} " + " UNION ALL ".join(f"SELECT '{k}' AS rule, i, ROUND(v + {x}, 8) AS value FROM v" for k, x in _FIRST.items()))
def _(spark, d):
    m, w = _measured(spark, d)
    rows = [(k, i, float(x)) for k in _FIRST for i, x in enumerate(steps.make_step(k)(0, m[:, :1], w)[:, 0])]
    return _table(spark, rows, "rule string, i int, value double", "value")


@query("line_search_on_a_quadratic", f"WITH {_L} SELECT i, ROUND(w, 8) AS ahead, ROUND(w, 8) AS both FROM v")
def _(spark, d):
    m, w = _measured(spark, d)
    v = m[:, :1]
    # half of twice the way to the minimum: a step of 1 ends as high as it began, one of 1/2 in the minimum
    cost = lambda x: float(((x - w) ** 2).sum())
    g = 2.0 * (w - v)
    step = steps.backtrack(v, g, -float((g * g).sum()), cost)
    other, way = steps.backtrack_both(v, -g, float((g * g).sum()), cost)
    return _table(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip((v + step * g)[:, 0], (v + other * way)[:, 0]))], "i int, ahead double, both double", "ahead", "both")


@query("energy_prior", f"WITH {_L} SELECT ROUND(-0.5 * POWER(SUM(v * w), 2), 8) AS energy FROM v")
def _(spark, d):
    (three, w), m = _measured(spark, d), gram.Moments(np.eye(8), [0, 8], 10)
    return _one(spark, energy=gram.energy(m, 0, three[:, :1], gram.only(m, 0, three[:, :1]), "dat", w.T, 0.5)).select(F.round("energy", 8).alias("energy"))


_MOMENTS = "g AS (SELECT SUM(a * a) AS aa, SUM(a * b) AS ab, SUM(b * b) AS bb, SUM(a * w) AS aw FROM v), s AS (SELECT *, SQRT((aa + bb) / 2 + SQRT(POWER((aa - bb) / 2, 2) + ab * ab)) AS s1, SQRT((aa + bb) / 2 - SQRT(POWER((aa - bb) / 2, 2) + ab * ab)) AS s2 FROM g)"


@query("algebra_forms", f"WITH {_V2}, {_MOMENTS} SELECT 'singular' AS rule, 0 AS i, ROUND(s1, 8) AS value FROM s UNION ALL SELECT 'singular', 1, ROUND(s2, 8) FROM s UNION ALL SELECT 'condition', 0, ROUND(s1 / s2, 6) FROM s UNION ALL SELECT 'smooth', 0, ROUND(aw / aa, 8) FROM s "
    "UNION ALL SELECT 'whiten', i, ROUND(ABS(a) / SQRT(aa) / (SQRT(aa) + 1e-8), 8) FROM v, s UNION ALL SELECT 'hat', i, ROUND(a * aw / aa, 8) FROM v, s "
    "UNION ALL SELECT 'defect_gradient', i, ROUND(4 * b / SQRT(aa + bb) * ab / (aa + bb), 8) FROM v, s UNION ALL SELECT 'masked', i, ROUND(CASE WHEN ROW_NUMBER() OVER (ORDER BY ABS(a) DESC, i) = 1 THEN a ELSE 0 END, 8) FROM v "
    "UNION ALL SELECT 'largest_of_row', i, ROUND(CASE WHEN ABS(a) >= ABS(b) AND ABS(a) >= ABS(c) THEN a ELSE 0 END, 8) FROM v")
def _(spark, d):
    three, w = _measured(spark, d)
    two, one = three[:, :2], three[:, :1]
    found = {
        "singular": linalg.svd(two)[1], "condition": [round(linalg.orthogonality_summary(two)["condition_number"], 6)], "smooth": linalg.smooth_regression(one, w)["coefficients"].ravel(),
        "whiten": np.abs(linalg.whiten(one)[:, 0]), "hat": linalg.hat_prediction(one, w)[:, 0], "defect_gradient": linalg.orthogonality_defect_gradient(two)[:, 0],
        "masked": constraints.masked_by_indicator(one)[:, 0], "largest_of_row": constraints.segment_by_rank(three, 0.67, basic=True, sign="either")[:, 0],
    }
    rows = [(k, i, float(x)) for k, m in found.items() for i, x in enumerate(m)]
    return spark.createDataFrame(rows, "rule string, i int, value double").select("rule", "i", (F.round("value", 8) + F.lit(0.0)).alias("value"))


@query("penalties", f"WITH {_V2} SELECT ROUND(GREATEST(0, 1 - SQRT(VAR_POP(a) + 1e-4)), 8) AS variance, ROUND(POWER(COVAR_SAMP(a, b), 2), 8) AS covariance, ROUND(POWER(COVAR_SAMP(a, w), 2), 8) AS crossed, ROUND(-ABS(COVAR_SAMP(a, w)), 8) AS acc, CAST(-SIGN(COVAR_SAMP(a, w)) AS DOUBLE) AS nc FROM v")
def _(spark, d):
    three, w = _measured(spark, d)
    a, w = var(three[:, :1]), var(w)
    found = {
        "variance": neural.variance_penalty(a), "covariance": neural.covariance_penalty(var(three[:, :2])), "crossed": neural.cross_penalty(a, w), "acc": neural.similarity(a, w, "acc"), "nc": neural.similarity(a, w, "nc"),
    }
    return _one(spark, **{k: float(np.asarray(x.x)) for k, x in found.items()}).select(*_r(list(found), 8))


@query("neural_optimisers_first_move", f"WITH {_L}, g AS (SELECT i, v, w / GREATEST(1.0, SQRT(SUM(w * w) OVER ())) + 1e-4 * v AS g FROM v) SELECT 'sgd' AS rule, i, ROUND(v - 5e-4 * g, 10) AS value FROM g UNION ALL SELECT 'adam', i, ROUND(v - 5e-4 * g / (ABS(g) + 1e-8), 10) FROM g UNION ALL SELECT 'larslow', i, ROUND(v - 5e-4 * 1e-3 * SQRT(SUM(v * v) OVER ()) / (SQRT(SUM(g * g) OVER ()) + 1e-8) * g, 10) FROM g")
def _(spark, d):
    (three, w), rows = _measured(spark, d), []
    for rule in ("sgd", "adam", "larslow"):
        params = {"x": three[:, :1].copy()}
        neural.Optimiser(neural.NeuralSpec(kind="lend", k=1, optimizer=rule)).step(params, {"x": w.copy()}, 0)
        rows += [(rule, i, float(x)) for i, x in enumerate(params["x"][:, 0])]
    return _table(spark, rows, "rule string, i int, value double", "value", digits=10)


# -- neural parts ---------------------------------------------------------------------------------------------------------------------------------


@query("projection_schedule", "SELECT vec_id, CASE WHEN vec_id % 20 < 12 THEN 0.0 ELSE LEAST(1.0, (vec_id % 20 - 11) / 8.0) END AS alpha FROM embeddings")
def _(spark, d):
    spec = neural.NeuralSpec(kind="lend", k=2, epochs=20, warmup=5, first_layer="scheduled")

    def at(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"vec_id": f["vec_id"], "alpha": [neural.alpha_at(spec, int(e) % 20) for e in f["vec_id"]]})

    return tables.load(spark, d, "embeddings").select(F.col("vec_id").cast("long")).mapInPandas(at, "vec_id long, alpha double")


@query("gating_weights", f"WITH x AS ({_sql_dims(_BOTH)}), m AS (" + " UNION ALL ".join(f"SELECT {i} AS i, ABS(CORR(e{i}, e{i + 32})) AS m FROM x" for i in range(3)) + "), e AS (SELECT e, 5 + 10 * LEAST(1.0, e / 30.0) AS s, GREATEST(0.0, LEAST(1.0, (e - 10) / 20.0)) AS rho FROM range(0, 41, 5) AS t(e)), r AS (SELECT CAST(e AS INT) AS epoch, CAST(i AS INT) AS view, rho, m / (1 + EXP(-s * (m - (SELECT AVG(m) FROM m)))) AS raw FROM m, e) SELECT epoch, view, ROUND((1 - rho) / 3 + rho * raw / (SUM(raw) OVER (PARTITION BY epoch) + 1e-8), 8) AS weight FROM r")
def _(spark, d):
    row = _dims(spark, d, _BOTH).agg(*[F.abs(F.corr(f"e{i}", f"e{i + 32}")).alias(f"m{i}") for i in range(3)]).first()
    rows = [(e, i, float(x)) for e in range(0, 41, 5) for i, x in enumerate(neural.gate(np.array(list(row)), e))]
    return _table(spark, rows, "epoch int, view int, weight double", "weight")


@query("view_agreement", f"WITH {_X}, {_CENTRED}, u AS (SELECT e0 / SQRT(SUM(e0 * e0) OVER ()) AS a, e32 / SQRT(SUM(e32 * e32) OVER ()) AS b FROM c), r AS (SELECT SUM(a * b) AS r FROM u) SELECT 'procrustes_r2' AS measure, ROUND(GREATEST(0, 2 * ABS(r) - 1), 8) AS value FROM r UNION ALL SELECT 'procrustes_r2_sharp', ROUND(GREATEST(0, 2 * ABS(r) - 1), 8) FROM r UNION ALL SELECT 'cca', ROUND(ABS(r), 8) FROM r UNION ALL SELECT 'rvcoef', ROUND(r * r, 6) FROM r UNION ALL SELECT 'trace', ROUND(GREATEST(0, r), 8) FROM r")
def _(spark, d):
    _, m = prep.fit_scalings(_dims(spark, d, _BOTH), {"lo": ["e0"], "hi": ["e32"]}, ["center"], moments=True)
    rows = [(k, float(neural.agreement_of_moments(m.gram, 2, k)[0])) for k in ("procrustes_r2", "procrustes_r2_sharp", "cca", "rvcoef", "trace")]
    return spark.createDataFrame(rows, "measure string, value double").select("measure", F.when(F.col("measure") == "rvcoef", F.round("value", 6)).otherwise(F.round("value", 8)).alias("value"))


@query("flow_inverse", f"WITH x AS ({_sql_dims(_FOUR)}) SELECT vec_id, " + ", ".join(f"ROUND(e{i}, 6) AS e{i}" for i in _FOUR) + " FROM x")
def _(spark, d):
    spec = neural.NeuralSpec(kind="flow", k=2, flow_hidden=8, flow_layers=3)
    params = {k: v + 0.1 * np.sin(np.arange(v.size)).reshape(v.shape) for k, v in neural.initial_parameters([4], spec).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: Var(v) for k, v in params.items()}
        for b in batches:
            x = np.column_stack([c.to_numpy() for c in b.columns[1:]])
            z, _ = neural.flow_forward(p, 0, var(x), spec)
            back = neural.flow_inverse(p, 0, z, spec).x if len(x) else x
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in back.T.copy()]], names=b.schema.names)

    x = _dims(spark, d, _FOUR)
    return x.mapInArrow(run, x.schema).select("vec_id", *_r(_e(_FOUR)))


@query("linear_layer_scores", f"WITH {_X} SELECT vec_id, " + ", ".join(f"ROUND({_weighted_sql(LO, j)}, 6) AS z{j + 1}" for j in range(2)) + " FROM x")
def _(spark, d):
    spec = neural.NeuralSpec(kind="lend", k=2, first_layer="raw")
    basis = _basis(LO, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([c.to_numpy() for c in b.columns[1:]])
            z = (var(x) @ neural._basis({"v0": Var(basis)}, 0, spec, 0.0)).x
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z[:, 0].copy()), pa.array(z[:, 1].copy())], names=["vec_id", "z1", "z2"])

    return _dims(spark, d, LO).mapInArrow(run, "vec_id long, z1 double, z2 double").select("vec_id", *_r(["z1", "z2"]))


# -- streaming -----------------------------------------------------------------------------------------------------------------------------------


@query("whitening_queue", f"WITH x AS ({_sql_dims([0, 1])} ORDER BY vec_id DESC LIMIT 256), g AS (SELECT AVG(e0) AS m0, AVG(e1) AS m1, VAR_SAMP(e0) AS a, COVAR_SAMP(e0, e1) AS b, VAR_SAMP(e1) AS c FROM x) SELECT ROUND(m0, 8) AS m0, ROUND(m1, 8) AS m1, ROUND(0.9 * a + 0.05 * (a + c) + 1e-4, 8) AS a, ROUND(0.9 * b, 8) AS b, ROUND(0.9 * c + 0.05 * (a + c) + 1e-4, 8) AS c FROM g")
def _(spark, d):
    newest = _dims(spark, d, [0, 1]).orderBy(F.desc("vec_id")).limit(256)  # what the queue holds
    queue, stats = whitening.FeatureQueue(256, 2), whitening.WhiteningStats(2)
    queue.push(np.array([[r["e0"], r["e1"]] for r in sorted(newest.collect(), key=lambda r: r["vec_id"])]))
    stats.update(queue.rows)
    return _one(spark, m0=stats.mean[0], m1=stats.mean[1], a=stats.cov[0, 0], b=stats.cov[0, 1], c=stats.cov[1, 1]).select(*_r(["m0", "m1", "a", "b", "c"], 8))


def _streamed(spark: SparkSession, d: str, columns: list[str], **settings) -> DataFrame:
    """The last state of a stream over ``embeddings``, which come in four parts; the stream is stopped after each and started again."""
    folder = _scratch(spark, "stream")
    rows = _dims(spark, d, [0, 1]).withColumn("part", F.pmod(F.floor(F.col("vec_id") / 50), F.lit(4)))
    for part in range(4):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.drop("part").schema).parquet(f"{folder}/in")
        stateful.run_to_table(stateful.running_statistics(stream, columns, "vec_id", **settings), f"{folder}/out", f"{folder}/checkpoint")
    return stateful.newest_state(spark, f"{folder}/out")


@query("whitening_stream", SQL["whitening_queue"].replace("SELECT ROUND(m0, 8)", "SELECT (SELECT MAX(vec_id) FROM embeddings) AS last, (SELECT COUNT(*) FROM x) AS n, (SELECT COUNT(DISTINCT (vec_id // 50) % 4) FROM embeddings) AS batches, ROUND(m0, 8)"))
def _(spark, d):
    got = _streamed(spark, d, ["e0", "e1"], capacity=256, rate=1.0, least=2)
    at = lambda c, i: F.round(F.get(c, F.lit(i)), 8)
    return got.select("last", "n", "batches", at("mean", 0).alias("m0"), at("mean", 1).alias("m1"), at("cov", 0).alias("a"), at("cov", 1).alias("b"), at("cov", 3).alias("c"))


@query("independent_stream")
def _(spark, d):
    got = _streamed(spark, d, ["e0", "e1"], capacity=256, least=2, every=2)
    return got.select("last", "n", "batches", F.posexplode("map").alias("place", "weight"))
