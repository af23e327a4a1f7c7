"""The operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statflow.functions import arrays, links
from statflow.models import forest, glm, kmeans, logistic, naive_bayes, tree
from statflow.operators import aggregates as agg
from statflow.operators import custom, graph, pairs, quantile, transform
from statflow.plans.durable import checkpoint_dir, materialize, part_count
from statflow.sources.binomial import binomial_source
from statflow.streaming import aggregates as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})


class WeightedMean(custom.Aggregate):
    """The mean of the second column weighted by the first: an example of a user's own aggregate."""

    schema = "mean double"

    def init(self):
        return 0.0, 0.0

    def add(self, state, batch):
        w, x = batch.iloc[:, 0], batch.iloc[:, 1]
        return state[0] + float(w.sum()), state[1] + float((w * x).sum())

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def finish(self, state):
        return pd.DataFrame({"mean": [state[1] / state[0] if state[0] else None]})


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT l_returnflag, '{c}' AS \"column\", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std_dev, round(max({c}) - min({c}), 4) AS range, min({c}) AS min, max({c}) AS max, count(*) AS count FROM lineitem GROUP BY l_returnflag"
        for c in LINE
    )
)
def summary(spark, sf_dir):
    return _round(agg.summary(_t(spark, sf_dir, "lineitem"), LINE, "l_returnflag"), mean=4, std_dev=4, range=4)


@query(" UNION ALL ".join(f"SELECT '{a}' AS \"row\", '{b}' AS col, round(covar_samp({a}, {b}), 3) AS covariance, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a in LINE for b in LINE))
def cov_cor(spark, sf_dir):
    return _round(agg.cov_cor(_t(spark, sf_dir, "lineitem"), LINE), covariance=3, correlation=6)


_EXPLODED = "(SELECT vec_id, label, unnest(generate_series(1, len(embedding))) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"


@query(f"SELECT CAST(i AS INTEGER) AS index, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std_dev, round(min(x), 6) AS min, round(max(x), 6) AS max FROM {_EXPLODED} GROUP BY i")
def preprocess(spark, sf_dir):
    return _round(agg.preprocess(_t(spark, sf_dir, "embeddings"), "embedding").stats, mean=6, std_dev=6, min=6, max=6)


@query(
    f"WITH e AS {_EXPLODED}, s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS d FROM e GROUP BY i) "
    "SELECT vec_id, CAST(i AS INTEGER) AS index, round((x - m) / d, 5) AS scaled FROM e JOIN s USING (i)"
)
def preprocess_transform(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings")
    scaled = agg.preprocess(df, "embedding").transform(df).select("vec_id", F.posexplode("scaled").alias("index", "scaled"))
    return _round(scaled, scaled=5)


@query("SELECT o_orderstatus, o_orderpriority AS mode FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1")
def mode(spark, sf_dir):
    return agg.mode(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


_HIST = "SELECT i AS index, coalesce(n, 0) AS n FROM (SELECT CAST(unnest(generate_series(0, 50)) AS INTEGER) AS i) LEFT JOIN (SELECT CAST(l_quantity AS INTEGER) AS i, count(*) AS n FROM lineitem GROUP BY 1) USING (i)"


@query(f"SELECT index, CAST(n AS DOUBLE) AS value FROM ({_HIST})")
def histogram(spark, sf_dir):
    return agg.histogram(_t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int")), "q", 51, long=True)


@query(f"SELECT index, round(n / sqrt(sum(n * n) OVER ()), 8) AS value FROM ({_HIST})")
def histogram_normalized(spark, sf_dir):
    rows = agg.histogram(_t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int")), "q", 51, normalize=True, p=2, long=True)
    return _round(rows, value=8)


@query("SELECT CAST(month(o_orderdate) - 1 AS INTEGER) AS index, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def line_chart(spark, sf_dir):
    return _round(agg.line_chart(_t(spark, sf_dir, "orders").withColumn("m", F.month("o_orderdate") - 1), "m", "o_totalprice", 12, long=True), value=2)


@query(
    "WITH k AS (SELECT DISTINCT event_type FROM events), g AS (SELECT event_type, h FROM k, (SELECT CAST(unnest(generate_series(0, 23)) AS INTEGER) AS h)), "
    "s AS (SELECT event_type, CAST(hour(ts) AS INTEGER) AS h, sum(value) AS v FROM events GROUP BY ALL) SELECT g.event_type, g.h AS index, round(coalesce(v, 0), 4) AS value FROM g LEFT JOIN s ON g.event_type = s.event_type AND g.h = s.h"
)
def line_chart_matrix(spark, sf_dir):
    return _round(agg.line_chart_matrix(_t(spark, sf_dir, "events").withColumn("h", F.hour("ts")), "event_type", "h", "value", 24, long=True), value=4)


@query(f"SELECT CAST(i AS INTEGER) AS \"row\", label AS col, round(sum(x), 4) AS value FROM {_EXPLODED} WHERE label < 10 GROUP BY i, label")
def collect_matrix(spark, sf_dir):
    return _round(agg.collect_matrix(_t(spark, sf_dir, "embeddings"), "label", "embedding", 10), value=4)


@query("SELECT label, count(*) AS n, round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings GROUP BY label")
def gather(spark, sf_dir):
    state = agg.gather(_t(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return _round(state.groupBy(F.col("extra.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(arrays.total("vector")).alias("total")), total=4)


@query("SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS position, event_id FROM events")
def sparse_indicator(spark, sf_dir):
    return agg.sparse_indicator(_t(spark, sf_dir, "events"), "event_id", "user_id").select("user_id", F.posexplode("indices").alias("position", "event_id"))


@query(
    "SELECT key, CAST(p AS INTEGER) AS position, CAST(i AS INTEGER) AS index, round(x, 6) AS value FROM (SELECT label AS key, row_number() OVER (PARTITION BY label ORDER BY embedding::DOUBLE[]) - 1 AS p, "
    "unnest(generate_series(1, len(embedding))) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
)
def build_sparse_array(spark, sf_dir):
    return _round(agg.build_sparse_array(_t(spark, sf_dir, "embeddings"), "label", "embedding"), value=6)


@query(
    "SELECT CAST(c_nationkey AS INTEGER) AS nation, CAST(month(o_orderdate) - 1 AS INTEGER) AS month, round(sum(o_totalprice), 2) AS value "
    "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"
)
def build_array_sum(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").cast("int").alias("nation"), (F.month("o_orderdate") - 1).alias("month"), "o_totalprice")
    return _round(agg.build_array(rows, ["nation", "month"], "o_totalprice", [25, 12]), value=2)


@query("SELECT l_linenumber - 1 AS line, round(exp(sum(ln(1 + l_tax / 1000))), 6) AS value FROM lineitem GROUP BY 1")
def build_array_product(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("line"), (1 + F.col("l_tax") / 1000).alias("f"))
    return _round(agg.build_array(rows, ["line"], "f", [7], "multiplication"), value=6)


@query("SELECT CAST(o_custkey % 100 AS INTEGER) AS slot, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def build_array_replacement(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).cast("int").alias("slot"), "o_totalprice", "o_orderkey")
    return agg.build_array(rows, ["slot"], "o_totalprice", [100], "replacement", order_by="o_orderkey")


@query("SELECT CAST(o_custkey % 100 AS INTEGER) AS slot, arg_min(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1")
def build_array_omission(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).cast("int").alias("slot"), "o_totalprice", "o_orderkey")
    return agg.build_array(rows, ["slot"], "o_totalprice", [100], "omission", order_by="o_orderkey")


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def first_k(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (-F.col("o_totalprice")).alias("x"))
    return agg.first_k(rows, 25, ["x", "o_orderkey"]).drop("x")


@query()
def reservoir_sample(spark, sf_dir):
    return agg.reservoir_sample(_t(spark, sf_dir, "orders"), 100, key="o_orderkey").select("o_orderkey")


@query("SELECT 100 AS n, 100 AS different, true AS spread, count(*) AS n_rows FROM orders")
def reservoir_sample_counts(spark, sf_dir):
    """The sample's size, without repeats, all from the table, and not from one end of it: its mean key
    lies within four standard errors of the table's."""
    orders = _t(spark, sf_dir, "orders")
    drawn = reservoir_sample(spark, sf_dir).join(orders, "o_orderkey")
    whole = orders.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("o_orderkey").alias("m"), F.stddev("o_orderkey").alias("d"))
    part = drawn.agg(F.count(F.lit(1)).cast("int").alias("n"), F.countDistinct("o_orderkey").cast("int").alias("different"), F.avg("o_orderkey").alias("x"))
    return part.crossJoin(whole).select("n", "different", (F.abs(F.col("x") - F.col("m")) < 0.4 * F.col("d")).alias("spread"), "n_rows")


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS index, round(x - 2 * x, 6) AS value FROM {_EXPLODED}")
def vector_subtract(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings").select("vec_id", arrays.subtract("embedding", arrays.add("embedding", "embedding")).alias("v"))
    return _round(df.select("vec_id", F.posexplode("v").alias("index", "value")), value=6)


@query(
    "SELECT '(intercept)' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS coefficient, count(*) AS n FROM lineitem "
    "UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3), count(*) FROM lineitem"
)
def ols(spark, sf_dir):
    return _round(agg.ols(_t(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice"), coefficient=3)


@query("SELECT vec_id, CAST(i AS INTEGER) AS index, round(x / n, 6) AS value FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS n FROM " + _EXPLODED + ")")
def normalize(spark, sf_dir):
    return _round(_t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(arrays.normalize("embedding")).alias("index", "value")), value=6)


@query(f"SELECT vec_id, CAST(i AS INTEGER) AS index, round(x, 6) AS x, round(2 * x, 6) AS y FROM {_EXPLODED}")
def expand(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", arrays.as_vector("embedding").alias("a"), arrays.add("embedding", "embedding").alias("b"))
    return _round(transform.expand(rows, ["a", "b"], "index", ["x", "y"]), x=6, y=6)


@query(
    "WITH l AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) - 1 AS id FROM (SELECT DISTINCT o_orderpriority FROM orders)), "
    "v AS (SELECT o_orderkey, [o_totalprice, CAST(id AS DOUBLE), CAST(o_custkey AS DOUBLE)] AS v FROM orders JOIN l ON o_orderpriority = p) "
    "SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS index, v[i] AS value FROM v, (VALUES (1), (2), (3)) AS t(i)"
)
def make_vector(spark, sf_dir):
    df = _t(spark, sf_dir, "orders")
    levels = [r[0] for r in df.select("o_orderpriority").distinct().collect()]  # five priorities
    v = arrays.make_vector(df, "o_totalprice", "o_orderpriority", "o_custkey", levels={"o_orderpriority": levels})
    return df.select("o_orderkey", F.posexplode(v).alias("index", "value"))


@query("SELECT o_orderkey, o_totalprice AS second FROM orders")
def tuple_get(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").select("o_orderkey", arrays.make_tuple("o_custkey", "o_totalprice").alias("t"))
    return df.select("o_orderkey", arrays.get(df, "t", 1).alias("second"))


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]) / 64, 6) AS mean FROM embeddings")
def matrix_mean(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings").select("vec_id", arrays.make_matrix(8, 8, "embedding").alias("m"))
    return _round(df.select("vec_id", arrays.matrix_mean("m").alias("mean")), mean=6)


@query("SELECT vec_id, round(embedding[1]::DOUBLE + embedding[3]::DOUBLE + embedding[3]::DOUBLE, 6) AS dot, label IN (1, 4, 4) AS member FROM embeddings")
def sparse_vector(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings").withColumn("i", F.array(F.lit(0), F.lit(2), F.lit(2))).withColumn("s", F.array(F.lit(1), F.lit(4), F.lit(4)))
    return _round(df.select("vec_id", arrays.sparse_dot("i", "embedding").alias("dot"), arrays.sparse_contains("s", F.col("label")).alias("member")), dot=6)


@query(
    "WITH p AS (SELECT DISTINCT round((l_discount + 0.01) * 5, 6) AS p FROM lineitem) SELECT p, round(ln(p / (1 - p)), 8) AS logit, round(ln(-ln(1 - p)), 8) AS cloglog, round(tan(pi() * (p - 0.5)), 8) AS cauchit, "
    "round(1 / p, 8) AS inverse, round(1 / (p * (1 - p)), 8) AS logit_slope, round(-1 / ((1 - p) * ln(1 - p)), 8) AS cloglog_slope, p AS probit_back, round(2 * (0.5 * ln(0.5 / p) + 0.5 * ln(0.5 / (1 - p))), 8) AS deviance FROM p"
)
def link_functions(spark, sf_dir):
    p = F.col("p")
    df = _t(spark, sf_dir, "lineitem").select(F.round((F.col("l_discount") + 0.01) * 5, 6).alias("p")).distinct()
    out = df.select(
        "p", links.LINK["logit"](p).alias("logit"), links.LINK["cloglog"](p).alias("cloglog"), links.LINK["cauchit"](p).alias("cauchit"), links.LINK["inverse"](p).alias("inverse"),
        links.DERIVATIVE["logit"](p).alias("logit_slope"), links.DERIVATIVE["cloglog"](p).alias("cloglog_slope"), links.INVERSE["probit"](links.LINK["probit"](p)).alias("probit_back"),
        links.DEVIANCE["binomial"](F.lit(0.5), p).alias("deviance"),
    )
    return _round(out, logit=8, cloglog=8, cauchit=8, inverse=8, logit_slope=8, cloglog_slope=8, probit_back=6, deviance=8)


_PAIRS = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_avg(embedding::DOUBLE[]) AS m, list_stddev_pop(embedding::DOUBLE[]) AS s, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS n FROM embeddings)
SELECT a.vec_id AS x, b.vec_id AS y, {0} FROM e a JOIN e b ON a.vec_id <= b.vec_id"""


@query(_PAIRS.format("round((list_dot_product(a.v, b.v) / 64 - a.m * b.m) / (a.s * b.s), 6) AS correlation, round(list_dot_product(a.v, b.v) / 64 - a.m * b.m, 6) AS covariance, round(abs(a.n + b.n - 2 * list_dot_product(a.v, b.v)), 6) AS distance"))
def pair_stats(spark, sf_dir):
    return _round(pairs.pair_stats(_t(spark, sf_dir, "embeddings"), "vec_id", "embedding", pairs.MEASURES, block=256), correlation=6, covariance=6, distance=6)


@query(
    "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_avg(embedding::DOUBLE[]) AS m, list_stddev_pop(embedding::DOUBLE[]) AS s FROM embeddings) "
    "SELECT a.vec_id AS x, b.vec_id AS y, round((list_dot_product(a.v, b.v) / 64 - a.m * b.m) / (a.s * b.s), 6) AS correlation FROM e a, e b WHERE a.label = 0 AND b.label = 1"
)
def cross_stats(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings")
    return _round(pairs.cross_stats(df.where("label = 0"), df.where("label = 1"), "vec_id", "embedding"), correlation=6)


@query(
    "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_avg(embedding::DOUBLE[]) AS m, list_stddev_pop(embedding::DOUBLE[]) AS s FROM embeddings) "
    "SELECT a.vec_id AS x, b.vec_id AS y, round((list_dot_product(a.v, b.v) / 64 - a.m * b.m) / (a.s * b.s), 6) AS correlation FROM e a, e b"
)
def cross_stats_all(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings")
    return _round(pairs.cross_stats(df, df, "vec_id", "embedding"), correlation=6)


def _charts(df: DataFrame) -> DataFrame:
    return agg.line_chart_matrix(df.select("label", F.posexplode("embedding").alias("i", "x")), "label", "i", "x", 64)


_NEAREST = f"""WITH e AS {_EXPLODED}, c AS (SELECT label AS k, list(s ORDER BY i) AS c FROM (SELECT label, i, sum(x) AS s FROM e GROUP BY label, i) GROUP BY label),
d AS (SELECT vec_id, k, {{0}} AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c)
SELECT vec_id, k AS nearest FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM d) WHERE r = 1"""


@query(_NEAREST.format("list_distance(v, c)"))
def nearest_neighbor(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings")
    return transform.nearest_neighbor(df, "embedding", _charts(df), "label", "chart").select("vec_id", "nearest")


@query(_NEAREST.format("-list_cosine_similarity(v, c)"))
def nearest_neighbor_cosine(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings")
    return transform.nearest_neighbor(df, "embedding", _charts(df), "label", "chart", normalization=True).select("vec_id", "nearest")


@query(" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS \"column\", round(median({c}), 6) AS median FROM lineitem GROUP BY l_returnflag" for c in LINE))
def median(spark, sf_dir):
    return _round(quantile.median(_t(spark, sf_dir, "lineitem"), LINE, "l_returnflag"), median=6)


_QS = (0.05, 0.25, 0.5, 0.75, 0.99)
_QUANTILES = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS q, round(quantile_cont({c}, {q}), 6) AS value FROM lineitem" for c in LINE[:2] for q in _QS)


@query(_QUANTILES)
def quantiles(spark, sf_dir):
    return _round(quantile.quantiles(_t(spark, sf_dir, "lineitem"), LINE[:2], _QS), value=6)


@query(_QUANTILES)
def binned_quantiles(spark, sf_dir):
    return _round(quantile.binned_quantiles(_t(spark, sf_dir, "lineitem"), LINE[:2], _QS), value=6)


def _glm(family: str, link: str, table: str, response: str, factor: str, sql_response: str, sql: str):
    def run(spark, sf_dir):
        df = _t(spark, sf_dir, table)
        return _round(glm.glm(df, response, [factor], family, link, epsilon=1e-10, maxit=50).table(df), coefficient=6)

    run.__name__ = f"glm_{family}_{link}"
    query(f"SELECT '{factor}=' || {factor} AS term, round({sql}, 6) AS coefficient FROM (SELECT {factor}, avg({sql_response}) AS m FROM {table} GROUP BY {factor})")(run)


def _irls_sql(table: str, y: str, x: str, link_inverse: str, slope: str, variance: str, start: str, w: str = "1.0", o: str = "0.0", passes: int = 14) -> str:
    """Intercept and slope by reweighted least squares, pass by pass, each a 2 x 2 system in closed form."""
    parts = [f"t AS MATERIALIZED (SELECT CAST({y} AS DOUBLE) AS y, CAST({x} AS DOUBLE) AS x, CAST({w} AS DOUBLE) AS w, CAST({o} AS DOUBLE) AS o FROM {table})", f"b0 AS MATERIALIZED (SELECT {start} AS a, 0.0::DOUBLE AS b FROM t)"]
    for i in range(passes):
        z = f"SELECT x, w / (({variance}) * ({slope}) * ({slope})) AS k, eta - o + (y - m) * ({slope}) AS z FROM (SELECT *, {link_inverse} AS m FROM (SELECT t.*, o + a + b * x AS eta FROM t, b{i}))"
        sums = f"SELECT sum(k) AS s0, sum(k * x) AS s1, sum(k * x * x) AS s2, sum(k * z) AS t0, sum(k * x * z) AS t1 FROM ({z})"
        parts.append(f"b{i + 1} AS MATERIALIZED (SELECT (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS a, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b FROM ({sums}))")
    return f"WITH {', '.join(parts)} SELECT '(intercept)' AS term, round(a, 5) AS coefficient FROM b{passes} UNION ALL SELECT '{x}', round(b, 5) FROM b{passes}"


def _glm_line(name: str, response: str, family: str, link: str, sql: str, **more):
    """A fit of lineitem with the discount as its numeric predictor."""

    def run(spark, sf_dir):
        df = _t(spark, sf_dir, "lineitem")
        return _round(glm.glm(df, response, ["l_discount"], family, link, epsilon=1e-10, maxit=50, **more).table(df), coefficient=5)

    run.__name__ = f"glm_{name}"
    query(sql)(run)


_W, _O = "1 + l_linenumber % 3", "ln(l_quantity + 1)"
_glm_line("poisson_weights_offset", "l_linenumber", "poisson", "log", _irls_sql("lineitem", "l_linenumber", "l_discount", "exp(eta)", "1 / m", "m", "ln(avg(y)) - avg(o)", _W, _O), weights=_W, offset=_O)
_glm_line("gamma_log_numeric", "l_quantity", "gamma", "log", _irls_sql("lineitem", "l_quantity", "l_discount", "exp(eta)", "1 / m", "m * m", "ln(avg(y))", _W), weights=_W)
_glm_line("binomial_logit_numeric", "cast(l_quantity > 20 as int)", "binomial", "logit", _irls_sql("lineitem", "CAST(l_quantity > 20 AS INTEGER)", "l_discount", "1 / (1 + exp(-eta))", "1 / (m * (1 - m))", "m * (1 - m)", "ln(avg(y) / (1 - avg(y)))", o="l_tax"), offset="l_tax")
_glm_line("negative_binomial_log", "l_linenumber", "negative_binomial", "log", _irls_sql("lineitem", "l_linenumber", "l_discount", "exp(eta)", "1 / m", "m + m * m / 3", "ln(avg(y))"), failures=3.0)
_glm_line("poisson_start", "l_linenumber", "poisson", "log", _irls_sql("lineitem", "l_linenumber", "l_discount", "exp(eta)", "1 / m", "m", "ln(avg(y))"), start=[1.0, 0.1])


_BIT, _SQL_BIT = "cast(l_discount > 0.055 as int)", "CAST(l_discount > 0.055 AS INTEGER)"
_glm("gaussian", "identity", "orders", "o_totalprice / 1000", "o_orderpriority", "o_totalprice / 1000", "m")
_glm("poisson", "log", "lineitem", "l_linenumber", "l_returnflag", "l_linenumber", "ln(m)")
_glm("poisson", "sqrt", "lineitem", "l_linenumber", "l_returnflag", "l_linenumber", "sqrt(m)")
_glm("poisson", "identity", "lineitem", "l_linenumber", "l_returnflag", "l_linenumber", "m")
_glm("gamma", "inverse", "lineitem", "l_quantity", "l_returnflag", "l_quantity", "1 / m")
_glm("gamma", "log", "lineitem", "l_quantity", "l_returnflag", "l_quantity", "ln(m)")
_glm("binomial", "logit", "lineitem", _BIT, "l_returnflag", _SQL_BIT, "ln(m / (1 - m))")
_glm("binomial", "cloglog", "lineitem", _BIT, "l_returnflag", _SQL_BIT, "ln(-ln(1 - m))")
_glm("binomial", "cauchit", "lineitem", _BIT, "l_returnflag", _SQL_BIT, "tan(pi() * (m - 0.5))")
_glm("inverse_gaussian", "inverse_squared", "lineitem", "l_quantity", "l_returnflag", "l_quantity", "1 / (m * m)")


@query(
    f"SELECT DISTINCT l_returnflag, l_linestatus, round(avg({_SQL_BIT}) OVER (PARTITION BY l_returnflag, l_linestatus), 6) AS prediction FROM lineitem"
)
def glm_predict_probit(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    model = glm.glm(df, _BIT, ["l_returnflag:l_linestatus"], "binomial", "probit", epsilon=1e-10, maxit=50)
    return _round(model.predict(df).select("l_returnflag", "l_linestatus", "prediction").distinct(), prediction=6).distinct()


@query(
    "WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem) "
    "SELECT l_orderkey, l_linenumber, round(a + b * l_quantity, 2) AS prediction FROM lineitem, s"
)
def glm_predict_gaussian(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    model = glm.GlmModel.from_json(glm.glm(df, "l_extendedprice", ["l_quantity"]).to_json())
    return _round(model.predict(df).select("l_orderkey", "l_linenumber", "prediction"), prediction=2)


_NB_COLS = ("l_quantity", "l_extendedprice")
_NB = """WITH s AS (SELECT {ranges} FROM lineitem), b AS ({bins}), c AS (SELECT class, count(*) AS n FROM (SELECT l_returnflag AS class FROM lineitem) GROUP BY class), t AS (SELECT count(*) AS n FROM lineitem)
SELECT b.class, attribute, level, count(*) AS count, round(count(*) / any_value(t.n), 8) AS joint, round(count(*) / any_value(c.n), 8) AS conditional FROM b JOIN c USING (class), t GROUP BY b.class, attribute, level""".format(
    ranges=", ".join(f"greatest(avg({c}) - stddev_pop({c}) * 1.5, min({c})) AS lo_{c}, least(avg({c}) + stddev_pop({c}) * 1.5, max({c})) AS hi_{c}" for c in _NB_COLS),
    bins=" UNION ALL ".join(
        f"SELECT l_returnflag AS class, '{c}' AS attribute, CAST(CASE WHEN {c} < lo_{c} THEN -1 WHEN {c} > hi_{c} THEN 10 ELSE least(9, CAST(floor(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / 10)) AS INTEGER)) END AS VARCHAR) AS level FROM lineitem, s" for c in _NB_COLS
    )
    + " UNION ALL SELECT l_returnflag, 'l_linestatus', l_linestatus FROM lineitem",
)


@query(_NB)
def naive_bayes_table(spark, sf_dir):
    return _round(naive_bayes.naive_bayes(_t(spark, sf_dir, "lineitem"), "l_returnflag", _NB_COLS, ["l_linestatus"], 10, 1.5).table, joint=8, conditional=8)


_NB_LEVEL = "CAST(CASE WHEN {0} < lo_{0} THEN -1 WHEN {0} > hi_{0} THEN 10 ELSE least(9, CAST(floor(({0} - lo_{0}) / ((hi_{0} - lo_{0}) / 10)) AS INTEGER)) END AS VARCHAR)"
_NB_PREDICT = """WITH s AS (SELECT {ranges} FROM lineitem), p AS MATERIALIZED (SELECT row_number() OVER () AS id, l_returnflag AS class, {levels}, l_linestatus AS v2 FROM lineitem, s),
n AS (SELECT class, count(*) AS n FROM p GROUP BY class), {counts},
d AS (SELECT p.id, p.class AS actual, n.class, ln(n.n / (SELECT count(*) FROM p)) + ln((coalesce(t0.c, 0) + 1) / (n.n + 12)) + ln((coalesce(t1.c, 0) + 1) / (n.n + 12)) + ln((coalesce(t2.c, 0) + 1) / (n.n + (SELECT count(DISTINCT v2) FROM p))) AS score
  FROM p CROSS JOIN n {joins})
SELECT actual AS l_returnflag, class AS prediction, count(*) AS count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS r FROM d) WHERE r = 1 GROUP BY ALL""".format(
    ranges=", ".join(f"greatest(avg({c}) - stddev_pop({c}) * 3.0, min({c})) AS lo_{c}, least(avg({c}) + stddev_pop({c}) * 3.0, max({c})) AS hi_{c}" for c in _NB_COLS),
    levels=", ".join(f"{_NB_LEVEL.format(c)} AS v{i}" for i, c in enumerate(_NB_COLS)),
    counts=", ".join(f"t{i} AS (SELECT class, v{i} AS v, count(*) AS c FROM p GROUP BY ALL)" for i in range(3)),
    joins=" ".join(f"LEFT JOIN t{i} ON t{i}.class = n.class AND t{i}.v = p.v{i}" for i in range(3)),
)


@query(_NB_PREDICT)
def naive_bayes_predict(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    return naive_bayes.naive_bayes(df, "l_returnflag", _NB_COLS, ["l_linestatus"]).predict(df).groupBy("l_returnflag", "prediction").count()


_CENTRES = [[10.0, 2.0], [25.0, 5.0], [40.0, 8.0]]


def _kmeans_sql(passes: int, fuzzy: bool) -> str:
    parts = ["p AS MATERIALIZED (SELECT row_number() OVER () AS id, l_quantity AS a, l_discount * 100 AS b FROM lineitem)"]
    parts.append("c0(k, a, b) AS MATERIALIZED (VALUES " + ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate(_CENTRES)) + ")")
    for i in range(passes):
        d = f"SELECT p.id, p.a, p.b, k, (p.a - c.a) * (p.a - c.a) + (p.b - c.b) * (p.b - c.b) AS d FROM p, c{i} c"
        if fuzzy:
            u = f"SELECT *, 1 / (d + 1e-9) AS u FROM ({d})"
            w = f"SELECT k, a, b, u / sum(u) OVER (PARTITION BY id) AS w FROM ({u})"
        else:
            w = f"SELECT k, a, b, 1 AS w FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS r FROM ({d})) WHERE r = 1"
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, sum(w * a) / sum(w) AS a, sum(w * b) / sum(w) AS b FROM ({w}) GROUP BY k)")
    return f"WITH {', '.join(parts)} SELECT CAST(k AS INTEGER) AS cluster, round(a, 5) AS a, round(b, 5) AS b FROM c{passes}"


def _k_means(spark, sf_dir, m: float) -> DataFrame:
    df = _t(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"))
    model = kmeans.k_means(df, ["a", "b"], 3, m=m, max_iter=5, epsilon=0.0, centers=_CENTRES)
    return _round(spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(model.centers)], "cluster int, a double, b double"), a=5, b=5)


@query(_kmeans_sql(5, False))
def kmeans_hard(spark, sf_dir):
    return _k_means(spark, sf_dir, 1)


@query(_kmeans_sql(5, True))
def kmeans_fuzzy(spark, sf_dir):
    return _k_means(spark, sf_dir, 2)


@query()
def kmeans_plus_plus(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings")
    return kmeans.k_means(df, "embedding", 10, max_iter=10, normalized=True).predict(df, "embedding").select("vec_id", "cluster")


def _mixed_sql(passes: int) -> str:
    parts = ["p AS MATERIALIZED (SELECT row_number() OVER () AS id, l_quantity AS x, l_returnflag AS v FROM lineitem)"]
    parts.append("c0(k, a) AS MATERIALIZED (VALUES (0, 10.0::DOUBLE), (1, 25.0::DOUBLE), (2, 40.0::DOUBLE)), f0 AS (SELECT 0 AS k, '' AS v, 0.0::DOUBLE AS f)")
    for i in range(passes + 1):
        d = f"SELECT p.id, p.x, p.v, c.k, (p.x - c.a) * (p.x - c.a) + (1 - coalesce(f, 0)) * (1 - coalesce(f, 0)) AS d FROM p CROSS JOIN c{i} c LEFT JOIN f{i} f ON f.k = c.k AND f.v = p.v"
        parts.append(f"w{i} AS MATERIALIZED (SELECT k, x, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, k) AS r FROM ({d})) WHERE r = 1)")
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, avg(x) AS a FROM w{i} GROUP BY k)")
        parts.append(f"f{i + 1} AS MATERIALIZED (SELECT k, v, count(*) / any_value(n) AS f FROM w{i} JOIN (SELECT k, count(*) AS n FROM w{i} GROUP BY k) USING (k) GROUP BY k, v)")
    return f"WITH {', '.join(parts)} SELECT CAST(k AS INTEGER) AS cluster, v AS l_returnflag, count(*) AS count FROM w{passes} GROUP BY ALL"


@query(_mixed_sql(10))
def kmeans_mixed(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    model = kmeans.k_means_mixed(df, ["l_quantity"], ["l_returnflag"], 3, max_iter=10, epsilon=0.0, centers=[[10.0], [25.0], [40.0]])
    return model.predict(df, ["l_quantity"]).groupBy("cluster", "l_returnflag").count()


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY l_returnflag")
def custom_aggregate(spark, sf_dir):
    return _round(custom.aggregate(_t(spark, sf_dir, "lineitem"), WeightedMean(), ["l_quantity", "l_extendedprice"], ["l_returnflag"]), mean=4)


@query()
def g_means(spark, sf_dir):
    root = kmeans.g_means(_t(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_extendedprice") / 1000).alias("price")), ["l_quantity", "price"], max_depth=3)  # the data have no clusters: every leaf would split
    return spark.createDataFrame([(i, x.depth, x.count) for i, x in enumerate(root.leaves())], "leaf int, depth int, rows long")


@query()
def decision_tree(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    model = tree.decision_tree(df, "l_extendedprice", ["l_quantity"], ["l_discount"], ["l_returnflag"], max_depth=2, learn_iters=8)
    return model.predict(df).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("prediction") - F.col("l_extendedprice"))), 2).alias("error"))


@query()
def random_forest_classify(spark, sf_dir):
    df = _t(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    return forest.random_forest(df, "embedding", "label", num_trees=10, max_depth=5, min_sample=1).predict(df).select("vec_id", "label", "prediction")


@query()
def classification_tree(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    return forest.classification_tree(df, ["l_quantity", "l_discount"], "l_returnflag").predict(df).groupBy("l_returnflag", "prediction").count()


@query()
def random_forest_batch(spark, sf_dir):
    df = _t(spark, sf_dir, "lineitem")
    train, test = df.where("l_linenumber <= 3"), df.where("l_linenumber > 3")
    return forest.random_forest_batch(train, test, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["l_orderkey", "l_linenumber"], num_trees=5, max_depth=5)


@query()
def logistic_multi(spark, sf_dir):
    ev = _t(spark, sf_dir, "events")
    cases = ev.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") != "error", F.col("event_type"))).alias("drugs"), F.collect_set(F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type"))).alias("effects"))
    model = logistic.logistic_multi(cases.withColumn("stratum", F.col("user_id") % 3), max_iter=20)
    return _round(model.table(ev), coefficient=4)


@query("SELECT CAST(s.range % 4 AS INTEGER) AS part, 1000 AS n FROM range(4) s")
def binomial_gen(spark, sf_dir):
    df = binomial_source(spark, 4, 1000, seed=7)
    return df.where("y1 >= 0 and y2 >= 0 and input1 >= 0 and input1 < 1").groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(
    "SELECT CAST(floor(epoch(ts) / 604800) * 604800 AS BIGINT) AS start, event_type, round(avg(value), 4) AS mean, min(value) AS min, max(value) AS max, count(*) AS count FROM events GROUP BY ALL"
)
def streaming_summary(spark, sf_dir):
    """Reads the events as a stream, to its end, and summarises them by week."""
    name = f"stream_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(_t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    windows = streaming.windowed_summary(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["value"], "7 days", by=["event_type"])
    # One row per week and type: the memory sink suits it.
    windows.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{checkpoint_dir(spark)}/statflow/{name}").trigger(availableNow=True).start().awaitTermination()
    return _round(spark.table(name).select(F.col("start").cast("long").alias("start"), "event_type", "mean", "min", "max", "count"), mean=4)


#: All distinct part -> supplier edges; parts are even, suppliers odd ids.
_G1 = "SELECT DISTINCT 2 * l_partkey AS s, 2 * l_suppkey + 1 AS t FROM lineitem"
_G1B = f"SELECT s, t FROM ({_G1}) UNION SELECT t, s FROM ({_G1}) WHERE s % 7 = 0"


def _g1(spark, sf_dir, back: bool = False) -> DataFrame:
    """Nearly all pairs differ: they are dealt first, by their number, and not combined before."""
    e = _t(spark, sf_dir, "lineitem").select((2 * F.col("l_partkey")).alias("s"), (2 * F.col("l_suppkey") + 1).alias("t"))
    e = e.repartition(part_count(spark, e.count()), "s", "t").distinct()
    # Sources are even and targets odd, so the edges back differ from all others.
    return e.union(e.where("s % 7 = 0").select("t", "s")) if back else e


def _page_rank_sql(updates: int) -> str:
    parts = [f"e AS MATERIALIZED ({_G1})", "o AS MATERIALIZED (SELECT s, t, 1.0::DOUBLE / count(*) OVER (PARTITION BY s) AS w FROM e)", "n AS MATERIALIZED (SELECT unnest(generate_series(0, (SELECT max(greatest(s, t)) FROM e))) AS node)"]
    parts.append("r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS r FROM n)")
    for i in range(updates):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.node, (1 - 0.85::DOUBLE) + 0.85::DOUBLE * coalesce(x, 0) AS r FROM n LEFT JOIN (SELECT t, sum(r * w) AS x FROM o JOIN r{i} ON s = node GROUP BY t) f ON n.node = f.t)")
    return f"WITH {', '.join(parts)} SELECT node, round(r + 1e-9, 7) AS rank FROM r{updates}"


@query(_page_rank_sql(19))
def page_rank(spark, sf_dir):
    ranks = graph.page_rank(_g1(spark, sf_dir))
    return _round(ranks.withColumn("rank", F.col("rank") + 1e-9), rank=7)


_REACH = "WITH RECURSIVE e AS MATERIALIZED ({0}), n AS (SELECT unnest(generate_series(0, (SELECT max(greatest(s, t)) FROM e))) AS node), r(a, b) AS (SELECT node, node FROM n UNION SELECT r.a, e.t FROM r JOIN e ON r.b = e.s) "


def _labels_sql(passes: int) -> str:
    """Least labels handed on along edges, both ways, more often than the graph is wide."""
    parts = [f"e AS MATERIALIZED (SELECT s, t FROM ({_G1}) UNION SELECT t, s FROM ({_G1}))", "c0 AS MATERIALIZED (SELECT unnest(generate_series(0, (SELECT max(greatest(s, t)) FROM e))) AS node, node AS c)"]
    for i in range(passes):
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT node, least(c, coalesce(x, c)) AS c FROM c{i} LEFT JOIN (SELECT s, min(c) AS x FROM e JOIN c{i} ON t = node GROUP BY s) ON node = s)")
    return f"WITH {', '.join(parts)} SELECT node, c AS component FROM c{passes}"


@query(_labels_sql(16))
def connected_components(spark, sf_dir):
    e = _t(spark, sf_dir, "lineitem").select((2 * F.col("l_partkey")).alias("s"), (2 * F.col("l_suppkey") + 1).alias("t"))
    return graph.connected_components(e)  # repeated edges change nothing


@query(_REACH.format(_G1B) + "SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a")
def strongly_connected_components(spark, sf_dir):
    return graph.strongly_connected_components(_g1(spark, sf_dir, back=True))


@query(
    f"WITH RECURSIVE e AS MATERIALIZED ({_G1B}), n AS (SELECT unnest(generate_series(0, (SELECT max(greatest(s, t)) FROM e))) AS node), r(node, d) AS (SELECT DISTINCT s, 0 FROM e WHERE s < 5 UNION SELECT e.t, r.d + 1 FROM r JOIN e ON r.node = e.s WHERE r.d < 60) "
    "SELECT n.node, coalesce(CAST(min(d) AS DOUBLE), 'inf'::DOUBLE) AS distance FROM n LEFT JOIN r ON n.node = r.node GROUP BY n.node"
)
def shortest_path(spark, sf_dir):
    return graph.shortest_path(_g1(spark, sf_dir, back=True).withColumn("init", F.when(F.col("s") < 5, F.lit(0.0)).otherwise(F.lit(float("inf")))))


@query(_REACH.format(_G1B) + "SELECT b AS node, min(a) AS least FROM r GROUP BY b")
def pregel_min(spark, sf_dir):
    e = materialize(_g1(spark, sf_dir, back=True), "graph")
    nodes = graph.pregel_setup(graph.vertices(e).withColumn("least", F.col("node")), "node")
    return graph.pregel(nodes, e, {"m": F.col("src_least")}, {"m": F.min}, {"least": F.least("least", F.coalesce("msg_m", "least"))})


@query("SELECT 'vector' AS kind, label, count(*) AS n FROM embeddings GROUP BY label")
def vector_json(spark, sf_dir):
    text = _t(spark, sf_dir, "embeddings").select("label", arrays.vector_json("embedding").alias("j"))
    parsed = text.select("label", F.get_json_object("j", "$.__type__").alias("kind"), F.get_json_object("j", "$.n_elem").cast("int").alias("k"))
    return parsed.where("k = 64").groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
