import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statflow.functions import arrays, links
from statflow.operators import aggregates as agg
from statflow.operators import pairs, quantile, transform
from statflow.plans import lookup


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [("a" if i % 3 else "b", float(i % 17), float((i * 7) % 11), i) for i in range(200)] + [("a", None, 1.0, 200), (None, 3.0, 4.0, 201)]
    return spark.createDataFrame(rows, "g string, x double, y double, i int")


def _rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "run",
    [
        lambda d: agg.summary(d, ["x", "y"], "g"), lambda d: agg.cov_cor(d, ["x", "y"]), lambda d: agg.mode(d, "x", "g"), lambda d: agg.histogram(d, "i", 50, long=True),
        lambda d: agg.line_chart(d.withColumn("k", F.col("i") % 20), "k", "y", 25, by="g", long=True), lambda d: agg.build_array(d.withColumn("k", F.col("i") % 7), ["k"], "x", [5]),
        lambda d: quantile.quantiles(d, ["x", "y"], [0.1, 0.5], "g"), lambda d: quantile.binned_quantiles(d, ["x", "i"], [0.0, 0.3, 0.5, 1.0], bins=7, threshold=5), lambda d: agg.ols(d, ["y", "i"], "x"),
    ],
)
def test_partitioning_does_not_matter(numbers, run):
    assert _rows(run(numbers.repartition(1))) == _rows(run(numbers.repartition(7)))


def test_summary_of_a_sequence(spark):
    r = agg.summary(spark.range(1, 101), ["id"]).first()
    assert (r["mean"], r["range"], r["min"], r["max"], r["count"]) == (50.5, 99.0, 1.0, 100.0, 100) and r["std_dev"] == pytest.approx(np.std(range(1, 101), ddof=1))
    assert quantile.median(spark.range(1, 101), ["id"]).first()["median"] == 50.5
    assert agg.summary(spark.range(0), ["id"]).first()["count"] == 0


def test_histogram_and_chart(spark):
    df = spark.createDataFrame([(-1, 1.0), (0, 2.0), (0, 3.0), (2, 4.0), (9, 5.0), (None, 1.0)], "i int, v double")
    assert agg.histogram(df, "i", 4).first()["histogram"] == [2.0, 0.0, 1.0, 0.0]
    assert agg.histogram(df, "i", 4, normalize=True).first()["histogram"] == pytest.approx([2 / 3, 0, 1 / 3, 0])
    assert agg.line_chart(df, "i", "v", 4, fill=-1.0).first()["chart"] == [5.0, -1.0, 4.0, -1.0]
    assert agg.line_chart(df.limit(0), "i", "v", 2).first()["chart"] == [0.0, 0.0]


def test_arrays_and_validation(spark):
    df = spark.createDataFrame([(1, 2.5, "b", [3.0, 4.0])], "i int, x double, c string, v array<double>")
    assert df.select(arrays.make_vector(df, "i", "x", "c", "v", levels={"c": ["b", "a"]})).first()[0] == [1.0, 2.5, 1.0, 3.0, 4.0]
    assert df.select(arrays.normalize("v"), arrays.normalize(F.array(F.lit(0.0), F.lit(0.0)))).first() == ([0.6, 0.8], [0.0, 0.0])
    assert df.select(arrays.vector_json("v")).first()[0] == '{"__type__":"vector","n_elem":2,"data":[3.0,4.0]}'
    assert spark.createDataFrame([(" 1  2 3",)], "s string").select(arrays.parse_vector("s", 2)).first()[0] == [1.0, 2.0]
    assert df.select(arrays.subtract("v", "v"), arrays.dot("v", "v"), arrays.sparse_contains(F.array(F.lit(1)), 2)).first() == ([0.0, 0.0], 25.0, False)
    for bad in (lambda: arrays.make_vector(df, "c"), lambda: arrays.get(df, "v", 0), lambda: agg.summary(df, []), lambda: agg.summary(df, ["nope"]), lambda: agg.histogram(df, "i", 0), lambda: agg.build_array(df, ["i"], "x", aggregate="max"), lambda: quantile.quantiles(df, ["x"], [2.0]), lambda: pairs.pair_stats(df, "i", "v", ["cosine"])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="too few"):
        spark.createDataFrame([("1",)], "s string").select(arrays.parse_vector("s", 2)).collect()


def test_expand(spark):
    df = spark.createDataFrame([(1, [1, 2], [3, 4]), (2, [], [])], "k int, a array<int>, b array<int>")
    assert _rows(transform.expand(df, ["a", "b"], "at")) == [(1, 0, 1, 3), (1, 1, 2, 4)]
    with pytest.raises(Exception, match="unequal"):
        transform.expand(spark.createDataFrame([([1], [2, 3])], "a array<int>, b array<int>"), ["a", "b"]).collect()


def test_build_array(spark):
    df = spark.createDataFrame([(0, 0, 2.0, 1), (0, 0, 3.0, 2), (1, 2, 5.0, 3), (5, 0, 7.0, 4)], "a int, b int, v double, o int")
    for how, want in (("sum", 5.0), ("multiplication", 6.0), ("replacement", 3.0), ("omission", 2.0)):
        built = agg.build_array(df, ["a", "b"], "v", [2, 3], how, order_by="o")
        assert {(r["a"], r["b"]): r["value"] for r in built.collect()} == {(0, 0): want, (1, 2): 5.0}
        assert agg.dense_array(built, ["a", "b"], [2, 3]).first() == ([2, 3], [want, 0.0, 0.0, 0.0, 0.0, 5.0])
    with pytest.raises(Exception, match="out of range"):
        agg.build_array(df, ["a", "b"], "v", [2, 3], error=True).collect()
    assert agg.build_array(df, ["a"], "v").count() == 3


def test_samples(spark):
    df = spark.range(1000)
    a, b = agg.reservoir_sample(df, 50).collect(), agg.reservoir_sample(df, 50).collect()
    assert a == b and len({r[0] for r in a}) == 50 and agg.reservoir_sample(df, 5000).count() == 1000
    assert [r[0] for r in agg.first_k(df, 3, "id").collect()] == [0, 1, 2]
    mean = np.mean([np.mean([r[0] for r in agg.reservoir_sample(df, 100, seed).collect()]) for seed in range(20)])
    assert abs(mean - 499.5) < 30


def test_ols_and_gram(spark):
    rng = np.random.default_rng(0)
    x = rng.random((500, 3))
    y = 1.5 + x @ [2.0, -1.0, 0.5] + 1e6
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    got = {r["term"]: r["coefficient"] for r in agg.ols(df, ["a", "b", "c"], "y").collect()}
    assert got["a"] == pytest.approx(2) and got["b"] == pytest.approx(-1) and got["c"] == pytest.approx(0.5)
    n, mean, m2 = agg.gram(df.select(F.array("a", "b").alias("v")), "v", 2)
    assert n == 500 and mean == pytest.approx(x[:, :2].mean(0)) and m2 / 499 == pytest.approx(np.cov(x[:, :2].T))


def test_links(spark):
    quad = lambda v: math.erfc(-v / math.sqrt(2)) / 2
    p = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.7, 0.975, 0.9999, 1 - 1e-9]
    z = [-8.0, -4.5, -2.0, -0.3, 0.0, 0.2, 0.9, 3.0, 6.0]
    df = spark.createDataFrame(list(zip(p, z, strict=True)), "p double, z double")
    for r in df.select("p", "z", links.normal_quantile(F.col("p")).alias("q"), links.erf(F.col("z")).alias("e"), links.normal_cdf(F.col("z")).alias("c")).collect():
        assert quad(r["q"]) == pytest.approx(r["p"], rel=1e-9, abs=1e-12) and links.normal_quantile_of(np.array([r["p"]]))[0] == pytest.approx(r["q"], rel=1e-13) and r["e"] == pytest.approx(math.erf(r["z"]), abs=1e-14) and r["c"] == pytest.approx(quad(r["z"]), abs=1e-14) and links.erf_of(np.array([r["z"]]))[0] == pytest.approx(r["e"], abs=1e-14)
    mid = df.where("p between 0.01 and 0.99")
    for name in links.LINK:
        back = mid.select("p", links.INVERSE[name](links.LINK[name](F.col("p"))).alias("b"), links.DERIVATIVE[name](F.col("p")).alias("d"), ((links.LINK[name](F.col("p") + 1e-6) - links.LINK[name](F.col("p") - 1e-6)) / 2e-6).alias("n"))
        for r in back.collect():
            assert r["b"] == pytest.approx(r["p"], rel=1e-9) and r["d"] == pytest.approx(r["n"], rel=1e-4)


def test_pairs_cover_all(spark):
    rows = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(23)] + [(3, [1.0, 2.0, 3.0]), (99, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    for block in (4, 100):
        assert pairs.pair_stats(df, "k", "v", ["distance"], block=block).count() == 24 * 25 // 2
        assert pairs.pair_stats(df, "k", "v", ["distance"], diag=False, block=block).count() == 24 * 23 // 2
        assert pairs.cross_stats(df, df, "k", "v", ["covariance"], block=block).count() == 24 * 24
    assert pairs.pair_stats(df.limit(0), "k", "v").count() == 0


def test_nearest(spark):
    charts = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0]), ("c", [1.0, 0.0])], "k string, c array<double>")
    df = spark.createDataFrame([(1, [5.0, 0.1]), (2, [0.1, 0.2]), (3, None)], "i int, v array<double>")
    assert [r["nearest"] for r in transform.nearest_neighbor(df, "v", charts, "k", "c").orderBy("i").collect()] == ["a", "a", None]
    assert [r["nearest"] for r in transform.nearest_neighbor(df, "v", charts, "k", "c", normalization=True).orderBy("i").collect()] == ["a", "b", None]


def test_lookup_join_two_ways(spark):
    big = spark.range(500).select("id", (F.col("id") % 3).alias("k"))
    small = spark.createDataFrame([(0, "x"), (1, "y")], "k long, s string")
    a = lookup.join_lookup(big, small, "k", "id").select("id", "s")
    b = lookup.join_lookup(big, small, "k", "id", limit=0).select("id", "s")
    assert sorted(a.collect()) == sorted(b.collect()) and "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    """Scans read what is asked for; aggregates combine before they shuffle."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = agg.summary(df.where("l_quantity > 10"), ["l_tax"], "l_returnflag")._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan and "PushedFilters" in plan and "GreaterThan(l_quantity,10.0)" in plan
    assert "l_extendedprice" not in plan
