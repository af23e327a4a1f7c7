import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statflow.models import forest, glm, kmeans, logistic, naive_bayes, tree
from statflow.sources.binomial import binomial_source
from statflow.streaming.aggregates import windowed_histogram, windowed_summary


def _frame(spark, x, y, names="abc"):
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in [*names[: x.shape[1]], "y"]))


BETA = np.array([0.4, 0.8, -0.5, 0.3])


@pytest.mark.parametrize("family,link", [(f, k) for f, ks in glm.FAMILIES.items() for k in ks])
def test_parameters_are_recovered(spark, family, link):
    rng = np.random.default_rng(11)
    x = rng.random((6000, 3))
    eta = BETA[0] + x @ BETA[1:]
    if link in ("inverse", "inverse_squared", "identity", "sqrt"):
        eta = eta + 1
    mu = glm.INVERSE[link](eta)
    y = {
        "gaussian": lambda: rng.normal(mu, 0.3), "poisson": lambda: rng.poisson(mu), "gamma": lambda: rng.gamma(5, mu / 5), "exponential": lambda: rng.exponential(mu),
        "binomial": lambda: rng.binomial(50, mu) / 50, "inverse_gaussian": lambda: rng.wald(mu, 20.0),
    }[family]()
    df = _frame(spark, x, y).withColumn("n", F.lit(50.0))
    model = glm.glm(df, "y", ["a", "b", "c"], family, link, weights="n" if family == "binomial" else None)
    want = BETA + [1.0 if link in ("inverse", "inverse_squared", "identity", "sqrt") else 0, 0, 0, 0]
    assert model.converged and model.n == 6000
    assert np.abs(np.array(model.coefficients) - want).max() < (0.35 if family == "exponential" else 0.15)
    again = glm.GlmModel.from_json(model.to_json())
    rows = again.predict(df).select("prediction").limit(5).collect()
    first = df.limit(5).collect()
    beta = np.array(model.coefficients)
    assert [r[0] for r in rows] == pytest.approx([float(glm.INVERSE[link](beta[0] + np.array([f["a"], f["b"], f["c"]]) @ beta[1:])) for f in first])


def test_null_deviance_and_interactions(spark):
    rng = np.random.default_rng(2)
    rows = [(f"f{i}", f"g{j}", float(rng.gamma(5, (1 + i + 2 * j) / 5)), float(rng.random())) for i in range(3) for j in range(3) for _ in range(40)]
    df = spark.createDataFrame(rows, "f string, g string, y double, x double")
    y = np.array([r[2] for r in rows])
    null = glm.glm(df.withColumn("one", F.lit(1.0)), "y", ["one"], "gamma", "inverse", intercept=False)
    mu = 1 / null.coefficients[0]
    assert null.deviance == pytest.approx(2 * (np.log(mu / y) + (y - mu) / mu).sum()) and null.pearson == pytest.approx(((y - mu) ** 2 / mu**2).sum())
    cells = glm.glm(df, "y", ["f", "f:g"], "gamma", "inverse")
    assert cells.design.names == [f"f=f{i}:g=g{j}" for i in range(3) for j in range(3)] and not cells.design.intercept
    means = {(r["f"], r["g"]): r["m"] for r in df.groupBy("f", "g").agg(F.avg("y").alias("m")).collect()}
    assert [1 / c for c in cells.coefficients] == pytest.approx([means[f"f{i}", f"g{j}"] for i in range(3) for j in range(3)])
    mixed = glm.glm(df, "y", ["f:x", "x"], "gaussian")
    assert mixed.design.names[0] == "(intercept)" and mixed.design.names[1:] == ["f=f0:x", "f=f1:x", "f=f2:x"]
    shifted = glm.glm(df, "y", ["x"], "poisson", "log", offset="x * 2")
    plain = glm.glm(df, "y", ["x"], "poisson", "log")
    assert shifted.coefficients[1] == pytest.approx(plain.coefficients[1] - 2, abs=1e-6)
    assert glm.glm(df, "y", ["x"], "poisson", "log", start=plain.coefficients).iteration <= 2
    for bad in ({"family": "t"}, {"family": "gamma", "link": "logit"}, {"epsilon": 0}, {"start": [1.0]}):
        with pytest.raises(ValueError):
            glm.glm(df, "y", ["x"], **{"family": "gaussian", **bad})
    with pytest.raises(ValueError):
        glm.glm(df.limit(0), "y", ["x"])


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    parts = [rng.normal(c, s, (400, 2)) for c, s in (((2.5, 2.5), (2, 1.5)), ((19.1, 25.1), (1, 1.5)), ((-10, 15), (0.5, 0.8)))]
    rows = [("abc"[k], float(x), float(y)) for k, p in enumerate(parts) for x, y in p]
    return spark.createDataFrame(rows, "k string, x double, y double").cache()


def test_kmeans(blobs):
    for args in ({}, {"m": 2}, {"p": 1}, {"normalized": True}, {"centers": [[0.0, 0.0], [20.0, 20.0], [-5.0, 10.0]]}):
        model = kmeans.k_means(blobs, ["x", "y"], 3, **args)
        got = sorted(model.centers)
        assert np.abs(np.array(got) - [[-10, 15], [2.5, 2.5], [19.1, 25.1]]).max() < 1.5, args
        split = kmeans.KMeansModel.from_json(model.to_json()).predict(blobs, ["x", "y"]).groupBy("k").agg(F.countDistinct("cluster").alias("n")).collect()
        assert all(r["n"] <= 2 for r in split)
    with pytest.raises(ValueError):
        kmeans.k_means(blobs, ["x", "y"], 3, p=0)


def test_kmeans_keeps_empty_clusters(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,)], "x double")
    assert kmeans.k_means(df, ["x"], 2, centers=[[2.0], [500.0]]).centers == [[pytest.approx(5 / 3)], [500.0]]


def test_g_means(blobs):
    root = kmeans.g_means(blobs, ["x", "y"])
    leaves = root.leaves()
    assert len(leaves) == 3 and sorted(x.count for x in leaves) == [400, 400, 400] and '"children"' in root.to_json()


def test_naive_bayes(blobs):
    model = naive_bayes.naive_bayes(blobs, "k", ["x", "y"], bins=15)
    assert model.table.agg(F.sum("joint")).first()[0] == pytest.approx(2.0)
    assert model.predict(blobs).where("prediction = k").count() > 1150


def test_forest(blobs, tmp_path):
    model = forest.random_forest(blobs, ["x", "y"], "k", num_trees=5, max_depth=5, min_sample=1)
    assert model.predict(blobs).where("prediction = k").count() > 1180
    model.save(str(tmp_path / "f"))
    again = forest.ForestModel.load(str(tmp_path / "f"), ["x", "y"], model.levels)
    assert again.predict(blobs).where("prediction = k").count() > 1180
    out = forest.random_forest_batch(blobs, blobs, ["x"], "y", ["k"], num_trees=3, max_depth=4, min_sample=1)
    assert out.columns == ["k", "x", "prediction"] and out.count() == 1200


@pytest.mark.parametrize("split", ["anova", "lda"])
def test_tree_finds_a_planted_break(spark, split):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(0, 1, 600), rng.uniform(2, 3, 600)])
    y = np.where(x < 1.5, 1 + 2 * x, 10 - 3 * x) + rng.normal(0, 0.05, 1200)
    df = spark.createDataFrame([(float(a), float(b), "u" if a < 1.5 else "v") for a, b in zip(x, y, strict=True)], "x double, y double, c string")
    for disc in ([], ["c"]):
        model = tree.decision_tree(df, "y", ["x"], discrete=disc, split=split, max_depth=2)
        err = model.predict(df).select(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("y"), 2)))).first()[0]
        assert err < 0.15 and len(model.root.leaves()) >= 2
    straight = tree.decision_tree(df.where("x < 1"), "y", ["x"], max_depth=2, threshold=0.5)
    assert len(straight.root.leaves()) == 1 and straight.root.slopes[0] == pytest.approx(2, abs=0.05)


def test_classification_tree_and_depth_cut(spark, blobs):
    model = forest.classification_tree(blobs, ["x", "y"], "k")
    assert model.predict(blobs).where("prediction = k").count() > 1190
    df = spark.createDataFrame([(float(i), float(i if i < 50 else 200 - i)) for i in range(100)], "x double, y double")
    fit = tree.decision_tree(df, "y", ["x"], max_depth=2)
    flat = fit.predict(df, depth=0).select("x", "prediction").orderBy("x").collect()
    assert flat[10][1] == pytest.approx(fit.root.intercept + 10 * fit.root.slopes[0])


def test_split_maths():
    assert tree.gini_gain(0.5, 0.5, 0.5) == 0.5 and tree.gini_gain(0.5, 0.5, 0.25) == 0
    gain, left = tree.discrete_split(np.array([[10.0, 0], [0, 10], [9, 1], [0, 0]]))
    assert gain == pytest.approx(tree.gini_gain(19 / 30, 20 / 30, 19 / 30)) and left == [0, 2]
    assert tree.split_point((0.5, 0.0, 1.0), (0.5, 4.0, 1.0)) == pytest.approx(2.0)


def test_logistic(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        d = [x for x in "pqr" if rng.random() < 0.4]
        p = 0.7 if "p" in d else 0.15
        rows.append((d, [e for e in ("ache", "rash") if rng.random() < (p if e == "ache" else 0.3)], f"s{i % 4}"))
    m = logistic.logistic_multi(spark.createDataFrame(rows, "drugs array<string>, effects array<string>, stratum string"), max_iter=60)
    beta = {(e, d): m.coefficients[i, j] for i, e in enumerate(m.effects) for j, d in enumerate(m.drugs)}
    assert beta["ache", "p"] > 1 and abs(beta["rash", "p"]) < 0.6 and abs(beta["ache", "q"]) < 0.6
    assert logistic.spline(np.array([-1e-12]))[0] == pytest.approx(logistic.spline(np.array([0.0]))[0]) == pytest.approx(0.25)


def test_binomial_source(spark):
    df = binomial_source(spark, 3, 5000, seed=4)
    assert df.count() == 15000 and sorted(df.collect()) == sorted(binomial_source(spark, 3, 5000, seed=4).collect())
    one = df.where(F.spark_partition_id() == 0)
    n = one.select(F.max(F.col("y1") + F.col("y2")), F.min(F.col("y1") + F.col("y2"))).first()
    assert n[0] == n[1]
    if n[0]:
        rng = np.random.default_rng((4, 0))
        coefficients, intercept = rng.random(3), rng.random()
        model = glm.glm(one.withColumn("n", F.lit(n[0])), "y1 / n", ["input1", "input2", "input3"], "binomial", "logit", weights="n")
        assert np.abs(np.array(model.coefficients) - [intercept, *coefficients]).max() < 0.15


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.range(600).select(F.timestamp_seconds(F.col("id") * 10).alias("ts"), (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 5).cast("int").alias("i"))
    rows.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).parquet(str(src))
    for name, df in (("s", windowed_summary(stream, "ts", ["v"], "10 minutes")), ("h", windowed_histogram(stream, "ts", "i", 4, "1 hour"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r["start"]: (r["count"], round(r["mean"], 9)) for r in spark.table("s").collect()}
    want = {r["w"]: (r["n"], round(r["m"], 9)) for r in rows.groupBy(F.window("ts", "10 minutes").start.alias("w")).agg(F.count("v").alias("n"), F.avg("v").alias("m")).collect()}
    assert got == want and spark.table("h").agg(F.sum("count")).first()[0] == 480
    assert math.isclose(sum(c for c, _ in got.values()), 600)


def test_kmeans_with_factors(blobs):
    df = blobs.withColumn("f", F.when(F.rand(1) < 0.9, F.col("k")).otherwise("z"))
    model = kmeans.k_means_mixed(df, ["x"], ["f"], 3, centers=[[0.0], [15.0], [-8.0]])
    assert np.abs(np.array(sorted(model.centers))[:, 0] - [-10, 2.5, 19.1]).max() < 1 and model.converged
    assert model.predict(df, ["x"]).groupBy("k", "cluster").count().count() <= 5
    assert all(abs(sum(f) - 1) < 1e-9 for c in model.frequencies for f in c)


def test_custom_aggregate_and_iteration(spark):
    from statflow.operators.custom import aggregate, iterate
    from statflow.queries import WeightedMean

    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 4.0), (None, 1.0, 7.0)], "k string, w double, x double").repartition(3)
    assert {r["k"]: r["mean"] for r in aggregate(df, WeightedMean(), ["w", "x"], ["k"]).collect()} == {"a": 3.5, None: 7.0}
    assert aggregate(df, WeightedMean(), ["w", "x"]).first()["mean"] == pytest.approx(21 / 5)
    assert aggregate(df.limit(0), WeightedMean(), ["w", "x"]).first()["mean"] is None
    out, passes, done = iterate(spark.range(4), lambda s, i: (s.select((F.col("id") + 1).alias("id")), i == 3))
    assert passes == 3 and done and out.agg(F.sum("id")).first()[0] == 18
