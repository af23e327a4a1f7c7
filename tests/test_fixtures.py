import numpy as np
import pytest
from pyspark.sql import functions as F

from statflow.models import glm
from statflow.operators import quantile
from statflow.sources import fixtures


@pytest.mark.parametrize("name", fixtures.SCHEMAS)
def test_rows_do_not_depend_on_partitions(spark, name):
    df = fixtures.fixture(spark, name, 2500, 3)
    key = [F.col(c) for c in df.columns]
    assert df.count() == 2500
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", 3)
    try:
        again = fixtures.fixture(spark, name, 2500, 3).orderBy(*key).collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    assert df.orderBy(*key).collect() == again


@pytest.mark.parametrize(
    "name,response,family,link,terms,weights",
    [
        ("binomial", "y1 / (y1 + y2)", "binomial", "logit", ["x1", "x2", "x3"], "y1 + y2"), ("gamma", "y", "gamma", "inverse", ["x1", "x2", "x3"], None), ("normal", "y", "gaussian", "identity", ["x1", "x2", "x3"], None),
        ("poisson", "y", "poisson", "log", ["x1", "x2", "x3"], None), ("exponential", "y", "exponential", "identity", ["x1", "x2", "x3"], None), ("interaction", "y", "gamma", "inverse", ["f1:f2"], None),
    ],
)
def test_models_recover_the_parameters(spark, name, response, family, link, terms, weights):
    model = glm.glm(fixtures.fixture(spark, name, 20_000, 1), response, terms, family, link, weights=weights)
    assert np.abs(np.array(model.coefficients) - fixtures.coefficients(name, 1)).max() < 0.2


def test_factor_means(spark):
    b = fixtures.coefficients("factor", 1)
    model = glm.glm(fixtures.fixture(spark, "factor", 20_000, 1), "y", ["f1", "f2"], "gamma", "inverse")
    c = model.coefficients
    for i in range(3):
        for j in range(3):
            assert c[i] + c[3 + j] == pytest.approx(b[0] + b[1 + i] + b[4 + j], rel=0.05)


def test_medians(spark):
    assert quantile.median(fixtures.fixture(spark, "sequence", 100), ["i"]).first()["median"] == 50.5
    got = [r["median"] for r in quantile.median(fixtures.fixture(spark, "columns", 6000), [f"c{i}" for i in range(6)]).orderBy("column").collect()]
    assert np.abs(np.array(got) - [2.5, 2.5, 19.1, 25.1, -10, 15]).max() < 0.15
    ties = fixtures.fixture(spark, "ties", 4000)
    a, b = quantile.quantiles(ties, ["a", "d"], [0.25, 0.5]).collect(), quantile.binned_quantiles(ties, ["a", "d"], [0.25, 0.5], bins=20, threshold=50).collect()
    assert {r[:2]: r[2] for r in a} == pytest.approx({r[:2]: r[2] for r in b})
