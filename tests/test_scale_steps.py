"""Steps whose work or state must not grow with a single task or with every pass."""

import numpy as np
import pyarrow as pa
import pytest

from statflow.models import glm
from statflow.operators import components, graph, quantile
from statflow.plans import durable, partials


def test_alike_rows_are_counted_before_the_passes(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(y), float(x)) for y, x in zip(rng.integers(1, 7, 500), rng.integers(0, 3, 500), strict=True)], "y int, x double")
    kept = glm._counted(df)
    assert kept.count() <= 18 and kept.agg({"n": "sum"}).first()[0] == 500
    unlike = glm._counted(spark.range(100))
    assert unlike.count() == 100 and unlike.agg({"n": "sum"}).first()[0] == 100
    counted = glm.glm(df, "y", ["x"], "poisson")
    before, glm.ALIKE = glm.ALIKE, 10**9  # every row by itself
    try:
        single = glm.glm(df, "y", ["x"], "poisson")
    finally:
        glm.ALIKE = before
    assert counted.n == single.n == 500 and counted.coefficients == pytest.approx(single.coefficients)
    assert (counted.deviance, counted.pearson) == pytest.approx((single.deviance, single.pearson))


def test_quantiles_over_several_sorted_parts(spark, monkeypatch):
    monkeypatch.setattr(quantile, "PART_VALUES", 40)  # takes PART_VALUES to exist: one task held all values before
    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][i % 3], float(v), None if i % 2 else float(i)) for i, v in enumerate(rng.normal(size=600).round(2))] + [("empty", None, None), ("nan", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    qs = (0.0, 0.1, 0.5, 0.77, 1.0)
    got = {(r["g"], r["column"], r["q"]): r["value"] for r in quantile.quantiles(df, ["x", "y"], qs, "g").collect()}
    assert len(got) == 5 * 2 * len(qs)
    for g in ("a", "b", None):
        for k, c in ((1, "x"), (2, "y")):
            known = [r[k] for r in rows if r[0] == g and r[k] is not None]
            assert [got[g, c, q] for q in qs] == pytest.approx([np.quantile(known, q) for q in qs])
    assert got["empty", "x", 0.5] is None and np.isnan(got["nan", "x", 0.5])
    whole = {(r["column"], r["q"]): r["value"] for r in quantile.quantiles(df.where("g <> 'nan'"), ["x"], qs).collect()}
    assert [whole["x", q] for q in qs] == pytest.approx([np.quantile([r[1] for r in rows[:600] if r[0]], q) for q in qs])


def test_tasks_join_up_their_own_edges():
    rng = np.random.default_rng(8)
    u, v = rng.integers(0, 900, 800), rng.integers(0, 900, 800)
    x, y = components._forest(u, v)
    assert len(x) < len(np.unique(np.concatenate([u, v]))) and len(np.unique(x)) == len(x)
    label = np.arange(900)
    for _ in range(900):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
    mine = np.arange(900)
    mine[x] = y
    assert (mine == label).all()


def test_large_states_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 5)
    state = graph._state(spark.range(10), 10)
    joined = spark.range(20).join(state, "id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(durable, "PART_ROWS", 100)
    assert durable.part_count(spark, 5000) == 51
    own = spark.conf.get("spark.sql.shuffle.partitions")
    durable.materialize(spark.range(10).groupBy("id").count(), "part", 5000)
    assert spark.conf.get("spark.sql.shuffle.partitions") == own


def test_vectors_come_as_one_matrix():
    batch = pa.RecordBatch.from_pydict({"v": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]})
    assert partials.stacked(batch.slice(1), "v").tolist() == [[3.0, 4.0], [5.0, 6.0]]
    with pytest.raises(ValueError):
        partials.stacked(pa.RecordBatch.from_pydict({"v": [[1.0], [3.0, 4.0]]}), "v")
