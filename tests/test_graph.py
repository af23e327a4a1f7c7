import itertools
import random

import pytest
from pyspark.sql import functions as F

from statflow.operators import graph
from statflow.operators.components import star_components

EDGES = [(0, 1), (1, 0), (2, 3), (3, 2), (2, 0), (5, 5), (6, 7), (6, 7), (7, 8), (8, 6), (8, 9)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "s long, t long")


def test_components(edges):
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6, 9: 6}
    assert {r["node"] for r in graph.connected_components(edges, dense=False).collect()} == set(got) - {4}


def test_scc_refines_components(edges):
    got = {r["node"]: r["component"] for r in graph.strongly_connected_components(edges).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6, 9: 9}


def test_shortest_path(spark):
    rows = [(0, 1, 4.0, 0.0), (0, 2, 1.0, 0.0), (2, 1, 2.0, float("inf")), (1, 3, 1.0, float("inf")), (5, 4, 1.0, float("inf"))]
    df = spark.createDataFrame(rows, "s long, t long, w double, init double")
    got = {r["node"]: r["distance"] for r in graph.shortest_path(df, weight="w").collect()}
    inf = float("inf")
    assert got == {0: 0.0, 1: 3.0, 2: 1.0, 3: 4.0, 4: inf, 5: inf}
    with pytest.raises(RuntimeError):
        graph.shortest_path(spark.createDataFrame([(0, 1, -1.0, 0.0), (1, 0, -1.0, None)], "s long, t long, w double, init double"), weight="w", max_iter=5)


def test_page_rank(edges):
    rank = dict.fromkeys(range(10), 1.0)
    for _ in range(3):
        new = dict.fromkeys(rank, 0.15)
        for s, t in EDGES:
            new[t] += 0.85 * rank[s] / sum(e[0] == s for e in EDGES)
        rank = new
    got = {r["node"]: r["rank"] for r in graph.page_rank(edges, updates=3).collect()}
    assert got == pytest.approx(rank)


def test_pregel_both_ways(spark, edges):
    nodes = graph.pregel_setup(spark.createDataFrame([(1, 7), (2, 5)], "k long, v long"), "k", edges)
    nodes = nodes.withColumn("v", F.coalesce("v", F.col("node")))
    out = graph.pregel(nodes, edges, {"m": F.col("src_v")}, {"m": F.max}, {"v": F.greatest("v", "msg_m")}, reverse={"m": F.col("dst_v")})
    assert {r["node"]: r["v"] for r in out.collect()} == {0: 7, 1: 7, 2: 7, 3: 7, 4: 4, 5: 5, 6: 9, 7: 9, 8: 9, 9: 9}
    with pytest.raises(ValueError):
        graph.pregel(nodes, edges, {"m": F.col("src_v")}, {"m": F.max}, {"nope": F.lit(1)})


def test_star_components_on_random_graphs(spark):
    rng = random.Random(3)
    e = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(6000, 6200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in e:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in set(itertools.chain(*[p for p in e if p[0] != p[1]]))}
    got = {r["node"]: r["component"] for r in star_components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == want


def test_empty(spark):
    none = spark.createDataFrame([], "s long, t long")
    assert graph.connected_components(none).count() == graph.page_rank(none, updates=1).count() == graph.strongly_connected_components(none).count() == 0
