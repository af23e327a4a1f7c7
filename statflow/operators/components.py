"""Connected components by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.plans.durable import forget, materialize, scratch
from statflow.plans.lookup import join_lookup


#: Edges a task joins up at a time.
CHUNK = 1 << 20


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from every node to the least one it reaches by these edges."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        low, new = np.minimum(x, y), label.copy()
        np.minimum.at(new, np.maximum(x, y), low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    far = label != np.arange(len(ids))
    return ids[far], ids[label[far]]


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as forests, which connect the same nodes with at most one edge a node."""
    u, v, held = [], [], 0
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
        held += batch.num_rows
        if held >= CHUNK:
            x, y = _forest(np.concatenate(u), np.concatenate(v))
            u, v, held = [x], [y], len(x)
            if held > CHUNK // 2:
                yield pa.RecordBatch.from_pydict({"u": x, "v": y})
                u, v, held = [], [], 0
    if held:
        x, y = _forest(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_pydict({"u": x, "v": y})


def star_components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v (long, same type). Returns node, component (the least node
    reachable) for every node that has an edge to another one. State is written
    after each round and the one before deleted; rows with a null end are dropped.
    Tasks join up their own edges first, in memory and without a shuffle.
    Edges meet the minima of their ends by a measured lookup, so hubs are split by their
    size. Rounds grow with the logarithm of the nodes (squared, at worst)."""
    spark = edges.sparkSession
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e = materialize(e.mapInArrow(_join_up, "u long, v long"), "forests")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", e.count())
    before = None
    while True:
        digest = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if digest == before or digest["n"] == 0:
            break
        before, n = digest, 2 * digest["n"]
        with scratch(spark) as keep:
            sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = join_lookup(sym.where("v > u"), low, "u", "v", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = materialize(large, "large", n)
            low2 = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low", n)
            small = join_lookup(large, low2, "u", "v", "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            new = keep(materialize(small.union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges", n))
        forget(e)
        e = new
    stars = e.groupBy("u").agg(F.min("v").alias("v"))
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return stars.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
