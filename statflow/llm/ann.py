"""Approximate nearest neighbours by adaptive dimension scan
(ADSampling, Gao and Long 2023; column blocks after PDX, Kuffo et al. 2025).

Vectors are scaled to unit length, so that the nearest by squared distance is the
nearest by cosine, rotated by one random orthogonal matrix and dealt into the
lists of a coarse index. Within a probed list they lie in column blocks: the
distances over the first block of dimensions are computed for all, then a
hypothesis test abandons candidates whose partial distance, scaled up to all
dimensions, is too large to be among the nearest so far; the rest go on to the
next block. Survivors are scored in double precision on the original vectors. Each
query first scans its nearest list alone; the k-th distance there is the threshold that its
other lists start from.

The index (centroids) is fitted on at most SAMPLE vectors, those with the least
hashed ids; every vector is indexed. Of equal vectors the k + 1 with the least
ids are scanned, which is all that k places can show: a vector that a third of
all rows share costs a handful of rows per map task. There are sqrt(n) / 2 lists, up to one a fitted vector. Lists are cut into tiles of
about TILE rows by hash and their queries into chunks of about TILE, so a task
holds two bounded blocks. A query visits the share PROBE of the lists, LEAST
at least, set for a recall of over 0.9 on vectors with hardly any cluster structure; as the
queries are a share of all rows too, work and shuffle grow with their product.

Edge cases: vectors that are null, empty, zero, hold nulls or numbers that are
not finite, or differ in length from most take no part, neither do null ids;
repeated rows (same id and vector) count once, the same id with another vector
is never its own neighbour, and of several vectors of a query's id the least asks; ties go to the smaller id; where fewer than k
candidates exist all are returned; an empty table gives no rows; extra columns
are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statflow.plans.durable import materialize

K = 5
EVERY = 50
SAMPLE = 20_000
TILE = 4096
BLOCK = 16
EPSILON = 2.1
PROBE = 0.6
LEAST = 16
SEED = 42
SLACK = 1e-5
RESULT = "query_id long, rank int, vec_id long, score double"


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id (long), v (array<double>): the rows that take part."""
    v = F.col(vector).cast("array<double>")
    base = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    base = base.where(finite & F.exists("v", lambda x: x != 0))
    # Lengths of vectors are few; with ties the shorter one.
    top = base.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return base.where(F.size("v") == top[0]["n"]) if top else base.limit(0)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), c)
    return c


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row in the same order of operations, so equal vectors score alike."""
    scale = max(np.abs(q).max(), 1e-300)
    q = q / scale
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def scan(q: np.ndarray, q_id: int, rot_q: np.ndarray, blocks: list[np.ndarray], raw: np.ndarray, ids: np.ndarray, start: np.ndarray, k: int, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of a tile for one query, within the squared distance ``limit``: ids and cosines. ``blocks``: one
    (dimensions, rows) array per column block; ``start``: distances over the first."""
    dims, block = len(rot_q), len(blocks[0])
    alive = np.flatnonzero(ids != q_id)
    part = start[alive]
    # The k candidates best over the first block give the first threshold.
    lead = alive[np.argpartition(part, k - 1)[:k]] if len(alive) > k else alive
    full = sum(((b[:, lead] - rot_q[i * block : i * block + len(b), None]) ** 2).sum(axis=0) for i, b in enumerate(blocks))
    radius = min(full.max() if len(lead) >= k else np.inf, limit)
    done = block
    for b in blocks[1:]:
        keep = part <= radius * done / dims * (1 + EPSILON / np.sqrt(done)) ** 2
        alive, part = alive[keep], part[keep]
        part = part + ((b[:, alive] - rot_q[done : done + len(b), None]) ** 2).sum(axis=0)
        done += len(b)
    cut = min(np.partition(part, k - 1)[k - 1] if len(alive) > k else np.inf, limit)
    alive = alive[part <= cut + SLACK]  # single precision decides on nothing near the border
    score = _cosines(q, raw[alive])
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][order], score[order]


def search(df: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding", probe: float = PROBE, seed: int = SEED) -> DataFrame:
    """RESULT: for each row whose id is divisible by ``every``, its k nearest other rows."""
    spark = df.sparkSession
    base = usable(df, vec_id, vector)
    few = Window.partitionBy("v").orderBy("vec_id")
    rows = base.withColumn("_r", F.dense_rank().over(few)).where(F.col("_r") <= k + 1).drop("_r").dropDuplicates(["vec_id", "v"])
    rows = materialize(rows, "vectors")
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], RESULT)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()  # at most SAMPLE rows
    rng = np.random.default_rng(seed)
    fit = _unit(_matrix(sample["v"]))
    dims = fit.shape[1]
    lists = int(np.clip(np.ceil(np.sqrt(n) / 2), 1, len(fit)))
    centres = _kmeans(fit, lists, rng)
    rotation = np.linalg.qr(rng.standard_normal((dims, dims)))[0]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["v"])
                pdf["list"] = np.argmax(_unit(x) @ centres.T, axis=1).astype(np.int32)
                pdf["v"] = [r.tobytes() for r in x]
                yield pdf[["vec_id", "v", "list"]]

    indexed = materialize(rows.mapInPandas(assign, "vec_id long, v binary, list int"), "lists")
    sizes = np.zeros(lists, np.int64)
    for r in indexed.groupBy("list").count().collect():  # a row a list, SAMPLE at most
        sizes[r["list"]] = r["count"]
    tiles = np.maximum(1, -(-sizes // TILE))
    probes = min(lists, max(LEAST, int(np.ceil(probe * lists))))

    def route(nearest: bool):
        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = _matrix(pdf["v"])
                    order = np.argsort(-(_unit(x) @ centres.T), axis=1, kind="stable")
                    # The nearest lists that hold k others, then on to the share that is probed.
                    first = np.minimum(1 + (np.cumsum(sizes[order], axis=1) <= k).sum(axis=1), lists)
                    last = first if nearest else np.maximum(probes, first)
                    rows = [(i, v.tobytes(), int(j), r) for i, v, r, o, a, z in zip(pdf["vec_id"], x, pdf["radius"], order, first, last, strict=True) for j in (o[:z] if nearest else o[a:z])]
                    yield pd.DataFrame(rows, columns=["vec_id", "v", "list", "radius"]).astype({"list": np.int32, "radius": float})

        return deal

    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def compare(queries: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(tile):
            decode = lambda s: np.frombuffer(b"".join(s), np.float64).reshape(len(s), dims)
            raw, q = decode(tile["v"]), decode(queries["v"])
            ids, limit = tile["vec_id"].to_numpy(), queries["radius"].to_numpy()
            turned = np.ascontiguousarray((_unit(raw) @ rotation).T.astype(np.float32))
            rot_q = (_unit(q) @ rotation).astype(np.float32)
            blocks = [turned[i : i + BLOCK] for i in range(0, dims, BLOCK)]
            a, b = rot_q[:, :BLOCK], blocks[0]
            for at in range(0, len(q), 256):
                p = a[at : at + 256]
                first = (p * p).sum(axis=1)[:, None] + (b * b).sum(axis=0)[None] - 2 * (p @ b)
                for j in range(len(p)):
                    i = at + j
                    got, score = scan(q[i], queries["vec_id"].iat[i], rot_q[i], blocks, raw, ids, first[j], k, limit[i])
                    found += [(queries["vec_id"].iat[i], g, s) for g, s in zip(got, score, strict=True)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def ask(queries: DataFrame, nearest: bool) -> DataFrame:
        routed = materialize(queries.mapInPandas(route(nearest), "vec_id long, v binary, list int, radius double"), "routed")
        load = np.zeros(lists, np.int64)
        for r in routed.groupBy("list").count().collect():
            load[r["list"]] = r["count"]
        chunks = -(-load // TILE)
        shape = F.broadcast(spark.createDataFrame([(i, int(tiles[i]), int(chunks[i])) for i in np.flatnonzero(chunks).tolist()], "list int, tiles int, chunks int"))
        cells = indexed.join(shape, "list").withColumn("tile", mine("tiles")).withColumn("chunk", each("chunks")).select("list", "tile", "chunk", "vec_id", "v")
        calls = routed.join(shape, "list").withColumn("chunk", mine("chunks")).withColumn("tile", each("tiles")).select("list", "tile", "chunk", "vec_id", "v", "radius")
        key = ["list", "tile", "chunk"]
        return calls.groupBy(key).cogroup(cells.groupBy(key)).applyInPandas(compare, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda near: near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    asked = base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    near = materialize(top(ask(asked.withColumn("radius", F.lit(float("inf"))), True)), "nearest")
    radius = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (F.greatest(F.lit(0.0), 2 - 2 * F.col("score")) + SLACK).alias("radius"))
    rest = ask(asked.join(radius, "vec_id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf")))), False)
    return top(near.drop("rank").union(rest))
