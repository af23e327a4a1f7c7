"""K-means with Minkowski distance, hard or fuzzy, and G-means.

Each pass is one scan; a task adds up weights and weighted sums of its rows per
cluster, so what moves is clusters x dimensions numbers a task.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.functions.arrays import as_vector
from statflow.operators.aggregates import reservoir_sample
from statflow.plans.durable import materialize
from statflow.plans.partials import add_up, stacked


def _vectors(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    v = as_vector(cols) if isinstance(cols, str) else F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(np.float64)


def _distances(x: np.ndarray, c: np.ndarray, p: float) -> np.ndarray:
    """Sum of abs(x - c)^p, no root, a column per centre; centres one at a time bound the memory."""
    return np.stack([(np.abs(x - row) ** abs(p)).sum(axis=1) for row in c], axis=1)


def _memberships(x: np.ndarray, c: np.ndarray, p: float, m: float) -> np.ndarray:
    d = _distances(x, c, p)
    if m == 1:
        best = d.argmin(axis=1) if p > 0 else d.argmax(axis=1)
        return np.eye(len(c))[best]
    u = (d + 1e-9) ** (-1 / (m - 1))
    return u / u.sum(axis=1, keepdims=True)


@dataclass
class KMeansModel:
    centers: list[list[float]]
    iteration: int
    converged: bool
    p: float = 2.0
    m: float = 1.0
    low: list[float] | None = None
    high: list[float] | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> KMeansModel:
        return cls(**json.loads(text))

    def predict(self, df: DataFrame, cols: str | Sequence[str], output: str = "cluster") -> DataFrame:
        """Adds the index of the nearest centre; ties to the first."""
        c = np.array(self.centers)
        low, high = (np.array(self.low), np.array(self.high)) if self.low is not None else (None, None)
        p = self.p
        if low is not None:
            c = _scale(c, low, high)

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            known = v.map(lambda x: x is not None and not np.isnan(np.asarray(x, float)).any()).to_numpy()
            out = pd.Series([None] * len(v), dtype="Int32")
            if known.any():
                x = np.stack(v[known].to_numpy()).astype(float)
                d = _distances(_scale(x, low, high) if low is not None else x, c, p)
                out[known] = d.argmin(axis=1) if p > 0 else d.argmax(axis=1)
            return out

        v = as_vector(cols) if isinstance(cols, str) else F.array(*[F.col(x).cast("double") for x in cols])
        return df.withColumn(output, nearest(v))


def _scale(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    width = high - low
    return np.where(width > 0, (x - low) / np.where(width > 0, width, 1), 0.0)


def plus_plus(sample: np.ndarray, k: int, p: float, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeding: chance in proportion to the squared distance to the nearest centre so far."""
    c = [sample[rng.integers(len(sample))]]
    while len(c) < k:
        d = _distances(sample, np.array(c), p).min(axis=1) ** 2
        total = d.sum()
        c.append(sample[rng.choice(len(sample), p=d / total) if total > 0 else rng.integers(len(sample))])
    return np.array(c)


def k_means(
    df: DataFrame, cols: str | Sequence[str], k: int, p: float = 2.0, m: float = 1.0, max_iter: int = 100, epsilon: float = 1e-6, convergence: str = "absolute",
    centers: str | Sequence[Sequence[float]] = "k-means++", sample_size: int = 1000, normalized: bool = False, seed: int = 42,
) -> KMeansModel:
    """``p``: power of the distance (negative: the farthest centre); ``m``: fuzziness, 1 for hard.
    ``centers``: given ones, "standard" (a sample of rows) or "k-means++" (seeded on a sample of
    ``sample_size`` rows). An empty cluster keeps its centre. Stops when no coordinate moves by more
    than ``epsilon`` (``relative``: of its old value), or after ``max_iter`` passes."""
    if k < 1 or p == 0 or m < 1 or max_iter < 1:
        raise ValueError("k, max_iter >= 1, p != 0 and m >= 1 are needed")
    if convergence not in ("absolute", "relative"):
        raise ValueError("convergence: absolute or relative")
    rows = _vectors(df, cols)
    low = high = None
    if normalized:
        st = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("i").collect()
        low, high = np.array([r["lo"] for r in st]), np.array([r["hi"] for r in st])
    fit = (lambda x: _scale(x, low, high)) if normalized else (lambda x: x)
    if isinstance(centers, str):
        if centers not in ("standard", "k-means++"):
            raise ValueError("centers: standard, k-means++ or a list")
        sample = reservoir_sample(rows, k if centers == "standard" else max(k, sample_size), seed).toPandas()  # a bounded sample
        if len(sample) < k:
            raise ValueError("fewer rows than clusters")
        x = fit(_stack(sample))
        c = x[:k] if centers == "standard" else plus_plus(x, k, p, np.random.default_rng(seed))
    else:
        c = fit(np.array(centers, float))
        if len(c) != k:
            raise ValueError(f"{k} centres are needed")
    size = c.shape[1]
    done, it = False, 0
    for it in range(1, max_iter + 1):
        now = c

        def sums(batches):
            out = np.zeros((k, size + 1))
            for batch in batches:
                x = fit(stacked(batch, "v"))
                u = _memberships(x, now, p, m)  # noqa: B023
                out[:, :size] += u.T @ x
                out[:, size] += u.sum(axis=0)
            return out.ravel()

        got = add_up(rows, sums, arrow=True)
        if got is None:
            raise ValueError("no complete rows")
        got = got.reshape(k, size + 1)
        full = got[:, size:] > 0
        c = np.where(full, got[:, :size] / np.where(full, got[:, size:], 1), now)
        move = np.abs(c - now)
        if convergence == "relative":
            move = move / np.maximum(np.abs(now), 1e-12)
        if move.max() <= epsilon:
            done = True
            break
    if normalized:
        c = c * (high - low) + low
    return KMeansModel(c.tolist(), it, done, p, m, low.tolist() if normalized else None, high.tolist() if normalized else None)


@dataclass
class MixedKMeansModel:
    """Clusters over numbers and categories: centres, and per cluster and factor the levels' frequencies."""

    centers: list[list[float]]
    frequencies: list[list[list[float]]]  # cluster, factor, level
    factors: list[str]
    levels: list[list[str]]
    p: float
    iteration: int
    converged: bool

    def predict(self, df: DataFrame, cols: Sequence[str], output: str = "cluster") -> DataFrame:
        """Adds the nearest cluster; null where a number is; an unknown level counts as never seen."""
        c, f, p = np.array(self.centers), [np.array(x) for x in zip(*self.frequencies, strict=True)], self.p

        @F.pandas_udf("int")
        def nearest(v: pd.Series, q: pd.Series) -> pd.Series:
            known = v.map(lambda x: x is not None and not np.isnan(np.asarray(x, float)).any()).to_numpy()
            out = pd.Series([None] * len(v), dtype="Int32")
            if known.any():
                out[known] = _mixed(np.stack(v[known].to_numpy()).astype(float), np.stack(q[known].to_numpy()), c, f, p).argmin(axis=1)
            return out

        return df.withColumn(output, nearest(F.array(*[F.col(x).cast("double") for x in cols]), _codes(self.factors, self.levels)))


def _codes(factors: Sequence[str], levels: Sequence[Sequence[str]]):
    code = lambda c, lv: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in lv]), F.col(c).cast("string")).cast("int") - 1, F.lit(-1))
    return F.array(*[code(c, lv) for c, lv in zip(factors, levels, strict=True)])


def _mixed(x: np.ndarray, q: np.ndarray, c: np.ndarray, f: list[np.ndarray], p: float) -> np.ndarray:
    d = _distances(x, c, p)
    for k, freq in enumerate(f):  # clusters x levels
        share = np.where(q[:, k, None] >= 0, freq[:, np.maximum(q[:, k], 0)].T, 0.0)
        d = d + (1 - share) ** p
    return d


def k_means_mixed(
    df: DataFrame, cols: Sequence[str], factors: Sequence[str], k: int, p: float = 2.0, max_iter: int = 100, epsilon: float = 1e-6, centers: str | Sequence[Sequence[float]] = "k-means++", sample_size: int = 1000, seed: int = 42,
) -> MixedKMeansModel:
    """Hard k-means with categories: a level adds (1 - its frequency in the cluster)^p to the distance.
    The first pass goes by numbers alone, which gives the first frequencies; stops by relative moves
    of centres and moves of frequencies."""
    if not factors or not cols or k < 1 or p <= 0:
        raise ValueError("numbers, factors, k >= 1 and p > 0 are needed")
    levels = []
    for c in factors:
        values = [r[0] for r in df.select(F.col(c).cast("string").alias("c")).where("c is not null").distinct().orderBy("c").limit(10_001).collect()]
        if len(values) > 10_000:
            raise ValueError(f"{c}: over 10 000 levels")
        levels.append(values)
    rows = df.dropna(subset=[*cols, *factors]).select(F.array(*[F.col(c).cast("double") for c in cols]).alias("v"), _codes(factors, levels).alias("q"))
    if isinstance(centers, str):
        sample = _stack(reservoir_sample(rows.select("v"), k if centers == "standard" else max(k, sample_size), seed).toPandas())
        c = sample[:k] if centers == "standard" else plus_plus(sample, k, p, np.random.default_rng(seed))
    else:
        c = np.array(centers, float)
    size, widths = len(cols), [len(x) for x in levels]
    f = [np.zeros((k, w)) for w in widths]
    done, it = False, 0
    for it in range(1, max_iter + 1):
        now, freq = c, f

        def sums(batches):
            out = np.zeros((k, 1 + size + sum(widths)))
            for pdf in batches:
                x, q = _stack(pdf), np.stack(pdf["q"].to_numpy())
                at = _mixed(x, q, now, freq, p).argmin(axis=1)  # noqa: B023
                np.add.at(out[:, 0], at, 1)
                for j in range(size):
                    np.add.at(out[:, 1 + j], at, x[:, j])
                start = 1 + size
                for j, w in enumerate(widths):
                    np.add.at(out, (at, start + q[:, j]), 1)
                    start += w
            return out.ravel()

        got = add_up(rows, sums)
        if got is None:
            raise ValueError("no complete rows")
        got = got.reshape(k, -1)
        n = got[:, :1]
        c = np.where(n > 0, got[:, 1 : 1 + size] / np.maximum(n, 1), now)
        cuts = np.cumsum([1 + size, *widths])
        f = [np.where(n > 0, got[:, a:b] / np.maximum(n, 1), old) for a, b, old in zip(cuts[:-1], cuts[1:], freq, strict=True)]
        moved = max((np.abs(c - now) / np.maximum(np.abs(now), 1e-12)).max(), *(np.abs(a - b).max() for a, b in zip(f, freq, strict=True)))
        if it > 1 and moved <= epsilon:
            done = True
            break
    return MixedKMeansModel(c.tolist(), [[x[i].tolist() for x in f] for i in range(k)], list(factors), levels, p, it, done)


@dataclass
class GMeansNode:
    center: list[float]
    depth: int
    count: int = 0
    category: str = "leaf"  # leaf, parent
    p_value: float | None = None
    children: list[GMeansNode] = field(default_factory=list)

    def leaves(self) -> list[GMeansNode]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]

    def to_json(self) -> str:
        return json.dumps(asdict(self))


def g_means(df: DataFrame, cols: str | Sequence[str], alpha: float = 1e-4, epsilon: float = 1e-4, max_iter: int = 30, max_depth: int = 16, least: int = 20) -> GMeansNode:
    """Hierarchical clustering that splits a node in two while its rows, projected on the line between
    the halves' centres, fail the Jarque-Bera test of normality at ``alpha``. A level's nodes are
    fitted together: three kinds of scans (moments, two means, test) per level, whatever its nodes."""
    rows = materialize(_vectors(df, cols), "vectors")
    first = rows.limit(1).collect()
    if not first:
        raise ValueError("no complete rows")
    d = len(first[0]["v"])
    # A path of splits assigns a row to its node: [(centre 0, centre 1)] by node.
    splits: dict[int, tuple[np.ndarray, np.ndarray, int, int]] = {}

    def place(x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        todo = set(splits) & {0}
        while todo:
            nxt = set()
            for node in todo:
                here = np.flatnonzero(at == node)
                a, b, left, right = splits[node]
                y = x[here]
                at[here] = np.where(((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1), left, right)
                nxt |= {left, right} & set(splits)
            todo = nxt
        return at

    def moments(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            x = stacked(batch, "v")
            at = place(x)
            for node in np.unique(at):
                y = x[at == node]
                v = np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()])
                out[int(node)] = out.get(int(node), 0) + v
        return out or None

    total = add_up(rows, moments, key="node", arrow=True)
    root = GMeansNode((total[0][1 : d + 1] / total[0][0]).tolist(), 0, int(total[0][0]))
    nodes, active, fresh = {0: root}, [0], 1
    for _ in range(max_depth):
        total = add_up(rows, moments, key="node", arrow=True)
        pairs: dict[int, np.ndarray] = {}
        for node in active:
            got = total.get(node)
            if got is None or got[0] < least:
                continue
            n, mean = got[0], got[1 : d + 1] / got[0]
            cov = got[d + 1 :].reshape(d, d) / n - np.outer(mean, mean)
            w, e = np.linalg.eigh(cov)
            step = e[:, -1] * math.sqrt(max(w[-1], 0) * 2 / math.pi)
            if np.abs(step).max() > 0:
                pairs[node] = np.stack([mean + step, mean - step])
        moving = set(pairs)
        for _ in range(max_iter):
            if not moving:
                break

            def halves(batches):
                out: dict[int, np.ndarray] = {}
                for batch in batches:
                    x = stacked(batch, "v")
                    at = place(x)
                    for node in moving:  # noqa: B023
                        y = x[at == node]
                        if len(y):
                            a, b = pairs[node]  # noqa: B023
                            left = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
                            v = np.concatenate([[left.sum()], y[left].sum(0), [(~left).sum()], y[~left].sum(0)])
                            out[node] = out.get(node, 0) + v
                return out or None

            got = add_up(rows, halves, key="node", arrow=True)
            still = set()
            for node in moving:
                v, old = got[node].reshape(2, d + 1), pairs[node]
                new = np.where(v[:, :1] > 0, v[:, 1:] / np.maximum(v[:, :1], 1), old)
                pairs[node] = new
                if (np.abs(new - old) / np.maximum(np.abs(old), 1e-12)).max() > epsilon:
                    still.add(node)
            moving = still

        def test(batches):
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                x = stacked(batch, "v")
                at = place(x)
                for node, (a, b) in pairs.items():  # noqa: B023
                    y = x[at == node]
                    if len(y):
                        length = np.linalg.norm(a - b)
                        z = (y - nodes_mean[node]) @ (a - b) / length  # noqa: B023
                        left = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
                        v = np.concatenate([[len(z), left.sum()], [(z**q).sum() for q in (1, 2, 3, 4)]])
                        out[node] = out.get(node, 0) + v
            return out or None

        nodes_mean = {k: np.array(nodes[k].center) for k in pairs}
        pairs = {k: v for k, v in pairs.items() if np.linalg.norm(v[0] - v[1]) > 0}
        got = add_up(rows, test, key="node", arrow=True) if pairs else {}
        active = []
        for node, (n, left, s1, s2, s3, s4) in (got or {}).items():
            mean = s1 / n
            v2 = s2 / n - mean**2
            m3 = s3 / n - 3 * mean * s2 / n + 2 * mean**3
            m4 = s4 / n - 4 * mean * s3 / n + 6 * mean**2 * s2 / n - 3 * mean**4
            jb = n / 6 * ((m3 / v2**1.5) ** 2 + (m4 / v2**2 - 3) ** 2 / 4) if v2 > 0 else 0.0
            nodes[node].p_value = math.exp(-jb / 2)
            if nodes[node].p_value < alpha and 0 < left < n:
                a, b = pairs[node]
                kids = [GMeansNode(a.tolist(), nodes[node].depth + 1, int(left)), GMeansNode(b.tolist(), nodes[node].depth + 1, int(n - left))]
                nodes[node].category, nodes[node].children = "parent", kids
                splits[node] = (a, b, fresh, fresh + 1)
                nodes[fresh], nodes[fresh + 1] = kids
                active += [fresh, fresh + 1]
                fresh += 2
        if not active:
            break
    return root
