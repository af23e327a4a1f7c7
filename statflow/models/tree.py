"""Linear regression trees by expectation-maximisation.

A node's rows (regressors and response) are modelled as two Gaussians; the split
that best tells the two apart - a hyperplane over the continuous variables or a
set of levels of a discrete one - sends rows left or right, and each leaf holds
a linear regression. All nodes of a level are fitted in the same scans, each
adding up weighted moments per node.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.plans.durable import materialize
from statflow.plans.partials import add_up, stacked


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def gini_gain(p1: float, left: float, both: float) -> float:
    """Gain of a binary split: share of class 1, of the left side, of class 1 on the left."""
    return 2 * (both - p1 * left) ** 2 / (left * (1 - left)) if 0 < left < 1 else 0.0


def discrete_split(counts: np.ndarray) -> tuple[float, list[int]]:
    """``counts``: level x class weights. (gain, levels that go left), by prefix of the levels in order of
    their share of class 1 (Breiman et al. 1984)."""
    mass = counts.sum(axis=1)
    total = mass.sum()
    if total <= 0:
        return 0.0, []
    order = [i for i in np.argsort(-np.divide(counts[:, 0], mass, out=np.zeros(len(mass)), where=mass > 0), kind="stable") if mass[i] > 0]
    p1, best, left, both = counts[:, 0].sum() / total, (0.0, []), 0.0, 0.0
    for k, i in enumerate(order[:-1]):
        left += mass[i] / total
        both += counts[i, 0] / total
        gain = gini_gain(p1, left, both)
        if gain > best[0] + 1e-12:
            best = (gain, [int(x) for x in order[: k + 1]])
    return best


def split_point(a: tuple[float, float, float], b: tuple[float, float, float]) -> float:
    """Where two weighted normals (weight, mean, sd) are equally likely, between their means; else
    the midpoint weighted by the deviations."""
    (wa, ma, sa), (wb, mb, sb) = a, b
    mid = (wa * sb * ma + wb * sa * mb) / max(wa * sb + wb * sa, 1e-300) if wa * sb + wb * sa > 0 else (ma + mb) / 2
    if sa <= 0 or sb <= 0 or wa <= 0 or wb <= 0:
        return (ma + mb) / 2
    qa = 1 / sb**2 - 1 / sa**2
    qb = 2 * (ma / sa**2 - mb / sb**2)
    qc = mb**2 / sb**2 - ma**2 / sa**2 + 2 * math.log(wa * sb / (wb * sa))
    if abs(qa) < 1e-12:
        roots = [-qc / qb] if qb else []
    else:
        disc = qb**2 - 4 * qa * qc
        roots = [(-qb + s * math.sqrt(disc)) / (2 * qa) for s in (1, -1)] if disc >= 0 else []
    inside = [r for r in roots if min(ma, mb) <= r <= max(ma, mb)]
    return inside[0] if inside else mid


def hyperplane(kind: str, wa: float, ma: np.ndarray, sa: np.ndarray, wb: float, mb: np.ndarray, sb: np.ndarray) -> tuple[float, np.ndarray, float]:
    """(gain, normal, offset): rows with normal . x <= offset go left. ``anova``: the best single
    axis; ``lda``: the pooled discriminant; ``qda``: the direction between the means under the sum of both spreads."""
    if kind == "anova":
        f = (ma - mb) ** 2 / np.maximum(np.diag(sa) + np.diag(sb), 1e-300)
        n = np.zeros(len(ma))
        n[int(np.argmax(f))] = 1.0
    else:
        pooled = wa * sa + wb * sb if kind == "lda" else sa + sb
        n = np.linalg.lstsq(pooled + 1e-12 * np.eye(len(ma)), ma - mb, rcond=None)[0]
        size = np.linalg.norm(n)
        n = n / size if size > 0 else n
    pa, pb = float(n @ ma), float(n @ mb)
    da, db = math.sqrt(max(float(n @ sa @ n), 0)), math.sqrt(max(float(n @ sb @ n), 0))
    if pa == pb:
        return 0.0, n, pa
    t = split_point((wa, pa, da), (wb, pb, db))
    la = normal_cdf((t - pa) / da) if da > 0 else float(pa <= t)
    lb = normal_cdf((t - pb) / db) if db > 0 else float(pb <= t)
    return gini_gain(wa, wa * la + wb * lb, wa * la), n, t


@dataclass
class TreeNode:
    depth: int
    count: float = 0.0
    intercept: float = 0.0
    slopes: list[float] = field(default_factory=list)
    variance: float = 0.0
    normal: list[float] | None = None
    offset: float = 0.0
    attribute: int | None = None
    lefts: list[int] | None = None
    left: TreeNode | None = None
    right: TreeNode | None = None

    def leaves(self) -> list[TreeNode]:
        return [*self.left.leaves(), *self.right.leaves()] if self.left else [self]

    def as_dict(self) -> dict:
        split = {"attribute": self.attribute, "left_levels": self.lefts} if self.attribute is not None else {"normal": self.normal, "offset": self.offset}
        out = {"count": self.count, "regressor": {"intercept": self.intercept, "slopes": self.slopes}, "variance": self.variance}
        return out | ({"splitter": split, "left": self.left.as_dict(), "right": self.right.as_dict()} if self.left else {})


def _goes_left(node: TreeNode, cont: np.ndarray, disc: np.ndarray) -> np.ndarray:
    if node.attribute is not None:
        return np.isin(disc[:, node.attribute], node.lefts)
    return cont @ np.array(node.normal) <= node.offset


@dataclass
class RegressionTree:
    root: TreeNode
    discrete: list[str]
    levels: list[list[str]]
    splits: list[str]
    regressors: list[str]

    def to_json(self) -> str:
        return json.dumps({"discrete": self.discrete, "levels": self.levels, "splits": self.splits, "regressors": self.regressors, "root": self.root.as_dict()})

    def predict(self, df: DataFrame, output: str = "prediction", depth: int | None = None) -> DataFrame:
        """Adds the leaf regression's value, or that of the node at ``depth``; null where an input is
        null. An unseen level goes right."""
        root, k = self.root, len(self.splits) + len(self.regressors)

        @F.pandas_udf("double")
        def infer(cont: pd.Series, disc: pd.Series) -> pd.Series:
            ok = np.array([c is not None for c in cont], bool)
            if ok.any():
                ok[ok] = ~np.isnan(np.stack(cont[ok].to_numpy()).astype(float)).any(axis=1)
            out = np.full(len(cont), np.nan)
            if ok.any():
                x = np.stack(cont[ok].to_numpy()).astype(float).reshape(-1, k)
                d = np.stack(disc[ok].to_numpy()) if len(self.discrete) else np.zeros((len(x), 0), int)
                y = np.zeros(len(x))

                def walk(node: TreeNode, at: np.ndarray) -> None:
                    if node.left is None or node.depth == depth:
                        y[at] = node.intercept + x[at][:, len(self.splits) :] @ np.array(node.slopes)
                        return
                    left = _goes_left(node, x[at], d[at])
                    walk(node.left, at[left])
                    walk(node.right, at[~left])

                walk(root, np.arange(len(x)))
                out[ok] = y
            return pd.Series(out).where(ok, None)

        c, d = _inputs(self.discrete, self.levels, [*self.splits, *self.regressors])
        return df.withColumn(output, infer(c, d))


def _inputs(discrete: Sequence[str], levels: Sequence[Sequence[str]], cont: Sequence[str]):
    codes = [F.array_position(F.array(*[F.lit(x) for x in lv]), F.col(c).cast("string")).cast("int") - 1 for c, lv in zip(discrete, levels, strict=True)]
    return F.array(*[F.col(c).cast("double") for c in cont]), F.array(*codes).cast("array<int>") if codes else F.array().cast("array<int>")


def decision_tree(
    df: DataFrame, response: str, regressors: Sequence[str], split_on: Sequence[str] = (), discrete: Sequence[str] = (), split: str = "anova", threshold: float = 0.01, limit: float = 1e-6,
    restarts: int = 3, disc_iters: int = 2, learn_iters: int = 30, max_depth: int = 4, least: int = 10, seed: int = 42,
) -> RegressionTree:
    """Grows level by level and prunes splits whose leaves lower the residual variance by less than ``threshold``."""
    if split not in ("anova", "lda", "qda"):
        raise ValueError("split: anova, lda or qda")
    if not regressors:
        raise ValueError("at least one regressor is needed")
    cont = [*split_on, *regressors]
    levels = []
    for c in discrete:
        values = [r[0] for r in df.select(F.col(c).cast("string").alias("c")).where("c is not null").distinct().orderBy("c").limit(1001).collect()]
        if len(values) > 1000:
            raise ValueError(f"{c}: over 1000 levels")
        levels.append(values)
    c, d = _inputs(discrete, levels, cont)
    rows = materialize(df.dropna(subset=[response, *cont, *discrete]).select(c.alias("c"), d.alias("d"), F.col(response).cast("double").alias("y")), "rows")
    s, r, nd = len(cont), len(regressors), len(discrete)
    dim = r + 1
    widths = [len(x) for x in levels]
    rng = np.random.default_rng(seed)
    root = TreeNode(0)
    nodes: dict[int, TreeNode] = {0: root}
    kids: dict[int, tuple[int, int]] = {}

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = stacked(batch, "c")
        q = stacked(batch, "d") if nd else np.zeros((len(x), 0), int)
        v = np.column_stack([x[:, s - r :], batch.column("y").to_numpy()])
        at = np.zeros(len(x), np.int64)
        todo = {0} & set(kids)
        while todo:
            nxt = set()
            for n in todo:
                here = np.flatnonzero(at == n)
                left = _goes_left(nodes[n], x[here], q[here])
                at[here] = np.where(left, kids[n][0], kids[n][1])
                nxt |= set(kids[n]) & set(kids)
            todo = nxt
        return x, q, v, at

    def density(z: np.ndarray, g: tuple[float, np.ndarray, np.ndarray]) -> np.ndarray:
        w, mu, cov = g
        chol = np.linalg.cholesky(cov)
        e = np.linalg.inv(chol) @ (z - mu).T
        return w / ((2 * math.pi) ** (len(mu) / 2) * np.diag(chol).prod()) * np.exp(-0.5 * np.einsum("ij,ij->j", e, e))

    def gathered(active: set[int], of) -> dict[int, np.ndarray]:
        def run(batches):
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                x, q, v, at = parts(batch)
                for n in active:
                    here = np.flatnonzero(at == n)
                    if len(here):
                        out[n] = out.get(n, 0) + of(n, x[here], q[here], v[here])
            return out or None

        return add_up(rows, run, key="node", arrow=True)

    def weighted(p: np.ndarray, z: np.ndarray) -> np.ndarray:
        return np.concatenate([[p.sum()], p @ z, ((z * p[:, None]).T @ z).ravel()])

    def gaussian(m: np.ndarray, k: int) -> tuple[float, np.ndarray, np.ndarray]:
        n = m[0]
        mu = m[1 : k + 1] / n
        cov = m[k + 1 :].reshape(k, k) / n - np.outer(mu, mu)
        return n, mu, cov + 1e-9 * (np.trace(cov) / k + 1e-12) * np.eye(k)

    active, fresh = {0}, 1
    for _depth in range(max_depth + 1):
        base = gathered(active, lambda n, x, q, v: weighted(np.ones(len(v)), v))
        frame, trial = {}, {}
        for n, m in base.items():
            count, mu, cov = gaussian(m, dim)
            beta = np.linalg.lstsq(cov[:r, :r], cov[:r, r], rcond=None)[0]
            node = nodes[n]
            node.count, node.slopes, node.intercept = float(count), beta.tolist(), float(mu[r] - mu[:r] @ beta)
            node.variance = float(max(cov[r, r] - cov[:r, r] @ beta, 0))
            if count >= max(least, 2 * (dim + 1)) and node.depth < max_depth and node.variance > 1e-12:
                chol = np.linalg.cholesky(cov)
                frame[n] = (mu, np.linalg.inv(chol))
                trial[n] = [[(0.5, rng.uniform(-1, 1, dim), np.eye(dim)) for _ in range(2)] for _ in range(restarts)]
        if not frame:
            break

        def step(states: dict[int, list]) -> tuple[dict[int, list], dict[int, list[float]], dict[int, list[float]]]:
            def of(n, x, q, v):
                mu, inv = frame[n]  # noqa: B023
                z = (v - mu) @ inv.T
                out = []
                for pair in states[n]:
                    a, b = density(z, pair[0]), density(z, pair[1])
                    t = a + b
                    p = np.where(t > 0, a / np.where(t > 0, t, 1), 0.5)
                    out += [weighted(p, z), weighted(1 - p, z), [np.log(np.maximum(t, 1e-300)).sum()]]
                return np.concatenate(out)

            got, new, like, moved = gathered(set(states), of), {}, {}, {}
            width = 1 + dim + dim * dim
            for n, m in got.items():
                new[n], like[n], moved[n] = [], [], []
                for k, pair in enumerate(states[n]):
                    at = k * (2 * width + 1)
                    both = [m[at : at + width], m[at + width : at + 2 * width]]
                    if min(b[0] for b in both) <= dim + 1:  # too little left for one: try anew
                        new[n].append([(0.5, rng.uniform(-1, 1, dim), np.eye(dim)) for _ in range(2)])
                        like[n].append(-math.inf)
                        moved[n].append(math.inf)
                        continue
                    total = both[0][0] + both[1][0]
                    gs = [gaussian(b, dim) for b in both]
                    new[n].append([(g[0] / total, g[1], g[2]) for g in gs])
                    like[n].append(float(m[at + 2 * width]))
                    moved[n].append(max(float(np.linalg.norm(g[1] - o[1])) for g, o in zip(gs, pair, strict=True)))
            return new, like, moved

        like: dict[int, list[float]] = {}
        for _ in range(max(1, disc_iters)):
            trial, like, _ = step(trial)
        best = {n: [trial[n][int(np.argmax(like[n]))]] for n in trial}
        settled, todo = {}, dict(best)
        for _ in range(learn_iters):
            if not todo:
                break
            todo, _, moved = step(todo)
            for n in list(todo):
                if moved[n][0] <= limit:
                    settled[n] = todo.pop(n)
        settled |= todo

        def separate(n, x, q, v):
            mu, inv = frame[n]  # noqa: B023
            z = (v - mu) @ inv.T
            a, b = density(z, settled[n][0][0]), density(z, settled[n][0][1])  # noqa: B023
            t = a + b
            p = np.where(t > 0, a / np.where(t > 0, t, 1), 0.5)
            out = [weighted(p, x), weighted(1 - p, x)]
            for k, w in enumerate(widths):
                ok = q[:, k] >= 0
                out += [np.bincount(q[ok, k], p[ok], w), np.bincount(q[ok, k], 1 - p[ok], w)]
            return np.concatenate(out)

        got, active = gathered(set(settled), separate), set()
        for n, m in got.items():
            node, width = nodes[n], 1 + s + s * s
            ga, gb = m[:width], m[width : 2 * width]
            if min(ga[0], gb[0]) <= s + 1:
                continue
            na, ma, sa = gaussian(ga, s)
            nb, mb, sb = gaussian(gb, s)
            gain, normal, offset = hyperplane(split, na / (na + nb), ma, sa, nb / (na + nb), mb, sb)
            choice = ("plane", normal, offset)
            at = 2 * width
            for k, w in enumerate(widths):
                counts = np.column_stack([m[at : at + w], m[at + w : at + 2 * w]])
                at += 2 * w
                g, lefts = discrete_split(counts)
                if g > gain:
                    gain, choice = g, ("levels", k, lefts)
            if gain <= 1e-9:
                continue
            if choice[0] == "plane":
                node.normal, node.offset = [float(z) for z in choice[1]], float(choice[2])
            else:
                node.attribute, node.lefts = choice[1], choice[2]
            node.left, node.right = TreeNode(node.depth + 1), TreeNode(node.depth + 1)
            kids[n] = (fresh, fresh + 1)
            nodes[fresh], nodes[fresh + 1] = node.left, node.right
            active |= {fresh, fresh + 1}
            fresh += 2
        if not active:
            break
    _prune(root, threshold)
    return RegressionTree(root, list(discrete), levels, list(split_on), list(regressors))


def _prune(node: TreeNode, threshold: float) -> float:
    """Residual sum of squares of the subtree after pruning."""
    own = node.variance * node.count
    if node.left is None:
        return own
    below = _prune(node.left, threshold) + _prune(node.right, threshold)
    if min(node.left.count, node.right.count) == 0 or below > own * (1 - threshold):
        node.left = node.right = node.normal = node.attribute = node.lefts = None
        return own
    return below
