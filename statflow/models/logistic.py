"""Many logistic models at once: one per effect, over shared drug indicators and
intercepts by group of strata, fitted by gradient ascent with the
complementary-logit spline as the mean."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.plans.durable import materialize
from statflow.plans.partials import add_up

ALPHA = 0.25


def spline(z: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    with np.errstate(over="ignore"):
        low = 2 * alpha / (1 + np.exp(2 * (alpha - 1) * z))
        high = 2 * alpha - 1 + 2 * (1 - alpha) / (1 + np.exp(-2 * alpha * z))
    return np.where(z < 0, low, high)


@dataclass
class LogisticModels:
    effects: list[str]
    drugs: list[str]
    groups: dict[str, list[list[str]]]
    coefficients: np.ndarray  # effect x drug
    intercepts: list[list[float]]
    iteration: int
    converged: bool

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(e, d, float(self.coefficients[i, j])) for i, e in enumerate(self.effects) for j, d in enumerate(self.drugs)]
        return df.sparkSession.createDataFrame(rows, "effect string, drug string, coefficient double")


MOST_STRATA = 100_000


def logistic_multi(cases: DataFrame, drugs: str = "drugs", effects: str = "effects", stratum: str = "stratum", step: float = 1.0, tolerance: float = 0.05, max_iter: int = 100, limit: int = 2_000_000) -> LogisticModels:
    """``cases``: arrays of drugs and of effects and a stratum. Strata of an effect are joined, in
    order, until a group holds max(10, sqrt(reports) / 2) cases. A coefficient moves by ``step`` times
    its mean gradient; stops when no step exceeds ``tolerance`` of its coefficient. At most ``limit`` coefficients and
    MOST_STRATA strata; beyond it fails."""
    flat = cases.select(F.array_distinct(drugs).alias("drugs"), F.array_distinct(effects).alias("effects"), F.col(stratum).cast("string").alias("stratum")).dropna()
    rows = materialize(flat, "cases")
    names = lambda c: [r[0] for r in rows.select(F.explode(c).alias("x")).where("x is not null").distinct().orderBy("x").limit(limit + 1).collect()]
    d, e = names("drugs"), names("effects")
    if not d or not e:
        raise ValueError("no drugs or no effects")
    if len(d) * len(e) > limit:
        raise ValueError(f"over {limit} coefficients")
    strata = {r["stratum"]: r["count"] for r in rows.groupBy("stratum").count().orderBy("stratum").limit(MOST_STRATA + 1).collect()}
    if len(strata) > MOST_STRATA:
        raise ValueError(f"over {MOST_STRATA} strata")
    plus = {r["x"]: r["count"] for r in rows.select(F.explode("effects").alias("x")).groupBy("x").count().collect()}
    order = sorted(strata)
    groups, of = {}, np.zeros((len(e), len(order)), np.int64)
    for i, name in enumerate(e):
        need, got, held = max(10.0, math.sqrt(plus[name]) / 2), [[]], 0
        for k, s in enumerate(order):
            got[-1].append(s)
            of[i, k] = len(got) - 1
            held += strata[s]
            if held >= need and k + 1 < len(order):
                got.append([])
                held = 0
        groups[name] = got
    width = max(len(g) for g in groups.values())
    where_d, where_e, where_s = ({x: i for i, x in enumerate(v)} for v in (d, e, order))
    beta, base = np.zeros((len(e), len(d))), np.zeros((len(e), width))

    def gradient(batches):
        # Per effect: gradient by drug, gradient by group; then cases by drug and, per effect, by group.
        gd, gg, nd, ng = np.zeros((len(e), len(d))), np.zeros((len(e), width)), np.zeros(len(d)), np.zeros((len(e), width))
        for pdf in batches:
            for ds, es, s in zip(pdf["drugs"], pdf["effects"], pdf["stratum"], strict=True):
                at = np.array([where_d[x] for x in ds if x is not None], np.int64)
                g = of[:, where_s[s]]
                z = base[np.arange(len(e)), g] + beta[:, at].sum(axis=1)
                diff = -spline(z)
                diff[[where_e[x] for x in es if x is not None]] += 1
                gd[:, at] += diff[:, None]
                gg[np.arange(len(e)), g] += diff
                nd[at] += 1
                ng[np.arange(len(e)), g] += 1
        return np.concatenate([gd.ravel(), gg.ravel(), nd, ng.ravel()])

    done, it = False, 0
    for it in range(1, max_iter + 1):
        got = add_up(rows, gradient)
        a, b = len(e) * len(d), len(e) * width
        gd, gg, nd, ng = got[:a].reshape(len(e), -1), got[a : a + b].reshape(len(e), -1), got[a + b : a + b + len(d)], got[a + b + len(d) :].reshape(len(e), -1)
        md, mg = step * gd / np.maximum(nd, 1), step * gg / np.maximum(ng, 1)
        beta, base = beta + md, base + mg
        if max((np.abs(md) / np.maximum(np.abs(beta), 1e-2)).max(), (np.abs(mg) / np.maximum(np.abs(base), 1e-2)).max()) <= tolerance:
            done = True
            break
    return LogisticModels(e, d, groups, beta, [base[i, : len(groups[x])].tolist() for i, x in enumerate(e)], it, done)
