"""Seeded synthetic tables whose true parameters are known, for checking fitted models.

Row i of a fixture depends on the seed and i alone, however the rows are dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BLOCK = 1000
_CENTRES = (((2.5, 2.5), (2.0, 1.5)), ((19.1, 25.1), (1.0, 1.5)), ((-10.0, 15.0), (0.5, 0.8)))
_X = "x1 double, x2 double, x3 double, "
SCHEMAS = {
    "binomial": _X + "y1 int, y2 int", "exponential": _X + "y double, lambda double", "factor": "f1 string, f2 string, y double", "interaction": "f1 string, f2 string, y double",
    "gamma": _X + "y double", "normal": _X + "y double", "poisson": _X + "y int", "clusters": "x double, y double", "columns": ", ".join(f"c{i} double" for i in range(6)),
    "classes": "class string, x double, y double", "ties": "a double, b double, c double, d double", "sequence": "i int",
}


def coefficients(name: str, seed: int = 0) -> np.ndarray:
    """The true parameters: intercept and slopes; for factors intercept, first and second factor's levels;
    for interactions the cells, row by row."""
    rng = np.random.default_rng((seed, 10**6))
    size = {"factor": 7, "interaction": 9}.get(name, 4)
    return rng.random(size) + (1 if name in ("gamma", "factor", "interaction") else 0)


def _block(name: str, rng: np.random.Generator, n: int, first: int, b: np.ndarray) -> dict[str, np.ndarray]:
    def linear(shift: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        x = rng.random((n, 3)) + shift
        return x, b[0] + x @ b[1:]

    def named(x: np.ndarray, **rest: np.ndarray) -> dict[str, np.ndarray]:
        return {"x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 2], **rest}

    def gaussian(k: np.ndarray) -> np.ndarray:
        return rng.normal(np.array([c[0] for c in _CENTRES])[k], np.array([c[1] for c in _CENTRES])[k])

    if name == "binomial":
        x, eta = linear()
        trials = rng.integers(1, 101, n)
        y = rng.binomial(trials, 1 / (1 + np.exp(-eta)))
        return named(x, y1=y, y2=trials - y)
    if name == "exponential":
        x, mean = linear()
        return named(x, y=rng.exponential(mean), **{"lambda": 1 / mean})
    if name in ("factor", "interaction"):
        f1, f2 = rng.integers(0, 3, n), rng.integers(0, 3, n)
        mean = 1 / (b[0] + b[1 + f1] + b[4 + f2] if name == "factor" else b[3 * f1 + f2])
        return {"f1": np.array(list("abc"))[f1], "f2": np.array(list("abc"))[f2], "y": rng.gamma(5, mean / 5)}
    if name == "gamma":
        x, eta = linear(1.0)
        return named(x, y=rng.gamma(5, 1 / eta / 5))
    if name == "normal":
        x, eta = linear()
        return named(x, y=rng.normal(eta, 1))
    if name == "poisson":
        x, eta = linear()
        return named(x, y=rng.poisson(np.exp(eta)))
    if name in ("clusters", "classes"):
        k = (np.arange(first, first + n)) % 3
        v = gaussian(k)
        return ({"class": np.array(list("abc"))[k]} if name == "classes" else {}) | {"x": v[:, 0], "y": v[:, 1]}
    if name == "columns":
        v = np.concatenate([gaussian(np.full(n, k)) for k in range(3)], axis=1)
        return {f"c{i}": v[:, i] for i in range(6)}
    if name == "ties":
        return dict(zip("abcd", np.floor(rng.random((4, n)) * 10_000) / 10_000, strict=True))
    return {"i": np.arange(first + 1, first + n + 1)}


def fixture(spark: SparkSession, name: str, rows: int, seed: int = 0) -> DataFrame:
    """``rows`` rows of a fixture of SCHEMAS."""
    if name not in SCHEMAS:
        raise ValueError(f"fixture: one of {', '.join(SCHEMAS)}")
    b = coefficients(name, seed)
    make: Callable = _block

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for block, own in pdf.groupby(pdf["id"] // BLOCK):
                whole = pd.DataFrame(make(name, np.random.default_rng((seed, int(block))), BLOCK, int(block) * BLOCK, b))
                yield whole.iloc[(own["id"] % BLOCK).to_numpy()]

    return spark.range(rows).mapInPandas(fill, SCHEMAS[name])
