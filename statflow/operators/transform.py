"""Row transforms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.functions.arrays import as_vector


def expand(df: DataFrame, cols: Sequence[str], index: str | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """One row per position of equally long arrays, in lock-step, the other columns repeated;
    ``index`` names a column for the position, from 0. Arrays of unequal length fail."""
    if not cols:
        raise ValueError("at least one array is needed")
    names = list(names or cols)
    if len(names) != len(cols):
        raise ValueError("one name per array")
    rest = [c for c in df.columns if c not in cols]
    if set(rest) & {*names, *([index] if index else [])}:
        raise ValueError("output names clash with other columns")
    zipped = F.arrays_zip(*[F.col(c) for c in cols])
    if len(cols) > 1:
        even = F.lit(True)
        for c in cols[1:]:
            even &= F.size(c) == F.size(cols[0])
        zipped = F.when(even, zipped).otherwise(F.raise_error(F.lit("expand: arrays of unequal length")))
    rows = df.select(*rest, F.posexplode(zipped).alias("__at", "__x"))
    first = [F.col("__at").alias(index)] if index else []
    return rows.select(*rest, *first, *[F.col("__x").getField(c).alias(n) for c, n in zip(cols, names, strict=True)])


def nearest_neighbor(df: DataFrame, vector: str, charts: DataFrame, key: str, chart: str, normalization: bool = False, output: str = "nearest") -> DataFrame:
    """Adds the key of the nearest chart: least squared Euclidean distance or, with
    ``normalization``, largest cosine. Ties go to the least key. The charts are a model of one
    row per class; they are collected and shipped with the tasks (at most 1 000 000 numbers)."""
    rows = charts.select(F.col(key).alias("k"), as_vector(chart).alias("v")).where("k is not null and v is not null").orderBy("k").limit(1_000_001).collect()
    if not rows:
        raise ValueError("no charts")
    if sum(len(r["v"]) for r in rows) > 1_000_000:
        raise ValueError("charts hold over 1 000 000 numbers; use cross_stats")
    keys = [r["k"] for r in rows]
    m = np.array([r["v"] for r in rows])
    if normalization:
        size = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.where(size > 0, m / np.where(size > 0, size, 1), m)
    half = (m * m).sum(axis=1) / 2

    @F.pandas_udf("int")
    def pick(v: pd.Series) -> pd.Series:
        known = v.notna().to_numpy()
        out = np.full(len(v), -1, np.int32)
        if known.any():
            score = np.stack(v[known].to_numpy()) @ m.T
            out[known] = np.argmax(score if normalization else score - half, axis=1)
        return pd.Series(out)

    names = F.array(*[F.lit(k) for k in keys])
    chosen = F.get(names, pick(as_vector(vector)))
    return df.withColumn(output, chosen)
