"""Additive sums: one vector per task, summed by Spark, read as one array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of lists of one size as a matrix, without an object per row."""
    column = batch.column(name)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors of several sizes")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def add_up(df: DataFrame, part: Callable[[Iterator], np.ndarray | None], key: str | None = None, arrow: bool = False):
    """``part`` turns a task's batches into one vector of sums (None: no rows), or, with
    ``key``, a dict from key to vector. The vectors are added entry by entry in a
    shuffle; the driver reads one row per entry, whatever the number of tasks. Batches
    are pandas frames, with ``arrow`` Arrow's record batches."""
    keyed = key is not None

    def run(batches: Iterator) -> Iterator:
        got = part(b for b in batches if (b.num_rows if arrow else len(b)))
        if got is None:
            return
        items = got.items() if keyed else [(0, got)]
        for k, v in items:
            out = {"k": np.full(len(v), k, np.int64), "i": np.arange(len(v), dtype=np.int32), "x": np.asarray(v, np.float64)}
            yield pa.RecordBatch.from_pydict(out) if arrow else pd.DataFrame(out)

    rows = (df.mapInArrow if arrow else df.mapInPandas)(run, "k long, i int, x double").groupBy("k", "i").agg(F.sum("x").alias("x")).collect()
    out: dict[int, np.ndarray] = {}
    sizes: dict[int, int] = {}
    for r in rows:
        sizes[r["k"]] = max(sizes.get(r["k"], 0), r["i"] + 1)
    for k, n in sizes.items():
        out[k] = np.zeros(n)
    for r in rows:
        out[r["k"]][r["i"]] = r["x"]
    return out if keyed else out.get(0)
