"""User-defined aggregates and iterations: the public extension points.

An aggregate is a mergeable state. It runs as partial states per task, merged in
two rounds, so that neither a group nor the driver ever receives more than FAN
states at once from a round.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Generic, TypeVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.plans.durable import materialize

FAN = 64
S = TypeVar("S")


class Aggregate(Generic[S]):
    """Subclass with a result schema and four methods. ``merge`` must be associative and commutative."""

    #: DDL of the result's columns.
    schema: str = ""

    def init(self) -> S:
        raise NotImplementedError

    def add(self, state: S, batch: pd.DataFrame) -> S:
        raise NotImplementedError

    def merge(self, a: S, b: S) -> S:
        raise NotImplementedError

    def finish(self, state: S) -> pd.DataFrame:
        """One or many rows."""
        raise NotImplementedError


def aggregate(df: DataFrame, agg: Aggregate, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Runs an aggregate over ``cols``, per group of ``by``. Without ``by`` an empty input gives the
    result of the initial state."""
    if not agg.schema:
        raise ValueError("the aggregate needs a schema")
    by = list(by)
    keys = [f"__k{i}" for i in range(len(by))] or ["__k0"]
    kinds = dict(df.dtypes)
    source = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=False)] if by else [F.lit(0).alias("__k0")], *[F.col(c).alias(c) for c in cols])
    head = ", ".join(f"{k} {kinds[b]}" for k, b in zip(keys, by, strict=False)) if by else "__k0 int"

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, Any] = {}
        for pdf in batches:
            for key, rows in pdf.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                states[key] = agg.add(states[key] if key in states else agg.init(), rows[list(cols)])
        yield pd.DataFrame([(*k, i % FAN, pickle.dumps(s)) for i, (k, s) in enumerate(states.items())], columns=[*keys, "__f", "__s"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        state = pickle.loads(pdf["__s"].iat[0])
        for s in pdf["__s"].iloc[1:]:
            state = agg.merge(state, pickle.loads(s))
        out = pdf[[*keys, "__f"]].head(1).copy()
        out["__s"] = [pickle.dumps(state)]
        return out

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        out = agg.finish(pickle.loads(join(pdf)["__s"].iat[0])).reset_index(drop=True)
        for i, k in enumerate(keys):
            out.insert(i, k, [pdf[k].iat[0]] * len(out))
        return out

    partial = source.mapInPandas(part, f"{head}, __f int, __s binary").withColumn("__f", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    merged = partial.groupBy(*keys, "__f").applyInPandas(join, f"{head}, __f int, __s binary")
    result = merged.groupBy(*keys).applyInPandas(end, f"{head}, {agg.schema}")
    names = [c.split(" ")[0] for c in agg.schema.split(", ")]
    out = result.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=False)], *names)
    if by or df.limit(1).count():
        return out
    return df.sparkSession.createDataFrame(agg.finish(agg.init()), agg.schema)


def iterate(state: Any, step: Callable[[Any, int], tuple[Any, bool]], max_iter: int = 100) -> tuple[Any, int, bool]:
    """Calls ``step(state, i)`` until it says it is done: (state, passes, converged). States that are
    DataFrames are written to the shared folder after each pass."""
    if max_iter < 1:
        raise ValueError("max_iter must be positive")
    for i in range(1, max_iter + 1):
        state, done = step(state, i)
        if isinstance(state, DataFrame):
            state = materialize(state, "state")
        if done:
            return state, i, True
    return state, max_iter, False
