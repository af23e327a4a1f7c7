"""A generating source: binomial responses of a logistic model, one seeded stream per partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "input1 double, input2 double, input3 double, y1 int, y2 int"


class _Stream(InputPartition):
    def __init__(self, stream: int):
        super().__init__(stream)
        self.stream = stream


class _Reader(DataSourceReader):
    def __init__(self, streams: int, rows: int, seed: int):
        self.streams, self.rows, self.seed = streams, rows, seed

    def partitions(self) -> list[InputPartition]:
        return [_Stream(i) for i in range(self.streams)]

    def read(self, partition: _Stream) -> Iterator:
        import pyarrow as pa

        rng = np.random.default_rng((self.seed, partition.stream))
        coefficients, intercept, trials = rng.random(3), rng.random(), int(rng.integers(0, 100))
        left = self.rows
        while left:
            n = min(left, 65_536)
            x = rng.random((n, 3))
            y = rng.binomial(trials, 1 / (1 + np.exp(-(intercept + x @ coefficients))))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c) for c in np.ascontiguousarray(x.T)], pa.array(y.astype(np.int32)), pa.array((trials - y).astype(np.int32))], names=["input1", "input2", "input3", "y1", "y2"]
            )
            left -= n


class BinomialSource(DataSource):
    """spark.read.format("binomial").option("streams", 4).option("rows", 1000000).load(): x uniform on
    [0, 1), y1 of a stream's fixed number of trials are successes, y2 the rest. Seeded by stream."""

    @classmethod
    def name(cls) -> str:
        return "binomial"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        opt = self.options
        streams, rows, seed = int(opt.get("streams", 1)), int(opt.get("rows", 1_000_000)), int(opt.get("seed", 0))
        if streams < 1 or rows < 0:
            raise ValueError("streams must be positive and rows not negative")
        return _Reader(streams, rows, seed)


def binomial_source(spark: SparkSession, streams: int = 1, rows: int = 1_000_000, seed: int = 0) -> DataFrame:
    spark.dataSource.register(BinomialSource)
    return spark.read.format("binomial").option("streams", streams).option("rows", rows).option("seed", seed).load()
