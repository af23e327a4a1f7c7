"""The one-pass aggregates over streams: they only merge sums, so a watermarked window suffices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_summary(stream: DataFrame, time: str, cols: Sequence[str], width: str, slide: str | None = None, lateness: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """Per window and group: start, end, column, mean, std_dev, range, min, max, count. Rows later than
    ``lateness`` are left out, as the watermark bounds the state."""
    if not cols:
        raise ValueError("at least one column is needed")
    rows = stream.dropna(subset=list(cols)).withWatermark(time, lateness)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_samp(x).alias(f"s_{c}"), F.min(x).alias(f"lo_{c}"), F.max(x).alias(f"hi_{c}")]
    wide = rows.groupBy(window.alias("w"), *by).agg(*aggs)
    out = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std_dev"), (F.col(f"hi_{c}") - F.col(f"lo_{c}")).alias("range"),
            F.col(f"lo_{c}").alias("min"), F.col(f"hi_{c}").alias("max"), F.col("__n").alias("count"),
        )
        for c in cols
    ]
    return wide.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, F.inline(F.array(*out)))


def windowed_histogram(stream: DataFrame, time: str, index: str, length: int, width: str, lateness: str = "10 minutes") -> DataFrame:
    """Per window: start, end, index, count for each index within [0, length) that occurs."""
    if length <= 0:
        raise ValueError("length must be positive")
    rows = stream.where(F.col(index).between(0, length - 1)).withWatermark(time, lateness)
    counted = rows.groupBy(F.window(time, width).alias("w"), F.col(index).cast("int").alias("index")).agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "index", "count")
