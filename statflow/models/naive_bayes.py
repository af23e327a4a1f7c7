"""Histogram naive Bayes: two aggregations, then a table of probabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bin(x: Column, low: float, high: float, bins: int) -> Column:
    """-1 below the range, ``bins`` above it; the upper end belongs to the last bin."""
    if high <= low:
        return F.when(x < low, -1).when(x > high, bins).otherwise(0)
    inside = F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins)).cast("int"))
    return F.when(x < low, -1).when(x > high, bins).otherwise(inside)


@dataclass
class NaiveBayesModel:
    response: str
    bins: int
    ranges: dict[str, tuple[float, float]]
    factors: list[str]
    table: DataFrame  # class, attribute, level (bin or factor level as text), count, joint, conditional
    classes: list[tuple[str, int]]
    n: int

    def predict(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        """Adds the class of the largest posterior, ties to the lesser class; counts get 1 added so that
        an unseen level rules nothing out. Attributes that are null are left out."""
        counts = {(r["class"], r["attribute"], r["level"]): r["count"] for r in self.table.collect()}  # classes x attributes x bins
        scores: list[Column] = [F.log(F.lit(size / self.n)) for _, size in self.classes]
        for a in [*self.ranges, *self.factors]:
            seen = sorted({lv for (_, x, lv) in counts if x == a})
            if a in self.ranges:
                levels, width = [str(b) for b in range(-1, self.bins + 1)], self.bins + 2
                at = _bin(F.col(a).cast("double"), *self.ranges[a], self.bins) + 1
            else:
                levels, width = seen, len(seen)
                at = F.coalesce(F.array_position(F.array(*[F.lit(lv) for lv in levels]), F.col(a).cast("string")).cast("int") - 1, F.lit(-1))
            # An array per class, the last entry for levels never seen: read by position, not searched.
            for i, (name, size) in enumerate(self.classes):
                logs = [math.log((float(counts.get((name, a, lv), 0)) + 1) / (size + width)) for lv in levels] + [math.log(1 / (size + width))]
                own = F.get(F.array(*[F.lit(x) for x in logs]), F.when(at < 0, F.lit(len(levels))).otherwise(at))
                scores[i] = scores[i] + F.when(F.col(a).isNull(), F.lit(0.0)).otherwise(own)
        # The greatest struct: each score is computed once, ties go to the first class.
        best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(name).alias("k")) for i, (s, (name, _)) in enumerate(zip(scores, self.classes, strict=True))]))
        return df.withColumn(output, best["k"])


def naive_bayes(df: DataFrame, response: str, numerics: Sequence[str], factors: Sequence[str] = (), bins: int = 10, width_factor: float = 3.0) -> NaiveBayesModel:
    """Ranges are mean -+ sd * ``width_factor`` within the data's; counts per class, attribute and bin,
    with the values below and above the range in bins of their own."""
    if not numerics:
        raise ValueError("at least one numeric attribute is needed")
    if bins < 1:
        raise ValueError("bins must be positive")
    rows = df.dropna(subset=[response, *numerics, *factors])
    aggs = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in numerics for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]
    st = rows.agg(*aggs).first()
    if st[f"m_{numerics[0]}"] is None:
        raise ValueError("no complete rows")
    ranges = {c: (max(st[f"m_{c}"] - st[f"s_{c}"] * width_factor, st[f"lo_{c}"]), min(st[f"m_{c}"] + st[f"s_{c}"] * width_factor, st[f"hi_{c}"])) for c in numerics}
    attrs = [F.struct(F.lit(c).alias("attribute"), _bin(F.col(c).cast("double"), *ranges[c], bins).cast("string").alias("level")) for c in numerics]
    attrs += [F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("level")) for c in factors]
    # One grouping per attribute, over a column or two each: cheaper than a row per attribute of every row.
    counts = None
    for a in attrs:
        part = rows.select(F.col(response).cast("string").alias("class"), a.alias("a")).select("class", "a.*").groupBy("class", "attribute", "level").agg(F.count(F.lit(1)).alias("count"))
        counts = part if counts is None else counts.union(part)
    classes = [(r["class"], r["count"]) for r in rows.groupBy(F.col(response).cast("string").alias("class")).count().orderBy("class").collect()]
    n = sum(c for _, c in classes)
    size = F.create_map(*[F.lit(x) for k, c in classes for x in (k, float(c))])
    table = counts.withColumn("joint", F.col("count") / n).withColumn("conditional", F.col("count") / size[F.col("class")])
    return NaiveBayesModel(response, bins, ranges, list(factors), table, classes, n)
