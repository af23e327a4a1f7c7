"""Exact medians and percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statflow.operators.aggregates import _by, _need
from statflow.plans.durable import materialize

#: Distinct values a task sorts, about.
PART_VALUES = 1 << 20


def quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float], by: str | Sequence[str] | None = None) -> DataFrame:
    """Exact percentiles, interpolated: column, q, value. Distinct values are counted per column and group and
    sorted over as many tasks as they ask for (``PART_VALUES`` each); the groups' counts in each sorted part say
    which part holds a rank, so no task sees more than its part. Nulls take no part, NaN is the greatest."""
    _need(df, cols)
    if not qs or any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie within [0, 1]")
    by = _by(by)
    groups = [f"__g{i}" for i in range(len(by))]
    keys = [*groups, "__c"]
    base = df.select(*[F.col(b).alias(g) for b, g in zip(by, groups, strict=True)], *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(cols)])
    counts = None
    for i in range(len(cols)):  # a null counts as one value of no rows, which keeps groups of nulls
        x = F.col(f"__x{i}")
        part = base.groupBy(*groups, x.alias("__x")).agg(F.count(x).alias("__n")).select(*groups, F.lit(i).alias("__c"), "__x", "__n")
        counts = part if counts is None else counts.union(part)
    counts = materialize(counts, "counts")
    parts = max(1, counts.count() // PART_VALUES + 1)
    rows = counts.where("__x is not null").repartitionByRange(parts, *keys, "__x").withColumn("__p", F.spark_partition_id())
    rows = materialize(rows, "sorted")
    inside = rows.groupBy(*keys, "__p").agg(F.sum("__n").alias("__s"))
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = inside.withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0))).withColumn("__total", F.sum("__s").over(Window.partitionBy(*keys)))
    rank = lambda q: F.lit(float(q)) * (F.col("__total") - 1)
    ends = [F.struct(F.lit(k).alias("__k"), end.alias("__r")) for k, q in enumerate(qs) for end in (F.floor(rank(q)), F.ceil(rank(q)))]
    wanted = starts.withColumn("__w", F.array_distinct(F.array(*ends))).select("*", F.expr("filter(__w, w -> w.__r >= __before and w.__r < __before + __s)").alias("__here")).where(F.size("__here") > 0)
    wanted = wanted.select(*[F.col(k).alias(f"{k}_w") for k in [*keys, "__p"]], "__before", "__total", "__here")
    # Only parts that hold a rank are sorted.
    near = rows.join(wanted, F.expr(" and ".join(f"{k} <=> {k}_w" for k in [*keys, "__p"])))
    running = Window.partitionBy(*keys, "__p").orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("__end", F.col("__before") + F.sum("__n").over(running))
    found = near.select(*keys, "__x", "__total", F.explode(F.expr("filter(__here, w -> w.__r >= __end - __n and w.__r < __end)")).alias("__w"))
    found = found.groupBy(*keys, "__w.__k").agg(F.max("__total").alias("__total"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    q = F.get(F.array(*[F.lit(float(q)) for q in qs]), F.col("__k"))
    part = q * (F.col("__total") - 1) - F.floor(q * (F.col("__total") - 1))
    value = F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(F.col("__lo") * (1 - part) + F.col("__hi") * part)
    found = found.select(*[F.col(k).alias(f"{k}_f") for k in keys], F.col("__k").alias("__k_f"), value.alias("value"))
    # Every group, column and q has a row, null where the column has no value.
    every = counts.select(*groups).distinct() if by else df.sparkSession.range(1)
    names = F.array(*[F.struct(F.lit(i).alias("__c"), F.lit(c).alias("column"), F.lit(k).alias("__k"), F.lit(float(q)).alias("q")) for i, c in enumerate(cols) for k, q in enumerate(qs)])
    every = every.select(*groups, F.inline(names))
    out = every.join(found, F.expr(" and ".join(f"{k} <=> {k}_f" for k in [*keys, "__k"])), "left")
    return out.select(*[F.col(g).alias(b) for b, g in zip(by, groups, strict=True)], "column", "q", "value")


def median(df: DataFrame, cols: Sequence[str], by: str | Sequence[str] | None = None) -> DataFrame:
    """column, median."""
    by = _by(by)
    return quantiles(df, cols, [0.5], by).select(*by, "column", F.col("value").alias("median"))


def binned_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float] = (0.5,), bins: int = 1000, threshold: int = 10_000, max_passes: int = 40) -> DataFrame:
    """Exact percentiles by successive binning: each pass counts, for every column and quantile at
    once, the values of a range by bins and keeps the bin that holds the rank; once a range holds
    at most ``threshold`` values (or one distinct value) they are sorted. The state is
    ``bins`` counts per quantile, whatever the data. Same values as ``quantiles``."""
    _need(df, cols)
    spark = df.sparkSession
    x = {c: F.col(c).cast("double") for c in cols}
    first = df.agg(*[f(x[c]).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count))]).first()
    out, jobs = {}, []
    for c in cols:
        n = first[f"n_{c}"]
        for q in qs:
            if n == 0:
                out[c, q] = None
                continue
            rank = q * (n - 1)
            for r in {int(rank), min(int(rank) + 1, n - 1)}:
                jobs.append([c, r, first[f"lo_{c}"], first[f"hi_{c}"], 0, n])  # the rank, the range, values below it, values in it
    ranks: dict[tuple[str, int], float] = {}
    todo = {(j[0], j[1]): j for j in jobs}

    def ranges(keys) -> dict[tuple, int]:
        """Ranges (column, lo, hi) numbered: ranks that lie in one share it."""
        return {r: n for n, r in enumerate(dict.fromkeys((todo[k][0], todo[k][2], todo[k][3]) for k in keys))}

    def inside(found: dict[tuple, int], *more) -> DataFrame:
        parts = [F.when(x[c].between(lo, hi), F.struct(F.lit(n).alias("k"), *[f(c, lo, hi) for f in more], x[c].alias("x"))) for (c, lo, hi), n in found.items()]
        return df.select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))

    for _ in range(max_passes):
        for key, (_, _, lo, hi, _, _) in list(todo.items()):
            if lo == hi:
                ranks[key] = lo
                del todo[key]
        # Ranges that are small by now are read in one job: at most ``threshold`` values each.
        if small := [k for k, job in todo.items() if job[5] <= threshold]:
            found = ranges(small)
            values: dict[int, list[float]] = {}
            for r in inside(found).select("p.k", "p.x").collect():
                values.setdefault(r["k"], []).append(r["x"])
            for v in values.values():
                v.sort()
            for k in small:
                c, rank, lo, hi, below, _ = todo.pop(k)
                ranks[k] = values[found[c, lo, hi]][rank - below]
        if not todo:
            break
        found = ranges(todo)
        at = lambda c, lo, hi: F.least(F.lit(bins - 1), F.floor((x[c] - lo) / ((hi - lo) / bins)).cast("int")).alias("b")
        counted = inside(found, at).groupBy("p.k", "p.b").agg(F.count(F.lit(1)).alias("n"), F.min("p.x").alias("lo"), F.max("p.x").alias("hi"))
        bins_of: dict[int, list] = {}
        for row in sorted(counted.collect(), key=lambda r: r["b"]):  # at most ``bins`` rows a range
            bins_of.setdefault(row["k"], []).append(row)
        for job in todo.values():
            below = job[4]
            for row in bins_of[found[job[0], job[2], job[3]]]:
                if job[1] < below + row["n"]:
                    job[2:] = [row["lo"], row["hi"], below, row["n"]]
                    break
                below += row["n"]
    else:
        raise RuntimeError("binning did not narrow the ranges")
    for c in cols:
        for q in qs:
            if (c, q) not in out:
                rank = q * (first[f"n_{c}"] - 1)
                lo = ranks[c, int(rank)]
                hi = ranks[c, min(int(rank) + 1, first[f"n_{c}"] - 1)]
                out[c, q] = lo + (hi - lo) * (rank - int(rank))
    return spark.createDataFrame([(c, float(q), out[c, q]) for c in cols for q in qs], "column string, q double, value double")
