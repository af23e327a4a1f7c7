"""One-pass aggregates. Each takes optional group columns ``by``; rows with a null in
an input column take no part. All are partial aggregations: one row per group and
task is shuffled."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statflow.functions.arrays import as_vector
from statflow.plans.partials import add_up


def _by(by: str | Sequence[str] | None) -> list[str]:
    return [by] if isinstance(by, str) else list(by or [])


def _need(df: DataFrame, cols: Sequence[str]) -> None:
    if not cols:
        raise ValueError("at least one column is needed")
    if missing := [c for c in cols if c not in df.columns]:
        raise ValueError(f"no such columns: {', '.join(missing)}")


def summary(df: DataFrame, cols: Sequence[str], by: str | Sequence[str] | None = None) -> DataFrame:
    """Per column: column, mean, std_dev (sample), range, min, max, count."""
    _need(df, cols)
    by = _by(by)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"__mean_{c}"), F.stddev_samp(x).alias(f"__sd_{c}"), F.min(x).alias(f"__min_{c}"), F.max(x).alias(f"__max_{c}")]
    wide = df.dropna(subset=list(cols)).groupBy(*by).agg(*aggs)
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"__mean_{c}").alias("mean"), F.col(f"__sd_{c}").alias("std_dev"), (F.col(f"__max_{c}") - F.col(f"__min_{c}")).alias("range"),
            F.col(f"__min_{c}").alias("min"), F.col(f"__max_{c}").alias("max"), F.col("__n").alias("count"),
        )
        for c in cols
    ]
    return wide.select(*by, F.inline(F.array(*rows)))


def cov_cor(df: DataFrame, cols: Sequence[str], which: str = "both", by: str | Sequence[str] | None = None) -> DataFrame:
    """Long form of the covariance (n - 1) and correlation matrices: row, col, covariance, correlation."""
    _need(df, cols)
    if which not in ("cov", "cor", "both"):
        raise ValueError("which: cov, cor or both")
    by, cols = _by(by), list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    want = [w for w in ("cov", "cor") if which in (w, "both")]
    use = {"cov": F.covar_samp, "cor": F.corr}
    aggs = [use[w](F.col(a).cast("double"), F.col(b).cast("double")).alias(f"__{w}_{a}_{b}") for a, b in pairs for w in want]
    wide = df.dropna(subset=cols).groupBy(*by).agg(*aggs)
    named = {"cov": "covariance", "cor": "correlation"}
    key = lambda w, a, b: f"__{w}_{a}_{b}" if (a, b) in pairs else f"__{w}_{b}_{a}"
    rows = [F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), *[F.col(key(w, a, b)).alias(named[w]) for w in want]) for a in cols for b in cols]
    return wide.select(*by, F.inline(F.array(*rows)))


def gram(df: DataFrame, vector: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, cross products about the means) of a vector column, for matrices too wide for one
    aggregate expression. Two passes, so that nothing cancels; one vector of sums per task."""
    rows = df.select(as_vector(vector).alias("v")).where("v is not null")

    def sums(batches):
        n, total = 0, np.zeros(size)
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy())
            n, total = n + len(x), total + x.sum(axis=0)
        return np.append(total, n) if n else None

    first = add_up(rows, sums)
    if first is None:
        return 0, np.zeros(size), np.zeros((size, size))
    n, mean = int(first[-1]), first[:-1] / first[-1]

    def products(batches):
        m2 = np.zeros((size, size))
        for pdf in batches:
            d = np.stack(pdf["v"].to_numpy()) - mean
            m2 += d.T @ d
        return m2.ravel()

    return n, mean, add_up(rows, products).reshape(size, size)


@dataclass
class ScalerModel:
    """Measures of a vector column and the scaling they stand for."""

    vector: str
    stats: DataFrame
    center: bool
    scale: bool
    range: bool

    def transform(self, df: DataFrame, output: str = "scaled") -> DataFrame:
        rows = self.stats.orderBy("index").collect()  # one row per dimension
        shift = [r["min"] if self.range else r["mean"] if self.center else 0.0 for r in rows]
        width = [r["max"] - r["min"] if self.range else r["std_dev"] if self.scale else 1.0 for r in rows]
        a, b = F.array(*[F.lit(float(x)) for x in shift]), F.array(*[F.lit(float(x)) for x in width])
        moved = F.zip_with(as_vector(self.vector), a, lambda x, m: x - m)
        return df.withColumn(output, F.zip_with(moved, b, lambda x, s: F.when(s == 0, F.lit(0.0)).otherwise(x / s)))


def preprocess(df: DataFrame, vector: str, center: bool = True, scale: bool = True, range: bool = False) -> ScalerModel:
    """Per dimension of a vector: index, mean, std_dev (population), min, max."""
    _need(df, [vector])
    flat = df.where(F.col(vector).isNotNull()).select(F.posexplode(as_vector(vector)).alias("index", "x"))
    stats = flat.groupBy("index").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std_dev"), F.min("x").alias("min"), F.max("x").alias("max"))
    return ScalerModel(vector, stats, center, scale, range)


def mode(df: DataFrame, col: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """The most frequent level; ties go to the least one. Counts first, so a frequent level costs one row a task."""
    _need(df, [col])
    by = _by(by)
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("__n"))
    return counts.groupBy(*by).agg(F.min_by(col, F.struct(-F.col("__n"), F.col(col))).alias("mode"))


def _fill(counts: DataFrame, keys: DataFrame | None, by: list[str], length: int, fill: float) -> DataFrame:
    """Rows (by, index, value) for each index below ``length``."""
    spark = counts.sparkSession
    axis = F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("index")
    grid = keys.select(*by, axis) if keys is not None else spark.range(1).select(axis)
    return grid.join(counts, [*by, "index"], "left").select(*by, "index", F.coalesce("value", F.lit(fill).cast("double")).alias("value"))


def _scaled(rows: DataFrame, by: list[str], p: float) -> DataFrame:
    size = rows.groupBy(*by).agg(F.pow(F.sum(F.pow(F.abs("value"), p)), 1 / p).alias("__norm"))
    joined = rows.join(size, by) if by else rows.crossJoin(size)
    return joined.select(*by, "index", F.when(F.col("__norm") == 0, F.lit(0.0)).otherwise(F.col("value") / F.col("__norm")).alias("value"))


def _array(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct("index", "value")))
    return rows.groupBy(*by).agg(F.transform(pairs, lambda x: x["value"]).alias(name))


def histogram(df: DataFrame, index: str, length: int, normalize: bool = False, p: float = 1, by: str | Sequence[str] | None = None, long: bool = False) -> DataFrame:
    """Counts of an integer index within [0, length), as an array or, ``long``, as rows index, value."""
    if length <= 0:
        raise ValueError("length must be positive")
    _need(df, [index])
    by = _by(by)
    counts = df.where(F.col(index).between(0, length - 1)).groupBy(*by, F.col(index).cast("int").alias("index")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    rows = _fill(counts, df.select(*by).distinct() if by else None, by, length, 0.0)
    rows = _scaled(rows, by, p) if normalize else rows
    return rows if long else _array(rows, by, "histogram")


def line_chart(df: DataFrame, index: str, value: str, length: int, normalize: bool = False, p: float = 2, fill: float = 0.0, by: str | Sequence[str] | None = None, long: bool = False) -> DataFrame:
    """Sums of a value by an integer index within [0, length); untouched slots hold ``fill``."""
    if length <= 0:
        raise ValueError("length must be positive")
    _need(df, [index, value])
    by = _by(by)
    inside = df.where(F.col(index).between(0, length - 1) & F.col(value).isNotNull())
    sums = inside.groupBy(*by, F.col(index).cast("int").alias("index")).agg(F.sum(F.col(value).cast("double")).alias("value"))
    rows = _fill(sums, df.select(*by).distinct() if by else None, by, length, fill)
    rows = _scaled(rows, by, p) if normalize else rows
    return rows if long else _array(rows, by, "chart")


def line_chart_matrix(df: DataFrame, key: str, index: str, value: str, length: int, normalize: bool = False, p: float = 2, long: bool = False) -> DataFrame:
    """One chart per key, keys without values included."""
    return line_chart(df, index, value, length, normalize, p, by=[key], long=long)


def collect_matrix(df: DataFrame, index: str, vector: str, size: int, by: str | Sequence[str] | None = None) -> DataFrame:
    """Long form (row, col, value) of the matrix whose column ``index`` is the sum of its vectors; untouched entries are left out."""
    _need(df, [index, vector])
    by = _by(by)
    flat = df.where(F.col(index).between(0, size - 1)).select(*by, F.col(index).cast("int").alias("col"), F.posexplode(as_vector(vector)).alias("row", "x"))
    return flat.groupBy(*by, "row", "col").agg(F.sum("x").alias("value")).select(*by, "row", "col", "value")


def gather(df: DataFrame, vector: str, extra: Sequence[str] = ()) -> DataFrame:
    """The vectors with a tuple of other columns: the state that later operators read. Nothing moves until it is used."""
    _need(df, [vector, *extra])
    return df.select(as_vector(vector).alias("vector"), F.struct(*[F.col(c) for c in extra]).alias("extra") if extra else F.lit(None).alias("extra"))


def sparse_indicator(df: DataFrame, index: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """All indices, repeats included, in ascending order. One array per group: groups must fit a row."""
    _need(df, [index])
    return df.where(F.col(index).isNotNull()).groupBy(*_by(by)).agg(F.sort_array(F.collect_list(index)).alias("indices"))


def build_sparse_array(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Coordinates (key, position, index, value) of each key's vectors; position numbers a key's vectors in order of their entries."""
    from pyspark.sql import Window

    _need(df, [key, vector])
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), as_vector(vector).alias("v"))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("key").orderBy("v")) - 1)
    return rows.select("key", "position", F.posexplode("v").alias("index", "value"))


WIDE = 30
AGGREGATES = {"sum": F.sum, "multiplication": F.product, "replacement": F.last, "omission": F.first}


def build_array(df: DataFrame, indices: Sequence[str], value: str, sizes: Sequence[int] | None = None, aggregate: str = "sum", error: bool = False, order_by: str | None = None, maximum: int | None = None) -> DataFrame:
    """Coordinates (indices..., value) of an array built from indexed values. With ``sizes``, indices
    beyond are left out, or fail with ``error``; without, the array is as large as its largest index
    (at most ``maximum``). ``replacement`` and ``omission`` keep the last and first by ``order_by``."""
    _need(df, [*indices, value])
    if aggregate not in AGGREGATES:
        raise ValueError(f"aggregate: one of {', '.join(AGGREGATES)}")
    if sizes is not None and len(sizes) != len(indices):
        raise ValueError("one size per index")
    if aggregate in ("replacement", "omission") and order_by is None:
        raise ValueError(f"{aggregate} needs order_by")
    rows = df.dropna(subset=[*indices, value])
    limits = list(sizes) if sizes is not None else [maximum] * len(indices)
    for c, n in zip(indices, limits, strict=True):
        inside = (F.col(c) >= 0) if n is None else F.col(c).between(0, n - 1)
        rows = rows.withColumn(c, F.when(inside, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} out of range")))) if error else rows.where(inside)
    x = F.col(value).cast("double")
    if order_by is None:
        agg = AGGREGATES[aggregate](x)
    else:
        agg = (F.max_by if aggregate == "replacement" else F.min_by)(x, F.col(order_by)) if aggregate in ("replacement", "omission") else AGGREGATES[aggregate](x)
    return rows.groupBy(*indices).agg(agg.alias("value"))


def dense_array(built: DataFrame, indices: Sequence[str], sizes: Sequence[int], fill: float = 0.0) -> DataFrame:
    """Row-major array<double> of a built array, absent entries filled: for arrays that fit a row."""
    at: Column = F.lit(0).cast("long")
    total = 1
    for c, n in zip(indices, sizes, strict=True):
        at = at * n + F.col(c).cast("long")
        total *= n
    flat = built.select(at.cast("int").alias("index"), "value")
    return _array(_fill(flat, None, [], total, fill), [], "data").select(F.array(*[F.lit(n) for n in sizes]).alias("dims"), "data")


def first_k(df: DataFrame, size: int, order_by: str | Sequence[str] | None = None) -> DataFrame:
    """``size`` rows: the first by ``order_by``, else any."""
    if size < 0:
        raise ValueError("size must not be negative")
    return df.orderBy(*_by(order_by)).limit(size) if order_by else df.limit(size)


def reservoir_sample(df: DataFrame, size: int, seed: int = 42, key: str | Sequence[str] | None = None) -> DataFrame:
    """A uniform sample of ``size`` rows without replacement. A top-k by a seeded hash of ``key``
    (default: the whole row as JSON), so reruns agree on any layout; of equal keys all draw alike, so name
    a unique one. Each task keeps ``size`` rows, so nothing is sorted in full."""
    if size < 0:
        raise ValueError("size must not be negative")
    names = _by(key)
    drawn = F.xxhash64(F.lit(seed), *[F.col(c) for c in names]) if names else F.xxhash64(F.lit(seed), F.to_json(F.struct(*df.columns)))
    return df.withColumn("__draw", drawn).orderBy("__draw").limit(size).drop("__draw")


def ols(df: DataFrame, x: Sequence[str], y: str, intercept: bool = True) -> DataFrame:
    """Least squares: term, coefficient, n. The cross products are one pass of partial aggregates (of
    over WIDE predictors: of matrices in Arrow batches); the solve is one small system."""
    _need(df, [*x, y])
    spark = df.sparkSession
    cols = [F.col(c).cast("double") for c in [*x, y]]
    rows = df.dropna(subset=[*x, y])
    if len(x) > WIDE:
        n, mean, m2 = gram(rows.select(F.array(*cols).alias("v")), "v", len(cols))
    else:
        at = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
        got = list(rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.covar_pop(cols[i], cols[j]) for i, j in at]).first())
        n = got[0]
        mean, m2 = np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
        if n:
            mean = np.array(got[1 : len(cols) + 1])
            for (i, j), v in zip(at, got[len(cols) + 1 :], strict=True):
                m2[i, j] = m2[j, i] = v * n
    if n == 0:
        return spark.createDataFrame([], "term string, coefficient double, n long")
    k = len(x)
    if not intercept:
        m2 = m2 + n * np.outer(mean, mean)
    beta = np.linalg.lstsq(m2[:k, :k], m2[:k, k], rcond=None)[0]
    terms = [("(intercept)", float(mean[k] - mean[:k] @ beta), n)] if intercept else []
    return spark.createDataFrame(terms + [(c, float(b), n) for c, b in zip(x, beta, strict=True)], "term string, coefficient double, n long")
