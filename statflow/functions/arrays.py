"""Vectors, matrices and tuples as arrays and structs.

A vector is ``array<double>``; a matrix is ``struct<n_rows, n_cols, data>`` with
``data`` row by row; a tuple is a struct. All builders return columns, so they stay
inside the plan's generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def as_vector(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("array<double>")


def make_vector(df: DataFrame, *cols: str, levels: dict[str, Sequence[str]] | None = None) -> Column:
    """One vector of scalars, categorical columns (as the position in their sorted
    ``levels``), arrays and matrices, in this order."""
    if not cols:
        raise ValueError("a vector needs at least one input")
    parts, levels = [], levels or {}
    for name in cols:
        kind = df.schema[name].dataType
        if name in levels:
            order = sorted(levels[name])
            parts.append(F.array((F.array_position(F.array(*[F.lit(x) for x in order]), F.col(name)) - 1).cast("double")))
        elif isinstance(kind, _NUMBERS):
            parts.append(F.array(F.col(name).cast("double")))
        elif isinstance(kind, T.ArrayType):
            parts.append(as_vector(name))
        elif isinstance(kind, T.StructType) and "data" in kind.names:
            parts.append(as_vector(F.col(f"{name}.data")))
        else:
            raise ValueError(f"{name}: {kind.simpleString()} needs levels to enter a vector")
    return F.concat(*parts)


def make_array(col: str) -> Column:
    """A vector is an array already."""
    return F.col(col)


def make_tuple(*cols: str) -> Column:
    return F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)])


def get(df: DataFrame, col: str, i: int) -> Column:
    """The i-th element of a tuple, from 0."""
    kind = df.schema[col].dataType
    if not isinstance(kind, T.StructType):
        raise ValueError(f"{col} is no tuple")
    if not 0 <= i < len(kind.fields):
        raise ValueError(f"{col} has {len(kind.fields)} elements; no {i}")
    return F.col(col).getField(kind.fields[i].name)


def make_matrix(n_rows: int, n_cols: int, data: Column | str) -> Column:
    data = as_vector(data)
    checked = F.when(F.size(data) == n_rows * n_cols, data).otherwise(F.raise_error(F.lit("matrix: wrong number of entries")))
    return F.struct(F.lit(n_rows).alias("n_rows"), F.lit(n_cols).alias("n_cols"), checked.alias("data"))


def total(v: Column | str) -> Column:
    return F.aggregate(as_vector(v), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_vector(a), as_vector(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_vector(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column | str) -> Column:
    """Euclidean norm 1; the zero vector stays as it is."""
    v = as_vector(v)
    scaled = F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n == 0, x).otherwise(x / n)))
    return scaled.getItem(0)


def matrix_mean(m: Column | str) -> Column:
    """Mean of all entries of a matrix, or of a vector."""
    data = (F.col(m) if isinstance(m, str) else m).getField("data")
    return total(data) / F.size(data)


def vector_mean(v: Column | str) -> Column:
    return total(v) / F.size(as_vector(v))


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_vector(a), as_vector(b), lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(as_vector(a), as_vector(b), lambda x, y: x - y)


def sparse_dot(indices: Column | str, dense: Column | str) -> Column:
    """Sum of the dense vector's entries at the given positions, from 0; repeats count."""
    dense = as_vector(dense)
    return F.aggregate(F.col(indices) if isinstance(indices, str) else indices, F.lit(0.0), lambda s, i: s + F.coalesce(F.get(dense, i.cast("int")), F.lit(0.0)))


def sparse_contains(indices: Column | str, i: int | Column) -> Column:
    return F.array_contains(F.col(indices) if isinstance(indices, str) else indices, i)


def parse_vector(col: str, size: int) -> Column:
    """A vector from text, numbers between white space; fails on fewer than ``size``."""
    v = F.transform(F.split(F.trim(F.col(col)), r"\s+"), lambda x: x.cast("double"))
    return F.when(F.size(v) >= size, F.slice(v, 1, size)).otherwise(F.raise_error(F.lit("vector: too few numbers")))


def vector_json(v: Column | str) -> Column:
    v = as_vector(v)
    return F.to_json(F.struct(F.lit("vector").alias("__type__"), F.size(v).alias("n_elem"), v.alias("data")))


def matrix_json(m: str) -> Column:
    return F.to_json(F.struct(F.lit("matrix").alias("__type__"), F.col(f"{m}.n_rows"), F.col(f"{m}.n_cols"), F.col(f"{m}.data")))
