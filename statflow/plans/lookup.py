"""Joins of a large side with a lookup table."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statflow.plans.durable import materialize

BROADCAST_BYTES = 8 << 20
#: A key with more than one in SPREAD of the rows is split, into parts of that size.
SPREAD = 2000


def _bytes(df: DataFrame):
    """About how many bytes a row takes in memory."""
    total = F.lit(16)
    for c, t in df.dtypes:
        total += F.lit(16) if t in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp") else 4 * F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(4))
    return total


def local_table(spark: SparkSession, rows: Sequence[Sequence[int]], schema: str) -> DataFrame:
    """A few rows of numbers as a table. They go to the JVM as Arrow, so no executor starts Python workers to read them,
    which would stay beside those of the functions."""
    kind = StructType.fromDDL(schema)
    columns = [pa.array([r[k] for r in rows], {"int": pa.int32(), "bigint": pa.int64()}[f.dataType.simpleString()]) for k, f in enumerate(kind)]
    return spark.createDataFrame(pa.table(columns, names=kind.names), kind)


def join_lookup(big: DataFrame, lookup: DataFrame, on: str | Sequence[str], salt_by: str, how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``big`` joined with ``lookup`` (unique on ``on``). The lookup is written and measured: up to
    ``limit`` bytes it is broadcast. Beyond, the rows of ``big`` are counted by key (``big`` is read
    once more for that); keys with over one in SPREAD of them - SPREAD at most, so they are
    broadcast - are dealt by a hash of ``salt_by`` into parts of about that many rows, and their
    lookup rows repeated as often. No other key is larger than such a part."""
    on = [on] if isinstance(on, str) else list(on)
    lookup = materialize(lookup, "lookup")
    size = lookup.agg(F.sum(_bytes(lookup))).first()[0] or 0
    if size <= limit:
        return big.join(F.broadcast(lookup), on, how)
    counts = materialize(big.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")), "keys")
    part = (counts.agg(F.sum("__n")).first()[0] or 0) // SPREAD + 1
    hot = counts.where(F.col("__n") > part).select(*[F.col(c).alias(f"__{c}") for c in on], F.ceil(F.col("__n") / part).cast("int").alias("__parts"))
    same = lambda df: [df[c].eqNullSafe(F.col(f"__{c}")) for c in on]  # noqa: E731  keys that are null match nothing but are dealt as well
    drop = [*[f"__{c}" for c in on], "__parts"]
    salt = F.pmod(F.xxhash64(salt_by), F.coalesce("__parts", F.lit(1)).cast("long")).cast("int")
    salted = big.join(F.broadcast(hot), same(big), "left").withColumn("__salt", salt).drop(*drop)
    copies = lookup.join(F.broadcast(hot), same(lookup), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop(*drop)
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")
