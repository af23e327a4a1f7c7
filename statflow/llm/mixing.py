"""Mixing sources to target weights.

Sources are ranked by code point (null last) and weigh 5, 2, 1, repeating. The
total number of words is shared by weight; a source's target stops at three
times its own size and the excess goes to the others, again by weight: the
fix-point is target = min(cap, level * weight) for one common level, found from
one pass over the sources in order of cap / weight. A document is then taken
floor(rate) times, rate = target / size of its source, plus once more if a
number hashed from the seed and its id falls below the rate's fraction.

Only the per-source sums are shuffled (partial sums first); the documents meet
their rate in a join on the source whose small side, one row per source, is
repeated over SALTS so that a hot source spreads; it is written first, so Spark
broadcasts it only where its known size allows.

Edge cases: a null or empty text has size 0 and is taken 0 times; sources
without words have target 0; repeated rows draw alike, as the draw depends on
the seed and the id (null ids on the text as well); an empty table gives no
rows; extra columns pass through unless they bear a result column's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statflow.plans.durable import materialize
from statflow.llm.text import n_words, text_of, unit_hash

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 42
SALTS = 16
_NEW = ("size", "source_size", "target", "rate", "copies", "taken")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes``: source, source_size, one row per source. Adds target (double).
    The windows run over one row per source, never over documents."""
    w = F.lit(0)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    for i, x in enumerate(weights):
        w = F.when(F.pmod(F.col("_rank"), F.lit(len(weights))) == i, F.lit(x)).otherwise(w)
    s = sizes.withColumn("_rank", rank).withColumn("_w", w.cast("long"))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(cap))
    # Compare cap / weight by cross-multiplied integers: lcm of the weights keeps the order exact.
    scale = 1
    for x in weights:
        scale *= x
    s = s.withColumn("_key", F.col("_cap") * (F.lit(scale) / F.col("_w")).cast("long"))
    upto = Window.orderBy("_key", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_key", "_rank").rowsBetween(0, Window.unboundedFollowing)
    everywhere = Window.orderBy("_key", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("_cap").over(upto), F.lit(0))
    s = s.withColumn("_left", left).withColumn("_rest", F.sum("_w").over(after))
    # Capped while the level that the rest would get lies above cap / weight.
    s = s.withColumn("_capped", F.col("_left") * F.col("_w") > F.col("_cap") * F.col("_rest"))
    level = F.first(F.when(~F.col("_capped"), F.struct("_left", "_rest")), ignorenulls=True).over(everywhere)
    s = s.withColumn("_level", level)
    shared = F.col("_level._left").cast("double") * F.col("_w").cast("double") / F.col("_level._rest").cast("double")
    return s.select("source", "source_size", F.when(F.col("_capped") | F.col("_level").isNull(), F.col("_cap").cast("double")).otherwise(shared).alias("target"))


def _draw(seed: int, doc_id: str, text: str) -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(text_of(text))))
    return unit_hash(F.lit(str(seed)), key)


def rates(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = SEED, whole: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, rate, copies, taken (with
    ``whole``: all the input's columns and those)."""
    keep = [c for c in docs.columns if c not in _NEW] if whole else [doc_id]
    base = docs.select(
        *[F.col(c) for c in keep], F.col(source).cast("string").alias("__source"), n_words(text_of(text)).cast("long").alias("size"), _draw(seed, doc_id, text).alias("__draw")
    )
    sizes = docs.select(F.col(source).cast("string").alias("source"), n_words(text_of(text)).cast("long").alias("size"))
    # Written, so that Spark knows its real size when it chooses between a broadcast and the salted join.
    per = materialize(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    per = per.withColumnRenamed("source", "__s").withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    base = base.withColumn("__salt_", F.floor(F.col("__draw") * 1e6 % SALTS).cast("int"))
    joined = base.join(per, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__salt_") == F.col("__salt")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = joined.withColumn("rate", rate)
    out = out.withColumn("copies", F.floor("rate") + (F.col("__draw") < F.col("rate") - F.floor("rate")).cast("long"))
    out = out.withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*keep, *_NEW)


def mix(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, with ``docs``'s columns."""
    renamed = docs.select(*docs.columns, F.col(source).alias("__src"), F.col(text).alias("__txt"), F.col(doc_id).alias("__id"))
    clash = {c: f"__own_{c}" for c in docs.columns if c in _NEW}
    out = rates(renamed.withColumnsRenamed(clash), "__src", "__txt", "__id", seed, whole=True)
    out = out.where("copies > 0").withColumn("__copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return out.select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])
