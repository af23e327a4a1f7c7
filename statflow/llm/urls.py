"""URL filters by a temporal list join, in DataFrame functions only.

A list is a history: dated entries that add or remove a pattern. Per pattern the
entries become validity intervals - an addition holds until the pattern's next
entry - and a capture is judged by the intervals that hold at its own fetch time,
never by the list of today.

Patterns: ``domain`` (the host or a parent of it), ``host`` (this host alone) and
``prefix`` (host and leading path segments). A capture is looked up by the few
keys it can match; of the active patterns the longest decides, and of an
allowance and a block of one length the block. The as-of join is an equality on
the key, so it never pairs captures with unrelated entries. Each URL and time
is asked once, however many captures have it; verdicts then meet the captures. Both joins
measure their lookup: it is broadcast up to a bound; beyond, keys that hold many rows - a few
domains hold most captures - are dealt over as many tasks as their count asks for.
The intervals of a pattern, a few a day at most, are one row.

Edge cases: a null or malformed URL has no host, matches nothing and is kept; a
null fetch time lies in no interval; entries without a pattern or date are void;
of several entries of one pattern, kind and date a removal comes first, so an
addition on the same day holds; repeated captures each get a row; empty
captures give no rows, an empty list keeps all; extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statflow.llm.text import let
from statflow.plans.lookup import join_lookup

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a closing dot; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.+$", "")


def keys_of(url: Column) -> Column:
    """All keys that could match a URL: domain:..., host:..., prefix:.../..."""
    host = host_of(url)
    path = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda x: x != "")

    def of(h: Column) -> Column:
        labels = F.split(h, r"\.")
        domains = let(labels, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(p, i, F.size(p)), "."))))
        prefixes = let(path, lambda p: F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.concat(F.lit("prefix:"), h, F.lit("/"), F.array_join(F.slice(p, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>")))
        return F.when(h == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("host:"), h)), domains, prefixes))

    return let(host, of)


def intervals(entries: DataFrame) -> DataFrame:
    """``entries``: kind (domain, host, prefix), pattern, rule (block, allow), action (add,
    remove), at. Returns key, rule, since, until (null: still valid)."""
    pattern = F.when(F.col("kind") == "prefix", F.regexp_replace("pattern", "/+$", "")).otherwise(F.lower("pattern"))
    e = entries.where("kind in ('domain', 'host', 'prefix') and rule in ('block', 'allow') and pattern is not null and at is not null")
    e = e.select(F.concat("kind", F.lit(":"), pattern).alias("key"), "rule", F.col("action").alias("action"), "at").distinct()
    order = Window.partitionBy("key", "rule").orderBy("at", F.desc("action"))  # "remove" before "add"
    e = e.withColumn("until", F.lead("at").over(order))
    return e.where("action = 'add' and (until is null or until > at)").select("key", "rule", F.col("at").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, page_id: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Per capture: page_id, url, fetched_at, host, matched (the deciding key or null),
    since (of its interval), kept."""
    base = captures.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(fetched).alias("fetched_at"))
    asked = base.select("url", "fetched_at").dropna().distinct().withColumn("key", F.explode(keys_of(F.col("url"))))
    # One row per key: its intervals as an array.
    lists = intervals(entries).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("since", "until", "rule"))).alias("spans"))
    joined = join_lookup(asked, lists, "key", "url", "inner")
    active = F.filter("spans", lambda s: (s["since"] <= F.col("fetched_at")) & (s["until"].isNull() | (F.col("fetched_at") < s["until"])))
    # Longest pattern first; a block before an allowance.
    best = F.array_max(F.transform(active, lambda s: F.struct((F.length("key") - F.instr("key", ":")).alias("n"), (s["rule"] == "block").alias("block"), F.col("key").alias("key"), s["since"].alias("since"))))
    found = joined.select("url", "fetched_at", best.alias("best")).where("best is not null").groupBy("url", "fetched_at").agg(F.max("best").alias("best"))
    rows = join_lookup(base, found, ["url", "fetched_at"], "page_id")
    return rows.select("page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"), F.col("best.key").alias("matched"), F.col("best.since").alias("since"), (~F.coalesce("best.block", F.lit(False))).alias("kept"))
