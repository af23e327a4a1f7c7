"""Substring dedup by sliding sentence spans.

A text is cut into sentences: stretches up to a mark (. ! ?) or a line feed. A
stretch of over LONGEST words is cut on inside, after every word whose digest is
the least among REACH words on either side; so cuts follow the content, those
inside a passage do not depend on where it begins, and no piece is short.

A span is a run of RUN consecutive sentences that hold words (wordless ones in
between belong to it). Every run is hashed (XXH64 of lower-cased words) and
joined over the whole corpus; the first occurrence stays, and sentences inside
any other occurrence are removed. With RUN = 2 this removes exactly what all
longer runs would: a later occurrence of a longer run is made of later
occurrences of its pairs. Occurrences are in order of document id (rows without
one last), digest of the text, row, position.

The rows are written once with a row number of their own, so removals belong to
rows, never to ids that several rows share. Hashes are grouped with map-side
sums; those that make up over one in SHARE of all repeated spans are at most
SHARE, so they are broadcast; of the rest no group is larger than that fraction.
Removals meet their texts by row number, in one shuffle of the texts.

Edge cases: a null text stays null, an empty one empty; texts of fewer than RUN
sentences keep all; rows without an id are documents like any other; repeated
rows are copies - one of them is the first, whichever, the others lose every
span; rows of one id with different texts are different documents; equal spans
inside one document count as repeats; an empty table gives no rows; extra
columns are not carried. Hashes of 64 bits can collide: among 10^9 different
spans a chance of 3 %.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.plans.durable import materialize

RUN = 2
LONGEST = 20
REACH = 4
SHARE = 100_000
_UNIT = re.compile(r"[^.!?\n]*+(?:[.!?\n]++\s*+|\Z)")
_WORD = re.compile(r"[\x09-\x0D\x20]*+[^\x09-\x0D\x20]++[\x09-\x0D\x20]*+")
_LAST = (1 << 63) - 1


def _least(x: np.ndarray, reach: int) -> np.ndarray:
    """Positions of values less than the ``reach`` before and at most those after them."""
    ok = x >= 0
    for d in range(1, reach + 1):
        ok[d:] &= x[d:] < x[:-d]
        ok[:-d] &= x[:-d] <= x[d:]
    return np.flatnonzero(ok)


def sentences(text: str, longest: int = LONGEST, reach: int = REACH) -> list[str]:
    """Stretches that together are the text."""
    units = [u for u in _UNIT.findall(text) if u]
    long, digests, at = [], [-1] * reach, []  # -1: nothing within reach of a unit's end is the least
    for n, unit in enumerate(units):
        if len(unit) > 2 * longest:
            words = unit.lower().encode("utf-8", "surrogatepass").split()  # words as ASCII has them
            if len(words) > longest:
                long.append(n)
                at.append(len(digests))
                digests += map(crc32, words)
                digests += [-1] * reach
    if not long:
        return units
    least = _least(np.array(digests, np.int64), reach)
    out, done = [], 0
    edges = np.searchsorted(least, [*at, len(digests)]).tolist()
    least = least.tolist()
    for n, first, a, b in zip(long, at, edges[:-1], edges[1:], strict=True):
        out += units[done:n]
        words = _WORD.findall(units[n])
        cuts = [0, *(x - first + 1 for x in least[a:b]), len(words)]
        out += ["".join(words[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        done = n + 1
    return out + units[done:]


def _real(parts: list[str]) -> np.ndarray:
    return np.array([i for i, p in enumerate(parts) if not p.isspace()], np.int64)


def spans(text: str | None, run: int = RUN) -> np.ndarray:
    """Hash of each run; run k holds the k-th sentence with words and the run - 1 next ones."""
    return _hashes(sentences(text or ""), run)


def _hashes(parts: list[str], run: int) -> np.ndarray:
    parts = [" ".join(p.lower().split()).encode("utf-8", "surrogatepass") for p in parts]
    h = xxhash.xxh64_intdigest
    own = np.array([h(p) for p in parts if p], np.uint64)
    if len(own) < run:
        return np.zeros(0, np.int64)
    x = np.zeros(len(own) - run + 1, np.uint64)
    for d in range(run):  # splitmix64 after each sentence: the order of sentences counts
        x = x * np.uint64(3) + own[d : d + len(x)] + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x.view(np.int64)


def all_spans(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, text, digest, n_sentences, h and k (hash and number of each run, its first occurrence in the
    row), own (numbers of the others)."""

    @F.pandas_udf("n_sentences long, h array<long>, k array<int>, own array<int>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            parts = sentences(t or "")
            h = _hashes(parts, run)
            first = np.zeros(len(h), bool)
            first[np.unique(h, return_index=True)[1]] = True
            rows.append((len(parts), h[first], np.flatnonzero(first).astype(np.int32), np.flatnonzero(~first).astype(np.int32)))
        return pd.DataFrame(rows, columns=["n_sentences", "h", "k", "own"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", "doc_id", "text", F.xxhash64("text").alias("digest"), cut("text").alias("s")).select("row", "doc_id", "text", "digest", "s.*")


def _attach(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` (h, ...) that have a group, with its columns. ``groups``: durable, one row an h, n rows each."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * SHARE > total
    met = rows.join(F.broadcast(groups.where(often)), "h", "left")  # at most SHARE groups are that frequent
    rare = met.where("n is null").select(*rows.columns).join(groups.where(~often), "h")
    return met.where("n is not null").unionByName(rare)


def repeats(found: DataFrame) -> DataFrame:
    """``found``: durable rows of ``all_spans``. row, cut (array of run numbers): what to remove beside ``own``."""
    once = found.select("row", F.coalesce("doc_id", F.lit(_LAST)).alias("at"), F.inline(F.arrays_zip("h", "k")))
    groups = materialize(once.groupBy("h").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    hits = materialize(_attach(once, groups).select("row", "at", "h", "k", "first"), "hits")
    gone = hits.where("at <> first").select("row", "k")
    # Several rows may share the first id: of these the least by digest and row number is the first.
    same = hits.where("at = first").select("row", "h", "k")
    ties = materialize(same.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "ties")
    if not ties.isEmpty():
        tied = _attach(same, ties).select("row", "h", "k").join(found.select("row", "digest"), "row")
        tied = materialize(tied, "tied")
        order = F.struct("digest", "row")
        heads = tied.groupBy("h").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("n"))
        gone = gone.union(_attach(tied, materialize(heads, "heads")).where(order != F.col("head")).select("row", "k"))
    return gone.groupBy("row").agg(F.collect_list("k").alias("cut"))


def remove_repeats(docs: DataFrame, run: int = RUN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_sentences, n_removed (long), text (what is left)."""
    if run < 1:
        raise ValueError("a run holds at least one sentence")
    found = materialize(all_spans(docs, run, doc_id, text), "spans")
    joined = found.select("row", "doc_id", "text", "n_sentences", "own").join(repeats(found), "row", "left")

    @F.pandas_udf("n_removed long, text string")
    def keep(texts: pd.Series, owns: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        out = []
        for t, own, cut in zip(texts, owns, cuts, strict=True):
            ks = np.concatenate([np.asarray(x, np.int64) for x in (own, cut) if x is not None])
            if not len(ks):
                out.append((0, t))
                continue
            parts = sentences(t)
            real = _real(parts)
            gone = np.zeros(len(parts) + 1, np.int64)
            np.add.at(gone, real[ks], 1)
            np.add.at(gone, real[ks + run - 1] + 1, -1)
            gone = np.cumsum(gone)[:-1] > 0
            out.append((int(gone.sum()), "".join(p for p, g in zip(parts, gone, strict=True) if not g)))
        return pd.DataFrame(out, columns=["n_removed", "text"])

    return joined.select("doc_id", "n_sentences", keep("text", "own", "cut").alias("k")).select("doc_id", "n_sentences", "k.*")
