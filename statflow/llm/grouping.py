"""Best-fit packing after linear grouping (Fernandez de la Vega and Lueker 1981).

Documents become token ids plus a closing id and are cut only where they are
longer than a sequence. The plan is made from the histogram of piece lengths
alone - at most ``capacity`` numbers, whatever the corpus:

1. pieces of over ``capacity / SMALL`` ids are large: in descending order they
   fall into GROUPS groups of equal cardinality, each rounded up to its longest;
2. the configurations of these few sizes that fill fewest sequences are found by
   linear programming with column generation (a knapsack prices columns);
3. each whole use of a configuration gets actual lengths: the longest left of at
   most each group's size, and for its last spot the longest left that fits;
4. what is left, large or small, goes longest first into the sequence where it
   fits best, or opens new ones. A configuration that actual lengths would leave more than
   a spare of ids open is given up in 3; several spares are planned and the plan
   of fewest sequences is taken.

Runs of sequences with the same layout are kept as one entry, so the plan stays
small. Pieces then meet their place by their rank among the pieces of the same
length. That rank is distributed: the pieces of each length are dealt by hash into as many
buckets as their number asks for, ranked inside (length, bucket) and shifted by the counts of the
buckets before, so a length that a third of all pieces share spreads over many tasks; order by id
makes reruns agree.

Edge cases: a null or empty text is one piece, the closing id; repeated rows are
packed one by one (which of two equal rows comes first is open and without
effect); an empty table gives no rows; extra columns are not carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statflow.llm.tokens import word_tokenizer
from statflow.plans.durable import BATCH_BYTES, materialize
from statflow.plans.lookup import local_table

CAPACITY = 2048
SMALL = 16
GROUPS = 64
#: Ids that a substituted configuration may leave open: all are planned, the fewest sequences win.
SPARES = (0, 8, 32, 128, CAPACITY)
BUCKET = 5_000
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: PIECES, and ids (little-endian unsigned 32-bit) with ``with_ids``."""
    width = capacity * 4
    kind = "array<struct<" + ", ".join(c.replace(" ", ":") for c in PIECES.split(", ")[1:]) + (", ids:binary" if with_ids else "") + ">>"

    @F.pandas_udf(kind)
    def cut(texts: pd.Series) -> pd.Series:
        encode, out = word_tokenizer(vocabulary).encode, []
        for t in texts:
            ids = encode(t or "") + END.to_bytes(4, "little")
            parts = [ids[at : at + width] for at in range(0, len(ids), width)]
            out.append([(k, k * capacity, len(p) // 4, zlib.crc32(p), *([p] if with_ids else [])) for k, p in enumerate(parts)])
        return pd.Series(out)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.inline(cut(F.col(text))))


def _price(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best multiset of sizes within the capacity: its value and counts."""
    best = np.zeros(capacity + 1)
    steps = []
    for g in np.flatnonzero(values > 1e-12):
        k, most = 1, capacity // sizes[g]
        while k <= most:
            w, v = sizes[g] * k, values[g] * k
            new = best[:-w] + v
            better = new > best[w:] + 1e-12
            steps.append((g, k, w, better))
            best[w:] = np.where(better, new, best[w:])
            k *= 2
    counts, c = np.zeros(len(sizes), np.int64), capacity
    for g, k, w, better in reversed(steps):
        if c >= w and better[c - w]:
            counts[g] += k
            c -= w
    return float(counts @ values), counts


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """(counts by size, whole uses): the rounded-down optimum of the covering program."""
    k = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(rounds):
        value, new = _price(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ new
        ok = step > 1e-12
        ratio = np.where(ok, x / np.where(ok, step, 1), np.inf)
        out = int(np.argmin(ratio))
        theta = ratio[out]
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        columns[:, out] = new
        inverse[out] /= step[out]
        others = np.arange(k) != out
        inverse[others] -= np.outer(step[others], inverse[out])
    return [(columns[:, i].astype(np.int64), int(x[i] + 1e-9)) for i in range(k) if x[i] + 1e-9 >= 1]


class _Plan:
    """Runs of sequences alike: first sequence, how many, what each holds as (length, first rank)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.used = capacity, dict(counts), dict.fromkeys(counts, 0)
        self.sequences, self.open, self.rooms, self.done = 0, {}, [], []

    def take(self, length: int, n: int) -> int:
        first = self.used[length]
        self.used[length] += n
        self.left[length] -= n
        return first

    def put(self, first: int, n: int, room: int, holds: list[tuple[int, int]]) -> None:
        if not n:
            return
        if room == 0:
            self.done.append((first, n, holds))
            return
        if room not in self.open or not self.open[room]:
            self.open[room] = []
            if room not in self.rooms:
                insort(self.rooms, room)
        self.open[room].append((first, n, holds))

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def best_fit(self, length: int) -> None:
        while self.left[length]:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                n = max(1, self.left[length] // each)
                self.put(self.new(n), n, self.capacity, [])
                continue
            room = self.rooms[at]
            first, n, holds = self.open[room].pop()
            if not self.open[room]:
                self.rooms.pop(at)
            each = min(room // length, self.left[length])
            fill = min(n, self.left[length] // each)
            ranks = [self.take(length, fill) for _ in range(each)]
            self.put(first + fill, n - fill, room, [(s, r + fill) for s, r in holds])
            self.put(first, fill, room - each * length, [*holds, *((length, r) for r in ranks)])

    def slots(self) -> np.ndarray:
        """Rows (length, first rank, n, first sequence, offset), in order of length and rank."""
        rows = []
        for first, n, holds in [*self.done, *(s for o in self.open.values() for s in o)]:
            at = 0
            for length, rank in holds:
                rows.append((length, rank, n, first, at))
                at += length
        out = np.array(rows, np.int64).reshape(-1, 5)
        return out[np.lexsort((out[:, 1], out[:, 0]))]


def _substitute(p: _Plan, lengths: list[int], chosen: list[tuple[np.ndarray, int]], sizes: np.ndarray, spare: int) -> None:
    """Actual lengths for the configurations: each spot gets the longest left of at most its
    group's size, the last spot the longest left that still fits. A configuration that what is
    left cannot fill but for ``spare`` ids is given up; its pieces go to the best fit."""
    have = [x for x in lengths if p.left[x]]
    for uses, times in chosen:
        spots = [int(sizes[g]) for g in np.flatnonzero(uses) for _ in range(uses[g])]
        while times > 0:
            picked, room = [], p.capacity
            for k, size in enumerate(spots):
                at = bisect_left(have, (room if k == len(spots) - 1 else size) + 1) - 1
                while at >= 0 and picked.count(have[at]) >= p.left[have[at]]:
                    at -= 1
                if at >= 0:
                    picked.append(have[at])
                    room -= have[at]
            if not picked or room > spare:
                break
            t = min(times, *(p.left[x] // picked.count(x) for x in set(picked)))
            p.put(p.new(t), t, room, [(x, p.take(x, t)) for x in picked])
            have = [x for x in have if p.left[x]] if any(not p.left[x] for x in picked) else have
            times -= t


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """``counts``: pieces by length. Slots (see ``_Plan.slots``) and the number of sequences."""
    lengths = sorted((x for x in counts if x < capacity), reverse=True)
    large = [x for x in lengths if x * small > capacity]
    total = sum(counts[x] for x in large)
    if total:
        # A group's size is its longest length; its demand, an equal share of the pieces.
        upto = np.cumsum([counts[x] for x in large])
        edges = np.unique(np.linspace(0, total, groups + 1).astype(np.int64))
        sizes = np.array(large)[np.searchsorted(upto, edges[:-1], side="right")]
        sizes, at = np.unique(sizes, return_index=True)
        sizes, demand = sizes[::-1], np.diff(np.append(edges[:-1][at[::-1]], total)).astype(float)
        chosen = configurations(sizes, demand, capacity)
    best = None
    for spare in SPARES if total else (0,):
        p = _Plan(counts, capacity)
        if n := counts.get(capacity, 0):
            p.put(p.new(n), n, 0, [(capacity, p.take(capacity, n))])
        if total:
            _substitute(p, sorted(large), chosen, sizes, spare)
        for x in lengths:
            p.best_fit(x)
        best = p if best is None or p.sequences < best.sequences else best
    return best.slots(), best.sequences


def ranked(cut: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds rank: 0, 1, ... among the pieces of one length, in an order that reruns keep. ``counts``: pieces by length."""
    shares = local_table(cut.sparkSession, [(x, -(-n // BUCKET)) for x, n in counts.items()], "length long, buckets long")  # at most ``capacity`` rows
    keyed = cut.join(F.broadcast(shares), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))).drop("buckets")
    sizes = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = keyed.withColumn("_n", F.row_number().over(within) - 1)
    return numbered.join(shifts, ["length", "bucket"]).withColumn("rank", F.col("shift") + F.col("_n")).drop("bucket", "shift", "_n")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut``: rows of PIECES, durable. Adds sequence_id and offset (long)."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    slots, _ = plan(counts, capacity)
    keys = slots[:, 0] << 44 | slots[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def look(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rank = rank.to_numpy()
        at = np.searchsorted(keys, length.to_numpy() << 44 | rank, side="right") - 1
        return pd.DataFrame({"sequence_id": slots[at, 3] + rank - slots[at, 1], "offset": slots[at, 4]})

    names = [c.split()[0] for c in PIECES.split(", ")]
    return ranked(cut, counts).select(*names, look("length", "rank").alias("at")).select(*names, "at.sequence_id", "at.offset")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(materialize(pieces(docs, vocabulary, capacity, doc_id, text), "pieces", batch=BATCH_BYTES), capacity)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (binary, little-endian unsigned
    32-bit, in order of offset), doc_ids and lengths (arrays, by offset). doc_id must be unique."""
    whole = materialize(pieces(docs, vocabulary, capacity, with_ids=True), "ids")
    placed = place(whole.drop("ids"), capacity).select("doc_id", "piece", "sequence_id", "offset")
    parts = whole.join(placed, ["doc_id", "piece"]).select("sequence_id", F.struct("offset", "doc_id", "length", "ids").alias("p"))
    # At most ``capacity`` ids meet in a row.
    rows = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return rows.select(
        "sequence_id", F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), "")).alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths")
    )
