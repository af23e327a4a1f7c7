"""SimHash near-duplicates by tiled exact comparison.

1. One fingerprint per document: 64 bits, each set where it is set in over half
   of the XXH64 hashes of the text's shingles.
2. Distinct fingerprints only are compared. Each belongs to a cell by the
   population counts of its upper and lower half (two counts to a step); cells
   whose counts must differ by more than the radius never meet. Cells of more than
   BLOCK fingerprints are split by hash into blocks, so a task holds two blocks
   at most, whatever the data.
3. Within a task both blocks are sorted by the population counts of their eight
   bytes and cut into tiles; a pair of tiles is skipped where the counts' ranges
   lie further apart than the radius, all others are compared in full: numpy
   exclusive-or and bit counts.
4. A task returns a spanning forest of the links it found, never all pairs:
   a group of m near copies gives m - 1 edges. Components come from alternating
   star steps over those edges.

The comparison is exact: every link within the radius counts. Comparing all
pairs is quadratic in the distinct fingerprints by nature; cells and tiles cut
its constant.

Edge cases: a null or empty text, or one of white space only, has fingerprint
zero and is linked like any other; fewer words than a shingle give one shingle
of them all; ties (exactly half) leave a bit unset; repeated rows of one doc_id
each get a row; null doc_ids get a fingerprint and the component of it, and
never name a component unless no other id is there; an empty table gives none;
extra columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statflow.operators.components import star_components
from statflow.plans.durable import BATCH_BYTES, materialize
from statflow.plans.lookup import join_lookup, local_table

SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 32_768
TILE = 256
WIDE = 512
#: For near-duplicates by similarity. Shingle sets of similarity s differ in a share
#: acos(2 s / (1 + s)) / pi of the bits: 0.151 at 0.8, give or take 0.016 over 512 bits. Pairs within
#: FIRST bits of the first word and MAYBE of all are candidates - at 0.8 that is more than four and five
#: deviations off, so about four pairs in 100 000 are missed there and fewer above; the shingles decide.
WIDTH = 8
SIMILARITY = 0.8
FIRST = 22
MAYBE = 118
#: At most this many shingles to a block, so that a task may hold those of two blocks.
HELD = 4_000_000
#: Bounds where sketches alone decide (``similar``).
NEAR = 18
CLOSE = 90
_ONES = np.uint64(0x0101010101010101)
_STEPS = np.array([[k * 0x9E3779B97F4A7C15 % 2**64] for k in range(WIDTH)], np.uint64)


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    h = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return np.array([h(b" ".join(parts), SEED)] if parts else [], np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle or None].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    hashes = _shingles(text, shingle)
    return int(_majority(hashes[None])[0]) if len(hashes) else 0


def _majority(hashes: np.ndarray) -> np.ndarray:
    """``hashes``: (words, n). Per word the bits that are set in over half of its n hashes."""
    words, n = hashes.shape
    counts = np.zeros((words, 8, 8), np.int64)  # word, byte, bit
    for at in range(0, n, 255 * 32):
        part = hashes[:, at : at + 255 * 32]
        if pad := -part.shape[1] % 32:
            part = np.concatenate([part, np.zeros((words, pad), np.uint64)], axis=1)
        part = part.reshape(words, -1, 32)
        for bit in range(8):
            lanes = ((part >> np.uint64(bit)) & _ONES).sum(axis=1, dtype=np.uint64)  # one bit of each byte; 255 sums fit a byte
            counts[:, :, bit] += np.ascontiguousarray(lanes).view(np.uint8).reshape(words, 32, 8).sum(axis=1, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=2, bitorder="little").reshape(words, 8).view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.select(F.col(doc_id).alias("doc_id"), of(F.col(text)).alias("fp"))


def _neighbours(radius: int) -> list[tuple[int, int]]:
    """Steps between cells whose counts can lie within the radius; half of them and (0, 0)."""
    gap = lambda d: max(0, 2 * abs(d) - 1)
    span = range(-(radius // 2 + 1), radius // 2 + 2)
    return [(a, b) for a in span for b in span if (a, b) >= (0, 0) and gap(a) + gap(b) <= radius]


def _byte_counts(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint8).reshape(-1, 8)).astype(np.int16)


class _Tiles:
    """A block in order of its bytes' counts, with each tile's least and largest counts."""

    def __init__(self, fps: np.ndarray):
        counts = _byte_counts(fps)
        half = counts.reshape(-1, 4, 2).sum(axis=2)
        order = np.lexsort([*counts.T[::-1], *half.T[::-1]])
        self.fps, counts = fps[order], counts[order]
        cuts = np.arange(0, len(fps), TILE)
        self.cuts = [(a, min(a + TILE, len(fps))) for a in cuts]
        self.low = np.minimum.reduceat(counts, cuts, axis=0)
        self.high = np.maximum.reduceat(counts, cuts, axis=0)
        half = half[order]
        self.low2 = np.minimum.reduceat(half, cuts, axis=0)
        self.high2 = np.maximum.reduceat(half, cuts, axis=0)


def _gaps(al: np.ndarray, ah: np.ndarray, bl: np.ndarray, bh: np.ndarray) -> np.ndarray:
    return np.maximum(0, np.maximum(bl - ah, al - bh)).sum(axis=1)


def forest(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> np.ndarray:
    """Spanning forest, as an (n, 2) array of fingerprints, of the links between ``a``
    and ``b`` (within ``a`` if None): uint64 arrays of distinct values."""
    same = b is None
    ta = _Tiles(a)
    tb = ta if same else _Tiles(b)
    shift = 0 if same else len(a)
    values = ta.fps if same else np.concatenate([ta.fps, tb.fps])
    parent = np.arange(len(values))
    edges: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (a0, a1) in enumerate(ta.cuts):
        first = i if same else 0
        gap = np.maximum(
            _gaps(ta.low[i], ta.high[i], tb.low[first:], tb.high[first:]),
            _gaps(ta.low2[i], ta.high2[i], tb.low2[first:], tb.high2[first:]),
        )
        x = ta.fps[a0:a1, None]
        for j in np.flatnonzero(gap <= radius) + first:
            b0, b1 = tb.cuts[j]
            p, q = np.nonzero(np.bitwise_count(x ^ tb.fps[None, b0:b1]) <= radius)
            if same and i == j:
                keep = p < q
                p, q = p[keep], q[keep]
            if not len(p):
                continue
            p, q = p + a0, q + b0 + shift
            # Links inside one tree bring nothing: only one per pair of trees is looked at.
            roots = np.array([find(z) for z in range(a0, a1)])[p - a0], np.array([find(z) for z in range(b0 + shift, b1 + shift)])[q - b0 - shift]
            _, at = np.unique(roots[0] * len(values) + roots[1], return_index=True)
            for k in at:
                u, v = find(p[k]), find(q[k])
                if u != v:
                    parent[max(u, v)] = min(u, v)
                    edges.append((p[k], q[k]))
    return values[np.array(edges, np.int64).reshape(-1, 2)]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``fps``: fp (long), distinct. Edges u, v (long) that connect what links within the radius connect."""
    high = F.bit_count(F.shiftrightunsigned("fp", 32))
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    cells = fps.select("fp", F.floor(high / 2).cast("int").alias("x"), F.floor(low / 2).cast("int").alias("y"))
    # At most 17 x 17 cells, whatever the data: their sizes may come to the driver.
    blocks = {(r["x"], r["y"]): -(-r["n"] // block) for r in cells.groupBy("x", "y").agg(F.count("*").alias("n")).collect()}
    steps, homes = [], []
    for (x, y), n in sorted(blocks.items()):
        for a, b in _neighbours(radius):
            if m := blocks.get((x + a, y + b)):
                steps.append((x, y, x + a, y + b, n, m, 0))
                if (a, b) != (0, 0):
                    homes.append((x + a, y + b, x, y, m, n, 1))
    spark = fps.sparkSession
    if not steps:
        return local_table(spark, [], "u long, v long")
    # At most 289 cells of at most 21 neighbours each: a bounded table.
    plan = F.broadcast(local_table(spark, steps + homes, "x int, y int, ox int, oy int, n int, m int, side int"))
    met = cells.join(plan, ["x", "y"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n").cast("long")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    within = (F.col("x") == F.col("ox")) & (F.col("y") == F.col("oy"))
    # A cell meets itself: block i with every j >= i, in the pair (i, j) as side 0 and in (j, i) as side 1.
    code = lambda x, y, k: (F.col(x) * 32 + F.col(y)).cast("long") * (1 << 24) + F.col(k)
    here, there = code("x", "y", "own"), code("ox", "oy", "other")
    flip = F.when(within, F.col("own") > F.col("other")).otherwise(F.col("side") == 1)
    met = met.select("fp", F.when(flip, there).otherwise(here).alias("a"), F.when(flip, here).otherwise(there).alias("b"), flip.cast("int").alias("side"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        fp = pdf["fp"].to_numpy().view(np.uint64)
        a, b = fp[side == 0], fp[side == 1]
        one = pdf["alone"].iloc[0]
        if len(a) == 0 or (len(b) == 0 and not one):
            return pd.DataFrame({"u": [], "v": []}, dtype=np.int64)
        return pd.DataFrame(forest(a, None if one else b, radius).view(np.int64), columns=["u", "v"])

    met = met.withColumn("alone", F.col("a") == F.col("b"))
    return met.groupBy("a", "b").applyInPandas(compare, "u long, v long")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id
    of all documents reachable over links)."""
    marked = materialize(fingerprints(docs, doc_id, text, shingle), "fingerprints", batch=BATCH_BYTES)
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    # Written first: in one stage with what the components do in Python, each task would hold two workers.
    found = star_components(materialize(links(classes.select("fp"), radius), "links"))
    named = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "named")
    first = named.groupBy("component").agg(F.min("first").alias("component_id"))
    lookup = named.join(first, "component").select("fp", "component_id")
    # A hot fingerprint's documents are dealt over 16 tasks, each with a copy of its row.
    lookup = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int"))
    out = salted.join(lookup, ["fp", "salt"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketch(text: str | None, shingle: int = 5) -> bytes:
    """WIDTH fingerprints of one text by independent hashes of its distinct shingles, 64 bits each:
    with repeats, one line that two texts repeat would outvote all they do not share."""
    return _sketch(np.unique(_shingles(text, shingle)))


def _sketch(hashes: np.ndarray) -> bytes:
    if not len(hashes):
        return bytes(8 * WIDTH)
    x = hashes[None] + _STEPS  # splitmix64: one hash per shingle, WIDTH mixes of it
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(x ^ (x >> np.uint64(31))).tobytes()


def _near(a: np.ndarray, b: np.ndarray | None, near: int, close: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a followed by b, in a alone if None) of the pairs of sketches that differ in at most
    ``near`` bits of the first word and ``close`` bits in all, tile by tile. Tiles are in order of
    the first word's population count; pairs of tiles whose counts lie further apart than ``near`` are skipped."""
    same = b is None
    order_a = np.argsort(np.bitwise_count(a[:, 0]), kind="stable")
    order_b = order_a if same else np.argsort(np.bitwise_count(b[:, 0]), kind="stable") + len(a)
    rows = a if same else np.concatenate([a, b])
    xa, xb = rows[order_a], rows[order_b]
    ones_a, ones_b = np.bitwise_count(xa[:, 0]).astype(int), np.bitwise_count(xb[:, 0]).astype(int)
    fa, fb = np.ascontiguousarray(xa[:, 0]), np.ascontiguousarray(xb[:, 0])
    words, bits = np.empty((WIDE, WIDE), np.uint64), np.empty((WIDE, WIDE), np.uint8)
    for a0 in range(0, len(fa), WIDE):
        a1 = min(a0 + WIDE, len(fa))
        left = fa[a0:a1, None]
        for b0 in range(a0 if same else 0, len(fb), WIDE):
            b1 = min(b0 + WIDE, len(fb))
            if ones_b[b0] - ones_a[a1 - 1] > near:
                break
            if ones_a[a0] - ones_b[b1 - 1] > near:
                continue
            x, n = words[: a1 - a0, : b1 - b0], bits[: a1 - a0, : b1 - b0]
            np.bitwise_count(np.bitwise_xor(left, fb[None, b0:b1], out=x), out=n)
            p, q = np.divmod(np.flatnonzero(n <= near), b1 - b0)
            if same and a0 == b0:
                p, q = p[p < q], q[p < q]
            if not len(p):
                continue
            p, q = p + a0, q + b0  # a few in a thousand pairs of unlike texts
            ok = np.bitwise_count(xa[p] ^ xb[q]).sum(axis=1) <= close
            if ok.any():
                yield order_a[p[ok]], order_b[q[ok]]


class _Forest:
    """Trees over rows, as one label a row; the links that joined them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def join(self, i: int, j: int) -> None:
        u, v = self.label[i], self.label[j]
        if u != v:
            self.label[self.label == max(u, v)] = min(u, v)
            self.links.append((i, j))

    def edges(self) -> np.ndarray:
        return np.array(self.links, np.int64).reshape(-1, 2)


def similar(a: np.ndarray, b: np.ndarray | None, near: int = NEAR, close: int = CLOSE) -> np.ndarray:
    """Spanning forest, as (n, 2) positions, of the pairs that ``_near`` finds."""
    trees = _Forest(len(a) + (0 if b is None else len(b)))
    for p, q in _near(a, b, near, close):
        for i in np.unique(p):
            js = q[p == i]
            for j in js[trees.label[js] != trees.label[i]]:
                trees.join(i, j)
    return trees.edges()


def alike(sets: list[np.ndarray], sketches: np.ndarray, second: np.ndarray | None, near: int = FIRST, close: int = MAYBE, similarity: float = SIMILARITY) -> np.ndarray:
    """Spanning forest, as (n, 2) positions, of the candidates whose sets (ascending hashes, not
    empty) have the similarity; between the rows marked ``second`` and the others, or all if None. Only
    candidates of different trees are looked at, all of one row at once."""
    order = np.arange(len(sets)) if second is None else np.concatenate([np.flatnonzero(~second), np.flatnonzero(second)])
    cut = len(sets) if second is None else int((~second).sum())
    trees = _Forest(len(sets))
    rows = sketches[order]
    sizes = np.array([len(s) for s in sets])
    thousandths = round(similarity * 1000)
    for p, q in _near(rows[:cut], None if second is None else rows[cut:], near, close):
        p, q = order[p], order[q]
        at = np.argsort(p, kind="stable")
        p, q = p[at], q[at]
        heads = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else []
        for a, b in zip(heads, [*heads[1:], len(p)], strict=True):
            i, js = p[a], q[a:b]
            # No set can share more than the smaller one holds.
            fits = np.minimum(sizes[i], sizes[js]) * 1000 >= thousandths * np.maximum(sizes[i], sizes[js])
            js = js[fits & (trees.label[js] != trees.label[i])]
            for c in range(0, len(js), 256):
                part = js[c : c + 256]
                part = part[trees.label[part] != trees.label[i]]
                if not len(part):
                    continue
                joined = np.concatenate([sets[j] for j in part])
                k = np.minimum(np.searchsorted(sets[i], joined), sizes[i] - 1)
                common = np.add.reduceat((sets[i][k] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[part])[:-1]]))
                # In whole numbers of a thousandth: 4 of 5 in common is 0.8.
                for j in part[common * 1000 >= thousandths * (sizes[i] + sizes[part] - common)]:
                    trees.join(i, j)
    return trees.edges()


def _words(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each value of a column of whole 64-bit words, as a view of the column's own memory."""
    out = []
    for part in column.chunks:
        _, offsets, data = part.buffers()
        width = np.int64 if pa.types.is_large_binary(part.type) else np.int32
        cuts = np.frombuffer(offsets, width, len(part) + 1, part.offset * np.dtype(width).itemsize).tolist()
        words = np.frombuffer(data, np.uint64, (cuts[-1] - cuts[0]) // 8, cuts[0])
        out += [words[(a - cuts[0]) // 8 : (b - cuts[0]) // 8] for a, b in zip(cuts, cuts[1:])]
    return out


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _deal(classes: DataFrame, block: int, held: int, similarity: float) -> DataFrame | None:
    """``classes``: id, size (> 0), ... once for each pair (a, b) of blocks that may hold candidates of it: a, b,
    second (of block b). Sets of a similarity have sizes within it, so with cells of sizes a factor
    1 / similarity wide only a cell and the next one meet. Cells are cut by hash into blocks of at most
    ``block`` rows and about ``held`` shingles."""
    width = math.log(1 / similarity) * (1 + 1e-6)  # a little more, for sizes exactly that far apart
    cells = classes.withColumn("x", F.floor(F.log("size") / width).cast("int"))
    # About a hundred cells, whatever the data: sizes grow by a factor from one to the next.
    n = {r["x"]: max(-(-r["n"] // block), -(-r["s"] // held)) for r in cells.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).collect()}
    steps = [(x, y, n[x], n[y], int(y < x)) for x in sorted(n) for y in (x - 1, x, x + 1) if y in n]
    if not steps:
        return None
    plan = F.broadcast(local_table(classes.sparkSession, steps, "x int, y int, n int, m int, back int"))
    met = cells.join(plan, "x").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n").cast("long")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    code = lambda x, k: F.col(x).cast("long") * (1 << 32) + F.col(k)
    here, there = code("x", "own"), code("y", "other")
    # A cell meets itself: block i with every j >= i.
    flip = F.when(F.col("x") == F.col("y"), F.col("own") > F.col("other")).otherwise(F.col("back") == 1)
    keep = [c for c in classes.columns if c != "size"]
    return met.select(*keep, F.when(flip, there).otherwise(here).alias("a"), F.when(flip, here).otherwise(there).alias("b"), flip.alias("second"))


def near_duplicates(classes: DataFrame, texts: Callable[[DataFrame], DataFrame], block: int = BLOCK, held: int = HELD, similarity: float = SIMILARITY) -> DataFrame:
    """``classes``: durable id, size, sketch of distinct shingle sets; ``texts`` gives id and set (binary, ascending
    hashes) of the ids it gets. Edges u, v that connect what pairs of the similarity connect. First each pair of
    blocks is compared by sketches and names the rows - never the pairs - that have a candidate; then
    the shingles of these rows meet there, and a task checks the candidates that are not
    connected yet."""
    none = local_table(classes.sparkSession, [], "u long, v long")
    dealt = _deal(classes.where("size > 0"), block, held, similarity)
    if dealt is None:
        return none

    def sides(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray | None]:
        rows = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(-1, WIDTH)
        return rows, None if pdf["a"].iat[0] == pdf["b"].iat[0] else pdf["second"].to_numpy()

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, second = sides(pdf)
        hit = np.zeros(len(rows), bool)
        if second is None:
            for p, q in _near(rows, None, FIRST, MAYBE):
                hit[p] = hit[q] = True
        elif second.any() and not second.all():
            order = np.concatenate([np.flatnonzero(~second), np.flatnonzero(second)])
            for p, q in _near(rows[~second], rows[second], FIRST, MAYBE):
                hit[order[p]] = hit[order[q]] = True
        return pdf.loc[hit, ["a", "b", "second", "id"]]

    named = materialize(dealt.groupBy("a", "b").applyInPandas(name, "a long, b long, second boolean, id long"), "candidates")
    sets = materialize(texts(named.select("id").distinct()), "shingles", batch=BATCH_BYTES)
    held_rows = named.join(sets, "id").join(classes.select("id", "sketch"), "id")

    def check(table: pa.Table) -> pa.Table:
        second = None if table["a"][0] == table["b"][0] else table["second"].to_numpy()
        rows = np.array(_words(table["sketch"]), np.uint64).reshape(-1, WIDTH)
        found = alike(_words(table["set"]), rows, second, similarity=similarity)
        return pa.table(dict(zip("uv", table["id"].to_numpy()[found].T, strict=True)))

    # Written before anything else is done in Python: in one stage, each task would hold two workers.
    return materialize(held_rows.groupBy("a", "b").applyInArrow(check, "u long, v long"), "links", batch=BATCH_BYTES)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, block: int = BLOCK, held: int = HELD, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near-duplicates, texts whose sets of word shingles have a Jaccard similarity of
    ``similarity`` or more: of each group - all that such links connect - one row stays, that of the least
    doc_id, of several rows of it the one whose id and text have the least digest, of rows alike in both one
    (by a digest of its columns). Texts without words are alike. Rows are told apart by id and text, so one id
    may stand for several texts; rows without an id cannot be named, take no part and all stay. Sketches of WIDTH fingerprints find candidates, tile by tile
    (see ``_near``); the shingles decide. Texts are read again only where they have a candidate, and
    shuffled only if what goes is too much to broadcast."""

    @F.pandas_udf("sketch binary, same binary, size int")
    def of(texts: pd.Series) -> pd.DataFrame:
        marks = []  # of a text at a time: sets of a whole batch would be as large as its texts
        for t in texts:
            x = np.unique(_shingles(t, shingle))
            marks.append((_sketch(x), xxhash.xxh3_128_digest(x.tobytes()), len(x)))
        sketches, same, sizes = zip(*marks, strict=True) if marks else ((), (), ())
        return pd.DataFrame({"sketch": sketches, "same": same, "size": np.array(sizes, np.int32)})

    @F.pandas_udf("binary")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_shingles(t, shingle)).tobytes() for t in texts])

    known = lambda c, mark: F.coalesce(F.concat(F.lit(mark), c.cast("string")), F.lit("-"))
    key = _free(docs, "row_key")
    keyed = docs.withColumn(key, F.unhex(F.md5(F.concat_ws(":", known(F.col(doc_id), "i"), known(F.col(text), "t")))))
    marked = keyed.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(key).alias("key"), of(F.col(text)).alias("m"))
    marked = materialize(marked.select("doc_id", "key", "m.*"), "marks", batch=BATCH_BYTES)
    # Texts of the same shingles are one class. Once written, its number stands.
    head = F.struct("doc_id", "key")
    classes = marked.groupBy("same").agg(F.min(head).alias("head"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()).drop("same"), "classes")

    def texts(ids: DataFrame) -> DataFrame:
        heads = classes.join(ids, "id").select(F.col("head.key").alias(key), F.col("id").alias("__id"))
        rows = join_lookup(keyed.select(key, F.col(text).alias("__text")), heads, key, "__text", "inner")
        return rows.select(F.col("__id").alias("id"), shingles("__text").alias("set")).dropDuplicates(["id"])

    stars = star_components(near_duplicates(classes.select("id", "size", "sketch"), texts, block, held, similarity)).withColumnRenamed("node", "id")
    groups = classes.select("id", "head").join(stars, "id", "left").groupBy(F.coalesce("component", "id")).agg(F.min("head").alias("head"))
    heads = groups.select(F.col("head.key").alias("key"))
    rows = marked.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows.join(heads.withColumn("stays", F.lit(True)), "key", "left"), "rows")
    gone = rows.where("stays is null").select(F.col("key").alias(key))
    kept = join_lookup(keyed, gone, key, doc_id, "left_anti")
    many = materialize(rows.where("stays and n > 1").select(F.col("key").alias(key)), "repeated")
    if not many.isEmpty():
        least = F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.xxhash64(F.to_json(F.struct(*docs.columns))))
        several = join_lookup(keyed, many, key, doc_id, "left_semi").groupBy(key).agg(least.alias("row")).select("row.*")
        return join_lookup(kept, many, key, doc_id, "left_anti").drop(key).unionByName(several)
    return kept.drop(key)
