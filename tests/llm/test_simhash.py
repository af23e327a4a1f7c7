import numpy as np
import pytest
from tests.llm import brute

from statflow.llm import simhash


def test_fingerprints_and_components(spark, sf_dir):
    texts = [None, "", " \n", "a b", "A B", "a b c d", "ÄB c d e", "x " * 5000] + ["a b c d"] * 3
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(i, brute.simhash(t)) for i, t in rows]
    want = brute.components(items, lambda a, b: (a ^ b).bit_count() <= 4)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.components(docs).collect()}
    assert got == {i: (f"{fp:016x}", want[i]) for i, fp in items}


@pytest.mark.parametrize("block", [40, 32768])
def test_links_lose_nothing(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 150, np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(0, 6)).astype(np.uint64), initial=np.uint64(0)) for b in base for _ in range(3)]
    fps = np.unique(np.concatenate([base, near, np.array([0, 1, 2**64 - 1, 7], np.uint64)]))
    items = [(int(x), int(x)) for x in fps.view(np.int64)]
    want = brute.components(items, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    df = spark.createDataFrame([(i,) for i, _ in items], "fp long")
    edges = [(r["u"], r["v"]) for r in simhash.links(df, 4, block).collect()]
    assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 4 for u, v in edges)
    linked = {frozenset(e) for e in edges}
    assert brute.components(items, lambda a, b: frozenset((a, b)) in linked) == want


def test_keep_one(spark):
    rows = [(1, "a b c d e f", 7), (2, "a b c d e f", 8), (2, "a b c d e f", 8), (3, "other words here now again", 9), (None, "a b c d e f", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    kept = simhash.keep_one(docs)
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert kept.columns == docs.columns and sorted(r["fp"] for r in kept.collect()) == [1, 7, 9]
    assert simhash.components(docs.limit(0)).count() == 0


def test_sketch_is_the_plain_majority():
    for text in (None, " ", "a b", "a b c d e f g", "x y " * 700, " ".join(str(i) for i in range(20000))):
        h = simhash._shingles(text, 5)
        want = []
        for k in range(simhash.WIDTH):
            word = 0
            for b in range(64):
                ones = 0
                for x in h.tolist():
                    x = (x + k * 0x9E3779B97F4A7C15) % 2**64
                    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                    ones += (x ^ x >> 31) >> b & 1
                    if len(h) > 2000:
                        break
                word |= (2 * ones > len(h)) << b
            want.append(word)
        got = np.frombuffer(simhash.sketch(text), np.uint64).tolist()
        assert got == want or len(h) > 2000 and all(x.bit_count() > 10 for x in got)


@pytest.mark.parametrize("block", [30, 70000])
def test_keep_one_by_similarity(spark, block):
    rng = np.random.default_rng(4)
    docs, groups = [], []
    for g in range(40):
        words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        docs.append((len(docs), " ".join(words)))
        groups.append(g)
        for edits in (0, 2, 4):  # each edit touches five shingles
            copy = list(words)
            for i in rng.choice(300, edits, replace=False):
                copy[i] = "new"
            docs.append((len(docs), " ".join(copy)))
            groups.append(g)
    base = [f"v{i}" for i in range(400)]
    docs += [(1000, " ".join(base)), (1001, " ".join(base[:200] + [f"u{i}" for i in range(200)]))]  # half in common: both stay
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(df, block=block).collect()}
    assert kept == {4 * g for g in range(40)} | {1000, 1001}


def test_similar_joins_large_groups_without_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, simhash.WIDTH, np.uint64)
    rows = np.repeat(base[None], 1500, axis=0)
    rows[np.arange(1500), rng.integers(0, simhash.WIDTH, 1500)] ^= np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)
    far = rng.integers(0, 2**64, (700, simhash.WIDTH), np.uint64)
    found = simhash.similar(np.concatenate([rows, far]), None)
    assert len(found) == 1499 and found.max() < 1500
    assert len(simhash.similar(rows[:900], rows[900:])) == 1499


def test_texts_that_share_a_repeated_line_both_stay(spark):
    line = " ".join(f"r{i}" for i in range(10))
    docs = []
    for k in range(60):
        own = [" ".join(f"d{k}w{i}" for i in range(a, a + 10)) for a in range(0, 210, 10)]
        docs.append((k, "\n".join(x for pair in zip(own, [line] * 20, strict=False) for x in pair) + "\n" + own[-1]))
    assert all(len(t.split()) == 410 for _, t in docs)
    assert simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).count() == 60


@pytest.mark.parametrize("block", [100, 70000])
def test_keep_one_checks_the_similarity(spark, sf_dir, block):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"v{i}" for i in range(1000)]
    rows += [(10**6 + k, " ".join(base[:-n] + [f"u{k}x{i}" for i in range(n)])) for k, n in enumerate((1, 60, 170, 170))]  # 0.65 - 0.89 to each other
    sets = [(i, set(simhash._shingles(t, 5).tolist())) for i, t in rows]
    want = brute.components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    assert kept == {i for i in want if want[i] == i}


def test_keep_one_goes_by_rows(spark):
    """Rows that share an id are told apart by their texts; of equal rows one stays; rows without an id all stay."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    c = " ".join(f"c{i}" for i in range(60))
    rows = [(1, a, 1), (5, a, 2), (5, b, 3), (None, b, 4), (None, c, 5), (None, c, 6), (7, None, 7), (8, " ", 8), (9, "x y", 9), (9, "x y", 9), (10, "x y z", 10), (11, a + " more", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key int")
    for parts in (1, 5):
        kept = simhash.keep_one(docs.repartition(parts)).collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept if r["text"]) == sorted([(1, a), (5, b), (0, b), (0, c), (0, c), (9, "x y"), (10, "x y z")])
        assert [r["row_key"] for r in kept if r["text"] is None] == [7] and len(kept) == 8


@pytest.mark.parametrize("block,held", [(40, 10**6), (10**5, 2000)])
def test_keep_one_matches_true_similarity(spark, block, held):
    """Planted copies of every similarity from 0.6 on, groups that hang together by chains, sizes exactly 4 to 5."""
    rng = np.random.default_rng(11)
    docs = []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(int(rng.integers(20, 400)))]
        docs.append(words)
        for _ in range(4):
            at = docs[-1] if rng.random() < 0.5 else words
            docs.append([w if rng.random() > rng.choice([0.005, 0.02, 0.04, 0.06]) else f"n{rng.integers(10**9)}" for w in at])
        docs += [words[: len(words) * 4 // 5], words + [f"t{i}" for i in range(len(words) // 4)]]
    docs += [[f"k{i}" for i in range(n)] for n in (8, 9, 4, 5, 6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    sets = [(i, set(simhash._shingles(t, 5).tolist())) for i, t in rows]
    want = brute.components(sets, lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), block=block, held=held).collect()}
    assert kept == {i for i in want if want[i] == i}


def test_unlike_templates_emit_no_pairs():
    """Many texts at 0.7 to each other: all are candidates, none links."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 280, np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 2**64, 60, np.uint64)])) for _ in range(700)]
    rows = np.stack([np.frombuffer(simhash._sketch(s), np.uint64) for s in sets])
    assert len(simhash.alike(sets, rows, None)) == 0 and len(simhash.alike(sets, rows, None, similarity=0.65)) == 699
