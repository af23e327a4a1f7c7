import numpy as np
import pytest

from statflow.llm import ann


def _brute(vectors, k=5, every=50):
    ids = np.array([i for i, _ in vectors])
    x = np.array([v for _, v in vectors], np.float64)
    u = x / np.abs(x).max(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    out = {}
    for i, q in zip(ids, u, strict=True):
        if i % every == 0:
            s = u @ q
            keep = ids != i
            order = np.lexsort((ids[keep], -np.round(s[keep], 12)))[:k]
            out[i] = (ids[keep][order].tolist(), s[keep][order])
    return out


def _compare(rows, want, least):
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    assert set(got) <= set(want)
    hits = total = 0
    for q, (ids, scores) in want.items():
        found = got.get(q, [])
        assert [x[2] for x in found] == list(range(1, len(found) + 1)) and len(found) == len(ids)
        s = [x[1] for x in found]
        assert all(a >= b for a, b in zip(s, s[1:], strict=False))
        hits += len({x[0] for x in found} & set(ids))
        total += len(ids)
        for i, v, _ in found:
            if i in ids:
                assert v == pytest.approx(scores[ids.index(i)], abs=1e-12)
    assert hits >= least * total


def test_recall(spark, sf_dir):
    for folder in {sf_dir, "/root/testdata/sf0.01"}:
        df = spark.read.parquet(f"{folder}/embeddings.parquet")
        _compare(ann.search(df).collect(), _brute([(r["vec_id"], r["embedding"]) for r in df.collect()]), 0.9)


def test_copies_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(1000 + i, [1.0] * 8) for i in range(300)]
    odd = [(2000, None), (2050, []), (2100, [0.0] * 8), (2150, [1.0, None] + [0.0] * 6), (2200, [float("nan")] + [1.0] * 7), (2250, [float("inf")] + [1.0] * 7), (2300, [1.0] * 5), (None, [1.0] * 8)]
    big = [(3000, [1e300] * 7 + [1.1e300]), (3050, [1e-300] * 7 + [1.1e-300])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows + odd + big + rows[:5]], "vec_id long, embedding array<double>, list long")
    found = ann.search(df, probe=1.0).collect()
    _compare(found, _brute(rows + big), 0.99)
    hot = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 1100]
    assert hot == [1000, 1001, 1002, 1003, 1004]


def test_few_and_none(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (51, [0.0, 1.0]), (52, [-1.0, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r["vec_id"]) for r in ann.search(df).collect()] == [(1, 51), (2, 52)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 50")).count() == 0
