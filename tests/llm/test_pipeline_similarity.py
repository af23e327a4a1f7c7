"""The pipeline's stages in turn, with near-duplicates as the exact similarity of shingle sets has them."""

import hashlib
from collections import Counter

from tests.llm import brute
from tests.llm.test_native import _fill
from tests.llm.test_pipeline import _passes, _redact, docs  # noqa: F401

import corpus_pipeline
from statflow.llm.queries import vocabulary
from statflow.llm.tokens import WordTokenizer


def _shingles(text):
    w = brute.words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages_by_true_similarity(spark, docs):  # noqa: F811
    stages = dict(corpus_pipeline.STAGES)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if _passes(r["text"])]
    kept = stages["quality"](spark, docs, "").cache()
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(r[:2] for r in rows)

    one = stages["simhash"](spark, kept, "").cache()
    sets = {i: _shingles(t) for i, t, _ in rows}
    head = brute.components(sorted(sets.items()), lambda a, b: 5 * len(a & b) >= 4 * len(a | b))
    rows = list({r[0]: r for r in rows if head[r[0]] == r[0]}.values())
    assert one.columns == docs.columns and one.count() == len(rows)
    assert {r["doc_id"]: r["text"] for r in one.collect()} == {r[0]: r[1] for r in rows}

    clean = stages["pii"](spark, one, "").cache()
    rows = [(i, _redact(t), s) for i, t, s in rows]
    assert clean.columns == docs.columns and {r["doc_id"]: r["text"] for r in clean.collect()} == {i: t for i, t, _ in rows}

    mixed = stages["mix"](spark, clean, "").cache()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    target = _fill(dict(sizes))
    rate = {i: target[s] / sizes[s] for i, _, s in rows}
    draw = {i: int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:13], 16) / 2**52 for i in rate}
    want = {i: n for i, x in rate.items() if (n := int(x) + (draw[i] < x - int(x)))}
    assert mixed.columns == docs.columns and {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want

    packed = stages["pack"](spark, mixed, "").collect()
    tok = WordTokenizer(vocabulary())
    got, fill = Counter(), {}
    for r in packed:
        got[r["doc_id"]] += r["length"]
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == {i: want[i] * (len(tok.encode(t)) // 4 + 1) for i, t, _ in rows if i in want}
    assert all(sum(n for _, n in p) <= 2048 and all(o == sum(n for q, n in p if q < o) for o, _ in p) for p in fill.values())
    assert len(fill) <= sum(got.values()) / 2048 * 1.05 + 2
