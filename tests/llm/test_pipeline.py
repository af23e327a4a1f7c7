"""The pipeline against plain versions of its stages, each on what its predecessor kept."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.test_native import _fill

import corpus_pipeline
from statflow.llm import quality, simhash
from statflow.llm.queries import vocabulary
from statflow.llm.tokens import WordTokenizer


def _passes(text):
    n, chars, symbols, dup, repeat = brute.quality(text)
    lines = sum(bool(brute.WORD.search(x)) for x in (text or "").split("\n"))
    return not (n < 50 or 100 * repeat > 50 * n or 10 * symbols > n or chars < 2 * n or chars > 20 * n or 2 * dup > lines)


def _redact(text):
    _, _, joined = brute.pii(text)
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in joined.split(",") if s))
    out, at = "", 0
    for a, b, k in spans:
        out += text[at:a] + (f"<{k}>" if a >= at else "")
        at = max(at, b)
    return out + text[at:]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    long = " ".join(f"w{i}" for i in range(3000))
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (10**6 + 2, long, "en", None, 1), (10**6 + 3, long, "en", "new", 1), (10**6 + 2, long, "en", None, 1)]
    return base.union(spark.createDataFrame(odd, base.schema)).withColumns({"rate": F.lit("r"), "sketch": F.lit(1), "fp": F.lit(None).cast("int")}).repartition(6)


def test_stages_match_plain_versions(spark, docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "simhash", "pii", "mix", "pack"]

    kept = stages["quality"](spark, docs, "").cache()
    assert kept.columns == docs.columns
    rows = [r for r in rows if _passes(r[1])]
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(r[:2] for r in rows)

    one = stages["simhash"](spark, kept, "").cache()
    assert one.columns == docs.columns
    sk = {i: np.frombuffer(simhash.sketch(t), np.uint64) for i, t, _ in rows}

    def linked(a, b):
        d = np.bitwise_count(a ^ b)
        return d[0] <= simhash.NEAR and d.sum() <= simhash.CLOSE

    head = brute.components(sorted(sk.items()), linked)
    first = {}
    for r in rows:
        if head[r[0]] == r[0]:
            first[r[0]] = r
    rows = list(first.values())
    assert {r["doc_id"]: r["text"] for r in one.collect()} == {r[0]: r[1] for r in rows} and one.count() == len(rows)

    clean = stages["pii"](spark, one, "").cache()
    rows = [(i, _redact(t), s) for i, t, s in rows]
    assert clean.columns == docs.columns and {r["doc_id"]: r["text"] for r in clean.collect()} == {i: t for i, t, _ in rows}

    mixed = stages["mix"](spark, clean, "").cache()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.words(t))
    target = _fill(dict(sizes))
    want = {}
    for i, _, s in rows:
        rate = target[s] / sizes[s]
        draw = int(hashlib.md5(f"42:{i}".encode()).hexdigest()[:13], 16) / 2**52
        if n := int(rate) + (draw < rate - int(rate)):
            want[i] = n
    assert mixed.columns == docs.columns and {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want

    packed = stages["pack"](spark, mixed, "").collect()
    tok = WordTokenizer(vocabulary())
    length = {i: len(tok.encode(t)) // 4 + 1 for i, t, _ in rows if i in want}
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == {i: n * want[i] for i, n in length.items()}
    fill = {}
    for r in packed:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 and all(o == sum(n for q, n in p if q < o) for o, _ in p) for p in fill.values())
    assert len(fill) <= sum(got.values()) / 2048 * 1.05 + 2


def test_run_and_empty(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() > 100
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_labelled_good_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    led = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    base = led.fail_mask.bitwiseAND(quality.mask_of(quality.BASE)) != 0
    assert led.where(F.col("quality") == 1).where(~base & ~quality.passes()).count() == 0
    bad = led.where("quality = 0")
    assert bad.where(base | ~quality.passes()).count() >= 0.9 * bad.count()
    assert not re.search("limit|sample", str(quality.passes()))
