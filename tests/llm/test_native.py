"""Quality rules, mixing and personal data against plain versions."""

import re

import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from statflow.llm import mixing, pii, quality

ODD = [
    None, "", " \t\r\n\x0b\x0c", "a", "a b c a b c", "a b a b a b a b", "x y z w", "é" * 70 + " \U0001f600 é", "l\nl\n\n \nl", "#*$%&|<> " * 60,
    "mail a@b.c._x@d.e, a@b a@b.c..d @x.y a%+b@c-d.e-f.g", "1.2.3.4.5.6.7.8 256.1.1.1 0000255.0.0.1 1..2.3.4 1.2.3", "4111 1111-1111 1111 4111111111111112 0-0 0000000000000",
    "+1 (743) 555-3824 +1 +12 +1((((( +123456789012345 +1234567890123456", "\U0001f600 a@b.de \U0001f600 +1 234 567 890 10.0.0.1", "1" * 30000, "a" * 30000, "9 " * 8000, "a@b.c " * 3000, "+" * 20000,
    "1.2.3.4.4111111111111111", "call me (555) 123-4567 or write bob [at] mail [dot] com",
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "s" if i % 3 else None, i) for i, t in enumerate([*ODD, ODD[5]])], "doc_id long, text string, source string, n_words int").repartition(3)


def test_quality_measures(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.ledger(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.quality(texts[r["doc_id"]]), r["doc_id"]


def test_quality_policy_keeps_columns(odd):
    kept = quality.apply_policy(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.ledger(odd.drop("n_words")).where(quality.passes()).collect()}
    assert quality.apply_policy(odd.limit(0)).count() == 0


def test_ablation(odd):
    led = quality.ledger(odd)
    rows = {(r["policy"], r["rule"]): r for r in quality.ablation(led).collect()}
    masks = [r["fail_mask"] for r in led.collect()]
    for (version, rule), r in rows.items():
        m, bit = quality.mask_of(quality.POLICIES[version]), 1 << quality.RULES[rule][0]
        assert r["n_kept"] == sum(not x & m for x in masks) and r["n_failed"] == sum(bool(x & bit) for x in masks) and r["n_only"] == sum(x & m == bit for x in masks)
    assert quality.ablation(led.limit(0)).where("n_docs = 0 and n_kept = 0").count() == len(rows)


def test_pii_base(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.detect(docs).collect():
        counts, digest, joined = brute.pii(texts[r["doc_id"]])
        assert ([r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]], r["base_sha256"]) == (counts, digest), (r["doc_id"], r["spans"], joined)
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(",")) and len(r["spans"].split(",")) - (r["spans"] == "") == sum(counts) + r["n_added"]


def test_pii_redaction(odd):
    out = {r["doc_id"]: r for r in pii.redact(odd).collect()}
    assert out[0]["text"] is None and out[1]["text"] == "" and out[14]["text"] == "\U0001f600 <email> \U0001f600 <phone>"  # the phone swallows the address
    assert out[18]["text"] == "<email> " * 3000 and out[5]["n_words"] == 5
    assert out[20]["text"].startswith("<ip>") and not re.search(r"\d{6}", out[20]["text"])


def test_span_model_learns():
    counts = {(0, 15): 500, (0, 7): 800, (1, 3): 200, (2, 1): 900, (3, 10): 40, (3, 2): 60, (3, 0): 100}
    m = pii.SpanModel.fit(counts)
    assert all(h > f for h, f in zip(m.hit, m.false, strict=True)) and m.probability(0, 15) > 0.5 > m.probability(2, 1)
    assert pii.SpanModel.fit({}).share == 0.5


def test_mix(spark, odd):
    rows = mixing.rates(odd).collect()
    assert len(rows) == odd.count() and {r["doc_id"]: r["size"] for r in rows} == {i: len(brute.words(t)) for i, t in enumerate([*ODD, ODD[5]])}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] % max(r["size"], 1) == 0
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = r["copies"]
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in taken.items() if v}
    assert mixing.rates(odd.limit(0)).count() == 0


def _fill(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        out = {s: cap * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if out[s] > cap * sizes[s]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000, "d": 3, None: 7}, {"a": 0, "b": 0}, {"x": 5}, {"a": 1, "b": 10**12, "c": 1, "d": 1, "e": 1, "\U0001f600": 4, "￿": 4}])
def test_targets(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = _fill(sizes)
    assert {r["source"]: pytest.approx(want[r["source"]], rel=1e-12) for r in rows} == {r["source"]: r["target"] for r in rows}


def test_loose_candidates_are_judged(spark):
    """Planted loose candidates, true ones in a telling or a free place, others after words that number
    something else: what is added is nearly all true, and nearly all that is true is added."""
    import random

    rng = random.Random(5)
    d = lambda n, first="0123456789": rng.choice(first) + "".join(rng.choices("0123456789", k=n - 1))
    phone = lambda sep: sep.join((d(3, "23456789"), d(3, "23456789"), d(4)))
    rows, good, bad = [], set(), set()
    for i in range(600):
        kind = i % 6
        true = i % 2 == 0
        word = rng.choice(["Please call", "mobile:", "Telefon", "phone"]) if true else rng.choice(["build", "part no", "rev", "order #", "serial", "version"])
        p = phone(rng.choice(".- ")) if kind < 4 or true else d(3, "01") + "." + d(3, "01") + "." + d(4)
        if true and kind == 4:
            p, word = f"{rng.choice(['ann', 'bob.k'])} [at] mail{i} [dot] com", "write to"
        rows.append((i, f"Some words here {word} {p} and so on."))
        (good if true else bad).add(i)
    rows += [(1000 + i, f"mail a{i}@b.com or +1 743 555 {d(4)} from 10.1.2.{i % 250}, 4111 1111 1111 {d(4)}") for i in range(400)]
    rows.append((2000, "build 415.555.2671 rev 800.555.0199 and part no 123.456.7890"))
    added = {r["doc_id"]: r["n_added"] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit, wrong = sum(added[i] > 0 for i in good), sum(added[i] > 0 for i in bad)
    assert hit >= 0.95 * len(good) and wrong <= 0.05 * len(bad) and added[2000] == 0
    assert pii.detect(spark.createDataFrame(rows[-1:], "doc_id long, text string")).first()["n_added"] == 0  # the priors alone say so


def test_expression_is_the_classifier(spark):
    model = pii.SpanModel.fit({(3, 0b1000010010 | 1 << 7): 40, (3, 0b1000010110): 25, (0, 16 + 2 + 4): 9, (3, 1 + 2 + 4): 500})
    votes = [(k, v) for k in range(4) for v in range(16, 1 << 14, 37) if v & 16 and not (v >> 8 & 1 and v >> 9 & 1)]
    df = spark.createDataFrame(votes, "k int, vote int").withColumn("x", F.struct("k", "vote"))
    for r in df.select("k", "vote", model.accepts(F.col("x")).alias("yes")).collect():
        assert r["yes"] == (model.probability(r["k"], r["vote"]) >= 0.5)


def test_many_spans_in_one_text(spark):
    """Loose and strict spans by the thousand, overlaps included, in near linear time."""
    text = "call +1 743 555 3824 or 743-555-3824, 1.2.3.4 then (743) 555-3824@x.com. " * 4000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.detect(docs).first()
    assert [r["n_email"], r["n_ip"], r["n_phone"]] == [4000, 4000, 4000] and r["n_added"] == 4000
    assert pii.redact(docs).first()["text"].startswith("call <phone> or <phone>, <ip> then (743) <email>. call")
