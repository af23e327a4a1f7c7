import json
import zlib

import numpy as np
import pytest

from statflow.llm import grouping
from statflow.llm.queries import vocabulary
from statflow.llm.tokens import WordTokenizer

ODD = [None, "", " ", "a", "It's WE'LL don't <|endoftext|> <|startoftext|>x", "ÀÉÎß straße İstanbul ΣΑΣ σ", "x\x1cy\x1dz \xa0 w", "é é à Å", "½ ² ٣ 12.5%", "漢字かな 한글 हिन्दी",
       "a" * 5000, "word " * 6000, "!?#" * 700, "\U0001f600‍\U0001f600 ﻿x", "i'd've 'S 'T", "­ áb"]


@pytest.fixture(scope="module")
def tokenizer():
    return WordTokenizer(vocabulary())


def test_ids_are_the_tokenizers(tokenizer, spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    for t in texts:
        assert np.frombuffer(tokenizer.encode(t or ""), "<u4").tolist() == tokenizer.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_vocabulary_suits_the_fast_merge(tokenizer):
    """Every token is what its own characters merge to, so merging by concatenation is merging by rule."""
    model = json.load(open(vocabulary(), encoding="utf-8"))["model"]
    rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
    joined = {"".join(m): i for m, i in rank.items()}
    assert len(joined) == len(rank)
    order = [w for w, i in sorted(model["vocab"].items(), key=lambda x: x[1])]
    first = model["vocab"]["".join(next(iter(rank)))]
    assert [("".join(m)) for m in rank] == order[first : first + len(rank)]
    for token in joined:
        end = token.endswith("</w>")
        parts = list(token.removesuffix("</w>"))
        parts[-1] += "</w>" * end
        while len(parts) > 1:
            best = min(zip(parts, parts[1:], strict=False), key=lambda p: rank.get(p, 10**9))
            assert best in rank, token
            i = next(i for i in range(len(parts) - 1) if (parts[i], parts[i + 1]) == best)
            parts[i : i + 2] = ["".join(best)]


def _check(rows, texts, tokenizer, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids = np.append(np.frombuffer(tokenizer.encode(t or ""), "<u4"), np.uint32(0))
        got = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in got] == list(range(-(-len(ids) // capacity)))
        for r in got:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == capacity * r["piece"] and len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(part.astype("<u4").tobytes())
        assert sum(r["length"] for r in got) == len(ids)
    fill = {}
    for r in rows:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(fill), sum(r["length"] for r in rows)


def test_pack(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    first = grouping.pack(docs.repartition(5), vocabulary()).collect()
    n, total = _check(first, texts, tokenizer, 2048)
    assert n <= -(-total // 2048) * 1.02 + 1
    again = grouping.pack(docs.repartition(3), vocabulary()).collect()
    assert sorted(first) == sorted(again)
    assert grouping.pack(docs.limit(0), vocabulary()).count() == 0


def test_sequences_round_trip(spark, tokenizer):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {}
    for r in grouping.sequences(docs, vocabulary(), 256).collect():
        ids, at = np.frombuffer(r["ids"], "<u4"), 0
        assert len(ids) == sum(r["lengths"]) <= 256
        for d, n in zip(r["doc_ids"], r["lengths"], strict=True):
            got.setdefault(d, []).append(n)
            at += n
    assert {d: sum(n) for d, n in got.items()} == {i: len(tokenizer.encode(t or "")) // 4 + 1 for i, t in enumerate(ODD)}


def test_null_and_large_ids(spark):
    big = 2**62 + 1
    docs = spark.createDataFrame([(None, "a b"), (big, "a b c"), (None, None)], "doc_id long, text string").repartition(1)
    assert sorted(str(r["doc_id"]) for r in grouping.pack(docs, vocabulary(), 16).collect()) == sorted(["None", str(big), "None"])
    import public_tokenizers

    from statflow.llm import binpack

    rows = binpack.pack_rows(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert sorted(map(str, rows[0]["doc_ids"])) == sorted(["None", str(big), "None"])


def test_repeated_rows_and_hot_length(spark):
    docs = spark.createDataFrame([(1, "a b c", 5)] * 40 + [(i, "d e f g", 1) for i in range(60)], "doc_id long, text string, piece int")
    rows = grouping.pack(docs, vocabulary(), 16).collect()
    assert len(rows) == 100 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 100
    assert len({r["sequence_id"] for r in rows}) <= 30


@pytest.mark.parametrize("counts", [{}, {1: 5}, {2048: 3}, {2047: 4, 1: 3}, {1025: 7, 1023: 7}, {700: 9, 600: 9, 748: 9}, {i: 1 + i % 7 for i in range(1, 2049, 3)}, {130: 100000, 1500: 7}])
def test_plan_places_all(counts):
    slots, n = grouping.plan(dict(counts))
    ends, used = {}, {}
    for length, rank, m, seq, offset in slots:
        assert rank == ends.get(length, 0)
        ends[length] = rank + m
        for s in {seq, seq + m - 1}:
            used.setdefault(s, set()).add((offset, length))
        assert 0 <= seq and seq + m <= n and offset + length <= 2048
    assert ends == counts
    assert n <= -(-sum(k * v for k, v in counts.items()) // 2048) * 1.12 + sum(v for k, v in counts.items() if k > 1024) + 1
