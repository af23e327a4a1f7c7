"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure is one bit of
``fail_mask`` and the measurements stay beside it. A policy is a versioned set
of bits: applying it, or asking what a rule costs (an ablation), is bitwise
arithmetic on the ledger and never reads the texts again.

Only DataFrame functions are used. All work on a text is done inside its row,
so nothing is shuffled and no key can be hot.

Edge cases: a null or empty text has no words and fails ``few_words``; ties and
repeated rows are judged one by one; an empty table gives an empty ledger; other
columns of the input pass through ``ledger`` unless they bear one of its own
names (``MEASURES`` or ``fail_mask``), in which case the ledger's column wins.

Windows of words are compared by a chained 64-bit hash; two different windows of
one text count as equal with probability about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statflow.llm.text import SPACE, let, text_of, words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: name -> (bit, condition under which a text fails, over a getter of measures).
RULES = {
    "few_words": (0, lambda m: m("n_words") < 50),
    "repeated_windows": (1, lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
    "symbols": (2, lambda m: m("n_symbols") * 10 > m("n_words")),
    "short_words": (3, lambda m: m("word_chars") < m("n_words") * 2),
    "long_words": (4, lambda m: m("word_chars") > m("n_words") * 20),
    "duplicate_lines": (5, lambda m: m("n_dup_lines") * 2 > m("n_lines")),
    "many_words": (6, lambda m: m("n_words") > 1_000_000),
}
BASE = ("few_words", "repeated_windows")
#: version -> rules in force.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "short_words", "long_words"),
    "v3": (*BASE, "symbols", "short_words", "long_words", "duplicate_lines"),
}
CURRENT = "v3"


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES[r][0] for r in rules)


def _repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(p: Column) -> Column:
            same = lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"])
            found = F.filter(p, lambda x, j: F.coalesce(same(x, j), F.lit(False)))
            return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, positions))

    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, covered))


def _measure(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_word = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(
        by_word.alias("w"),
        by_line.alias("l"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )


def fail_mask(m: Callable[[str], Column]) -> Column:
    """The bits of all rules that fail, over a getter of measures."""
    mask = F.lit(0).cast("long")
    for bit, failed in RULES.values():
        mask = mask.bitwiseOR(F.when(failed(m), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long"))
    return mask


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with MEASURES (long) and fail_mask (long)."""
    own = {*MEASURES, "fail_mask"}
    measured = docs.withColumn("_m", let(text_of(text), _measure))
    rest = [F.col(c) for c in docs.columns if c not in own]
    flat = measured.select(*rest, "_m.w.n_words", "_m.word_chars", "_m.n_symbols", "_m.l.n_dup_lines", "_m.w.n_repeat_words", "_m.l.n_lines")
    return flat.withColumn("fail_mask", fail_mask(F.col))


def passes(policy: str = CURRENT) -> Column:
    """True where the ledger row fails no rule of the policy."""
    return F.col("fail_mask").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def apply_policy(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns, whatever those are named."""
    where = {"n_words": "w.n_words", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_dup_lines": "l.n_dup_lines"}
    mask = fail_mask(lambda x: F.col(f"__m.{where.get(x, x)}"))
    checked = docs.withColumn("__m", let(text_of(text), _measure)).withColumn("__fail", mask)
    return checked.where(F.col("__fail").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0).drop("__m", "__fail")


def ablation(led: DataFrame) -> DataFrame:
    """One row per policy and rule: n_docs, n_kept under the policy, n_failed (that
    fail the rule), n_only (kept once the rule alone is taken out)."""
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for version, rules in POLICIES.items():
        mask = mask_of(rules)
        hit = F.col("fail_mask").bitwiseAND(F.lit(mask).cast("long"))
        aggs.append(F.coalesce(F.sum((hit == 0).cast("long")), F.lit(0)).alias(f"k_{version}"))
        for r in rules:
            bit = 1 << RULES[r][0]
            aggs.append(F.coalesce(F.sum((hit.bitwiseAND(F.lit(bit).cast("long")) != 0).cast("long")), F.lit(0)).alias(f"f_{version}_{r}"))
            aggs.append(F.coalesce(F.sum((hit == bit).cast("long")), F.lit(0)).alias(f"o_{version}_{r}"))
            rows.append(F.struct(
                F.lit(version).alias("policy"), F.lit(r).alias("rule"), F.col("n").alias("n_docs"), F.col(f"k_{version}").alias("n_kept"),
                F.col(f"f_{version}_{r}").alias("n_failed"), F.col(f"o_{version}_{r}").alias("n_only"),
            ))
    return led.agg(*aggs).select(F.inline(F.array(*rows)))
