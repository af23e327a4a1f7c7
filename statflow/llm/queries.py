"""The operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statflow.llm import ann, binpack, grouping, html, mixing, oracles, pii, quality, simhash, spans, urls

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def url_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` holds no fetch times: a day of 2024 is dealt to each by its id."""
    day = F.lit(19723) + F.pmod(F.col("page_id") * 7919, F.lit(366))
    return _table(spark, sf_dir, "pages").select("page_id", "url", day.cast("int").alias("fetched_at"))


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list: two standing entries, and entries for every host whose name's digest says so -
    blocked from a day on, some taken off again, some put back, some with an allowance for /en."""
    fixed = spark.createDataFrame(
        [("domain", "spam-farm.example.org", "block", "add", 19723), ("domain", "example.net", "allow", "add", 19800), ("domain", "example.net", "allow", "remove", 20000)],
        "kind string, pattern string, rule string, action string, at int",
    )
    hosts = _table(spark, sf_dir, "pages").select(urls.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    d = hosts.select("host", F.md5("host").alias("d"))
    day = F.lit(19723) + F.conv(F.substring("d", 2, 2), 16, 10).cast("int")
    row = lambda kind, pattern, rule, action, at: F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(rule).alias("rule"), F.lit(action).alias("action"), at.cast("int").alias("at"))
    host = F.col("host")
    en = F.concat(host, F.lit("/en/"))
    digit = lambda i: F.substring("d", i, 1)
    rows = F.concat(
        F.array(row("host", host, "block", "add", day)),
        F.when(digit(4) < "8", F.array(row("host", host, "block", "remove", day + 60))).otherwise(F.array().cast("array<struct<kind:string,pattern:string,rule:string,action:string,at:int>>")),
        F.when(digit(5) < "4", F.array(row("host", host, "block", "add", day + 120))).otherwise(F.array().cast("array<struct<kind:string,pattern:string,rule:string,action:string,at:int>>")),
        F.when(digit(6) < "4", F.array(row("prefix", en, "allow", "add", day + 30))).otherwise(F.array().cast("array<struct<kind:string,pattern:string,rule:string,action:string,at:int>>")),
    )
    return fixed.union(d.where(digit(1) < "6").select(F.explode(rows).alias("e")).select("e.*"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(url_captures(spark, sf_dir), url_list(spark, sf_dir))
    return out.withColumns({"matched": F.coalesce("matched", F.lit("")), "since": F.coalesce("since", F.lit(-1))})


def op3_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return binpack.pack_rows(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op2_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(_table(spark, sf_dir, "documents"))
    base = led.fail_mask.bitwiseAND(quality.mask_of(quality.BASE)) != 0
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & quality.passes()).alias("kept"), "fail_mask"
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(_table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_table(spark, sf_dir, "documents"))


def op8_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.pack(_table(spark, sf_dir, "documents"), vocabulary())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filters, op2_adaptive_scan, op3_binary_packing, op4_sentence_spans, op5_source_mixing, op6_quality_rules, op7_simhash,
        op8_grouped_packing, op9_main_text, op10_pii, quality_ablation,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": oracles.OP1,
    "op5_source_mixing": oracles.OP5,
    "op6_quality_rules": oracles.OP6,
    "quality_ablation": oracles.ABLATION,
}
