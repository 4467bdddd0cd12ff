"""The queries of the training-data operators, with production parameters over their whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.llm import decontaminate, html, lines, merkle, mixing, prefixes, quality, sharding, simhash, substring, tokens, toxicity, urlfilter
from portolan.llm.common import fresh_path, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(simhash.fingerprints(table(spark, sf_dir, "documents"), n=3, seed=42), budget=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits"
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, and what it alone rejects."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents").select("text")), tuple(quality.POLICIES))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.repeats(table(spark, sf_dir, "documents"), length=13))


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    tokens.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return tokens.documents(spark, path)


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.sharded(rows, [F.col("doc_id"), F.col("size"), F.col("text_crc32")], shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.counted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages").select("page_id", "url"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.of_rebuilt(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered())


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_token_shards": op6_token_shards,
    "op7_html_extraction": op7_html_extraction,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_url_filters": op10_url_filters,
    "op11_line_dedup": op11_line_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
    "quality_ablation": quality_ablation,
}
# Beyond SQL: a trained score (1), XXH64 and components (2), a tokenizer's ids (6), inferred wrappers (7), a keyed permutation (8).
SQL = {
    "op3_mixing": mixing.SQL,
    "op4_quality_rules": quality.sql(),
    "quality_ablation": quality.ablation_sql(tuple(quality.POLICIES)),
    "op5_substring_dedup": substring.SQL,
    "op9_decontamination": decontaminate.SQL,
    "op10_url_filters": urlfilter.SQL,
    "op11_line_dedup": lines.SQL,
    "op12_prefix_trie": prefixes.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
