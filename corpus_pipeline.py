"""The corpus pipeline: quality rules, SimHash near-dedup, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet before the next one reads it.
All but the last return the columns of `docs`; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.llm import decontaminate, mixing, quality, sharding, simhash
from portolan.llm.common import fresh_path, remove, table

POLICY, SHARDS = "v1", 24


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a rule of the policy rejects; the ledger of all of them is stored first, and the policy reads its bits.

    Null and empty texts have no words and are dropped. Repeated rows are judged one by one; there are no ties.
    """
    return quality.passed(quality.stored(docs, fresh_path(spark, "ledger")), POLICY, docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-equal texts: the one with the smallest doc_id.

    Equal rows are copies, one stays; of several texts with that doc_id each stays once. Null and empty texts are equal to one another. Rows
    without doc_id stay as they are.
    """
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what the benchmark holds too, and drops documents that are mostly that.

    An item of fewer than ten words is cut out wherever all its words stand in order, an item of one word wherever it stands. Null and
    empty texts pass, repeated rows are cut alike, a benchmark without words cuts nothing.
    """
    return decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix begins it, in the mix's order.

    Documents without words are never begun. A null source is a source. Repeated rows are taken one by one.
    """
    return mixing.applied(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and slot, which replace columns of these names. Null ids and texts are numbered like others; which of equal rows
    gets which slot makes no difference."""
    return sharding.sharded(docs, [F.col("doc_id"), F.xxhash64("text")], SHARDS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]
ORACLE_SQL = None  # signatures and the permutation are beyond SQL; tests hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`."""
    docs, path, before = table(spark, sf_dir, "documents"), fresh_path(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        if before:  # nothing reads it any more
            remove(spark, before)
        before = f"{path}/{name}"
    return docs
