"""The corpus pipeline: quality rules, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the one
before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from addrsift.llm.common import scratch
from addrsift.llm.exact import drop_copies
from addrsift.llm.minhash import drop_near_copies
from addrsift.llm.packing import pack
from addrsift.llm.quality import fit, keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned ones reject."""
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs, rules)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences in length buckets and token-budget batches."""
    return pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("packing", packing)]

#: Learned rules, signatures and dynamic programming have no SQL; the tests
#: hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, f"pipeline-{i}"))
        docs = spark.read.parquet(path)
    return docs
