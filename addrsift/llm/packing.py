"""Length buckets with the least padding, and batches of a token budget in them.

Documents are cut into sequences of at most ``max_tokens``, which bounds the
histogram of lengths; dynamic programming over it finds the bucket boundaries
with the least padding.  Batches are numbered inside each bucket by counts per
shard and their running sum, so no task holds a bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged, text_of


@dataclass(frozen=True)
class Packing:
    """max_tokens: longest sequence; buckets: how many lengths to pad to;
    token_budget: padded tokens of a batch; shard_rows: rows numbered by a task."""

    max_tokens: int = 2048
    buckets: int = 16
    token_budget: int = 16_384
    shard_rows: int = 20_000


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` of the ascending ``lengths`` to pad to, the last one
    among them, with the least padding in total.  Ties: the shorter boundary."""
    if not lengths:
        return []
    at = np.array(lengths, dtype=np.float64)
    n = np.concatenate([[0.0], np.cumsum(np.array(counts, dtype=np.float64))])
    s = np.concatenate([[0.0], np.cumsum(at * counts)])
    m = len(lengths)
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, m)):
        step, cut = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int)
        for j in range(1, m + 1):
            cost = best[:j] + at[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            cut[j] = int(np.argmin(cost))
            step[j] = cost[cut[j]]
        cuts.append(cut)
        best = step
    out, j = [], m
    for cut in reversed(cuts):
        out.append(lengths[j - 1])
        j = cut[j]
    return out[::-1]


def n_words(text: str | Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("bigint")


def sequences(docs: DataFrame, doc_id: str, length: Column, max_tokens: int) -> DataFrame:
    """doc_id, segment, start, n_tokens: each document in runs of at most
    ``max_tokens``; one without tokens is one run of length 0."""
    last = F.greatest(F.ceil(F.col("n") / max_tokens) - 1, F.lit(0)).cast("bigint")
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("bigint").alias("n"))
        .select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("segment"))
        .select(
            "doc_id", "segment", (F.col("segment") * max_tokens).alias("start"),
            F.least(F.lit(max_tokens), F.col("n") - F.col("segment") * max_tokens).cast("int").alias("n_tokens"),
        )
    )


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: Column | None = None, plan: Packing = Packing()) -> DataFrame:
    """Every token of every document in one batch of one bucket.

    Returns doc_id, segment, start, n_tokens, bucket (0 is the shortest),
    bucket_tokens (the length padded to), batch (numbered from 0 in its
    bucket) and slot (place in the batch).  A batch holds as many sequences as
    the token budget has room for at the bucket's length, one at least; only
    the last of a bucket may be short.  The order in a bucket is by a hash of
    id, segment and length, so it does not depend on how files are cut.

    A null text or length counts as 0; rows without tokens are sequences of
    length 0; repeated rows are packed as often as they come; an empty table
    gives no rows.  Tokens are words unless ``length`` counts others.
    """
    runs = staged(sequences(docs, doc_id, n_words(text) if length is None else length, plan.max_tokens), "packing-runs")
    histogram = sorted((r.n_tokens, r["count"]) for r in runs.groupBy("n_tokens").count().collect())  # max_tokens + 1 rows at most
    edges = best_boundaries([x for x, _ in histogram], [n for _, n in histogram], plan.buckets) or [0]
    shards = max(1, math.ceil(sum(n for _, n in histogram) / plan.shard_rows))
    bucket = reduce(add, [(F.col("n_tokens") > e).cast("int") for e in edges])
    key = F.xxhash64("doc_id", "segment", "n_tokens")
    placed = (
        runs.withColumn("bucket", bucket)
        .withColumn("bucket_tokens", F.element_at(F.array(*map(F.lit, edges)), F.col("bucket") + 1))
        .withColumn("_key", key)
        .withColumn("_shard", F.pmod(F.col("_key"), F.lit(shards)))
    )
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("bucket", "_shard").agg(F.count("*").alias("_n")).select(
        "bucket", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("bucket", "_shard").orderBy("_key", "doc_id", "segment", "n_tokens")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(plan.token_budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("bigint")
    return (
        placed.withColumn("_rank", F.row_number().over(inside)).join(starts, ["bucket", "_shard"])
        .withColumn("_rank", F.col("_before") + F.col("_rank") - 1).withColumn("_room", capacity)
        .select(
            "doc_id", "segment", "start", "n_tokens", "bucket", "bucket_tokens",
            F.floor(F.col("_rank") / F.col("_room")).cast("bigint").alias("batch"),
            F.pmod(F.col("_rank"), F.col("_room")).cast("int").alias("slot"),
        )
    )
