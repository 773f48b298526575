"""Exact duplicates by a heavy-hitter split.

A Misra-Gries summary of k counters per partition, merged once, names every
digest held by more than n / (k + 1) of the n rows.  Those at most k
candidates are counted exactly and their winners broadcast, so that copies of
frequent texts leave where they are read.  The rest is shuffled by digest, and
no group there can hold more than n / (k + 1) rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of, whole_rows

#: Counters of a summary: bounds the broadcast winners to as many rows.
COUNTERS = 1000

#: Runs of white space that are not already a single space.
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def text_digest(text: str | Column) -> Column:
    """SHA-256 of a text in which each run of white space is one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), _RUN, " "), 256))


def shrink(counts: dict, k: int) -> dict:
    """Misra-Gries: at most k counters, each lowered by the (k + 1)-th largest.

    Also merges summaries, when given their summed counters.
    """
    if len(counts) <= k:
        return dict(counts)
    cut = heapq.nlargest(k + 1, counts.values())[-1]
    return {x: n - cut for x, n in counts.items() if n > cut}


def _summaries(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = Counter(shrink(counts, k))
        yield pa.RecordBatch.from_pydict(
            {"digest": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())}
        )

    return run


def frequent(keys: DataFrame, k: int = COUNTERS) -> list[bytes]:
    """Candidates among the values of the binary column ``digest``: all that
    more than n / (k + 1) of n rows hold, at most k."""
    parts = keys.select("digest").mapInArrow(_summaries(k), "digest binary, n bigint")
    top = (
        parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k + 1).collect()
    )  # k + 1 rows at most
    return [bytes(x) for x in shrink({bytes(r.digest): r.n for r in top}, k)]


def heavy_winners(keys: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(digest, first, group_size) of the frequent digests, counted exactly.

    ``keys`` has digest and the sortable struct ``first``.  At most k rows,
    held by the driver, ready to be broadcast.
    """
    spark = keys.sparkSession
    found = frequent(keys, k)
    candidates = spark.createDataFrame([(bytearray(x),) for x in found], "digest binary")
    counted = (
        keys.join(F.broadcast(candidates), "digest")
        .groupBy("digest").agg(F.min("first").alias("first"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    schema = counted.schema
    return spark.createDataFrame(counted.collect() if found else [], schema)


def _order(*columns: Column) -> Column:
    """Sorts by the columns with nulls last, as a struct."""
    return F.struct(*[x for i, c in enumerate(columns) for x in (c.isNull().alias(f"n{i}"), c.alias(f"v{i}"))])


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """Each row's group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest id stays; null ids come last, and of rows that
    repeat the smallest id exactly one stays.  A null text counts as empty, and
    empty texts are equal.  An empty table gives no rows.  Other columns of the
    input are ignored.  Texts are read once; of very long ones, too, only the
    digest goes on.
    """
    rows = staged(
        docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest"))
        .withColumn("row", F.monotonically_increasing_id()),
        "exact-digests",
    ).withColumn("first", _order(F.col("doc_id"), F.col("row")))
    winners = F.broadcast(heavy_winners(rows, counters))
    at_hand = rows.join(winners.withColumnRenamed("first", "keep"), "digest")
    rest = rows.join(winners.select("digest"), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("first").alias("keep"), F.count("*").alias("group_size"))
    dealt = rest.join(groups, "digest")
    columns = [
        "doc_id", F.col("keep.v0").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.v1")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    ]
    return at_hand.select(*columns).unionByName(dealt.select(*columns))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that ``exact_groups`` keeps, whole and with all their columns.

    Texts are read twice: for the digests, and for the rows that stay.  Copies
    of frequent texts never reach the shuffle.
    """
    spark_rows = whole_rows(docs, digest=text_digest(text), first=_order(F.col(doc_id)))
    keys = staged(spark_rows.select("digest", "first"), "exact-keys")
    winners = heavy_winners(keys, counters).select("digest", F.col("first").alias("keep"))
    stays = spark_rows.join(F.broadcast(winners), "digest", "left").filter("keep IS NULL OR first = keep")
    ranked = Window.partitionBy("digest").orderBy("first")
    return stays.withColumn("rank", F.row_number().over(ranked)).filter("rank = 1").select("_row.*")
