"""Queries that run a stream over a given table until its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir, pinned
from ..streaming import running as R
from ..streaming import upserts as U
from .base import query
from .checks import ENTRIES, with_
from .inputs import frame, streamed_log_lines


def _fed(spark, parts, start):
    """Runs a stream over a folder that gets one part of text lines after the other.

    ``start`` makes the query of the lines and the folder; each of its runs goes on where
    the one before ended.
    """
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").text(f"{base}/in")
        start(R.stream_lines(spark, f"{base}/in"), base).awaitTermination()
        yield base


def _run(spark, df, mode):
    """Write a stream to a new folder next to the checkpoints and read the result back."""
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def replace(batch, _):
        batch.write.mode("overwrite").parquet(f"{base}/result")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state")
    running = writer.foreachBatch(replace).trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{base}/result")


@query(with_(ENTRIES, """SELECT ip, count(*) AS "count", coalesce(min(ts) FILTER (WHERE ts > 0), min(ts)) AS first_ts,
  coalesce(max(ts) FILTER (WHERE ts > 0), min(ts)) AS last_ts,
  count(*) FILTER (WHERE login_status = 'failed') AS login_failed_count,
  count(*) FILTER (WHERE contains(lower(line), 'password')) AS search_hits,
  coalesce(max(ts) FILTER (WHERE ts > 0) - min(ts) FILTER (WHERE ts > 0) <= 86400, false) AND count(*) >= 10 AS is_ddos
FROM entries GROUP BY ip"""))
def stream_running_stats(spark, sf_dir):
    """Running statistics per address after three batches, of which each changed only its
    addresses; the first two are merged, and the last is written twice."""
    lines = frame(spark, sf_dir, "log_lines")

    def start(texts, base):
        entries = R.stream_entries(texts, detect_login=True, search="password")
        changed = R.running_stats(entries, window=86400).writeStream.outputMode("update")
        return changed.option("checkpointLocation", f"{base}/state").foreachBatch(U.upsert(f"{base}/result")).trigger(availableNow=True).start()

    for i, base in enumerate(_fed(spark, [lines.where(F.col("event_id") % 3 == k).select("line") for k in range(3)], start)):
        result = f"{base}/result"
        if i == 1:
            U.merge(spark, result, ["ip"])
    changes = spark.read.parquet(f"{result}/changes")
    last = changes.agg(F.max("batch")).first()[0]
    U.upsert(result)(pinned(changes.where(F.col("batch") == last).drop("batch")), last)
    return U.current(spark, result, ["ip"]).select(
        "ip", "count", "first_ts", "last_ts", "login_failed_count", "search_hits", "is_ddos"
    )


@query(with_(ENTRIES, """SELECT ts // 86400 * 86400 AS window_start, ip, count(*) AS "count",
  min(ts) AS first_ts, max(ts) AS last_ts FROM entries WHERE ts > 0 GROUP BY ALL"""))
def stream_daily_stats(spark, sf_dir):
    """Statistics per address and day at the end of the stream."""
    lines = streamed_log_lines(spark, sf_dir)
    stats = R.windowed_stats(R.stream_entries(lines, value="line"), "1 day", "40 days")
    return _run(spark, stats, "complete").select(
        F.unix_seconds("window_start").alias("window_start"), "ip", "count", "first_ts", "last_ts"
    )


_LATE, _LAST_ON_TIME = "event_id % 97 = 0", 1704499200  # 2024-01-06, 00:00:00 UTC


@query(with_(ENTRIES, f"""SELECT ts // 86400 * 86400 AS window_start, ip, count(*) AS "count", min(ts) AS first_ts, max(ts) AS last_ts
FROM entries WHERE ts > 0 AND NOT ({_LATE} AND ts < {_LAST_ON_TIME}) GROUP BY ALL"""))
def stream_late_rows(spark, sf_dir):
    """Statistics per address and day in append mode: windows come out once the watermark
    has passed them, and rows that come later than it are left out."""
    lines = frame(spark, sf_dir, "log_lines")
    late = F.expr(_LATE) & (F.unix_seconds(F.col("ts").cast("timestamp")) < _LAST_ON_TIME)
    day = F.dayofmonth("ts")
    parts = [lines.where(~late & (day <= 10)), lines.where((day > 10) & (day <= 20)), lines.where(late | (day > 20))]
    # far later lines, whose own windows stay open
    ends = [spark.createDataFrame([(f"2024-06-0{i} 00:00:00 the end from 192.0.2.1",)], "line string") for i in (1, 2)]

    def start(texts, base):
        stats = R.windowed_stats(R.stream_entries(texts), "1 day", "2 days").writeStream.outputMode("append").format("parquet")
        return stats.option("path", f"{base}/result").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()

    for base in _fed(spark, [p.select("line") for p in [*parts, *ends]], start):
        pass
    return spark.read.parquet(f"{base}/result").select(
        F.unix_seconds("window_start").alias("window_start"), "ip", "count", "first_ts", "last_ts"
    )
