"""Continuous input: running statistics per address, and per time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import extract_date, login_status, search_flag
from ..operators.entries import entry_rows
from ..operators.stats import with_attack_flags


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Lines of text files as they arrive in a folder."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path)


def stream_entries(
    lines: DataFrame,
    detect_login: bool = False,
    search: str | None = None,
    search_regex: str | None = None,
    ipv6_mode: str = "reference",
    assume_year: int | None = None,
    keep: Callable[[Column], Column] | None = None,
    value: str = "value",
) -> DataFrame:
    """Entries of a stream of lines; a stream has no line order, so none is given."""
    attributes = {
        "_date": extract_date("value", assume_year),
        "login_status": login_status("value") if detect_login else F.lit(None).cast("string"),
        "matches_search": search_flag("value", search, search_regex),
    }
    found = lines.select(F.col(value).alias("value")).select(entry_rows(attributes, keep, ipv6_mode))
    return found.select("ip", "_date.date_string", "_date.ts", "login_status", "matches_search")


def _aggregates() -> list[Column]:
    dated = F.when(F.col("ts") > 0, F.struct("ts", "date_string"))
    return [
        F.count(F.lit(1)).alias("count"),
        F.min(dated).alias("_first"),
        F.max(dated).alias("_last"),
        F.min(F.struct("ts", "date_string")).alias("_any"),
        F.count_if(F.col("login_status") == "success").alias("login_success_count"),
        F.count_if(F.col("login_status") == "failed").alias("login_failed_count"),
        F.count_if("matches_search").alias("search_hits"),
    ]


def _named(grouped: DataFrame, keys: list[str]) -> DataFrame:
    return grouped.select(
        *keys,
        F.coalesce("_first.date_string", "_any.date_string").alias("first_seen"),
        F.coalesce("_last.date_string", "_any.date_string").alias("last_seen"),
        "count",
        F.coalesce("_first.ts", "_any.ts").alias("first_ts"),
        F.coalesce("_last.ts", "_any.ts").alias("last_ts"),
        "login_success_count", "login_failed_count", "search_hits",
    )


def running_stats(entries: DataFrame, **attack_options) -> DataFrame:
    """Statistics and attack flags of everything seen so far, one row per address.

    For ``update`` or ``complete`` output.  State holds one row per address for
    ever, as the batch result does.  Entries with equal time stamps have no order,
    so the texts of first and last sighting are then the smallest and largest, and
    an address without any dated entry shows its smallest time stamp.
    """
    return with_attack_flags(
        _named(entries.groupBy("ip").agg(*_aggregates()), ["ip"]), **attack_options
    )


def windowed_stats(
    entries: DataFrame, window: str, lateness: str, **attack_options
) -> DataFrame:
    """Statistics per address and event-time window, with bounded state.

    Entries without a positive time stamp are left out and entries later than the
    watermark are dropped; this is the bounded counterpart of
    :func:`running_stats`, not the same result.
    """
    timed = entries.where(F.col("ts") > 0).withColumn("event_time", F.timestamp_seconds("ts"))
    grouped = (
        timed.withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", window).alias("window"), "ip")
        .agg(*_aggregates())
    )
    named = _named(grouped, ["window", "ip"]).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*"
    ).drop("window")
    return with_attack_flags(named, **attack_options)


