"""Shapes of results: records, table view, map features.

All are projections; sorting is left to :func:`operators.stats.by_count` and the
writers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P

FLAGS = ["is_ddos", "is_spray", "is_scan", "is_bruteforce"]
CORE = [
    "ip", "first_seen", "last_seen", "count", "first_ts", "last_ts",
    "login_success_count", "login_failed_count", "search_hits", *FLAGS,
]


def enrichment_columns(stats: DataFrame) -> list[str]:
    """Columns beyond the statistics, in name order."""
    return sorted(c for c in stats.columns if c not in CORE)


def _core(stats: DataFrame, search_hits: bool) -> list[Column]:
    flags = [
        (F.col(f) if f in stats.columns else F.lit(False)).alias(f) for f in FLAGS
    ]
    fields = [
        F.col("ip").alias("ip_address"), F.col("first_seen"), F.col("last_seen"), F.col("count"),
        F.col("first_ts").alias("first_timestamp"), F.col("last_ts").alias("last_timestamp"),
        F.col("login_success_count"), F.col("login_failed_count"), *flags,
    ]
    return [*fields, F.col("search_hits")] if search_hits else fields


def _texts(stats: DataFrame, columns: list[str]) -> Column:
    """Enrichment values as text; null (and left out of JSON) if there is none."""
    types = dict(stats.dtypes)
    return F.struct(*[_text(c, types[c]).alias(c) for c in columns])


def _text(column: str, kind: str) -> Column:
    """A value as text, coordinates with six decimals; null stays null."""
    text = F.format_string("%.6f", column) if kind == "double" else F.col(column).cast("string")
    return F.when(F.col(column).isNotNull(), text)


def stats_records(stats: DataFrame, search_hits: bool = False) -> DataFrame:
    """One record per address with its enrichment nested; null where there is none."""
    columns = enrichment_columns(stats)
    extra = []
    if columns:
        some = F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull()
        extra = [F.when(some, _texts(stats, columns)).alias("enrichment")]
    return stats.select(*_core(stats, search_hits), *extra)


def _json_without_end(record: Column) -> Column:
    text = F.to_json(record, {"ignoreNullFields": "false"})
    return F.substr(text, F.lit(1), F.length(text) - 1)


def stats_json(stats: DataFrame, search_hits: bool = False) -> DataFrame:
    """The same records as JSON text, ``value``, sorted by count.

    Missing first and last sightings are null, missing enrichment is left out.
    """
    columns = enrichment_columns(stats)
    head = _json_without_end(F.struct(*_core(stats, search_hits)))
    tail = F.lit("}")
    if columns:
        nested = F.to_json(_texts(stats, columns))
        tail = F.when(nested != "{}", F.concat(F.lit(',"enrichment":'), nested, tail)).otherwise(tail)
    return stats.orderBy(F.desc("count"), "ip").select(F.concat(head, tail).alias("value"))


def geo_features(stats: DataFrame, search_hits: bool = False) -> DataFrame:
    """One GeoJSON feature per address that has both coordinates.

    Gives ip, count, longitude, latitude and the feature as JSON text ``feature``.
    """
    columns = [c for c in enrichment_columns(stats) if c not in ("latitude", "longitude")]
    head = _json_without_end(F.struct(*_core(stats, search_hits)))
    more = F.to_json(_texts(stats, columns)) if columns else F.lit("{}")
    properties = F.when(more == "{}", F.concat(head, F.lit("}"))).otherwise(
        F.concat(head, F.lit(","), F.substr(more, F.lit(2)))
    )
    feature = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['),
        F.format_string("%.6f", "longitude"), F.lit(","), F.format_string("%.6f", "latitude"),
        F.lit(']},"properties":'), properties, F.lit("}"),
    )
    return stats.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "ip", "count", "longitude", "latitude", feature.alias("feature")
    )


def entry_records(entries: DataFrame, with_filename: bool) -> DataFrame:
    """Records of entries: address, time stamp, place."""
    columns = [F.col("ip").alias("ip_address"), F.col("date_string").alias("date")]
    if with_filename:
        columns.append(F.col("filename"))
    if "line_number" in entries.columns:
        columns.append(F.col("line_number"))
    return entries.select(*columns, "ts")


def display_view(
    stats: DataFrame, logins: bool = True, search_hits: bool = False
) -> DataFrame:
    """The table view: headings and texts as a reader sees them.

    Which columns appear follows from the options and the columns of ``stats``, so
    nothing has to be read to know the shape.
    """
    yes_no = {"is_ddos": "DDoS", "is_spray": "Spray", "is_scan": "Scan", "is_bruteforce": "BruteForce"}
    columns = [
        F.col("ip").alias("IP Address"),
        F.coalesce("first_seen", F.lit("(no date)")).alias("First Seen"),
        F.coalesce("last_seen", F.lit("(no date)")).alias("Last Seen"),
        F.col("count").alias("Count"),
    ]
    if search_hits:
        columns.append(F.col("search_hits").alias("SearchHits"))
    if logins:
        columns.append(
            F.concat(
                F.lit("OK:"), F.col("login_success_count").cast("string"),
                F.lit(" F:"), F.col("login_failed_count").cast("string"),
            ).alias("Login")
        )
    columns += [
        F.when(F.col(flag), "Yes").otherwise("No").alias(name)
        for flag, name in yes_no.items() if flag in stats.columns
    ]
    types = dict(stats.dtypes)
    for c in enrichment_columns(stats):
        columns.append(F.coalesce(_text(c, types[c]), F.lit("")).alias(P.DISPLAY_NAMES.get(c, c)))
    return stats.select(*columns)
