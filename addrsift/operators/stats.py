"""Per-address statistics and the aggregates built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


STATS_COLUMNS = [
    "ip", "first_seen", "last_seen", "count", "first_ts", "last_ts",
    "login_success_count", "login_failed_count", "search_hits", "correlation",
]


# Mergeable aggregates of entries.  ``_first`` and ``_last`` are the dated entries
# with the smallest and largest time stamp, the earliest entry winning ties;
# ``_head`` is the first entry in input order, dated or not.
_PARTIALS = {
    "_n": "count({kept} 1 {end})",
    "_first": "min({kept} CASE WHEN ts > 0 THEN struct(ts, row_id, pos, date_string) END {end})",
    "_last": "max({kept} CASE WHEN ts > 0 THEN"
    " named_struct('ts', ts, 'r', -row_id, 'p', -pos, 'date_string', date_string) END {end})",
    "_head": "min({kept} struct(row_id, pos, ts, date_string) {end})",
    "_ok": "count({kept} CASE WHEN login_status = 'success' THEN 1 END {end})",
    "_failed": "count({kept} CASE WHEN login_status = 'failed' THEN 1 END {end})",
    "_hits": "count({kept} CASE WHEN matches_search THEN 1 END {end})",
}
_MERGE = {"_first": "min", "_last": "max", "_head": "min"}
_ALL = "_all"


def ip_stats(entries: DataFrame, keep: Column | None = None, ranked: bool = False) -> DataFrame:
    """One row per address: counts, first and last sighting, login and search counts.

    With a ``correlation`` column, entries are first reduced per (address, value),
    so a hot address is spread over its values and only distinct values are
    gathered per address.  ``keep`` restricts what is counted while all entries are
    still seen; ``ranked`` then adds ``all_count``, the count without ``keep``, and
    keeps addresses that have no kept entry.
    """
    correlated = "correlation" in entries.columns
    kept, end = "", ""
    if keep is not None:
        entries = entries.withColumn("_keep", keep)
        kept, end = "CASE WHEN _keep THEN", "END"
    parts = {n: text.format(kept=kept, end=end) for n, text in _PARTIALS.items()}
    if ranked:
        parts[_ALL] = "count(1)"
    aggregates = [F.expr(text).alias(n) for n, text in parts.items()]
    joined = "CAST(null AS STRING)"
    if correlated:
        if keep is not None:
            entries = entries.withColumn("correlation", F.expr("CASE WHEN _keep THEN correlation END"))
        merged = [F.expr(f"{_MERGE.get(n, 'sum')}({n})").alias(n) for n in parts]
        values = F.expr("array_sort(collect_list(correlation))").alias("_values")
        grouped = entries.groupBy("ip", "correlation").agg(*aggregates)
        grouped = grouped.groupBy("ip").agg(*merged, values)
        joined = "CASE WHEN size(_values) > 0 THEN array_join(_values, ', ') END"
    else:
        grouped = entries.groupBy("ip").agg(*aggregates)

    # a first entry of a year before 1970 keeps its place as first
    return grouped.selectExpr(
        "ip",
        "CASE WHEN _head.ts >= 0 AND _first IS NOT NULL THEN _first.date_string"
        " ELSE _head.date_string END AS first_seen",
        "CASE WHEN _last IS NOT NULL THEN _last.date_string ELSE _head.date_string END AS last_seen",
        "_n AS count",
        "CASE WHEN _head.ts < 0 THEN _head.ts ELSE coalesce(_first.ts, _head.ts) END AS first_ts",
        "coalesce(_last.ts, _head.ts) AS last_ts",
        "_ok AS login_success_count",
        "_failed AS login_failed_count",
        "_hits AS search_hits",
        f"{joined} AS correlation",
        *([f"{_ALL} AS all_count"] if ranked else []),
    )


def top_ips(entries: DataFrame, n: int) -> DataFrame:
    """(ip, count) of the ``n`` most frequent addresses; ties by address."""
    counts = entries.groupBy("ip").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "ip").limit(n)


def entries_of_top_ips(entries: DataFrame, n: int) -> DataFrame:
    """Entries whose address is among the ``n`` most frequent."""
    return entries.join(top_ips(entries, n).select("ip"), "ip", "left_semi")


def top_stats(entries: DataFrame, n: int, keep: Column | None = None) -> DataFrame:
    """Statistics of the entries of the ``n`` most frequent addresses, in one scan.

    The same rows as ``ip_stats(entries_of_top_ips(entries, n).where(keep))``:
    ranking and statistics come out of one aggregate instead of two scans.
    """
    ranked = ip_stats(entries, keep=keep, ranked=True)
    return (
        ranked.orderBy(F.desc("all_count"), "ip").limit(n)
        .where(F.col("count") > 0)
        .drop("all_count")
    )


def by_count(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("count"), "ip")


def unique_entries(entries: DataFrame) -> DataFrame:
    """First entry of every address in input order."""
    rest = [c for c in entries.columns if c not in ("ip", "row_id", "pos")]
    first = F.min(F.struct("row_id", "pos", *rest)).alias("_e")
    return entries.groupBy("ip").agg(first).select(
        *[F.col("ip") if c == "ip" else F.col(f"_e.{c}") for c in entries.columns]
    )


def entry_totals(entries: DataFrame) -> DataFrame:
    """Unique addresses, and files among the first entries of each address."""
    return unique_entries(entries).agg(
        F.count(F.lit(1)).alias("unique_ips"),
        F.count_distinct("filename").alias("unique_files"),
    )


def distinct_ips(entries: DataFrame) -> DataFrame:
    return entries.select("ip").distinct()


# -- attack flags ---------------------------------------------------------------


def with_attack_flags(
    stats: DataFrame,
    ddos: bool = True,
    bruteforce: bool = True,
    spray: bool = True,
    scan: bool = True,
    threshold: int = 10,
    window: int | Column = 300,
) -> DataFrame:
    """Add ``is_ddos``, ``is_spray``, ``is_scan`` and ``is_bruteforce``.

    The rules look at the counts of an address and the span between its first and
    last time stamp; divisions are whole.  ``threshold`` and ``window`` (seconds)
    may be columns of the row.
    """
    threshold = threshold if isinstance(threshold, Column) else F.lit(int(threshold))
    window = window if isinstance(window, Column) else F.lit(int(window)).cast("bigint")
    span = F.col("last_ts") - F.col("first_ts")
    timed = (F.col("first_ts") > 0) & (F.col("last_ts") > 0)
    many = F.col("count") >= threshold
    failed = F.col("login_failed_count")
    half = F.floor(threshold / 2)
    rules = {
        "is_ddos": (ddos, timed & many & (span <= window)),
        "is_spray": (
            spray,
            timed & (failed >= half) & (failed < threshold)
            & (span > window) & (span < window * 10),
        ),
        "is_scan": (scan, timed & many & (span > 0) & (span <= F.floor(window / 5))),
        "is_bruteforce": (bruteforce, timed & (failed >= threshold) & (span <= window)),
    }
    return stats.withColumns({n: rule if on else F.lit(False) for n, (on, rule) in rules.items()})
