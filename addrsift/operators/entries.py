"""From lines to entries (one row per address occurrence), and entry filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions.lines import extract_date, login_status, search_flag
from ..session import pinned


#: Widths of range buckets: from a day to longer than any time stamp.
#: In place of a width, for entries without a time stamp.
_UNDATED = -1
_WIDTHS = 28


def explode_ips(lines: DataFrame, ipv6_mode: str = "reference", value: str = "value") -> DataFrame:
    """Add ``pos`` and ``ip``: one row per address of a line, duplicates kept.

    The array stays inside the generator, so it is built once per line and lines
    without addresses are gone before any other expression runs.
    """
    return lines.select("*", F.posexplode(A.extract_ips(value, ipv6_mode)).alias("pos", "ip"))


def with_date(df: DataFrame, value: str = "value", assume_year: int | None = None) -> DataFrame:
    """Add ``date_string`` and ``ts`` of :func:`functions.lines.extract_date`."""
    return (
        df.withColumn("_date", extract_date(value, assume_year))
        .select(*df.columns, "_date.date_string", "_date.ts")
    )


def address_test(
    no_private: bool = False, no_reserved: bool = False, no_ipv4: bool = False,
    no_ipv6: bool = False,
) -> Callable[[Column], Column] | None:
    """The address filters that are switched on, as one test of an address."""
    tests = [
        (no_ipv4, A.is_ipv4), (no_ipv6, A.is_ipv6), (no_private, A.is_private), (no_reserved, A.is_reserved),
    ]
    on = [test for wanted, test in tests if wanted]
    if not on:
        return None

    def keep(ip: Column) -> Column:
        out = ~on[0](ip)
        for test in on[1:]:
            out = out & ~test(ip)
        return out

    return keep


def address_filter(**options: bool) -> Column | None:
    """The same filters as a predicate over the column ``ip``."""
    keep = address_test(**options)
    return None if keep is None else keep(F.col("ip"))


def entry_rows(
    attributes: dict[str, Column],
    keep: Callable[[Column], Column] | None = None,
    ipv6_mode: str = "reference",
    value: str = "value",
    inside: Callable[[Column], Column] | None = None,
) -> Column:
    """Generator of ``pos``, ``ip`` and the ``attributes`` of a line.

    The addresses of a line are taken once and filtered first; only where some are
    left are the attributes computed, once for the line however many addresses it
    has.  ``inside`` may drop the line by its attributes.
    """
    hits = F.transform(A.extract_ips(value, ipv6_mode), lambda ip, i: F.struct(i.alias("pos"), ip.alias("ip")))
    if keep is not None:
        hits = F.filter(hits, lambda h: keep(h["ip"]))
    of_line = F.array(F.struct(*[c.alias(n) for n, c in attributes.items()]))
    if inside is not None:
        of_line = F.filter(of_line, inside)

    def rows(found: Column) -> Column:
        return F.flatten(
            F.transform(
                of_line,
                lambda a: F.transform(
                    found,
                    lambda h: F.struct(
                        h["pos"].alias("pos"), h["ip"].alias("ip"), *[a[n].alias(n) for n in attributes]
                    ),
                ),
            )
        )

    some = F.filter(F.array(hits), lambda found: F.size(found) > 0)
    return F.inline(F.flatten(F.transform(some, rows)))


def extract_entries(
    lines: DataFrame,
    detect_login: bool = False,
    search: str | None = None,
    search_regex: str | None = None,
    ipv6_mode: str = "reference",
    assume_year: int | None = None,
    correlation: Column | None = None,
    keep: Callable[[Column], Column] | None = None,
    time_range: tuple[int | None, int | None, bool] | None = None,
    last: int | None = None,
) -> DataFrame:
    """Entries of lines.

    ``keep`` tests an address before any line attribute is computed.
    ``correlation``, an expression over the line columns, adds a column of that name
    in which empty text is null.  ``time_range`` (start, end, include missing)
    drops entries outside while the time stamp is taken, which saves taking it once to
    filter and once to keep.
    """
    attributes = {
        "_date": extract_date("value", assume_year),
        "login_status": login_status("value") if detect_login else F.lit(None).cast("string"),
        "matches_search": search_flag("value", search, search_regex),
    }
    if correlation is not None:
        attributes["correlation"] = F.nullif(correlation, F.lit(""))
    inside = None
    if time_range is not None:
        inside = lambda a: _inside(a["_date"]["ts"], *time_range)
    numbered = ["line_number"] if "line_number" in lines.columns else []
    extra = ["correlation"] if correlation is not None else []
    if last is None:
        found = lines.select("file_path", *numbered, "row_id", entry_rows(attributes, keep, ipv6_mode, inside=inside))
    else:
        hits = explode_ips(lines, ipv6_mode)
        hits = last_entries(hits if keep is None else hits.where(keep(F.col("ip"))), last)
        found = hits.select("*", *[c.alias(n) for n, c in attributes.items()])
        if time_range is not None:
            found = found.where(_inside(F.col("_date.ts"), *time_range))
    return found.select(
        "ip",
        "_date.date_string",
        "_date.ts",
        F.col("file_path").alias("filename"),
        *numbered,
        "row_id",
        "pos",
        "login_status",
        "matches_search",
        *extra,
    )


def _inside(ts: Column, start, end, include_missing: bool) -> Column:
    """Plain comparisons, which a scan of stored entries can use."""
    inside = ts != 0
    if start is not None:
        inside = inside & (ts >= start)
    if end is not None:
        inside = inside & (ts <= end)
    return inside | (ts == 0) if include_missing else inside


def in_time_range(
    ts: str = "ts",
    start: int | Column | None = None,
    end: int | Column | None = None,
    include_missing: bool = False,
) -> Column:
    """Inclusive range with optional ends; ``ts`` 0 means no time stamp."""
    return _inside(F.col(ts), start, end, include_missing)


def filter_time_range(
    entries: DataFrame,
    start: int | None = None,
    end: int | None = None,
    include_missing: bool = False,
    observe: Observation | None = None,
) -> DataFrame:
    """Keep entries in the range; ``observe`` receives what was left out.

    The observed metrics are ``excluded`` and ``no_timestamp``, counted while the
    entries stream through the filter.
    """
    keep = in_time_range("ts", start, end, include_missing)
    if observe is not None:
        entries = entries.observe(
            observe,
            F.count_if(~keep).alias("excluded"),
            F.count_if(F.col("ts") == 0).alias("no_timestamp"),
        )
    return entries.where(keep)


def write_time_range(
    entries: DataFrame, path: str, start: int | None = None, end: int | None = None, include_missing: bool = False,
) -> dict[str, int]:
    """Writes the entries in the range as Parquet and returns what was left out, counted
    by the same single pass."""
    seen = Observation()
    filter_time_range(entries, start, end, include_missing, seen).write.parquet(path)
    return seen.get


def time_range_counts(
    entries: DataFrame, start: int | None = None, end: int | None = None,
    include_missing: bool = False,
) -> DataFrame:
    """The same two counts as a one-row table."""
    keep = in_time_range("ts", start, end, include_missing)
    return entries.agg(
        F.count_if(~keep).alias("excluded"),
        F.count_if(F.col("ts") == 0).alias("no_timestamp"),
    )


def last_entries(entries: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries in input order."""
    return entries.orderBy(F.desc("row_id"), F.desc("pos")).limit(n)


#: Cut ranges that a join may broadcast, counted each time (about 60 bytes each); copies
#: that salting makes of more than that, together.
BROADCAST_RANGES, SALTED_RANGES = 100_000, 20_000_000


def match_ranges(
    entries: DataFrame, ranges: DataFrame, include_missing: bool = False, bucket_seconds: int = 86_400,
    broadcast_rows: int = BROADCAST_RANGES,
) -> DataFrame:
    """Entries joined to every named range that holds them.

    ``ranges(name, start_ts, end_ts)`` has null for an open end.  A range is cut
    into buckets of whole powers of two times ``bucket_seconds``, as few as cover
    it, and an entry meets the one bucket of each width that holds it; ends are
    then compared exactly.  So the work is an equi-join, whatever the number of
    ranges and however long they are.

    Entries of one day or open-ended ranges put most entries into one bucket.  The cut
    ranges are counted: up to ``broadcast_rows`` of them come to the entries, which stay
    where they are; more are copied for salts over which the entries of a bucket are dealt.
    """
    widths = [bucket_seconds << i for i in range(_WIDTHS)]
    low, high = -(1 << 40), 1 << 40
    ends = ranges.select(
        "name", "start_ts", "end_ts", F.coalesce("start_ts", F.lit(low)).alias("_lo"), F.coalesce("end_ts", F.lit(high)).alias("_hi")
    ).where("_lo <= _hi")
    span = F.col("_hi") - F.col("_lo")
    level = F.lit(_WIDTHS - 1)
    for i in reversed(range(_WIDTHS - 1)):
        level = F.when(span <= widths[i], i).otherwise(level)
    sized = ends.withColumn("_level", level).withColumn(
        "_width", F.element_at(F.array(*[F.lit(w).cast("bigint") for w in widths]), F.col("_level") + 1)
    )
    first, last = F.floor(F.col("_lo") / F.col("_width")), F.floor(F.col("_hi") / F.col("_width"))
    cut = sized.select("name", "start_ts", "end_ts", "_level", F.explode(F.sequence(first, last)).alias("_bucket"))
    if include_missing:  # undated entries belong to all ranges, wrong ones too
        none = F.lit(None).cast("bigint")
        every = ranges.select("name", none.alias("start_ts"), none.alias("end_ts"), F.lit(_UNDATED).alias("_level"), F.lit(0).cast("bigint").alias("_bucket"))
        cut = cut.unionByName(every)
    cut = pinned(cut)
    counted = {r["_level"]: r["count"] for r in cut.groupBy("_level").count().collect()}  # a row for each width at most
    names = entries.columns
    if not counted:
        return entries.where(F.lit(False)).withColumn("range_name", F.lit(None).cast("string"))
    places = [F.struct(F.lit(i).alias("_level"), F.floor(F.col("ts") / widths[i]).alias("_bucket")) for i in sorted(counted) if i != _UNDATED]
    missing = F.array(F.struct(F.lit(_UNDATED).alias("_level"), F.lit(0).cast("bigint").alias("_bucket")))
    own = F.when(F.col("ts") == 0, missing)  # nothing without a range of any width
    met = entries.select("*", F.inline(own.otherwise(F.array(*places)) if places else own))
    if not include_missing:
        met = met.where("ts <> 0")
    inside = (F.col("start_ts").isNull() | (F.col("ts") >= F.col("start_ts"))) & (F.col("end_ts").isNull() | (F.col("ts") <= F.col("end_ts")))
    keys, total = ["_level", "_bucket"], sum(counted.values())
    if total <= broadcast_rows:
        cut = F.broadcast(cut)
    else:
        shares = max(1, min(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), SALTED_RANGES // total))
        met = met.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, kind in entries.dtypes if "map<" not in kind]), F.lit(shares)).cast("int"))
        cut = cut.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        keys.append("_salt")
    return met.join(cut, keys).where(inside).select(*names, F.col("name").alias("range_name"))
