"""Relating addresses to a field of delimited logs or to a pattern.

The layout of every file is sniffed from its first lines, which are read alone; the
resulting table has one row per file and is joined to the lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import field_at, field_map, registered_domain, split_fields
from ..session import pinned
from ..sources.lines import PATHS, file_heads, split_first, split_table
from .joins import sorted_by_text

#: Every text that holds an address matches this.
_LIKE_ADDRESS = r"[0-9]\.[0-9]|:[0-9a-fA-F]*:"
_COUNTS = {d: f"_c{i}" for i, d in enumerate(P.DELIMITERS)}


def sample_lines(lines: DataFrame, n: int = P.SAMPLE_LINES) -> DataFrame:
    """The first ``n`` lines of every file with their rank; see :func:`file_heads`."""
    return file_heads(lines, n)


def delimiter_scores(sample: DataFrame) -> DataFrame:
    """Per file and delimiter: mean count, deviation, consistency and score.

    Counts are whole numbers, so sums and sums of squares keep the population
    deviation free of rounding that depends on the order of rows.
    """
    filled = F.col("value") != ""
    counted = sample.withColumns(
        {
            c: F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))
            for d, c in _COUNTS.items()
        }
    )
    per_file = counted.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(filled).alias("n"),
        F.min(F.struct("rank", "row_id", "value", "last_id")).alias("_line"),
        *[F.sum(F.when(filled, F.col(c))).alias(f"s{c}") for c in _COUNTS.values()],
        *[F.sum(F.when(filled, F.col(c) * F.col(c))).alias(f"q{c}") for c in _COUNTS.values()],
    )
    options = F.array(
        *[
            F.struct(
                F.lit(i).alias("rank"), F.lit(d).alias("delimiter"),
                F.col(f"s{c}").alias("s"), F.col(f"q{c}").alias("q"),
            )
            for i, (d, c) in enumerate(_COUNTS.items())
        ]
    )
    n, s, q = F.col("n"), F.col("_o.s"), F.col("_o.q")
    mean = s / n
    deviation = F.sqrt((n * q - s * s).cast("double")) / n
    return (
        per_file.select("file_path", "n_lines", "n", "_line", F.explode(options).alias("_o"))
        .where((F.col("n_lines") >= 2) & (F.col("n") > 0))
        .select(
            "file_path", "_line",
            F.col("_o.rank").alias("rank"), F.col("_o.delimiter").alias("delimiter"),
            mean.alias("mean"), deviation.alias("deviation"),
        )
        .where(F.col("mean") >= 1)
        .withColumn(
            "consistency", F.greatest(1 - F.col("deviation") / F.col("mean"), F.lit(0.0))
        )
        .withColumn("score", F.col("consistency") * F.col("mean"))
    )


def csv_layouts(lines: DataFrame, header: bool | None = None) -> DataFrame:
    """Layout of every delimited file; files that are not delimited have no row.

    The best score wins, the earlier delimiter on ties.  The first line is a header
    if at least half of its fields (rounded down) start with a letter, unless
    ``header`` says so or not.

    A header is known again by its text (``header_line``), in the first split of
    its file.  If that text holds an address, lines that repeat it count, so such
    files are scanned once more to know the header by its place (``header_row``),
    as it always is for lines of a column.
    """
    best = delimiter_scores(sample_lines(lines)).groupBy("file_path").agg(
        F.max_by(
            F.struct("delimiter", "mean", "consistency", "_line"),
            F.struct("score", -F.col("rank")),
        ).alias("_b")
    )
    fields = split_fields(F.col("_b._line.value"), F.col("_b.delimiter"))
    named = F.size(F.filter("_fields", lambda x: x.rlike("^[A-Za-z]")))
    has_header = (
        F.lit(header) if header is not None else named >= F.floor(F.size("_fields") / 2)
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>"))
    layouts = (
        best.where(F.col("_b.consistency") >= 0.8)
        .withColumn("_fields", fields)
        .withColumn("has_header", has_header)
        .select(
            "file_path",
            F.col("_b.delimiter").alias("delimiter"),
            (F.floor("_b.mean") + 1).cast("int").alias("field_count"),
            "has_header",
            F.when(F.col("has_header"), field_map(F.col("_fields"))).otherwise(empty).alias("fields"),
            F.when(F.col("has_header"), F.col("_b._line.row_id")).alias("header_row"),
            F.when(F.col("has_header"), F.col("_b._line.last_id")).alias("split_end"),
            F.when(F.col("has_header"), F.col("_b._line.value")).alias("header_line"),
        )
    )
    if PATHS not in lines.schema["file_path"].metadata:
        return layouts
    layouts = pinned(layouts)
    doubtful = layouts.where(F.col("header_line").rlike(_LIKE_ADDRESS))
    if doubtful.isEmpty():
        return layouts
    first = lines.where("block_start = 0").join(doubtful.select("file_path"), "file_path")
    places = split_table(first).select("file_path", F.col("first_id").alias("_row"), F.col("last_id").alias("_end"))
    return (
        layouts.join(places, "file_path", "left")
        .withColumns({"header_row": F.coalesce("header_row", "_row"), "split_end": F.coalesce("split_end", "_end")})
        .select(layouts.columns)
    )


def with_layout(lines: DataFrame, layouts: DataFrame, field: str | None = None) -> DataFrame:
    """Lines without header lines, plus ``delimiter`` and ``field_index`` of ``field``.

    Files without a layout keep all lines and get nulls.  A header that is known by
    its place (``header_row``) is looked for there; should Spark cut the file otherwise
    than when the layout was taken, that is an error, never a header among the data.
    Others are known by their text (``header_line``).
    """
    name = "" if field is None else field.strip(" \t\r\n").lower()
    for column, kind in (("header_row", "bigint"), ("split_end", "bigint"), ("header_line", "string")):
        if column not in layouts.columns:
            layouts = layouts.withColumn(column, F.lit(None).cast(kind))
    table = pinned(
        layouts.select(
            "file_path", "delimiter", "header_row", "split_end", "header_line",
            F.try_element_at("fields", F.lit(name)).alias("field_index"),
        )
    )
    joined = lines.join(table, "file_path", "left")
    place = split_first(F.col("row_id"), F.col("header_row"), F.col("split_end"))
    data = F.when(F.col("header_row").isNotNull(), place != 0).when(F.col("header_line").isNotNull(), F.col("value") != F.col("header_line"))
    first = (F.col("block_start") == 0) & (F.col("header_row").isNotNull() | F.col("header_line").isNotNull())
    return joined.where(F.when(first, data).otherwise(F.lit(True))).drop("header_row", "split_end", "header_line")


def user_value() -> Column:
    """Lower-cased field of lines from :func:`with_layout`."""
    return F.lower(field_at("value", F.col("delimiter"), F.col("field_index")))


def host_value(domain: bool = False) -> Column:
    """Lower-cased host field, cut to its registered domain if asked."""
    host = field_at("value", F.col("delimiter"), F.col("field_index"))
    return F.lower(registered_domain(host) if domain else host)


def custom_value(pattern: str, line: Column | str = "value") -> Column:
    """First capture group of the first match, or the whole match; case-sensitive."""
    group = 1 if re.compile(pattern).groups else 0
    return F.regexp_extract(line, pattern, group)


def correlate(
    lines: DataFrame,
    user: str | None = None,
    host: str | None = None,
    custom: str | None = None,
    domain: bool = False,
    header: bool | None = None,
    custom_needs_layout: bool = False,
    layouts: DataFrame | None = None,
) -> tuple[DataFrame, Column]:
    """Lines ready for extraction and the expression of their correlation value.

    Exactly one of ``user``, ``host`` and ``custom`` is given.  A pattern works on
    any text; ``custom_needs_layout`` restricts it to files with a layout and skips
    their header lines.
    """
    given = [x for x in (user, host, custom) if x is not None]
    if len(given) != 1:
        raise ValueError("exactly one of user, host and custom correlation is possible")
    if custom is not None:
        if not custom_needs_layout:
            return lines, custom_value(custom)
        laid = with_layout(lines, csv_layouts(lines, header) if layouts is None else layouts)
        return laid, F.when(F.col("delimiter").isNotNull(), custom_value(custom))
    field = user if user is not None else host
    laid = with_layout(lines, csv_layouts(lines, header) if layouts is None else layouts, field)
    return laid, user_value() if user is not None else host_value(domain)


def ip_correlations(entries: DataFrame) -> DataFrame:
    """Distinct (ip, correlation) pairs with their counts: the long form, any size."""
    return (
        entries.where(F.col("correlation").isNotNull())
        .groupBy("ip", "correlation").agg(F.count(F.lit(1)).alias("count"))
    )


def correlation_groups(stats: DataFrame, label: str = "Correlation") -> DataFrame:
    """Addresses and events per correlation value set, largest first."""
    groups = stats.groupBy(F.coalesce("correlation", F.lit("unknown")).alias("correlation_value")).agg(
        F.count(F.lit(1)).alias("unique_ips"), F.sum("count").alias("total_events")
    ).withColumn("label", F.lit(label))
    return sorted_by_text(groups, "correlation_value", F.desc("total_events"))
