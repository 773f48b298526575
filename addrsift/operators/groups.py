"""Statistics grouped by network operator, country or organisation; geo filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import is_eu_country, is_gdpr_country
from ..session import pinned
from .joins import salted_join, sorted_by_text

# group kind -> key column, extra column taken from the smallest address
_KINDS = {"asn": ("asn", "org"), "country": ("cc", "country"), "org": ("org", None)}


def outside_eu(stats: DataFrame) -> DataFrame:
    """Addresses outside the EU; an unknown country counts as outside."""
    return stats.where(~F.coalesce(is_eu_country("cc"), F.lit(False)))


def outside_gdpr(stats: DataFrame) -> DataFrame:
    """Addresses outside the GDPR region; an unknown country counts as outside."""
    return stats.where(~F.coalesce(is_gdpr_country("cc"), F.lit(False)))


def _with_note(name: str, note: str) -> Column:
    return F.concat(F.col(name), F.coalesce(F.concat(F.lit(" ("), F.col(note), F.lit(")")), F.lit("")))


def group_label(kind: str) -> Column:
    """Heading of the group of a row, as the table view shows it."""
    if kind == "asn":
        return F.coalesce(_with_note("asn", "org"), F.lit("Unknown ASN"))
    if kind == "country":
        return F.coalesce(_with_note("country", "cc"), F.lit("Unknown Country"))
    if kind == "org":
        return F.coalesce("org", F.lit("Unknown Organization"))
    if kind == "correlation":
        return F.coalesce("correlation", F.lit("Unknown"))
    raise ValueError(f"unknown group kind {kind!r}")


def group_key(kind: str) -> Column:
    """Key of the group of a row, as records carry it."""
    column = {"correlation": "correlation"}.get(kind) or _KINDS[kind][0]
    return F.coalesce(column, F.lit("unknown"))


def label_totals(stats: DataFrame, kind: str) -> DataFrame:
    """Groups by heading, largest first."""
    totals = stats.groupBy(group_label(kind).alias("group_label")).agg(
        F.sum("count").alias("total_count"), F.count(F.lit(1)).alias("unique_ips")
    )
    return sorted_by_text(totals, "group_label", F.desc("total_count"))


def key_totals(stats: DataFrame, kind: str) -> DataFrame:
    """Groups by key, in key order; the extra name is that of the smallest address."""
    extra = _KINDS[kind][1]
    aggs = [F.sum("count").alias("total_count"), F.count(F.lit(1)).alias("unique_ips")]
    if extra is not None:
        aggs.append(F.min_by(extra, "ip").alias(extra))
    return stats.groupBy(group_key(kind).alias("group_key")).agg(*aggs).orderBy("group_key")


def group_members(stats: DataFrame, kind: str, order: bool = True) -> DataFrame:
    """Members of every group in long form, one row per address."""
    members = stats.select(
        group_key(kind).alias("group_key"), "ip", "count", "first_seen", "last_seen"
    )
    if not order:
        return members
    if kind == "correlation":
        return _members_in_place(stats, kind).select(members.columns)
    return members.orderBy("group_key", "ip")


def members_with_totals(stats: DataFrame, kind: str) -> DataFrame:
    """Members in long form with the totals of their group, the largest group first."""
    return _members_in_place(stats, kind, F.desc("total_events"))


def _members_in_place(stats: DataFrame, kind: str, *before: Column) -> DataFrame:
    """Members and the totals of their group, by ``before``, the key of the group and the address.

    The statistics are written once, so that totals and members come from one pass
    over the logs.  A key may be the joined values of an address, a text as long as they
    are many: groups are known by its digest and get their places first, so that neither
    joins nor sort keys hold the text.  Most addresses may share the group of those
    without a place, so members of a group are spread over copies of its totals.
    """
    digest = F.unhex(F.sha2("group_key", 256)).alias("_group")
    members = pinned(group_members(stats, kind, order=False).select("*", digest))
    totals = members.groupBy("_group").agg(
        F.any_value("group_key").alias("_key"), F.count(F.lit(1)).alias("unique_ips"), F.sum("count").alias("total_events")
    )
    # ids grow with the partition, and so does the order
    places = pinned(
        sorted_by_text(totals, "_key", *before)
        .select("_group", "unique_ips", "total_events", F.monotonically_increasing_id().alias("_place"))
    )
    return salted_join(members, places, ["_group"], F.col("ip")).orderBy("_place", "ip").drop("_group", "_place")


def nested_groups(stats: DataFrame, kind: str) -> DataFrame:
    """One row per group with its members in an array, for groups known to be small."""
    member = F.struct("ip", "count", "first_seen", "last_seen")
    groups = stats.groupBy(group_key(kind).alias("group_key")).agg(
        F.sum("count").alias("total_count"), F.sort_array(F.collect_list(member)).alias("ips")
    )
    return sorted_by_text(groups, "group_key")
