"""The whole analysis in one call, steps in a fixed order.

lines -> entries -> address filters -> top addresses -> last entries -> time range
-> statistics -> attack flags -> enrichment -> region filters -> output shape.
Limits come before the time range; search counts hits and drops nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..operators import correlate as C
from ..operators import entries as E
from ..operators import groups as G
from ..operators import lookups as L
from ..operators import networks as N
from ..operators import stats as S
from ..session import pinned
from ..sinks import views as V

OUTPUTS = ("stats", "table", "records", "json", "geojson", "groups", "group_labels", "members")


@dataclass
class Options:
    """Options of :func:`dig`; unset ones switch their step off."""

    # extraction
    detect_login: bool = False
    search: str | None = None
    search_regex: str | None = None
    ipv6_mode: str = "reference"
    assume_year: int | None = None
    # correlation, at most one
    correlate_user: str | None = None
    correlate_host: str | None = None
    correlate_custom: str | None = None
    extract_domain: bool = False
    header: bool | None = None
    layouts: DataFrame | None = None  # ready-made ones save the pass that takes them
    custom_needs_layout: bool = False
    # filters
    no_private: bool = False
    no_reserved: bool = False
    no_ipv4: bool = False
    no_ipv6: bool = False
    top_limit: int = 0
    limit: int = 0
    start_ts: int | None = None
    end_ts: int | None = None
    include_no_timestamp: bool = False
    # attacks
    detect_ddos: bool = False
    detect_spray: bool = False
    detect_scan: bool = False
    detect_bruteforce: bool = False
    threshold: int = 10
    window_seconds: int = 300
    # enrichment tables
    geo_blocks: DataFrame | None = None
    asn_blocks: DataFrame | None = None
    hostnames: DataFrame | None = None
    threats: DataFrame | None = None
    threat_lists: list[str] | None = None
    lookups: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    outside_eu: bool = False
    outside_gdpr: bool = False
    # output
    output: str = "stats"
    group_by: str | None = None

    @property
    def time_range(self) -> tuple[int | None, int | None, bool] | None:
        if self.start_ts is None and self.end_ts is None:
            return None
        return self.start_ts, self.end_ts, self.include_no_timestamp

    @property
    def searching(self) -> bool:
        return bool(self.search or self.search_regex)

    @property
    def correlating(self) -> bool:
        return any(
            x is not None for x in (self.correlate_user, self.correlate_host, self.correlate_custom)
        )

    def check(self) -> None:
        if self.output not in OUTPUTS:
            raise ValueError(f"output must be one of {OUTPUTS}")
        needs_geo = (
            self.outside_eu or self.outside_gdpr or self.output == "geojson"
            or self.group_by in ("asn", "country", "org")
        )
        if needs_geo and self.geo_blocks is None and self.asn_blocks is None:
            raise ValueError("region filters, maps and groups by region need geo_blocks or asn_blocks")
        if self.output in ("groups", "group_labels", "members") and not (
            self.group_by or self.correlating
        ):
            raise ValueError("grouped output needs group_by or a correlation")


def time_bounds(spark, text: str, now: int) -> dict[str, int | None]:
    """``start_ts`` and ``end_ts`` options of a ``from,to`` text; wrong text is an error."""
    given = spark.range(1).select(F.lit(text).alias("text"))
    row = given.select(times.time_range("text", now, strict=True).alias("r")).first()
    return {"start_ts": row.r.start_ts, "end_ts": row.r.end_ts}


def dig(lines: DataFrame, **options) -> DataFrame:
    """Run the analysis over lines of any source; see :class:`Options`."""
    o = Options(**options)
    o.check()
    stats = _attacks(_statistics(_entries(lines, o), o), o)
    return _shape(_enriched(stats, o), o)


def _entries(lines: DataFrame, o: Options) -> DataFrame:
    correlation = None
    if o.correlating:
        lines, correlation = C.correlate(
            lines, user=o.correlate_user, host=o.correlate_host, custom=o.correlate_custom,
            domain=o.extract_domain, header=o.header, layouts=o.layouts,
            custom_needs_layout=o.custom_needs_layout,
        )
    latest = {"last": o.limit} if o.limit and not o.top_limit else {}
    return E.extract_entries(
        lines,
        **latest,
        detect_login=o.detect_login,
        search=o.search,
        search_regex=o.search_regex,
        ipv6_mode=o.ipv6_mode,
        assume_year=o.assume_year,
        correlation=correlation,
        keep=E.address_test(o.no_private, o.no_reserved, o.no_ipv4, o.no_ipv6),
        # limits look at entries of all times, so the range can only come early without them
        time_range=None if o.top_limit or o.limit else o.time_range,
    )


def _statistics(entries: DataFrame, o: Options) -> DataFrame:
    if o.time_range is None or not (o.top_limit or o.limit):
        keep = None
    else:
        keep = E.in_time_range("ts", *o.time_range)
    if o.top_limit and not o.limit:
        return S.top_stats(entries, o.top_limit, keep)
    if o.top_limit:
        entries = S.entries_of_top_ips(entries, o.top_limit)
        if o.limit:
            entries = E.last_entries(entries, o.limit)
    return S.ip_stats(entries if keep is None else entries.where(keep))


def _attacks(stats: DataFrame, o: Options) -> DataFrame:
    return S.with_attack_flags(
        stats, o.detect_ddos, o.detect_bruteforce, o.detect_spray, o.detect_scan,
        o.threshold, o.window_seconds,
    )


def _enriched(stats: DataFrame, o: Options) -> DataFrame:
    threats = None if o.threats is None else N.wanted_threats(o.threats, o.threat_lists)
    if not (o.geo_blocks is None and o.asn_blocks is None and threats is None):
        stats = N.with_networks(stats, o.geo_blocks, o.asn_blocks, threats)
    if o.hostnames is not None:
        stats = L.with_hostname(stats, o.hostnames)
    if o.lookups:
        stats = pinned(stats)  # every lookup starts from its addresses
    for lookup in o.lookups:
        stats = stats.join(lookup(stats.select("ip")), "ip", "left")
    if threats is not None:
        stats = stats.select(*[c for c in stats.columns if c != "lists"], *N.threat_flags(o.threat_lists))
    if o.outside_eu:
        stats = G.outside_eu(stats)
    if o.outside_gdpr:
        stats = G.outside_gdpr(stats)
    return stats


def _shape(stats: DataFrame, o: Options) -> DataFrame:
    kind = "correlation" if o.correlating else o.group_by
    if o.output == "groups":
        return C.correlation_groups(stats, _label(o)) if o.correlating else G.key_totals(stats, kind)
    if o.output == "group_labels":
        return G.label_totals(stats, kind)
    if o.output == "members":
        return G.members_with_totals(stats, kind) if o.correlating else G.group_members(stats, kind)
    if not o.correlating:
        stats = stats.drop("correlation") if o.output != "stats" else stats
    if o.output == "table":
        return V.display_view(S.by_count(stats), o.detect_login, o.searching)
    if o.output == "records":
        return V.stats_records(S.by_count(stats), o.searching)
    if o.output == "json":
        return V.stats_json(stats, o.searching)
    if o.output == "geojson":
        return V.geo_features(S.by_count(stats), o.searching)
    return stats


def _label(o: Options) -> str:
    if o.correlate_user is not None:
        return "User"
    return "Host" if o.correlate_host is not None else "Custom"
