"""Queries over network joins, groups, lookups, captured answers and output shapes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import networks as NF
from ..functions import responses as R
from ..operators import entries as E
from ..operators import groups as G
from ..operators import lookups as L
from ..operators import networks as N
from ..operators import stats as S
from ..plans.dig import dig
from ..session import checkpoint_dir, pinned
from ..sinks import views as V
from ..sinks import writers as W
from ..sources import lists as T
from .base import query
from .checks import ENTRIES, EU, GDPR, HITS, LINES, stats_of, v4_number, v6_hex, with_
from .extraction import END, START
from .inputs import NOW, check_sql, frame, log_lines, table
from .statistics import STATS, entries

# -- membership and longest prefix --------------------------------------------------------


@query(with_(check_sql("address_pool"), f"""SELECT event_id, ip4, net4,
  {v4_number('ip4')} // (1 << (32 - plen)) = {v4_number("split_part(net4, '/', 1)")} // (1 << (32 - plen)) AS inside,
  ip4 = split_part(net4, '/', 1) AS same
FROM (SELECT *, CAST(split_part(net4, '/', 2) AS BIGINT) AS plen FROM address_pool)"""))
def cidr_match_v4(spark, sf_dir):
    return frame(spark, sf_dir, "address_pool").select(
        "event_id", "ip4", "net4",
        NF.cidr_match("ip4", "net4").alias("inside"),
        NF.cidr_match("ip4", "substring_index(net4, '/', 1)").alias("same"),
    )


@query(with_(check_sql("address_pool"), f"""SELECT event_id, ip6, net6,
  left({v6_hex('ip6')}, plen // 4) = left({v6_hex("replace(split_part(net6, '/', 1), '::', ':0:0:0')")}, plen // 4) AS inside
FROM (SELECT *, CAST(split_part(net6, '/', 2) AS BIGINT) AS plen FROM address_pool)"""))
def cidr_match_v6(spark, sf_dir):
    return frame(spark, sf_dir, "address_pool").select(
        "event_id", "ip6", "net6", NF.cidr_match("ip6", "net6").alias("inside")
    )


def _inside(ip: str, net: str) -> str:
    """SQL: address in network; IPv6 prefixes are whole hex digits."""
    base, plen = f"split_part({net}, '/', 1)", f"CAST(split_part({net}, '/', 2) AS BIGINT)"
    size = f"(1 << (32 - {plen}))"
    return (
        f"CASE WHEN NOT contains({net}, '/') THEN {ip} = {net} "
        f"WHEN contains({net}, ':') <> contains({ip}, ':') THEN false "
        f"WHEN contains({net}, ':') THEN left({v6_hex(ip)}, {plen} // 4) = left({v6_hex(base)}, {plen} // 4) "
        f"ELSE {v4_number(ip)} // {size} = {v4_number(base)} // {size} END"
    )


# The names of the threat lists, as columns of results.
_LISTS = ["CINSBadRep", "PeerDrop", "NordVPN_v4", "NordVPN_v6", "Mullvad_v4", "Mullvad_v6", "PhishTank"]
_FLAG_COLUMNS = ", ".join(
    f"CASE WHEN bool_or(list_name = '{n}' AND hit) THEN 'Yes' ELSE 'No' END AS {n}" for n in _LISTS
)


@query(with_(ENTRIES, check_sql("threats"), "ips AS (SELECT ip, count(*) AS n FROM entries GROUP BY ip)",
             f"""SELECT ip, max(n) AS "count", {_FLAG_COLUMNS}
  FROM (SELECT ip, n, list_name, {_inside('ip', 'network')} AS hit FROM ips, threats) GROUP BY ip"""))
def threat_flags(spark, sf_dir):
    stats = S.ip_stats(entries(spark, sf_dir)).select("ip", "count")
    return N.with_threat_flags(stats, frame(spark, sf_dir, "threats"))


_GEO = [check_sql("geo_blocks"), f"""located AS (SELECT s.*, g.cc, g.country, g.city, g.latitude, g.longitude
  FROM stats s LEFT JOIN (SELECT ip, network, cc, country, city, latitude, longitude
    FROM (SELECT ip FROM stats), geo_blocks WHERE {_inside('ip', 'network')}
    QUALIFY row_number() OVER (PARTITION BY ip ORDER BY CAST(split_part(network, '/', 2) AS INT) DESC) = 1) g
  ON s.ip = g.ip)"""]
_ASN = [check_sql("asn_blocks"), f"""placed AS (SELECT l.*, 'AS' || a.asn AS asn, a.org FROM located l
  LEFT JOIN (SELECT ip, asn, org FROM (SELECT ip FROM stats), asn_blocks WHERE {_inside('ip', 'network')}
    QUALIFY row_number() OVER (PARTITION BY ip ORDER BY CAST(split_part(network, '/', 2) AS INT) DESC, 'AS' || asn, org NULLS FIRST) = 1) a
  ON l.ip = a.ip)"""]
PLACED = [*STATS, *_GEO, *_ASN]


def _stats(spark, sf_dir):
    return S.ip_stats(entries(spark, sf_dir, detect_login=True)).drop("correlation")


def placed_stats(spark, sf_dir):
    return N.with_geo(
        _stats(spark, sf_dir), frame(spark, sf_dir, "geo_blocks"), frame(spark, sf_dir, "asn_blocks")
    )


@query(with_(STATS, _GEO, 'SELECT ip, "count", cc, country, city, latitude, longitude FROM located'))
def geo_lpm(spark, sf_dir):
    geo = N.with_geo(_stats(spark, sf_dir), frame(spark, sf_dir, "geo_blocks"))
    return geo.select("ip", "count", "cc", "country", "city", "latitude", "longitude")


@query(with_(check_sql("address_pool"), """ips AS (SELECT DISTINCT unnest([ip4, ip6]) AS ip FROM address_pool)""",
    f"""nets AS (SELECT 'n' || event_id AS cc, net, CAST(split_part(net, '/', 2) AS BIGINT) AS plen, split_part(net, '/', 1) AS base
  FROM (SELECT event_id, unnest([net4, net6]) AS net FROM address_pool WHERE event_id % 7 = 0))""",
    f"""keyed AS (SELECT cc, plen, CASE WHEN contains(net, ':') THEN left({v6_hex("replace(base, '::', ':0:0:0')")}, plen // 4)
  ELSE CAST({v4_number('base')} // (1 << (32 - plen)) AS VARCHAR) END AS key, contains(net, ':') AS six FROM nets)""",
    f"""asked AS (SELECT ip, plen, CASE WHEN contains(ip, ':') THEN left({v6_hex('ip')}, plen // 4)
  ELSE CAST({v4_number('ip')} // (1 << (32 - plen)) AS VARCHAR) END AS key, contains(ip, ':') AS six
  FROM ips, (SELECT DISTINCT plen, contains(net, ':') AS of6 FROM nets) WHERE of6 = contains(ip, ':'))""",
    """best AS (SELECT ip, min(cc) AS cc, plen FROM asked JOIN keyed USING (plen, key, six) GROUP BY ip, plen
  QUALIFY row_number() OVER (PARTITION BY ip ORDER BY plen DESC) = 1)""",
    "SELECT ip, cc FROM ips LEFT JOIN best USING (ip)"))
def lpm_many_lengths(spark, sf_dir):
    """Longest prefix among networks of nearly every length, found by halving."""
    pool = frame(spark, sf_dir, "address_pool")
    ips = pool.select(F.explode(F.array("ip4", "ip6")).alias("ip")).distinct()
    named = F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("cc")
    blocks = pool.where("event_id % 7 = 0").select(named, F.explode(F.array("net4", "net6")).alias("network"))
    return N.with_networks(ips, blocks, halve=True).select("ip", "cc")


@query(with_(PLACED, "SELECT ip, cc, coalesce(asn, 'AS0') AS asn, coalesce(org, country) AS org FROM placed"))
def asn_override(spark, sf_dir):
    """ASN and organisation of the second table take the place of those of the first."""
    geo = frame(spark, sf_dir, "geo_blocks").withColumns({"asn": F.lit("AS0"), "org": F.col("country")})
    placed = N.with_geo(_stats(spark, sf_dir), geo, frame(spark, sf_dir, "asn_blocks"))
    return placed.select("ip", "cc", F.coalesce("asn", F.lit("AS0")).alias("asn"), "org")


@query(with_(LINES, HITS, "stats AS (SELECT DISTINCT ip FROM hits)", _GEO,
             "SELECT event_id, CAST(pos AS INTEGER) AS pos, h.ip, cc, city FROM hits h JOIN located l ON h.ip = l.ip"))
def enrich_entries_geo(spark, sf_dir):
    """Every entry with the place of its address, looked up once per address."""
    blocks = frame(spark, sf_dir, "geo_blocks")
    placed = L.enrich_entries(
        E.extract_entries(log_lines(spark, sf_dir)), lambda ips: N.with_geo(ips, blocks)
    )
    return placed.select(F.col("row_id").alias("event_id"), "pos", "ip", "cc", "city")




@query(with_(STATS, _GEO, f'SELECT ip, "count", cc FROM located WHERE cc IS NULL OR cc NOT IN ({EU})'))
def filter_outside_eu(spark, sf_dir):
    return G.outside_eu(placed_stats(spark, sf_dir)).select("ip", "count", "cc")


@query(with_(STATS, _GEO, f"""SELECT ip, "count", cc FROM located WHERE cc IS NULL OR cc NOT IN ({GDPR})"""))
def filter_outside_gdpr(spark, sf_dir):
    return G.outside_gdpr(placed_stats(spark, sf_dir)).select("ip", "count", "cc")


# -- groups --------------------------------------------------------------------------------


@query(with_(PLACED, """SELECT coalesce(asn, 'unknown') AS group_key, CAST(sum("count") AS BIGINT) AS total_count,
  count(*) AS unique_ips, arg_min_null(org, ip) AS org FROM placed GROUP BY 1"""))
def group_by_asn(spark, sf_dir):
    return G.key_totals(placed_stats(spark, sf_dir), "asn")


@query(with_(PLACED, """SELECT coalesce(cc, 'unknown') AS group_key, CAST(sum("count") AS BIGINT) AS total_count,
  count(*) AS unique_ips, arg_min_null(country, ip) AS country FROM placed GROUP BY 1"""))
def group_by_country(spark, sf_dir):
    return G.key_totals(placed_stats(spark, sf_dir), "country")


@query(with_(PLACED, """SELECT coalesce(org, 'unknown') AS group_key, CAST(sum("count") AS BIGINT) AS total_count,
  count(*) AS unique_ips FROM placed GROUP BY 1"""))
def group_by_org(spark, sf_dir):
    return G.key_totals(placed_stats(spark, sf_dir), "org")


@query(with_(PLACED, """SELECT CASE WHEN asn IS NULL THEN 'Unknown ASN' WHEN org IS NULL THEN asn
  ELSE asn || ' (' || org || ')' END AS group_label, CAST(sum("count") AS BIGINT) AS total_count,
  count(*) AS unique_ips FROM placed GROUP BY 1"""))
def group_labels_asn(spark, sf_dir):
    return G.label_totals(placed_stats(spark, sf_dir), "asn")


@query(with_(PLACED, """SELECT CASE WHEN country IS NULL THEN 'Unknown Country' ELSE country || ' (' || cc || ')' END AS group_label,
  CAST(sum("count") AS BIGINT) AS total_count, count(*) AS unique_ips FROM placed GROUP BY 1"""))
def group_labels_country(spark, sf_dir):
    return G.label_totals(placed_stats(spark, sf_dir), "country")


@query(with_(PLACED, """SELECT coalesce(cc, 'unknown') AS group_key, ip, "count", first_seen, last_seen FROM placed"""))
def group_members_country(spark, sf_dir):
    return G.group_members(placed_stats(spark, sf_dir), "country")


# -- lookups ---------------------------------------------------------------------------------


@query(with_(STATS, check_sql("ptr"), """SELECT s.ip, "count", rdns FROM stats s LEFT JOIN
  (SELECT ip, min(hostname) AS rdns FROM ptr WHERE hostname <> '' AND hostname <> ip GROUP BY ip) p ON s.ip = p.ip"""))
def hostname_join(spark, sf_dir):
    named = L.with_hostname(_stats(spark, sf_dir), frame(spark, sf_dir, "ptr"))
    return named.select("ip", "count", "rdns")


def _cache(spark, sf_dir):
    rows = frame(spark, sf_dir, "cache_rows")
    return rows.select("ip", "source", "cached_at", F.create_map(F.lit("score"), "score").alias("data"))


_FRESH = [check_sql("cache_rows"), f"""fresh AS (SELECT ip, source, max(cached_at) AS cached_at, max_by(score, cached_at) AS score
  FROM cache_rows WHERE floor(({NOW} - cached_at) / 3600) <= 24 GROUP BY ip, source)"""]


@query(with_(_FRESH, "SELECT * FROM fresh"))
def cache_fresh(spark, sf_dir):
    fresh = L.fresh_cache(_cache(spark, sf_dir), NOW, 24)
    return fresh.select("ip", "source", "cached_at", F.col("data")["score"].alias("score"))


@query(with_(STATS, _FRESH, "SELECT ip FROM stats WHERE ip NOT IN (SELECT ip FROM fresh WHERE source = 'abuse')"))
def cache_misses(spark, sf_dir):
    fresh = L.fresh_cache(_cache(spark, sf_dir), NOW, 24)
    return L.cache_misses(_stats(spark, sf_dir), fresh, "abuse")


@query(with_(STATS, _FRESH, f"""merged AS (SELECT * FROM fresh UNION ALL
    SELECT ip, 'abuse', {NOW}, 'new' FROM stats WHERE ip NOT IN (SELECT ip FROM fresh WHERE source = 'abuse') AND starts_with(ip, '8.'))
  SELECT * FROM merged""".replace("merged AS", ", merged AS")))
def cache_ttl_merge(spark, sf_dir):
    fresh = L.fresh_cache(_cache(spark, sf_dir), NOW, 24)
    misses = L.cache_misses(_stats(spark, sf_dir), fresh, "abuse")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    fetched = misses.select(
        "ip", F.lit("abuse").alias("source"), F.lit(NOW).cast("bigint").alias("cached_at"),
        F.when(F.col("ip").startswith("8."), F.create_map(F.lit("score"), F.lit("new"))).otherwise(none).alias("data"),
    )
    return L.merge_cache(fresh, fetched).select(
        "ip", "source", "cached_at", F.col("data")["score"].alias("score")
    )


@query(with_(STATS, check_sql("cache_rows"), """SELECT ip, "count" FROM stats WHERE ip NOT IN
  (SELECT ip FROM cache_rows WHERE source = 'abuse')"""))
def skip_enriched(spark, sf_dir):
    done = _cache(spark, sf_dir).select(
        "ip", F.when(F.col("source") == "abuse", F.col("data")["score"]).alias("abuseScore")
    )
    return L.not_enriched(_stats(spark, sf_dir), done, "abuseScore").select("ip", "count")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS shared,
  'a' || c_custkey AS a, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'b' END AS b FROM customer""")
def merge_maps(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    first = F.create_map(
        F.lit("shared"), F.lit("first"), F.lit("a"), F.concat(F.lit("a"), F.col("c_custkey").cast("string"))
    )
    second = F.when(
        F.col("c_custkey") % 3 != 0,
        F.create_map(F.lit("shared"), F.lit("second"), F.lit("b"), F.lit("b")),
    )
    data = rows.select("c_custkey", L.merge_data(first, second).alias("data"))
    return data.select("c_custkey", *[F.col("data")[k].alias(k) for k in ("shared", "a", "b")])


@query(with_(check_sql("providers"), "SELECT c_custkey, name FROM providers WHERE enabled AND api_key <> '' AND url_template <> ''"))
def usable_providers(spark, sf_dir):
    return L.usable_providers(frame(spark, sf_dir, "providers")).select("c_custkey", "name")


@query(with_(check_sql("providers"), "SELECT c_custkey, replace(replace(url_template, '{ip}', ip), '{api_key}', api_key) AS url FROM providers"))
def url_template(spark, sf_dir):
    return frame(spark, sf_dir, "providers").select(
        "c_custkey", R.fill_template("url_template", "ip", "api_key").alias("url")
    )


@query(with_(ENTRIES, "SELECT ip, 'length' AS source, CAST(length(ip) AS VARCHAR) AS size, false AS failed FROM entries GROUP BY ip"))
def user_lookup(spark, sf_dir):
    """A user function run once per distinct address."""
    found = L.fetch(entries(spark, sf_dir), "length", lambda ip: {"size": len(ip)}, NOW)
    return found.select(
        "ip", "source", F.col("data")["size"].alias("size"), F.col("error").isNotNull().alias("failed")
    )


_RUNS = [NOW - 25 * 3600, NOW - 2 * 3600, NOW + 2 * 3600]


def _size(ip: str) -> dict[str, int]:
    if ":" in ip:
        raise ValueError(f"no size of {ip}")
    return {"size": len(ip)}


@query(with_(ENTRIES, f"""SELECT ip, 'size' AS source, CAST(CASE WHEN bool_or(event_id % 3 = 0) THEN {_RUNS[2]} ELSE {_RUNS[1]} END AS BIGINT) AS cached_at,
  CAST(length(ip) AS VARCHAR) AS size FROM entries WHERE NOT contains(ip, ':') GROUP BY ip"""))
def cache_store(spark, sf_dir):
    """The stored cache after three runs: the second finds the rows of the first fresh, the
    third finds them expired; addresses that fail are never stored."""
    store = f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    seen = pinned(entries(spark, sf_dir).select("ip", "row_id"))
    for now, wanted in zip(_RUNS, (seen.where("row_id % 3 = 0"), seen, seen), strict=True):
        cache = W.read_store(spark, store)
        found = L.lookup_cached(wanted, cache, "size", _size, now)
        W.write_store(L.merge_cache(cache, found.select("ip", "source", "cached_at", "data")), store)
    return W.read_store(spark, store).select("ip", "source", "cached_at", F.col("data")["size"].alias("size"))


# -- threat list text ------------------------------------------------------------------------


@query(with_(check_sql("threat_lines"), """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 3 THEN '8.' || s_suppkey || '.0.0/16' ELSE '8.8.8.' || s_suppkey END AS network,
  CASE s_suppkey % 6 WHEN 3 THEN s_name ELSE s_name || ', seen' END AS message FROM threat_lines JOIN supplier USING (s_suppkey) WHERE s_suppkey % 6 IN (3, 5)"""))
def threat_list_parse(spark, sf_dir):
    return T.parse_threat_list(frame(spark, sf_dir, "threat_lines")).select(
        "s_suppkey", "network", "message"
    )


@query("""SELECT s_suppkey, CASE s_suppkey % 9 WHEN 0 THEN 'CINSBadRep' WHEN 1 THEN 'PeerDrop' WHEN 2 THEN 'NordVPN_v4'
  WHEN 3 THEN 'NordVPN_v6' WHEN 4 THEN 'Mullvad_v4' WHEN 5 THEN 'Mullvad_v6' WHEN 6 THEN 'PhishTank'
  WHEN 7 THEN 'other_list' ELSE 'my_own_list' END AS list_name FROM supplier""")
def threat_list_name(spark, sf_dir):
    lines = frame(spark, sf_dir, "threat_lines")
    return lines.select("s_suppkey", T.list_name("path").alias("list_name"))


# -- captured answers --------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE WHEN ok THEN c_name END AS netname,
  CASE WHEN ok AND c_custkey % 5 <> 0 THEN 'abuse' || c_custkey || '@example.com' END AS abuse,
  CASE WHEN ok AND c_custkey % 3 = 0 THEN '8.0.0.0 - 8.0.0.' || (c_custkey % 256) WHEN ok THEN '10.0.0.' || (c_custkey % 256) END AS cidr,
  CASE WHEN ok THEN 'P. ' || c_mktsegment END AS admin
FROM (SELECT *, c_custkey % 10 <> 9 AS ok FROM customer)""")
def whois_fields(spark, sf_dir):
    answers = frame(spark, sf_dir, "whois_answers")
    return answers.select("c_custkey", R.whois_fields("answer").alias("w")).select("c_custkey", "w.*")


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 9 THEN 'whois' || c_nationkey || '.example.net' END AS server FROM customer")
def whois_referral(spark, sf_dir):
    answers = frame(spark, sf_dir, "whois_answers")
    return answers.select("c_custkey", R.whois_referral("answer").alias("server"))


@query("""SELECT c_custkey, CASE WHEN ok THEN CAST(c_custkey % 101 AS VARCHAR) END AS "abuseScore",
  CASE WHEN ok AND c_custkey % 3 <> 0 THEN c_mktsegment END AS "usageType",
  CASE WHEN ok THEN CAST(c_custkey % 17 AS VARCHAR) END AS "totalReports",
  CASE WHEN ok AND c_custkey % 4 <> 0 THEN 'Net ' || c_nationkey END AS isp,
  CASE WHEN ok THEN CASE c_custkey % 5 WHEN 0 THEN 'Yes' ELSE 'No' END END AS "isTor"
FROM (SELECT *, c_custkey % 13 <> 12 AS ok FROM customer)""")
def abuse_json(spark, sf_dir):
    answers = frame(spark, sf_dir, "json_answers")
    return answers.select("c_custkey", R.abuse_report("threat_json").alias("a")).select("c_custkey", "a.*")


@query("""SELECT c_custkey, 'C' || c_nationkey AS country, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE c_mktsegment END AS city,
  'R' || (c_custkey % 7) AS region, c_name AS org, CASE WHEN c_custkey % 3 < 2 THEN 'AS' || c_custkey END AS asn,
  'Etc/' || c_nationkey AS timezone FROM customer""")
def geo_provider_json(spark, sf_dir):
    answers = frame(spark, sf_dir, "json_answers")
    return answers.select("c_custkey", R.geo_report("geo_json").alias("g")).select("c_custkey", "g.*")


@query("""SELECT c_custkey, CASE WHEN ok THEN CAST(c_custkey % 101 AS VARCHAR) END AS abuse_score,
  CASE WHEN ok THEN CASE c_custkey % 2 WHEN 0 THEN 'true' ELSE 'false' END END AS whitelisted,
  CASE WHEN ok AND c_custkey % 3 <> 0 THEN c_mktsegment END AS usage_type,
  CASE WHEN ok THEN CAST(c_custkey % 17 AS VARCHAR) END AS total_reports
FROM (SELECT *, c_custkey % 13 <> 12 AS ok FROM customer)""")
def threat_provider_json(spark, sf_dir):
    answers = frame(spark, sf_dir, "json_answers")
    return answers.select("c_custkey", R.threat_report("threat_json").alias("t")).select("c_custkey", "t.*")


_SHORT = "strftime(o_orderdate, '%m/%-d/%Y %H:%M')"


@query(f"""SELECT o_orderkey, 'host' || o_orderkey || '.example.com' AS tls_cn,
  CASE o_orderkey % 3 WHEN 0 THEN 'Root ' || o_orderstatus WHEN 1 THEN 'Root' || o_orderstatus END AS tls_issuer,
  'sha' || (256 + 128 * (o_orderkey % 3)) || 'WithRSA' AS tls_algorithm, {_SHORT} AS tls_created,
  CASE WHEN o_orderkey % 4 <> 0 THEN {_SHORT} END AS tls_expires,
  CASE WHEN o_orderkey % 3 < 2 THEN 'TLSv1.' || (o_orderkey % 4) END AS tls_version,
  CAST(1024 * (1 + o_orderkey % 4) AS VARCHAR) AS tls_keysize FROM orders""")
def tls_fields(spark, sf_dir):
    answers = frame(spark, sf_dir, "tls_answers")
    return answers.select("o_orderkey", R.certificate("cert", "session").alias("c")).select("o_orderkey", "c.*")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'Foo ' || strftime(o_orderdate, '%b %-d %H:%M:%S %Y') || ' GMT'
  ELSE {_SHORT} END AS shown FROM orders""")
def cert_date(spark, sf_dir):
    return frame(spark, sf_dir, "cert_dates").select("o_orderkey", R.cert_date("cert_text").alias("shown"))


_STATUS = "CASE o_orderkey % 7 WHEN 6 THEN NULL ELSE CAST(200 + o_orderkey % 5 AS VARCHAR) END"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce('301->' || {_STATUS}, '301') ELSE {_STATUS} END AS http_status,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'web ' || o_orderstatus WHEN o_orderkey % 3 = 0 THEN 'first' END AS http_server,
  CASE o_orderkey % 5 WHEN 0 THEN 'Yes' ELSE 'No' END AS http_csp,
  CASE WHEN o_orderkey % 3 = 0 THEN coalesce({_STATUS}, '301') ELSE {_STATUS} END AS last_status FROM orders""")
def http_headers(spark, sf_dir):
    answers = frame(spark, sf_dir, "http_answers")
    both = answers.select(
        "o_orderkey", R.http_headers("headers", follow_redirects=True).alias("h"),
        R.http_headers("headers")["http_status"].alias("last_status"),
    )
    return both.select("o_orderkey", "h.*", "last_status")


_TITLE_LINE = "regexp_extract(chr(10) || html, '(?i)\\n([^\\n]*<title[^\\n]*)', 1)"
_TITLE = f"trim(regexp_replace({_TITLE_LINE}, '<[^>]*>', '', 'g'), ' ' || chr(9) || chr(13) || chr(10))"


@query(f"""SELECT page_id, CASE WHEN length(t) > 50 THEN left(t, 47) || '...' ELSE nullif(t, '') END AS title
FROM (SELECT page_id, {_TITLE} AS t FROM pages)""")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.html_title("html").alias("title"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 >= 4 THEN 'DEAD' ELSE
  'avg: ' || printf('%.1f', CAST(CAST((o_orderkey % 300) || '.' || (10 + o_custkey % 90) AS FLOAT) AS DOUBLE)) || 'ms jitter: '
  || printf('%.1f', CAST(CAST((o_custkey % 9) || '.' || (100 + o_orderkey % 900) AS FLOAT) AS DOUBLE)) || 'ms' END AS ping FROM orders""")
def ping_summary(spark, sf_dir):
    return frame(spark, sf_dir, "ping_answers").select("o_orderkey", R.ping_summary("answer").alias("ping"))


# -- output shapes --------------------------------------------------------------------------------



def _json(fields: list[str]) -> str:
    """SQL of a JSON object text from ``name:kind:expression`` triples."""
    parts = []
    for f in fields:
        name, kind, value = f.split(":", 2)
        text = f"'\"' || {value} || '\"'" if kind == "s" else f"CAST({value} AS VARCHAR)"
        parts.append(f"'\"{name}\":' || coalesce({text}, 'null')")
    return " || ',' || ".join(parts)


_CORE_JSON = _json([
    "ip_address:s:ip", "first_seen:s:first_seen", "last_seen:s:last_seen", 'count:n:"count"',
    "first_timestamp:n:first_ts", "last_timestamp:n:last_ts", "login_success_count:n:login_success_count",
    "login_failed_count:n:login_failed_count", "is_ddos:n:'false'", "is_spray:n:'false'",
    "is_scan:n:'false'", "is_bruteforce:n:'false'",
])


def _present(names: list[str]) -> str:
    return " || ".join(f"coalesce(',\"{n}\":\"' || {v} || '\"', '')" for n, v in names)


_FEATURES = f"""SELECT ip, "count", longitude, latitude, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":['
  || printf('%.6f', longitude) || ',' || printf('%.6f', latitude) || ']}},"properties":{{' || {_CORE_JSON}
  || {_present([(c, c) for c in ('asn', 'cc', 'city', 'country', 'org')])} || '}}}}' AS feature
FROM placed WHERE latitude IS NOT NULL"""
#: Numbered in the order of documents.
GEO_BODY = f"""SELECT feature AS value, row_number() OVER (ORDER BY "count" DESC, ip) AS rn FROM ({_FEATURES})"""


@query(with_(PLACED, _FEATURES))
def geojson_features(spark, sf_dir):
    return V.geo_features(placed_stats(spark, sf_dir))


_ENRICHMENT = _present([
    ("asn", "asn"), ("cc", "cc"), ("city", "city"), ("country", "country"),
    ("latitude", "printf('%.6f', latitude)"), ("longitude", "printf('%.6f', longitude)"), ("org", "org"),
])


_RECORDS = f"""SELECT '{{' || {_CORE_JSON} || CASE WHEN e = '' THEN '' ELSE ',"enrichment":{{' || substr(e, 2) || '}}' END || '}}' AS value, ip, "count"
FROM (SELECT *, {_ENRICHMENT} AS e FROM placed)"""
STATS_BODY = f"""SELECT value, row_number() OVER (ORDER BY "count" DESC, ip) AS rn FROM ({_RECORDS})"""


@query(with_(PLACED, f"SELECT value FROM ({_RECORDS})"))
def stats_json(spark, sf_dir):
    return V.stats_json(placed_stats(spark, sf_dir))


@query(with_(PLACED, """SELECT ip AS "IP Address", coalesce(first_seen, '(no date)') AS "First Seen",
  coalesce(last_seen, '(no date)') AS "Last Seen", "count" AS "Count", search_hits AS "SearchHits",
  'OK:' || login_success_count || ' F:' || login_failed_count AS "Login",
  CASE WHEN first_ts > 0 AND "count" >= 10 AND last_ts - first_ts <= 86400 THEN 'Yes' ELSE 'No' END AS "DDoS",
  'No' AS "Spray", 'No' AS "Scan", 'No' AS "BruteForce", coalesce(asn, '') AS asn, coalesce(cc, '') AS cc,
  coalesce(city, '') AS city, coalesce(country, '') AS country, coalesce(printf('%.6f', latitude), '') AS latitude,
  coalesce(printf('%.6f', longitude), '') AS longitude, coalesce(org, '') AS org FROM placed"""))
def table_view(spark, sf_dir):
    flagged = S.with_attack_flags(
        placed_stats(spark, sf_dir), spray=False, scan=False, bruteforce=False, window=86400
    )
    return V.display_view(S.by_count(flagged), search_hits=True)


@query(with_(ENTRIES, """SELECT ip AS ip_address, date_string AS date, 'events.log' AS filename, ts FROM entries
  QUALIFY row_number() OVER (PARTITION BY ip ORDER BY event_id, pos) = 1"""))
def entry_records(spark, sf_dir):
    return V.entry_records(S.unique_entries(entries(spark, sf_dir)), with_filename=True)


_KEPT = [*ENTRIES, f"""kept AS (SELECT * FROM entries WHERE NOT starts_with(ip, '10.') AND (ts = 0 OR ts BETWEEN {START} AND {END}))""",
         stats_of("kept", hits="contains(lower(line), 'password')")]


@query(with_(_KEPT, _GEO, _ASN, check_sql("threats"), f"""SELECT p.*, t.* EXCLUDE (ip),
  first_ts > 0 AND "count" >= 5 AND last_ts - first_ts <= 86400 AS is_ddos,
  first_ts > 0 AND login_failed_count >= 2 AND login_failed_count < 5 AND last_ts - first_ts > 86400 AND last_ts - first_ts < 864000 AS is_spray,
  first_ts > 0 AND "count" >= 5 AND last_ts - first_ts > 0 AND last_ts - first_ts <= 17280 AS is_scan,
  first_ts > 0 AND login_failed_count >= 5 AND last_ts - first_ts <= 86400 AS is_bruteforce
FROM placed p JOIN (SELECT ip, {_FLAG_COLUMNS} FROM (SELECT ip, list_name, {_inside('ip', 'network')} AS hit
  FROM (SELECT ip FROM stats), threats) GROUP BY ip) t ON p.ip = t.ip
WHERE cc IS NULL OR cc NOT IN ({EU})"""))
def dig_end_to_end(spark, sf_dir):
    """All steps: filters, time range, statistics, flags, places, threat lists, region filter."""
    return dig(
        log_lines(spark, sf_dir),
        detect_login=True, search="password", no_private=True,
        start_ts=START, end_ts=END, include_no_timestamp=True,
        detect_ddos=True, detect_spray=True, detect_scan=True, detect_bruteforce=True,
        threshold=5, window_seconds=86400,
        geo_blocks=frame(spark, sf_dir, "geo_blocks"), asn_blocks=frame(spark, sf_dir, "asn_blocks"),
        threats=frame(spark, sf_dir, "threats"), outside_eu=True,
    ).drop("correlation")
