"""Queries over extraction, classification, filters and time arguments."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import addresses as A
from ..functions import lines as L
from ..functions import text as X
from ..functions import times as T
from ..operators import entries as E
from ..session import checkpoint_dir
from .base import query
from .checks import ENTRIES, EU, FAILED, GDPR, HITS, LINES, V4, V6, dated, exploded, with_
from .inputs import CODE_OF_NATION, NOW, check_sql, frame, log_lines, table

START, END = 1704844800, 1705708800  # 2024-01-10 and 2024-01-20, 00:00:00 UTC


@query(f"""SELECT doc_id, CAST(unnest(range(len(ips))) AS INTEGER) AS pos, unnest(ips) AS ip
FROM (SELECT doc_id, regexp_extract_all(text, '{V4}') AS ips FROM documents)""")
def extract_ipv4_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(A.extract_ipv4("text")).alias("pos", "ip"))


@query(with_(exploded("pages", "html", "page_id"), "SELECT page_id, CAST(pos AS INTEGER) AS pos, ip FROM hits"))
def extract_ips_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumnRenamed("html", "value")
    return E.explode_ips(pages).select("page_id", "pos", "ip")


@query(with_(LINES, f"""SELECT event_id, CAST(unnest(range(len(ips))) AS INTEGER) AS pos, unnest(ips) AS ip
FROM (SELECT event_id, regexp_extract_all(line, '{V6}') AS ips FROM log_lines)"""))
def extract_ipv6_lines(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    return lines.select(
        F.col("row_id").alias("event_id"),
        F.posexplode(A.extract_ipv6("value")).alias("pos", "ip"),
    )


@query(with_(check_sql("address_pool"), exploded(
    "(SELECT event_id, 'a ' || ip || ' b ' || ip6 || ', ' || ip || 'x std::dead ' || event_id || '::' || event_id || ' c' AS t FROM address_pool)",
    "t", "event_id"), "SELECT event_id, CAST(pos AS INTEGER) AS pos, ip FROM hits"))
def extract_ips_mixed(spark, sf_dir):
    pool = frame(spark, sf_dir, "address_pool")
    text = F.concat(
        F.lit("a "), "ip", F.lit(" b "), "ip6", F.lit(", "), "ip", F.lit("x std::dead "),
        F.col("event_id").cast("string"), F.lit("::"), F.col("event_id").cast("string"), F.lit(" c"),
    )
    lines = pool.select("event_id", text.alias("value"))
    return E.explode_ips(lines).select("event_id", "pos", "ip")


@query(with_(LINES, HITS, "SELECT event_id, CAST(pos AS INTEGER) AS pos, ip FROM hits"))
def explode_entries(spark, sf_dir):
    return E.explode_ips(log_lines(spark, sf_dir)).select(
        F.col("row_id").alias("event_id"), "pos", "ip"
    )


@query(with_(LINES, "l AS (SELECT event_id, line FROM log_lines)", dated("l", "line"),
             "SELECT event_id, date_string, ts FROM dated"))
def extract_date_formats(spark, sf_dir):
    return E.with_date(log_lines(spark, sf_dir)).select(
        F.col("row_id").alias("event_id"), "date_string", "ts"
    )


@query(with_(LINES, f"SELECT event_id, CASE WHEN {FAILED} THEN 'failed' ELSE 'success' END AS login_status FROM log_lines"))
def login_status(spark, sf_dir):
    return log_lines(spark, sf_dir).select(
        F.col("row_id").alias("event_id"), L.login_status("value").alias("login_status")
    )


@query(f"SELECT doc_id, CASE WHEN {FAILED.replace('lower(line)', 'lower(text)')} THEN 'failed' ELSE 'success' END AS login_status FROM documents")
def login_status_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", L.login_status("text").alias("login_status")
    )


@query(with_(LINES, "SELECT event_id, contains(lower(line), 'accepted pass') AS hit FROM log_lines"))
def search_literal(spark, sf_dir):
    return log_lines(spark, sf_dir).select(
        F.col("row_id").alias("event_id"), L.search_flag("value", search="ACCEPTED Pass").alias("hit")
    )


@query(with_(LINES, "SELECT event_id, regexp_matches(line, '(?i)USER[1-3]\\d* from|status=30\\d') AS hit FROM log_lines"))
def search_regex(spark, sf_dir):
    flag = L.search_flag("value", search="ignored", search_regex=r"USER[1-3]\d* from|status=30\d")
    return log_lines(spark, sf_dir).select(F.col("row_id").alias("event_id"), flag.alias("hit"))


_OCTETS = ", ".join(f"TRY_CAST(split_part(v4, '.', {i}) AS INT) AS o{i}" for i in (1, 2, 3, 4))
_POOL = [check_sql("address_pool"), f"""judged AS (SELECT *,
  o1 <= 255 AND o2 <= 255 AND o3 <= 255 AND o4 <= 255 AS whole,
  o1 IN (0, 10, 127) OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168)
    OR (o1 = 169 AND o2 = 254) AS local4,
  (o1 = 192 AND o2 = 0 AND o3 = 2) OR (o1 = 198 AND o2 = 51 AND o3 = 100)
    OR (o1 = 203 AND o2 = 0 AND o3 = 113) OR o1 >= 224 AS special4,
  low = '::1' OR left(low, 3) IN ('fe8', 'fe9', 'fea', 'feb') OR left(low, 2) IN ('fc', 'fd') AS local6,
  low IN ('::', '::0') OR left(low, 2) = 'ff' OR left(low, 8) = '2001:db8' AS special6
FROM (SELECT *, {_OCTETS} FROM (SELECT event_id, ip, lower(ip) AS low, contains(ip, ':') AS six,
  contains(ip, '.') AS dot, regexp_replace(lower(ip), '^::ffff:', '') AS v4 FROM address_pool)))"""]


@query(with_(_POOL, """SELECT event_id, ip, CASE WHEN dot THEN NOT six AND whole AND local4
  ELSE coalesce(local6, false) END AS private FROM judged"""))
def is_private(spark, sf_dir):
    pool = frame(spark, sf_dir, "address_pool")
    return pool.select("event_id", "ip", A.is_private("ip").alias("private"))


@query(with_(_POOL, """SELECT event_id, ip, CASE WHEN dot THEN whole AND (local4 OR special4)
  ELSE coalesce(local6 OR special6, false) END AS reserved FROM judged"""))
def is_reserved(spark, sf_dir):
    pool = frame(spark, sf_dir, "address_pool")
    return pool.select("event_id", "ip", A.is_reserved("ip").alias("reserved"))


@query(with_(check_sql("address_pool"), """SELECT event_id, contains(ip, '.') AND NOT contains(ip, ':') AS v4,
  contains(ip, ':') AS v6 FROM address_pool"""))
def ip_family(spark, sf_dir):
    pool = frame(spark, sf_dir, "address_pool")
    return pool.select("event_id", A.is_ipv4("ip").alias("v4"), A.is_ipv6("ip").alias("v6"))


@query(f"""SELECT n_nationkey, lower(cc) AS cc, cc IN ({EU}) AS eu, cc IN ({GDPR}) AS gdpr
FROM (SELECT n_nationkey, {CODE_OF_NATION} AS cc FROM nation)""")
def country_regions(spark, sf_dir):
    codes = F.lower(F.expr(CODE_OF_NATION))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", codes.alias("cc"))
    return rows.select(
        "n_nationkey", "cc", A.is_eu_country("cc").alias("eu"), A.is_gdpr_country("cc").alias("gdpr")
    )


@query(with_(LINES, HITS, "SELECT DISTINCT ip, sha256(ip) AS digest FROM hits"))
def ip_sha256(spark, sf_dir):
    hits = E.explode_ips(log_lines(spark, sf_dir))
    return hits.select("ip").distinct().select("ip", A.ip_digest("ip").alias("digest"))


# -- filters ----------------------------------------------------------------------

_V4 = "contains(ip, '.')"
_IN10 = "starts_with(ip, '10.')"


def _filtered(spark, sf_dir, **flags):
    entries = E.extract_entries(log_lines(spark, sf_dir), keep=E.address_test(**flags))
    return entries.select(F.col("row_id").alias("event_id"), "pos", "ip")


def _filter_check(keep: str) -> str:
    return with_(LINES, HITS, f"SELECT event_id, CAST(pos AS INTEGER) AS pos, ip FROM hits WHERE {keep}")


@query(_filter_check(f"NOT {_IN10}"))
def filter_no_private(spark, sf_dir):
    return _filtered(spark, sf_dir, no_private=True)


@query(_filter_check(
    f"NOT ({_IN10} OR starts_with(ip, '203.0.113.') OR starts_with(ip, '198.51.100.') OR starts_with(ip, '2001:db8'))"
))
def filter_no_reserved(spark, sf_dir):
    return _filtered(spark, sf_dir, no_reserved=True)


@query(_filter_check(f"NOT {_V4}"))
def filter_no_ipv4(spark, sf_dir):
    return _filtered(spark, sf_dir, no_ipv4=True)


@query(_filter_check(_V4))
def filter_no_ipv6(spark, sf_dir):
    return _filtered(spark, sf_dir, no_ipv6=True)


def _ranged(spark, sf_dir, start, end, include_missing=False):
    kept = E.extract_entries(log_lines(spark, sf_dir), time_range=(start, end, include_missing))
    return kept.select(F.col("row_id").alias("event_id"), "pos", "ip", "ts")


def _range_check(keep: str) -> str:
    return with_(ENTRIES, f"SELECT event_id, CAST(pos AS INTEGER) AS pos, ip, ts FROM entries WHERE {keep}")


@query(_range_check(f"ts <> 0 AND ts BETWEEN {START} AND {END}"))
def time_range(spark, sf_dir):
    return _ranged(spark, sf_dir, START, END)


@query(_range_check(f"ts <> 0 AND ts <= {START}"))
def time_range_open_start(spark, sf_dir):
    return _ranged(spark, sf_dir, None, START)


@query(_range_check(f"ts = 0 OR ts >= {END}"))
def time_range_include_missing(spark, sf_dir):
    return _ranged(spark, sf_dir, END, None, include_missing=True)


@query(_range_check(f"ts <> 0 AND ts >= {END}"))
def time_range_filter(spark, sf_dir):
    """The same as a filter over entries."""
    kept = E.filter_time_range(E.extract_entries(log_lines(spark, sf_dir)), END)
    return kept.select(F.col("row_id").alias("event_id"), "pos", "ip", "ts")


@query(with_(ENTRIES, f"""SELECT count(*) FILTER (WHERE ts = 0 OR ts NOT BETWEEN {START} AND {END}) AS excluded,
  count(*) FILTER (WHERE ts = 0) AS no_timestamp FROM entries"""))
def time_filter_counts(spark, sf_dir):
    return E.time_range_counts(E.extract_entries(log_lines(spark, sf_dir)), START, END)


@query(with_(ENTRIES, f"""SELECT count(*) FILTER (WHERE ts <> 0 AND ts BETWEEN {START} AND {END}) AS kept,
  count(*) FILTER (WHERE ts = 0 OR ts NOT BETWEEN {START} AND {END}) AS excluded, count(*) FILTER (WHERE ts = 0) AS no_timestamp FROM entries"""))
def time_filter_observed(spark, sf_dir):
    """What a filter left out, observed while its result was written."""
    path = f"{checkpoint_dir(spark)}/entries-{uuid.uuid4().hex}"
    seen = E.write_time_range(E.extract_entries(log_lines(spark, sf_dir)), path, START, END)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("kept")).select("kept", *[F.lit(n).cast("bigint").alias(c) for c, n in seen.items()])


@query(with_(ENTRIES, check_sql("range_rules"), """SELECT name AS range_name, count(*) AS entries,
  count(DISTINCT ip) AS ips, min(ts) AS first_ts FROM entries JOIN range_rules
  ON ts <> 0 AND (start_ts IS NULL OR ts >= start_ts) AND (end_ts IS NULL OR ts <= end_ts) GROUP BY name"""))
def range_rules_join(spark, sf_dir):
    entries = E.extract_entries(log_lines(spark, sf_dir))
    matched = E.match_ranges(entries, frame(spark, sf_dir, "range_rules"))
    return matched.groupBy("range_name").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("ip").alias("ips"),
        F.min("ts").alias("first_ts"),
    )


# -- time arguments -----------------------------------------------------------------

# Names of time units.
_UNIT = """CASE WHEN u IN ('s','sec','second','seconds') THEN 1 WHEN u IN ('m','min','minute','minutes') THEN 60
  WHEN u IN ('h','hr','hour','hours') THEN 3600 WHEN u IN ('d','day','days') THEN 86400
  WHEN u IN ('w','week','weeks') THEN 604800 WHEN u IN ('mo','month','months') THEN 2592000
  WHEN u IN ('y','yr','year','years') THEN 31536000 END"""
_SPANS = f"""spans AS (SELECT *, TRY_CAST(regexp_extract(trimmed, '^(\\d+)[A-Za-z]+$', 1) AS BIGINT) * {_UNIT} AS span
  FROM (SELECT *, lower(regexp_extract(trimmed, '^\\d+([A-Za-z]+)$', 1)) AS u
    FROM (SELECT event_id, time_text, trim(time_text, ' ' || chr(9) || chr(10) || chr(13)) AS trimmed FROM time_texts)))"""
_TIMES = [check_sql("time_texts"), _SPANS, dated("spans", "trimmed"), f"""timed AS (SELECT event_id, time_text,
  CAST(CASE WHEN trimmed = '' THEN 0 WHEN regexp_full_match(trimmed, '\\d+') THEN CAST(trimmed AS BIGINT)
    WHEN span IS NOT NULL THEN {NOW} - span WHEN date_string IS NOT NULL THEN ts END AS BIGINT) AS stamp FROM dated)"""]


@query(with_(check_sql("time_texts"), _SPANS,
             f"SELECT event_id, CASE WHEN trimmed = time_text THEN {NOW} - span END AS stamp FROM spans"))
def relative_time_column(spark, sf_dir):
    texts = frame(spark, sf_dir, "time_texts")
    return texts.select("event_id", T.relative_ts("time_text", NOW).alias("stamp"))


@query(with_(check_sql("time_texts"), _SPANS,
             "SELECT event_id, CASE WHEN trimmed = time_text THEN span END AS seconds FROM spans"))
def window_seconds_column(spark, sf_dir):
    texts = frame(spark, sf_dir, "time_texts")
    return texts.select("event_id", T.window_seconds("time_text").alias("seconds"))


@query(with_(_TIMES, "SELECT event_id, stamp FROM timed"))
def time_expr_column(spark, sf_dir):
    texts = frame(spark, sf_dir, "time_texts")
    return texts.select("event_id", T.time_expr_ts("time_text", NOW).alias("stamp"))


@query(with_(_TIMES, """, bounds AS (SELECT event_id, CASE WHEN trim(time_text) <> '' THEN stamp END AS s,
    CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE 1706000000 END AS e,
    event_id % 5 = 1 AS no_comma, stamp IS NULL AS bad FROM timed)
  SELECT event_id, CASE WHEN ok THEN s END AS start_ts, CASE WHEN ok THEN e END AS end_ts
  FROM (SELECT *, NOT no_comma AND NOT bad AND (s IS NULL OR e IS NULL OR e >= s) AS ok FROM bounds)"""))
def time_range_column(spark, sf_dir):
    tail = (
        F.when(F.col("event_id") % 5 == 0, F.lit(", "))
        .when(F.col("event_id") % 5 == 1, F.lit(" 1706000000"))
        .otherwise(F.lit(",1706000000 "))
    )
    texts = frame(spark, sf_dir, "time_texts").withColumn("range", F.concat("time_text", tail))
    texts = texts.select("event_id", T.time_range("range", NOW).alias("r"))
    return texts.select("event_id", "r.start_ts", "r.end_ts")


# -- text -----------------------------------------------------------------------------

_LABELS = "regexp_extract_all(host, '[^.]+')"


@query(f"""SELECT page_id, host, CASE WHEN n < 2 THEN host
  WHEN n >= 3 AND regexp_matches(lower(host), '\\.(co|com|net|org|gov|edu|ac)\\.+(uk|au|nz|za|br|jp)\\.*$')
  THEN array_to_string(list_slice(labels, n - 2, n), '.') ELSE array_to_string(list_slice(labels, n - 1, n), '.') END AS domain
FROM (SELECT *, {_LABELS} AS labels, len({_LABELS}) AS n FROM (SELECT page_id,
  regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '.Co.uk' WHEN 2 THEN '..org.au.' ELSE '.gov.us' END AS host FROM pages))""")
def registered_domains(spark, sf_dir):
    ending = (
        F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, ".Co.uk")
        .when(F.col("page_id") % 4 == 2, "..org.au.").otherwise(".gov.us")
    )
    host = F.concat(F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1), ending)
    hosts = table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    return hosts.select("page_id", "host", X.registered_domain("host").alias("domain"))


@query("""SELECT conv_id, turn, trim(chr(9) || ' ' || text || chr(13) || chr(10) || ' ', ' ' || chr(9) || chr(13) || chr(10)) AS trimmed
FROM conversations""")
def trim_text(spark, sf_dir):
    padded = F.concat(F.lit("\t "), "text", F.lit("\r\n "))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.trim(padded).alias("trimmed")
    )
