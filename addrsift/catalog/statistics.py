"""Queries over statistics, limits, attack flags and correlation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import correlate as C
from ..operators import entries as E
from ..operators import groups as G
from ..operators import stats as S
from .base import query
from .checks import ENTRIES, stats_of, with_
from .extraction import END, START
from .inputs import check_sql, csv_lines, log_lines

CORE = ["ip", "first_seen", "last_seen", "count", "first_ts", "last_ts"]


def entries(spark, sf_dir, **options):
    return E.extract_entries(log_lines(spark, sf_dir), **options)


STATS = [*ENTRIES, stats_of("entries")]


@query(with_(STATS, 'SELECT ip, first_seen, last_seen, "count", first_ts, last_ts FROM stats'))
def ip_stats(spark, sf_dir):
    return S.ip_stats(entries(spark, sf_dir)).select(*CORE)


@query(with_(STATS, 'SELECT ip, "count", login_success_count, login_failed_count FROM stats'))
def ip_stats_login(spark, sf_dir):
    return S.ip_stats(entries(spark, sf_dir, detect_login=True)).select(
        "ip", "count", "login_success_count", "login_failed_count"
    )


@query(with_(ENTRIES, stats_of("entries", hits="contains(lower(line), 'status=302')"),
             'SELECT ip, "count", search_hits FROM stats'))
def ip_stats_search(spark, sf_dir):
    return S.ip_stats(entries(spark, sf_dir, search="Status=302")).select("ip", "count", "search_hits")


@query("""WITH hits AS (SELECT doc_id, unnest(ips) AS ip FROM (SELECT doc_id,
  regexp_extract_all(text, '\\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\\b') AS ips FROM documents))
SELECT ip, count(*) AS "count" FROM hits GROUP BY ip""")
def ip_counts_documents(spark, sf_dir):
    from ..functions.addresses import extract_ipv4
    from .inputs import table

    hits = table(spark, sf_dir, "documents").select(F.explode(extract_ipv4("text")).alias("ip"))
    return hits.groupBy("ip").agg(F.count(F.lit(1)).alias("count"))


@query(with_(STATS, """SELECT ip, "count", CAST(row_number() OVER (ORDER BY "count" DESC, ip) - 1 AS BIGINT) AS place FROM stats"""))
def stats_by_count(spark, sf_dir):
    """All statistics in display order, written and read back with their places."""
    from ..session import checkpoint_dir

    ordered = S.by_count(S.ip_stats(entries(spark, sf_dir))).select("ip", "count")
    path = f"{checkpoint_dir(spark)}/by-count-{uuid.uuid4().hex}"
    ordered.write.json(path)
    # part files are in order, and so are the rows of each
    rows = spark.read.schema(ordered.schema).json(path).select("*", F.monotonically_increasing_id().alias("id"), "_metadata.file_name")
    sizes = rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = Window.orderBy("file_name").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file_name", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, "file_name").select("ip", "count", (F.col("id") - F.col("first") + F.col("before")).alias("place"))


@query(with_(ENTRIES, """SELECT ip, event_id, CAST(pos AS INTEGER) AS pos, date_string, ts FROM entries
  QUALIFY row_number() OVER (PARTITION BY ip ORDER BY event_id, pos) = 1"""))
def unique_entries(spark, sf_dir):
    first = S.unique_entries(entries(spark, sf_dir))
    return first.select("ip", F.col("row_id").alias("event_id"), "pos", "date_string", "ts")


@query(with_(ENTRIES, "SELECT count(DISTINCT ip) AS unique_ips, CAST(1 AS BIGINT) AS unique_files FROM entries"))
def entry_totals(spark, sf_dir):
    return S.entry_totals(entries(spark, sf_dir))


@query(with_(ENTRIES, "SELECT DISTINCT ip FROM entries"))
def distinct_ips(spark, sf_dir):
    return S.distinct_ips(entries(spark, sf_dir))


_TOP = 'top AS (SELECT ip, count(*) AS "count" FROM entries GROUP BY ip ORDER BY count(*) DESC, ip LIMIT 20)'


@query(with_(ENTRIES, _TOP, "SELECT * FROM top"))
def top_n_ips(spark, sf_dir):
    return S.top_ips(entries(spark, sf_dir), 20)


@query(with_(ENTRIES, _TOP, "SELECT event_id, CAST(pos AS INTEGER) AS pos, ip FROM entries WHERE ip IN (SELECT ip FROM top)"))
def entries_of_top_ips(spark, sf_dir):
    kept = S.entries_of_top_ips(entries(spark, sf_dir), 20)
    return kept.select(F.col("row_id").alias("event_id"), "pos", "ip")


@query(with_(ENTRIES, _TOP, f"kept AS (SELECT * FROM entries WHERE ip IN (SELECT ip FROM top) AND ts BETWEEN {START} AND {END})",
             stats_of("kept"), 'SELECT ip, first_seen, last_seen, "count", first_ts, last_ts FROM stats'))
def top_stats_in_range(spark, sf_dir):
    return S.top_stats(entries(spark, sf_dir), 20, E.in_time_range("ts", START, END)).select(*CORE)


@query(with_(ENTRIES, "SELECT event_id, CAST(pos AS INTEGER) AS pos, ip, ts FROM entries ORDER BY event_id DESC, pos DESC LIMIT 100"))
def last_n_entries(spark, sf_dir):
    return entries(spark, sf_dir, last=100).select(F.col("row_id").alias("event_id"), "pos", "ip", "ts")


# -- attack flags ------------------------------------------------------------------------


def _flags(spark, sf_dir, threshold, window):
    stats = S.ip_stats(entries(spark, sf_dir, detect_login=True))
    return S.with_attack_flags(stats, threshold=threshold, window=window)


def _flag_check(name: str, rule: str) -> str:
    return with_(STATS, f'SELECT ip, first_ts > 0 AND last_ts > 0 AND {rule} AS {name} FROM stats')


@query(_flag_check("is_ddos", '"count" >= 10 AND last_ts - first_ts <= 86400'))
def attack_ddos(spark, sf_dir):
    return _flags(spark, sf_dir, 10, 86400).select("ip", "is_ddos")


@query(_flag_check("is_bruteforce", "login_failed_count >= 5 AND last_ts - first_ts <= 86400"))
def attack_bruteforce(spark, sf_dir):
    return _flags(spark, sf_dir, 5, 86400).select("ip", "is_bruteforce")


@query(_flag_check("is_spray", "login_failed_count >= 5 AND login_failed_count < 10 AND last_ts - first_ts > 43200 AND last_ts - first_ts < 432000"))
def attack_spray(spark, sf_dir):
    return _flags(spark, sf_dir, 10, 43200).select("ip", "is_spray")


@query(_flag_check("is_scan", '"count" >= 10 AND last_ts - first_ts > 0 AND last_ts - first_ts <= 86400'))
def attack_scan(spark, sf_dir):
    return _flags(spark, sf_dir, 10, 432000).select("ip", "is_scan")


# -- correlation -----------------------------------------------------------------------------

ROWS = check_sql("csv_rows")
# the lines as written, and the values they were written from
CSV = [
    ROWS,
    """csv_lines AS (SELECT file_path, event_id, t || d || ip || d || CASE WHEN contains(user_name, '"')
    THEN '"' || replace(user_name, '"', '""') || '"' ELSE user_name END || d || ' ' || host || d || action AS line, d
  FROM csv_rows UNION ALL SELECT DISTINCT file_path, -1, 'Time' || d || 'IP' || d || 'User' || d || ' Host ' || d || 'action', d FROM csv_rows)""",
    "sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY event_id) AS rank FROM csv_lines) WHERE rank <= 20)",
    """counted AS (SELECT file_path, u.dd, u.k, CAST(count(*) AS BIGINT) AS n,
    CAST(sum(length(line) - length(replace(line, u.dd, ''))) AS BIGINT) AS s,
    CAST(sum(pow(length(line) - length(replace(line, u.dd, '')), 2)) AS BIGINT) AS q
  FROM sample, (VALUES (',', 0), (';', 1), ('|', 2), (chr(9), 3)) u(dd, k) GROUP BY ALL)""",
    """scored AS (SELECT *, greatest(1 - sqrt(n * q - s * s) / n / (s / n), 0.0) AS consistency,
    greatest(1 - sqrt(n * q - s * s) / n / (s / n), 0.0) * (s / n) AS score FROM counted WHERE s >= n)""",
    """layouts AS (SELECT * FROM scored WHERE consistency >= 0.8
    QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY score DESC, k) = 1)""",
]


@query(with_(CSV, """SELECT file_path, dd AS delimiter, s / n AS mean, consistency, score FROM scored"""))
def delimiter_scores(spark, sf_dir):
    scores = C.delimiter_scores(C.sample_lines(csv_lines(spark, sf_dir)))
    return scores.select("file_path", "delimiter", "mean", "consistency", "score")


@query(with_(CSV, """SELECT file_path, dd AS delimiter, CAST(floor(s / n) + 1 AS INTEGER) AS field_count,
  true AS has_header, CAST(-1 AS BIGINT) AS header_row FROM layouts"""))
def csv_layout(spark, sf_dir):
    return C.csv_layouts(csv_lines(spark, sf_dir)).select(
        "file_path", "delimiter", "field_count", "has_header", "header_row"
    )


@query(with_(CSV, """SELECT file_path, unnest(['time','ip','user','host','action']) AS name,
  CAST(unnest([0,1,2,3,4]) AS INTEGER) AS position FROM layouts"""))
def csv_header(spark, sf_dir):
    return C.csv_layouts(csv_lines(spark, sf_dir)).select(
        "file_path", F.explode("fields").alias("name", "position")
    )


@query(with_(ROWS, """SELECT event_id, unnest([t, ip, user_name, host, action]) AS field,
  CAST(unnest([0,1,2,3,4]) AS INTEGER) AS position FROM csv_rows"""))
def split_fields(spark, sf_dir):
    lines = C.with_layout(csv_lines(spark, sf_dir), C.csv_layouts(csv_lines(spark, sf_dir)))
    fields = X.split_fields("value", F.col("delimiter"))
    return lines.select(
        F.col("row_id").alias("event_id"), F.posexplode(fields).alias("position", "field")
    )


def _correlated(spark, sf_dir, **how):
    lines, value = C.correlate(csv_lines(spark, sf_dir), **how)
    return E.extract_entries(lines, correlation=value)


@query(with_(ROWS, "SELECT event_id, ip, lower(user_name) AS correlation FROM csv_rows"))
def correlate_user(spark, sf_dir):
    return _correlated(spark, sf_dir, user="USER ").select(
        F.col("row_id").alias("event_id"), "ip", "correlation"
    )


@query(with_(ROWS, """SELECT event_id, ip, CASE WHEN starts_with(host, 'h') THEN 'example.co.uk' ELSE 'example.com' END AS correlation FROM csv_rows"""))
def correlate_host_domain(spark, sf_dir):
    return _correlated(spark, sf_dir, host="host", domain=True).select(
        F.col("row_id").alias("event_id"), "ip", "correlation"
    )


@query(with_(ENTRIES, r"""SELECT event_id, CAST(pos AS INTEGER) AS pos, ip, nullif(regexp_extract(line, 'status=(\d+)', 1), '') AS correlation FROM entries"""))
def correlate_custom(spark, sf_dir):
    lines, value = C.correlate(log_lines(spark, sf_dir), custom=r"status=(\d+)")
    return E.extract_entries(lines, correlation=value).select(
        F.col("row_id").alias("event_id"), "pos", "ip", "correlation"
    )


_USER_STATS = [
    ROWS,
    """user_stats AS (SELECT ip, count(*) AS n, array_to_string(list_sort(list(DISTINCT lower(user_name))), ', ') AS correlation,
  min_by(t, (t, event_id)) AS first_seen, max_by(t, (t, -event_id)) AS last_seen FROM csv_rows GROUP BY ip)""",
]


def _user_stats(spark, sf_dir):
    return S.ip_stats(_correlated(spark, sf_dir, user="user"))


@query(with_(_USER_STATS, 'SELECT ip, n AS "count", correlation, first_seen, last_seen FROM user_stats'))
def correlation_sets(spark, sf_dir):
    return _user_stats(spark, sf_dir).select("ip", "count", "correlation", "first_seen", "last_seen")


@query(with_(ROWS, 'SELECT ip, lower(user_name) AS correlation, count(*) AS "count" FROM csv_rows GROUP BY ALL'))
def ip_correlations(spark, sf_dir):
    return C.ip_correlations(_correlated(spark, sf_dir, user="user"))


@query(with_(_USER_STATS, """SELECT correlation AS correlation_value, count(*) AS unique_ips,
  CAST(sum(n) AS BIGINT) AS total_events, 'User' AS label FROM user_stats GROUP BY correlation"""))
def correlation_groups(spark, sf_dir):
    return C.correlation_groups(_user_stats(spark, sf_dir), "User")


@query(with_(_USER_STATS, """SELECT correlation AS group_key, ip, n AS "count", first_seen, last_seen,
  count(*) OVER (PARTITION BY correlation) AS unique_ips,
  CAST(sum(n) OVER (PARTITION BY correlation) AS BIGINT) AS total_events FROM user_stats"""))
def correlation_members(spark, sf_dir):
    return G.members_with_totals(_user_stats(spark, sf_dir), "correlation")


