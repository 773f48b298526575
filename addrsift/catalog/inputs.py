"""Inputs of the registered queries, derived from the given tables by SQL.

The same SQL text builds every input here and in the check, so both sides start
from equal rows; only two spellings differ by engine: ``{D:name}`` formats ``ts``
and ``{each:...}`` repeats a row for each of the values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1706745600  # 2024-02-01 00:00:00 UTC, after the last event

FORMATS = {
    "common": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
    "iso": (r"yyyy-MM-dd\'T\'HH:mm:ss", "%Y-%m-%dT%H:%M:%S"),
    "apache": ("dd/MMM/yyyy:HH:mm:ss", "%d/%b/%Y:%H:%M:%S"),
    "syslog": ("MMM dd HH:mm:ss", "%b %d %H:%M:%S"),
    "date": ("yyyy-MM-dd", "%Y-%m-%d"),
    "cert": ("MMM d HH:mm:ss yyyy", "%b %-d %H:%M:%S %Y"),
}

# Country codes of the 25 nations, by key.
CODES = [
    "DE", "FR", "US", "GB", "CH", "NO", "IS", "LI", "AT", "BR", "JP", "NL", "SE",
    "PL", "ES", "IT", "CA", "AU", "IN", "CN", "ZA", "DK", "FI", "IE", "PT",
]
CODE_OF_NATION = "CASE n_nationkey " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END"

_IP_OF_EVENT = """CASE user_id % 4
    WHEN 0 THEN '10.' || (user_id % 20) || '.' || day(ts) || '.7'
    WHEN 1 THEN '203.0.113.' || (user_id % 20 + day(ts))
    WHEN 2 THEN '8.' || (user_id % 20) || '.' || day(ts) || '.9'
    ELSE '2001:db8:0:0:0:0:' || (user_id % 20) || ':' || day(ts) END"""

# name -> (tables read, SQL)
INPUTS: dict[str, tuple[list[str], str]] = {
    # log lines in five date formats and without a date, one or two addresses
    "log_lines": (["events"], f"""
SELECT event_id, ts, user_id,
  CASE event_id % 6 WHEN 0 THEN {{D:common}} WHEN 1 THEN {{D:iso}} || 'Z'
    WHEN 2 THEN '[' || {{D:apache}} || ' +0000]' WHEN 3 THEN {{D:syslog}}
    WHEN 4 THEN {{D:date}} ELSE '-' END
  || ' host app: '
  || CASE event_type WHEN 'error' THEN 'Failed password' WHEN 'signup' THEN 'Accepted password'
       WHEN 'view' THEN 'GET /index.html status=200' WHEN 'click' THEN 'POST /api status=302'
       ELSE 'BUY item' END
  || ' for user' || user_id || ' from ' || ip || ' port ' || (1024 + event_id % 1000)
  || CASE WHEN event_id % 17 = 0 THEN ' via 198.51.100.9' ELSE '' END AS line
FROM (SELECT *, {_IP_OF_EVENT} AS ip FROM {{events}}) e"""),

    # delimited logs of four files, each with its own delimiter and a header line
    "csv_rows": (["events"], f"""
SELECT event_id, 'audit' || (user_id % 4) || '.csv' AS file_path,
  CASE user_id % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN '|' ELSE chr(9) END AS d,
  {{D:common}} AS t, ip,
  CASE WHEN event_id % 11 = 0 THEN 'User' || user_id || ', the "Second"'
       ELSE 'User' || user_id END AS user_name,
  CASE WHEN user_id % 2 = 0 THEN 'h' || (user_id % 5) || '.Corp.example.co.uk'
       ELSE 'mail.Example.com' END AS host,
  event_type AS action
FROM (SELECT *, {_IP_OF_EVENT} AS ip FROM {{events}}) e"""),

    # addresses of every class and a network for each
    "address_pool": (["events"], """
SELECT event_id,
  CASE event_id % 12
    WHEN 0 THEN '10.' || b || '.' || c || '.' || d
    WHEN 1 THEN '172.' || (b % 40) || '.' || c || '.' || d
    WHEN 2 THEN CASE WHEN b % 2 = 0 THEN '192.168.' ELSE '192.0.' END || (c % 4) || '.' || d
    WHEN 3 THEN CASE WHEN b % 2 = 0 THEN '169.254.' ELSE '198.51.' END || (98 + c % 4) || '.' || d
    WHEN 4 THEN '203.0.' || (112 + c % 3) || '.' || d
    WHEN 5 THEN 'fe' || CASE c % 3 WHEN 0 THEN '80' WHEN 1 THEN 'C0' ELSE 'bf' END || '::' || d
    WHEN 6 THEN CASE c % 4 WHEN 0 THEN 'fd00:' WHEN 1 THEN 'FF02:' WHEN 2 THEN 'fb00:' ELSE '2001:db8:' END || ':' || d
    WHEN 7 THEN '::ffff:' || a || '.' || b || '.' || c || '.' || d
    WHEN 8 THEN CASE c % 3 WHEN 0 THEN '::1' WHEN 1 THEN '::' ELSE '::0' END
    ELSE a || '.' || b || '.' || c || '.' || d END AS ip,
  a || '.' || b || '.' || c || '.' || d AS ip4,
  (a - a % 2) || '.' || (b - b % 8) || '.' || c || '.' || d || '/' || (event_id % 33) AS net4,
  '2001:db8:' || a || ':' || b || ':' || c || ':0:' || d || ':1' AS ip6,
  '2001:db8:' || a || ':' || b || ':' || (c - c % 2) || '::/' || (4 * (event_id % 33)) AS net6
FROM (SELECT event_id, event_id % 256 AS a, (event_id * 31) % 256 AS b, (event_id * 17) % 256 AS c,
        (event_id * 13) % 256 AS d FROM {events}) e"""),

    # time arguments of every kind
    "time_texts": (["events"], """
SELECT event_id,
  CASE event_id % 9
    WHEN 0 THEN '1704' || (100000 + event_id % 800000)
    WHEN 1 THEN (1 + event_id % 40) || 'hours'
    WHEN 2 THEN (event_id % 7) || ' days'
    WHEN 3 THEN {D:common}
    WHEN 4 THEN {D:iso} || 'Z'
    WHEN 5 THEN '[' || {D:apache} || ' +0000]'
    WHEN 6 THEN ' ' || {D:date} || ' '
    WHEN 7 THEN ' '
    ELSE (1 + event_id % 90) || CASE event_id % 14 WHEN 0 THEN 's' WHEN 1 THEN 'MIN' WHEN 2 THEN 'm'
      WHEN 3 THEN 'h' WHEN 4 THEN 'hr' WHEN 5 THEN 'd' WHEN 6 THEN 'Day' WHEN 7 THEN 'w'
      WHEN 8 THEN 'weeks' WHEN 9 THEN 'mo' WHEN 10 THEN 'months' WHEN 11 THEN 'y' WHEN 12 THEN 'yr'
      ELSE 'seconds' END END AS time_text
FROM {events}"""),

    # named ranges, some with open ends
    "range_rules": (["nation"], f"""
SELECT n_name AS name,
  CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE CAST({NOW} - 86400 * (31 - n_nationkey) AS BIGINT) END AS start_ts,
  CASE WHEN n_nationkey % 7 = 0 THEN NULL ELSE CAST({NOW} - 86400 * (25 - n_nationkey) AS BIGINT) END AS end_ts
FROM {{nation}}"""),

    # nested blocks with country, place and coordinates; Country codes
    "geo_blocks": (["nation"], """
SELECT network, cc, CASE WHEN cc IS NULL THEN NULL ELSE 'Land ' || cc END AS country,
  CASE WHEN plen >= 16 THEN 'City ' || k ELSE NULL END AS city,
  CASE WHEN plen >= 16 THEN CAST(k * 1.5 - 10 AS DOUBLE) ELSE NULL END AS latitude,
  CASE WHEN plen >= 16 THEN CAST(k * 2.25 - 30 AS DOUBLE) ELSE NULL END AS longitude
FROM (
  SELECT n_nationkey AS k, plen,
    CASE plen WHEN 8 THEN '8.0.0.0/8' WHEN 16 THEN '8.' || n_nationkey || '.0.0/16'
      WHEN 24 THEN '8.' || n_nationkey || '.1.0/24' WHEN 17 THEN '10.' || n_nationkey || '.0.0/17'
      ELSE '2001:db8:0:0:0:0:' || n_nationkey || ':0/112' END AS network,
    CASE WHEN n_nationkey = 3 THEN NULL WHEN plen = 8 THEN 'US' WHEN plen = 24 THEN 'CH'
      ELSE """ + CODE_OF_NATION + """ END AS cc
  FROM (SELECT n_nationkey, {each:8, 16, 24, 17, 112} AS plen FROM {nation}) p
  WHERE plen <> 8 OR n_nationkey = 0) g"""),

    "asn_blocks": (["supplier"], """
SELECT '8.' || (2 * (s_suppkey % 128)) || CASE WHEN s_suppkey < 128 THEN '.0.0/16'
    ELSE '.' || (CAST(floor(s_suppkey / 128) AS INT) % 32) || '.0/24' END AS network,
  CAST(64500 + s_suppkey AS BIGINT) AS asn, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE s_name END AS org
FROM {supplier}"""),

    # threat list rows of the seven lists: exact addresses and networks of both families
    "threats": (["supplier"], """
SELECT CASE s_suppkey % 7 WHEN 0 THEN 'CINSBadRep' WHEN 1 THEN 'PeerDrop' WHEN 2 THEN 'NordVPN_v4'
    WHEN 3 THEN 'NordVPN_v6' WHEN 4 THEN 'Mullvad_v4' WHEN 5 THEN 'Mullvad_v6' ELSE 'PhishTank' END AS list_name,
  CASE s_suppkey % 5
    WHEN 0 THEN '8.' || (s_suppkey % 20) || '.0.0/16'
    WHEN 1 THEN '10.' || (s_suppkey % 20) || '.' || (s_suppkey % 28 + 1) || '.7'
    WHEN 2 THEN '203.0.113.' || (s_suppkey % 48) || '/' || (27 + s_suppkey % 6)
    WHEN 3 THEN '2001:db8:0:0:0:0:' || (s_suppkey % 20) || ':0/112'
    ELSE '10.' || (s_suppkey % 20) || '.' || (s_suppkey % 28) || '.0/24' END AS network,
  s_name AS message
FROM {supplier}"""),

    # lines of threat list files with comments, blanks and quoted messages
    "threat_lines": (["supplier"], """
SELECT s_suppkey,
  CASE s_suppkey % 9 WHEN 0 THEN 'https://lists.example.org/services/cinsscore-army-list-badrep.csv'
    WHEN 1 THEN 'https://lists.example.org/services/spamhaus-peer-drop-list.csv'
    WHEN 2 THEN 'https://lists.example.org/nordvpn/all-addresses.ipv4.csv'
    WHEN 3 THEN 'https://lists.example.org/nordvpn/all-addresses.ipv6.csv'
    WHEN 4 THEN 'https://lists.example.org/mullvad/all-addresses.ipv4.csv'
    WHEN 5 THEN 'https://lists.example.org/mullvad/all-addresses.ipv6.csv'
    WHEN 6 THEN 'phishtank-last-7-days.csv'
    WHEN 7 THEN 'https://lists.example.org/nordvpn/other-list.csv' ELSE '/data/my-own-list.csv' END AS path,
  CASE s_suppkey % 6 WHEN 0 THEN '# ' || s_name || ', comment' WHEN 1 THEN '' WHEN 2 THEN s_name
    WHEN 3 THEN ' 8.' || s_suppkey || '.0.0/16 , "' || s_name || '"' WHEN 4 THEN ', no network'
    ELSE '8.8.8.' || s_suppkey || ',' || s_name || ', seen' END AS value
FROM {supplier}"""),

    # names of addresses, some empty, some only the address again
    "ptr": (["customer"], """
SELECT ip, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN ip
    ELSE lower(c_mktsegment) || c_custkey || '.example.com' END AS hostname
FROM (SELECT *, '8.' || (c_custkey % 20) || '.' || (c_custkey % 28 + 1) || '.9' AS ip FROM {customer}) c"""),

    # cached lookups of different age
    "cache_rows": (["customer"], f"""
SELECT '8.' || (c_custkey % 20) || '.' || (c_custkey % 28 + 1) || '.9' AS ip,
  CASE c_custkey % 2 WHEN 0 THEN 'abuse' ELSE 'geo' END AS source,
  CAST({NOW} - 1800 * (c_custkey % 97) - c_custkey AS BIGINT) AS cached_at,
  'v' || c_custkey AS score
FROM {{customer}}"""),

    # captured answers
    "whois_answers": (["customer"], """
SELECT c_custkey,
  CASE WHEN c_custkey % 10 = 9 THEN 'NetName: SHORT'
  ELSE '% This is the ' || c_mktsegment || ' database' || chr(10)
    || 'refer:        whois://whois' || c_nationkey || '.example.net/43' || chr(10) || chr(10)
    || CASE c_custkey % 3 WHEN 0 THEN 'NetRange:  8.0.0.0 - 8.0.0.' ELSE 'inetnum:   10.0.0.' END
    || (c_custkey % 256) || chr(10)
    || CASE c_custkey % 4 WHEN 0 THEN 'netname:' || chr(10) ELSE '' END
    || '  OrgName:   ' || c_name || chr(13) || chr(10)
    || 'abuse-c:  AC' || c_custkey || '-X' || chr(10)
    || CASE c_custkey % 5 WHEN 0 THEN '' ELSE 'OrgAbuseEmail: abuse' || c_custkey || '@example.com' || chr(10) END
    || 'person:   P. ' || c_mktsegment || chr(10) || 'admin-c:  ignored' END AS answer
FROM {customer}"""),

    "json_answers": (["customer"], """
SELECT c_custkey,
  CASE WHEN c_custkey % 13 = 12 THEN '{"data": {broken' ELSE
  '{"data":{"abuseConfidenceScore":' || (c_custkey % 101) || ',"isWhitelisted":'
    || CASE c_custkey % 2 WHEN 0 THEN 'true' ELSE 'false' END
    || ',"usageType":' || CASE c_custkey % 3 WHEN 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END
    || ',"totalReports":' || (c_custkey % 17)
    || CASE c_custkey % 4 WHEN 0 THEN '' ELSE ',"isp":"Net ' || c_nationkey || '"' END
    || ',"isTor":' || CASE c_custkey % 5 WHEN 0 THEN 'true' ELSE 'false' END || '}}' END AS threat_json,
  '{"country":"C' || c_nationkey || '"' || CASE c_custkey % 3 WHEN 0 THEN '' ELSE ',"city":"' || c_mktsegment || '"' END
    || ',"region":"R' || (c_custkey % 7) || '","org":"' || c_name || '"'
    || CASE c_custkey % 3 WHEN 0 THEN ',"asn":"AS' || c_custkey || '"' WHEN 1 THEN ',"asn":{"asn":"' || c_custkey || '"}' ELSE '' END
    || ',"timezone":"Etc/' || c_nationkey || '"}' AS geo_json
FROM {customer}"""),

    "tls_answers": (["orders"], """
SELECT o_orderkey,
  'Certificate:' || chr(10) || '    Signature Algorithm: first' || o_custkey || chr(10)
    || '        Issuer: C = US, O = ' || o_orderpriority
    || CASE o_orderkey % 3 WHEN 0 THEN ', CN = Root ' || o_orderstatus WHEN 1 THEN ', CN=Root' || o_orderstatus || ', L = X' ELSE '' END || chr(10)
    || '        Validity' || chr(10) || '            Not Before: ' || {D:cert} || ' GMT' || chr(10)
    || CASE o_orderkey % 4 WHEN 0 THEN '' ELSE '            Not After : ' || {D:cert} || ' GMT' || chr(10) END
    || '        Subject: CN = host' || o_orderkey || '.example.com, O = Y' || chr(10)
    || '                Public-Key: (' || (1024 * (1 + o_orderkey % 4)) || ' bit)' || chr(10)
    || '    Signature Algorithm: sha' || (256 + 128 * (o_orderkey % 3)) || 'WithRSA' || chr(10) AS cert,
  CASE o_orderkey % 3 WHEN 0 THEN 'New, TLSv1.2, Cipher is X' || chr(10) || 'SSL-Session:' || chr(10)
      || '    Protocol  : TLSv1.' || (o_orderkey % 4) || chr(10) || '---' || chr(10)
    WHEN 1 THEN 'New, TLSv1.' || (o_orderkey % 4) || ', Cipher is X' || chr(10)
    ELSE 'no peer certificate' END AS session
FROM (SELECT *, o_orderdate AS ts FROM {orders}) o"""),

    "cert_dates": (["orders"], """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN 'Foo ' ELSE '' END || {D:cert} || ' GMT' AS cert_text
FROM (SELECT *, o_orderdate AS ts FROM {orders}) o"""),

    "http_answers": (["orders"], """
SELECT o_orderkey,
  CASE o_orderkey % 3 WHEN 0 THEN 'HTTP/1.1 301 Moved' || chr(13) || chr(10) || 'Server: first' || chr(13) || chr(10) || chr(13) || chr(10) ELSE '' END
    || 'HTTP/2 ' || CASE o_orderkey % 7 WHEN 6 THEN 'abc' ELSE CAST(200 + o_orderkey % 5 AS VARCHAR(9)) END || chr(13) || chr(10)
    || CASE o_orderkey % 4 WHEN 0 THEN '' ELSE 'sErver:  web ' || o_orderstatus || chr(13) || chr(10) END
    || CASE o_orderkey % 5 WHEN 0 THEN 'Content-Security-Policy: x' || chr(13) || chr(10) ELSE 'X-Other: y' || chr(13) || chr(10) END AS headers
FROM {orders}"""),

    "ping_answers": (["orders"], """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN '1 packets transmitted, 0 received, 100% packet loss'
    WHEN 5 THEN 'unknown host'
    ELSE '3 packets transmitted, 3 received, 0% packet loss' || chr(10)
      || CASE o_orderkey % 2 WHEN 0 THEN 'rtt min/avg/max/mdev = ' ELSE 'round-trip min/avg/max/stddev = ' END
      || '1.5/' || (o_orderkey % 300) || '.' || (10 + o_custkey % 90) || '/99.125/' || (o_custkey % 9) || '.' || (100 + o_orderkey % 900) || ' ms' END AS answer
FROM {orders}"""),

    "providers": (["customer"], """
SELECT c_custkey, 'p' || c_custkey AS name, c_custkey % 3 <> 0 AS enabled,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'key' || c_custkey END AS api_key,
  CASE c_custkey % 5 WHEN 0 THEN '' ELSE 'https://{ip}.api.example.com/{ip}?k={api_key}' END AS url_template,
  '8.8.' || (c_custkey % 256) || '.1' AS ip
FROM {customer}"""),
}


def _filled(name: str, engine: int) -> str:
    text = INPUTS[name][1]
    call = ("date_format(ts, '{}')", "strftime(ts, '{}')")[engine]
    for key, formats in FORMATS.items():
        text = text.replace("{D:" + key + "}", call.format(formats[engine]))
    return re.sub(r"\{each:(.*?)\}", (r"explode(array(\1))", r"unnest([\1])")[engine], text)


def check_sql(name: str) -> str:
    """The input as a named subquery of the check."""
    text = _filled(name, 1)
    for t in INPUTS[name][0]:
        text = text.replace("{" + t + "}", t)
    return f"{name} AS ({text})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables whose rows make texts, and rows that a task makes and searches texts of at most.
_SPREAD, ROWS_PER_TASK = {"events", "orders", "customer"}, 100_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt one by one over all slots and more, so that no task grows with the table.

    The lines built from the rows are expensive to search, the rows are narrow.  Files
    are no measure of the work: a split may hold no rows, or a row group of millions.
    Nor are keys, which may repeat.  Counting reads the ends of the files alone.
    Rows go by their places in the files: without a key Spark would sort what a task
    reads, a whole row group, before it is dealt.
    """
    slots = rows.sparkSession.sparkContext.defaultParallelism
    placed = rows.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    return placed.repartition(max(slots, -(-rows.count() // ROWS_PER_TASK)), "_file", "_row").drop("_file", "_row")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input as a DataFrame."""
    tables, _ = INPUTS[name]
    text = _filled(name, 0)
    views = {}
    for t in tables:
        # one view per folder, so that sessions may look at several scales
        view = f"addrsift_{t}_{abs(hash(sf_dir))}"
        rows = table(spark, sf_dir, t)
        if t in _SPREAD:
            rows = spread(rows)
        rows.createOrReplaceTempView(view)
        views[t] = view
    for t, view in views.items():
        text = text.replace("{" + t + "}", view)
    return spark.sql(text)


def streamed_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines as a stream over the events table."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    view = f"addrsift_event_stream_{abs(hash(sf_dir))}"
    rows.createOrReplaceTempView(view)
    return spark.sql(_filled("log_lines", 0).replace("{events}", view))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.lines import from_lines

    return from_lines(frame(spark, sf_dir, "log_lines"), "line", "event_id", "events.log")


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the four delimited files, each after its header."""
    rows = frame(spark, sf_dir, "csv_rows")
    d = F.col("d")
    quoted = F.when(
        F.col("user_name").contains('"'),
        F.concat(F.lit('"'), F.replace("user_name", F.lit('"'), F.lit('""')), F.lit('"')),
    ).otherwise(F.col("user_name"))
    body = rows.select(
        F.concat_ws("", "t", d, "ip", d, quoted, d, F.lit(" "), "host", d, "action").alias("value"),
        "file_path", F.lit(0).cast("bigint").alias("block_start"), F.col("event_id").alias("row_id"),
    )
    header = rows.select("file_path", "d").distinct().select(
        F.concat_ws("", F.lit("Time"), d, F.lit("IP"), d, F.lit("User"), d, F.lit(" Host "), d,
                    F.lit("action")).alias("value"),
        "file_path", F.lit(0).cast("bigint").alias("block_start"),
        F.lit(-1).cast("bigint").alias("row_id"),
    )
    return header.unionByName(body)
