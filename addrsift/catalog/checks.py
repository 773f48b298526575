"""Shared parts of the check SQL (DuckDB): extraction, dating, statistics."""

from __future__ import annotations

from .inputs import check_sql

# Patterns, months, failure words, country lists and unit names as results need them.
OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
H = "[0-9a-fA-F]{1,4}"
V4 = rf"\b(?:{OCTET}\.){{3}}{OCTET}\b"
V6 = (
    rf"\b(?:{H}:){{7}}{H}\b|\b(?:{H}:){{1,7}}:\b|\b(?:{H}:){{1,6}}:{H}\b"
    rf"|\b::(?:{H}:){{0,5}}{H}\b|\b{H}::(?:{H}:){{0,5}}{H}\b"
    rf"|\b::ffff:(?:{OCTET}\.){{3}}{OCTET}\b"
)
EU = (
    "'AT','BE','BG','HR','CY','CZ','DK','EE','FI','FR','DE','GR','HU','IE','IT','LV','LT','LU','MT','NL','PL','PT','RO','SK','SI','ES','SE'"
)
GDPR = EU + ",'IS','LI','NO','GB','CH'"
# position 3 * month - 2 of the month's name
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def with_(*parts: str) -> str:
    """``WITH`` of named subqueries (all but the last part) and the final query."""
    named: list[str] = []
    for part in parts[:-1]:
        for one in part if isinstance(part, (list, tuple)) else [part]:
            if one not in named:
                named.append(one)
    return "WITH " + ",\n".join(named) + "\n" + parts[-1]


def seconds(y: str, mo: str, d: str, h: str = "0", mi: str = "0", s: str = "0") -> str:
    """Epoch seconds, days counted on from the first of the month; null if out of range."""

    def n(text: str) -> str:
        return f"TRY_CAST({text} AS BIGINT)"

    return (
        f"CASE WHEN {n(mo)} BETWEEN 1 AND 12 AND {n(d)} BETWEEN 1 AND 31 AND {n(h)} BETWEEN 0 AND 23 "
        f"AND {n(mi)} BETWEEN 0 AND 59 AND {n(s)} BETWEEN 0 AND 60 THEN "
        f"(date_diff('day', DATE '1970-01-01', make_date({n(y)}, {n(mo)}, 1)) + {n(d)} - 1) * 86400 "
        f"+ {n(h)} * 3600 + {n(mi)} * 60 + {n(s)} END"
    )


def _clock(m: str) -> list[str]:
    return [f"substr({m}, length({m}) - 7, 2)", f"substr({m}, length({m}) - 4, 2)", f"right({m}, 2)"]


def _month(m: str, start: int) -> str:
    name = f"lower(substr({m}, {start}, 3))"
    at = f"position({name} IN '{MONTHS}')"
    return f"(CASE WHEN {at} % 3 = 1 THEN ({at} + 2) // 3 END)"


def dated(source: str, text: str, name: str = "dated") -> str:
    """Subquery ``name``: the columns of ``source`` plus date_string and ts of ``text``."""
    patterns = [
        r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})",
        r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})",
        r"\[(\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2})",
        r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})",
        r"(\d{4}-\d{2}-\d{2})",
    ]
    matches = ", ".join(
        f"nullif(regexp_extract({text}, '{p}', 1), '') AS m{i}" for i, p in enumerate(patterns)
    )

    def ymd(m: str) -> list[str]:
        return [f"substr({m}, 1, 4)", f"substr({m}, 6, 2)", f"substr({m}, 9, 2)"]

    values = [
        seconds(*ymd("m0"), *_clock("m0")),
        seconds(*ymd("m1"), *_clock("m1")),
        seconds("substr(m2, 8, 4)", _month("m2", 4), "substr(m2, 1, 2)", *_clock("m2")),
        seconds("1900", _month("m3", 1), r"regexp_extract(m3, '^...\s+(\d+)', 1)", *_clock("m3")),
        seconds(*ymd("m4")),
    ]
    stamps = ", ".join(f"{v} AS t{i}" for i, v in enumerate(values))
    choice = " ".join(f"WHEN t{i} IS NOT NULL THEN m{i}" for i in range(5))
    drop = ", ".join([f"m{i}" for i in range(5)] + [f"t{i}" for i in range(5)])
    return (
        f"{name} AS (SELECT * EXCLUDE ({drop}), CASE {choice} END AS date_string, "
        f"coalesce(t0, t1, t2, t3, t4, 0) AS ts FROM (SELECT *, {stamps} FROM "
        f"(SELECT *, {matches} FROM {source})))"
    )


def exploded(source: str, text: str, keep: str, name: str = "hits") -> str:
    """Subquery ``name``: ``keep`` columns of ``source`` and its addresses with positions."""
    return (
        f"{name} AS (SELECT {keep}, unnest(range(len(ips))) AS pos, unnest(ips) AS ip FROM "
        f"(SELECT *, list_concat(regexp_extract_all({text}, '{V4}'), "
        f"regexp_extract_all({text}, '{V6}')) AS ips FROM {source}))"
    )


# Words of a failed login.
FAILED = (
    "regexp_matches(lower(line), 'failed|failure|fail|wrong password|wrong username|invalid password"
    "|invalid username|invalid user|authentication failure|authentication failed|auth failed"
    "|auth failure|denied|no access|access denied|blocked|banned|unsuccessful|not allowed|rejected"
    "|bad password|incorrect password|incorrect username|login denied|login failed|logon failure"
    "|bad login|bad credentials|invalid credentials|unknown user|user not found|no such user"
    "|lockout|locked out|too many attempts|brute force')"
)

LINES = check_sql("log_lines")
# log_lines has a column ts of its own; entries have the extracted one
HITS = exploded("log_lines", "line", "event_id, line")
DATED = dated("hits", "line")
ENTRIES = [
    LINES, HITS, DATED,
    "entries AS (SELECT ip, date_string, ts, event_id, pos, line, "
    f"CASE WHEN {FAILED} THEN 'failed' ELSE 'success' END AS login_status FROM dated)",
]


def stats_of(source: str, name: str = "stats", hits: str = "true") -> str:
    """Subquery ``name``: statistics per address of the entries in ``source``."""
    order = "(event_id, pos)"
    return f"""{name} AS (SELECT ip,
  CASE WHEN f_ts < 0 OR lo IS NULL THEN f_date ELSE lo_date END AS first_seen,
  CASE WHEN hi IS NULL THEN f_date ELSE hi_date END AS last_seen, "count",
  CASE WHEN f_ts < 0 THEN f_ts ELSE coalesce(lo, f_ts) END AS first_ts,
  coalesce(hi, f_ts) AS last_ts, login_success_count, login_failed_count, search_hits
FROM (SELECT ip, count(*) AS "count",
    max(CASE WHEN fr = 1 THEN ts END) AS f_ts, max(CASE WHEN fr = 1 THEN date_string END) AS f_date,
    max(CASE WHEN ts > 0 AND lr = 1 THEN ts END) AS lo, max(CASE WHEN ts > 0 AND lr = 1 THEN date_string END) AS lo_date,
    max(CASE WHEN ts > 0 AND hr = 1 THEN ts END) AS hi, max(CASE WHEN ts > 0 AND hr = 1 THEN date_string END) AS hi_date,
    count(*) FILTER (WHERE login_status = 'success') AS login_success_count,
    count(*) FILTER (WHERE login_status = 'failed') AS login_failed_count,
    count(*) FILTER (WHERE {hits}) AS search_hits
  FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY {order}) AS fr,
      row_number() OVER (PARTITION BY ip ORDER BY ts <= 0, ts, {order}) AS lr,
      row_number() OVER (PARTITION BY ip ORDER BY ts <= 0, ts DESC, {order}) AS hr FROM {source})
  GROUP BY ip))"""


def v4_number(ip: str) -> str:
    part = [f"CAST(split_part({ip}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    return f"({part[0]} * 16777216 + {part[1]} * 65536 + {part[2]} * 256 + {part[3]})"


def v6_hex(ip: str) -> str:
    """32 hex digits of an uncompressed IPv6 text."""
    return " || ".join(f"lpad(split_part({ip}, ':', {i}), 4, '0')" for i in range(1, 9))
