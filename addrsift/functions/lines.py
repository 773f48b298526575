"""Column functions over whole log lines: login outcome, search, time stamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .addresses import _col


def _shortest(words: list[str]) -> list[str]:
    """Words that contain no other word of the list; enough for a contains test."""
    return [w for w in words if not any(v != w and v in w for v in words)]


_FAILED = " OR ".join(f"contains(lower({{line}}), '{w}')" for w in _shortest(P.FAILURE_KEYWORDS))


def login_status(line: str = "value") -> Column:
    """``failed`` if the line holds any failure keyword, else ``success``.

    ``line`` is a column name or SQL expression.  Plain contains tests beat one
    alternation several times over, and the lower-cased line is shared by them.
    """
    return F.expr(f"CASE WHEN {_FAILED.format(line=line)} THEN 'failed' ELSE 'success' END")


def search_flag(
    line: Column | str, search: str | None = None, search_regex: str | None = None
) -> Column:
    """Case-insensitive search; a regex wins over a literal, no criterion is true."""
    line = _col(line)
    if search_regex:
        return line.rlike("(?i)" + search_regex)
    if search:
        return F.lower(line).contains(search.lower())
    return F.lit(True)


# -- time stamps --------------------------------------------------------------
#
# A matched text is cut at fixed offsets and turned into seconds by arithmetic
# from the first day of its month, so that 2024-02-31 becomes 2 March.  Text
# that fails its range checks falls through to the next pattern.  The expression
# is written as SQL text: it is parsed once instead of built call by call.


def _num(start: int, length: int) -> str:
    return f"try_cast(substring(t, {start}, {length}) AS BIGINT)"


def _month(start: int) -> str:
    names = ", ".join(f"'{m}'" for m in P.MONTHS)
    return f"array_position(array({names}), lower(substring(t, {start}, 3)))"


_CLOCK = (_num(-8, 2), _num(-5, 2), _num(-2, 2))
_MIDNIGHT = ("0L", "0L", "0L")


def _seconds(y: str, mo: str, d: str, h: str, mi: str, s: str) -> str:
    return (
        f"CASE WHEN {mo} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 AND {h} BETWEEN 0 AND 23"
        f" AND {mi} BETWEEN 0 AND 59 AND {s} BETWEEN 0 AND 60"
        f" THEN (unix_date(make_date(CAST({y} AS INT), CAST({mo} AS INT), 1)) + {d} - 1) * 86400"
        f" + {h} * 3600 + {mi} * 60 + {s} END"
    )


def dates_sql(line: str, assume_year: int | None = None) -> str:
    """SQL of struct(date_string, ts), or null, for the SQL expression ``line``.

    The match ``t`` is a lambda variable, so it is computed once per pattern no
    matter how often its parts are used or how a filter on ``ts`` is moved about.
    """
    year = f"{P.YEARLESS if assume_year is None else int(assume_year)}L"
    ymd = (_num(1, 4), _num(6, 2), _num(9, 2))
    syslog_day = r"try_cast(regexp_extract(t, r'^...\s+(\d+)', 1) AS BIGINT)"
    parsers = [
        (P.DATE_SPACE, _seconds(*ymd, *_CLOCK)),
        (P.DATE_T, _seconds(*ymd, *_CLOCK)),
        (P.DATE_APACHE, _seconds(_num(8, 4), _month(4), _num(1, 2), *_CLOCK)),
        (P.DATE_SYSLOG, _seconds(year, _month(1), syslog_day, *_CLOCK)),
        (P.DATE_ONLY, _seconds(*ymd, *_MIDNIGHT)),
    ]

    def found(match: str, value: str) -> str:
        return (
            f"get(filter(transform(array({match}),"
            f" t -> if(t <> '', named_struct('date_string', t, 'ts', {value}), null)),"
            f" d -> d.ts IS NOT NULL), 0)"
        )

    # Without a date in figures (``iso`` is empty) three of the patterns cannot match.
    figures = {P.DATE_SPACE, P.DATE_T}
    steps = []
    for pattern, value in parsers:
        match = "iso" if pattern == P.DATE_ONLY else f"regexp_extract({line}, r'{pattern}', 1)"
        step = found(match, value)
        steps.append(f"CASE WHEN iso <> '' THEN {step} END" if pattern in figures else step)
    iso = f"regexp_extract({line}, r'{P.DATE_ONLY}', 1)"
    return f"get(transform(array({iso}), iso -> coalesce({', '.join(steps)})), 0)"


def extract_date(line: str = "value", assume_year: int | None = None) -> Column:
    """struct(date_string, ts): the first time stamp of a line in pattern order.

    ``line`` is a column name or SQL expression.  ``date_string`` is null and
    ``ts`` is 0 where there is none.  Zone marks are ignored.  Dates without a year
    belong to 1900 unless ``assume_year`` is set, so their ``ts`` is negative.
    """
    none = "named_struct('date_string', CAST(null AS STRING), 'ts', 0L)"
    return F.expr(f"coalesce({dates_sql(line, assume_year)}, {none})")
