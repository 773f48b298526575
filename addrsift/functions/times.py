"""Column functions over time arguments: relative times, windows and ranges.

Arguments are column names or SQL expressions.  ``now`` is always a parameter
(epoch seconds or an SQL expression), so that a query gives the same answer every
time it runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .lines import dates_sql

_UNITS = "|".join(sorted(P.UNIT_SECONDS, key=len, reverse=True))
_AMOUNT = rf"(?i)^(\d+)({_UNITS})$"


def _trimmed(text: str) -> str:
    return rf"trim(BOTH ' \t\n\r' FROM {text})"


def _window(text: str) -> str:
    sizes = []
    for seconds in sorted(set(P.UNIT_SECONDS.values())):
        names = ", ".join(f"'{n}'" for n, v in P.UNIT_SECONDS.items() if v == seconds)
        sizes.append(f"WHEN lower(regexp_extract({text}, r'{_AMOUNT}', 2)) IN ({names}) THEN {seconds}L")
    return f"try_cast(regexp_extract({text}, r'{_AMOUNT}', 1) AS BIGINT) * CASE {' '.join(sizes)} END"


def _time(text: str, now: str, assume_year: int | None) -> str:
    """SQL of a trimmed time argument: blank, epoch, relative, dated."""
    return (
        f"CASE WHEN {text} = '' THEN 0L"
        rf" WHEN {text} RLIKE r'^\d+$' THEN try_cast({text} AS BIGINT)"
        f" ELSE coalesce(({now}) - {_window(text)}, {dates_sql(text, assume_year)}.ts) END"
    )


def _strict(value: str, text: str, strict: bool, what: str) -> Column:
    if strict:
        problem = f"raise_error(concat('Invalid {what}: ', {text}))"
        value = f"CASE WHEN ({value}) IS NULL AND {text} IS NOT NULL THEN {problem} ELSE {value} END"
    return F.expr(value)


def window_seconds(text: str, strict: bool = False) -> Column:
    """``5m``, ``1h``, ``30sec`` … as seconds; null (or an error) otherwise."""
    return _strict(_window(text), text, strict, "time window format")


def relative_ts(text: str, now: str | int, strict: bool = False) -> Column:
    """``24hours``, ``7d`` … as ``now`` minus that long; null (or an error) otherwise."""
    value = f"CAST({now} AS BIGINT) - {_window(text)}"
    return _strict(value, text, strict, "relative time format")


def time_expr_ts(
    text: str, now: str | int, strict: bool = False, assume_year: int | None = None
) -> Column:
    """Any time argument as epoch seconds.

    Blank text is 0, digits are epoch seconds, then relative times, then the
    date patterns of :func:`addrsift.functions.lines.extract_date`.
    """
    value = _time(_trimmed(text), f"CAST({now} AS BIGINT)", assume_year)
    return _strict(value, text, strict, "time format")


def time_range(text: str, now: str | int, strict: bool = False) -> Column:
    """``from,to`` as struct(start_ts, end_ts); an open end is null.

    A range without a comma, with an unreadable end or with its end before its
    start is null, or an error when ``strict``.
    """
    now = f"CAST({now} AS BIGINT)"
    # the ends are lambda variables, so each is read once
    sides = (
        rf"transform(array(substring_index({text}, ',', 1), substring({text}, instr({text}, ',') + 1)),"
        rf" p -> {_trimmed('p')})"
    )
    ends = (
        f"transform({sides}, e -> named_struct('blank', e = '',"
        f" 'at', CASE WHEN e <> '' THEN {_time('e', now, None)} END))"
    )
    value = (
        f"get(transform(array({ends}), r -> CASE WHEN instr({text}, ',') > 0"
        " AND (r[0].blank OR r[0].at IS NOT NULL) AND (r[1].blank OR r[1].at IS NOT NULL)"
        " AND (r[0].blank OR r[1].blank OR r[1].at >= r[0].at)"
        " THEN named_struct('start_ts', r[0].at, 'end_ts', r[1].at) END), 0)"
    )
    return _strict(value, text, strict, "time range")
