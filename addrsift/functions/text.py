"""Column functions over delimited text and host names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .addresses import _col

_BLANK = " \t\r\n"
_QUOTED = r'"([^"]*+(?:""[^"]*+)*+)(?:"|$)'


def trim(text: Column | str) -> Column:
    """Without space, tab, CR and LF at both ends."""
    return F.trim(_col(text), F.lit(_BLANK))


def _raw_fields(line: Column, delimiter: str) -> Column:
    """Fields as written: a delimiter inside quotes does not split."""
    d = re.escape(delimiter)
    # possessive and unrolled: no recursion, so a field may be of any length
    field = rf'{d}([^"{d}]*+(?:"[^"]*+"?+[^"{d}]*+)*+)'
    quoted = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(field), F.lit(1))
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, d, -1))


def _clean(field: Column) -> Column:
    """Quotes around text vanish, doubled quotes inside them become one."""
    unquoted = F.replace(F.regexp_replace(field, _QUOTED, "$1"), F.lit('""'), F.lit('"'))
    return trim(F.when(field.contains('"'), unquoted).otherwise(field))


def _per_delimiter(delimiter: Column | str, build) -> Column:
    """``build(d)`` for the delimiter of the row, which may be a column."""
    if isinstance(delimiter, str):
        return build(delimiter)
    chosen = F.when(delimiter == P.DELIMITERS[0], build(P.DELIMITERS[0]))
    for d in P.DELIMITERS[1:]:
        chosen = chosen.when(delimiter == d, build(d))
    return chosen


def split_fields(line: Column | str, delimiter: Column | str) -> Column:
    """Quote-aware split into trimmed fields."""
    line = _col(line)
    return F.transform(_per_delimiter(delimiter, lambda d: _raw_fields(line, d)), _clean)


def field_at(line: Column | str, delimiter: Column | str, index: Column) -> Column:
    """The trimmed field at a 0-based index; null where the line has no such field."""
    line = _col(line)
    raw = _per_delimiter(delimiter, lambda d: F.get(_raw_fields(line, d), index))
    return _clean(raw)


def field_map(names: Column) -> Column:
    """MAP name -> 0-based index of header fields; the last of equal names wins."""
    lowered = F.transform(names, lambda x: F.lower(x))
    pairs = F.transform(lowered, lambda x, i: F.struct(x.alias("name"), i.alias("index")))
    last = F.filter(
        pairs,
        lambda p: (p["name"] != "")
        & (F.array_position(F.reverse(lowered), p["name"]) == F.size(lowered) - p["index"]),
    )
    return F.map_from_entries(last)


def registered_domain(host: Column | str) -> Column:
    """Last two labels of a host name, or three under names such as co.uk."""
    host = _col(host)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    special = (
        (n >= 3)
        & F.lower(F.get(labels, n - 2)).isin(P.SECOND_LEVEL)
        & F.lower(F.get(labels, n - 1)).isin(P.SECOND_LEVEL_TLDS)
    )
    keep = F.when(special, 3).otherwise(2)
    return F.when(n < 2, host).otherwise(
        F.array_join(F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), keep), ".")
    )
