"""Addresses and networks as numbers.

An address is (family, hi, lo): IPv4 in ``lo`` alone, IPv6 as two signed 64-bit
halves.  Masking two numbers is all a prefix match needs, and the masked numbers
are fixed-width join keys.

Arguments are column names or SQL expressions.  Intermediate values are bound to
lambda variables in the SQL text, so each is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_V4_TAIL = rf"^(.*:)({_V4})$"
_GROUPS = r"^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"


def _let(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``name`` bound to ``value``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _v4_number(text: str) -> str:
    part = [f"CAST(split_part({text}, '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    return f"({part[0]} * 16777216 + {part[1]} * 65536 + {part[2]} * 256 + {part[3]})"


def _half(first: int) -> str:
    number = [f"CAST(conv(g[{first + i}], 16, 10) AS BIGINT)" for i in range(4)]
    return (
        f"(shiftleft({number[0]}, 48) | shiftleft({number[1]}, 32)"
        f" | shiftleft({number[2]}, 16) | {number[3]})"
    )


def _v6_key(ip: str) -> str:
    """Struct of an IPv6 text in any notation; null if it is none."""
    dotted = _let(
        "n", _v4_number(f"regexp_extract(low, r'{_V4_TAIL}', 2)"),
        f"concat(regexp_extract(low, r'{_V4_TAIL}', 1), lower(hex(shiftright(n, 16))), ':', lower(hex(n & 65535)))",
    )
    folded = f"CASE WHEN low RLIKE r'{_V4_TAIL}' THEN {dotted} ELSE low END"
    # "::" stands for at least one group of zeros
    sides = (
        "named_struct('l', substring_index(f, '::', 1), 'r', substring(f, instr(f, '::') + 2))"
    )
    missing = "8 - if(s.l = '', 0, size(split(s.l, ':'))) - if(s.r = '', 0, size(split(s.r, ':')))"
    zeros = "repeat('0:', m)"
    filled = (
        f"CASE WHEN m >= 1 THEN concat(if(s.l = '', '', concat(s.l, ':')),"
        f" if(s.r = '', trim(TRAILING ':' FROM {zeros}), concat({zeros}, s.r))) END"
    )
    expanded = _let("s", sides, _let("m", missing, filled))
    whole = f"CASE WHEN contains(f, '::') THEN {expanded} ELSE f END"
    groups = _let("w", whole, f"CASE WHEN w RLIKE r'{_GROUPS}' THEN split(w, ':') END")
    key = (
        f"CASE WHEN g IS NOT NULL THEN named_struct('family', 6, 'hi', {_half(0)}, 'lo', {_half(4)}) END"
    )
    return _let("low", f"lower({ip})", _let("f", folded, _let("g", groups, key)))


def _key(ip: str) -> str:
    return (
        f"CASE WHEN {ip} RLIKE r'^{_V4}$' THEN named_struct('family', 4, 'hi', 0L, 'lo', {_v4_number(ip)})"
        f" WHEN contains({ip}, ':') THEN {_v6_key(ip)} END"
    )


def _cut(key: str, plen: str) -> str:
    """Struct (family, plen, hi, lo) of a key struct cut to ``plen`` bits."""
    low_bits = f"(if({key}.family = 4, 32, 128) - {plen})"
    hi_mask = (
        f"CASE WHEN {plen} <= 0 THEN 0L WHEN {plen} >= 64 THEN -1L ELSE shiftleft(-1L, 64 - {plen}) END"
    )
    lo_mask = (
        f"CASE WHEN {low_bits} <= 0 THEN -1L WHEN {low_bits} >= 64 THEN 0L"
        f" ELSE shiftleft(-1L, {low_bits}) END"
    )
    return (
        f"named_struct('family', {key}.family, 'plen', {plen},"
        f" 'hi', {key}.hi & {hi_mask}, 'lo', {key}.lo & {lo_mask})"
    )


def _network(network: str) -> str:
    plen = rf"try_cast(regexp_extract({network}, r'^[^/]*/(\d{{1,3}})$', 1) AS INT)"
    body = f"CASE WHEN k.family IS NOT NULL AND p <= if(k.family = 4, 32, 128) THEN {_cut('k', 'p')} END"
    return _let("k", _key(f"substring_index({network}, '/', 1)"), _let("p", plen, body))


def address_key(ip: str) -> Column:
    """struct(family, hi, lo); null for text that is no address.

    Octets with leading zeros are not addresses here.
    """
    return F.expr(_key(ip))


def network_key(network: str) -> Column:
    """struct(family, plen, hi, lo) of ``address/prefix``, host bits cleared.

    Null for text without a prefix, with a prefix out of range or with an address
    that is none.
    """
    return F.expr(_network(network))


def prefix_key(key: str, plen: str) -> Column:
    """struct(family, plen, hi, lo) of an :func:`address_key` column cut to ``plen`` bits."""
    return F.expr(_cut(key, plen))


def cidr_match(ip: str, network: str) -> Column:
    """Whether ``network`` holds ``ip``; without a prefix, whether the texts are equal."""
    inside = _let(
        "a", _key(ip), _let("n", _network(network),
        f"a.family = n.family AND {_cut('a', 'n.plen')} = n"),
    )
    return F.expr(
        f"CASE WHEN contains({network}, '/') THEN coalesce({inside}, false) ELSE {ip} = {network} END"
    )
