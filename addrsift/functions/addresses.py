"""Column functions over addresses: extraction and classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ipv4_sql(line: str) -> str:
    return f"regexp_extract_all({line}, r'{P.IPV4}', 0)"


def _ipv6_sql(line: str, mode: str) -> str:
    if mode not in ("reference", "full"):
        raise ValueError(f"ipv6 mode must be 'reference' or 'full', not {mode!r}")
    pattern = P.IPV6_REFERENCE if mode == "reference" else P.IPV6_FULL
    return (
        f"CASE WHEN contains({line}, '::') OR length({line}) - length(replace({line}, ':', '')) >= 7"
        f" THEN regexp_extract_all({line}, r'{pattern}', 0) ELSE CAST(array() AS ARRAY<STRING>) END"
    )


def extract_ipv4(line: str = "value") -> Column:
    """All IPv4 addresses of a line, in order; ``line`` is a column name or SQL expression."""
    return F.expr(_ipv4_sql(line))


def extract_ipv6(line: str = "value", mode: str = "reference") -> Column:
    """All IPv6 addresses of a line, in order.

    ``mode='reference'`` takes the first alternative that matches, which cuts
    ``2001:db8::1`` to ``2001:db8::``; ``mode='full'`` takes whole addresses.
    Every alternative needs either ``::`` or seven colons, so lines without
    them never reach the regular expression.
    """
    return F.expr(_ipv6_sql(line, mode))


def extract_ips(line: str = "value", ipv6_mode: str = "reference") -> Column:
    """IPv4 addresses of a line, then its IPv6 addresses."""
    return F.expr(f"concat({_ipv4_sql(line)}, {_ipv6_sql(line, ipv6_mode)})")


def is_ipv4(ip: Column | str) -> Column:
    ip = _col(ip)
    return ip.contains(".") & ~ip.contains(":")


def is_ipv6(ip: Column | str) -> Column:
    return _col(ip).contains(":")


# One anchored match decides an IPv4 range; numbers may carry leading zeros.
_N = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_PRIVATE_NETS = [
    rf"0*(?:0|10|127)\.{_N}\.{_N}",
    rf"0*172\.0*(?:1[6-9]|2[0-9]|3[01])\.{_N}",
    rf"0*192\.0*168\.{_N}",
    rf"0*169\.0*254\.{_N}",
]
_RESERVED_NETS = _PRIVATE_NETS + [
    r"0*192\.0+\.0*2",
    r"0*198\.0*51\.0*100",
    r"0*203\.0+\.0*113",
    rf"0*(?:22[4-9]|23[0-9]|24[0-9]|25[0-5])\.{_N}\.{_N}",
]
_PRIVATE_V4 = rf"^(?:{'|'.join(_PRIVATE_NETS)})\.{_N}(?![0-9])"
_RESERVED_V4 = rf"^(?:{'|'.join(_RESERVED_NETS)})\.{_N}(?![0-9])"


def _local_v6(lower: Column) -> Column:
    return (lower == "::1") | lower.rlike("^(fe[89ab]|f[cd])")


def is_private(ip: Column | str) -> Column:
    """Private, loopback, link-local and this-network addresses of both families.

    Text with a dot is judged as IPv4 as a whole, so a mapped address such as
    ``::ffff:10.0.0.1`` is not private.
    """
    ip = _col(ip)
    lower = F.lower(ip)
    return (
        F.when(ip.contains("."), ip.rlike(_PRIVATE_V4))
        .when(ip.contains(":"), _local_v6(lower))
        .otherwise(F.lit(False))
    )


def is_reserved(ip: Column | str) -> Column:
    """The private set plus documentation, multicast and future-use ranges."""
    ip = _col(ip)
    lower = F.lower(ip)
    mapped = F.substring_index(lower, ":", -1)
    v6 = (
        lower.isin("::", "::0")
        | _local_v6(lower)
        | lower.startswith("ff")
        | lower.startswith("2001:db8")
        | (lower.startswith("::ffff:") & is_ipv4(mapped) & mapped.rlike(_RESERVED_V4))
    )
    return (
        F.when(is_ipv4(ip), ip.rlike(_RESERVED_V4)).when(is_ipv6(ip), v6).otherwise(F.lit(False))
    )


def is_eu_country(cc: Column | str) -> Column:
    return F.upper(_col(cc)).isin(P.EU_COUNTRIES)


def is_gdpr_country(cc: Column | str) -> Column:
    return F.upper(_col(cc)).isin(P.GDPR_COUNTRIES)


def ip_digest(ip: Column | str) -> Column:
    """SHA-256 hex of the address text, a key that hides the address."""
    return F.sha2(_col(ip), 256)
