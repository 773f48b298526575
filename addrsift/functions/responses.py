"""Fields of captured answers: registry text, JSON, certificates, headers, pings.

Each function maps the text of one answer to a struct or a string with built-in
expressions; an absent field is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .addresses import _col

_BLANK = " \t\r\n"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _some(text: Column) -> Column:
    """Null for empty text."""
    return F.when(text != "", text)


def _after_colon(line: Column) -> Column:
    return F.trim(F.substr(line, F.instr(line, ":") + 1), F.lit(_BLANK))


def _first_value(text: Column, names: list[str], must_hold: str = "") -> Column:
    """Value of the first line that starts with one of ``names:`` and has a usable value."""
    start = f"(?i)^(?:{'|'.join(names)}):"
    lines = F.filter(
        F.transform(_lines(text), lambda x: F.trim(x, F.lit(_BLANK))), lambda x: x.rlike(start)
    )
    values = F.filter(F.transform(lines, _after_colon), lambda v: (v != "") & v.contains(must_hold))
    return F.get(values, 0)


def whois_fields(text: Column | str) -> Column:
    """struct(netname, abuse, cidr, admin); all null for answers of up to 100 characters."""
    text = F.when(F.octet_length(_col(text)) > 100, _col(text))
    return F.struct(
        _first_value(text, ["netname", "orgname"]).alias("netname"),
        _first_value(text, ["abuse-mailbox", "orgabuseemail", "abuse-c", "e-mail"], "@").alias(
            "abuse"
        ),
        _first_value(text, ["cidr", "inetnum", "netrange"]).alias("cidr"),
        _first_value(text, ["admin-c", "orgadminname", "orgadminhandle", "person"]).alias("admin"),
    )


def whois_referral(text: Column | str) -> Column:
    """Server named by the first referral line, without scheme and path."""
    line = F.get(F.filter(_lines(_col(text)), lambda x: x.rlike("refer:|ReferralServer:")), 0)
    value = F.regexp_replace(_after_colon(line), "^whois://", "")
    return _some(F.substring_index(value, "/", 1))


def abuse_report(text: Column | str) -> Column:
    """struct(abuseScore, usageType, totalReports, isp, isTor) of an abuse report."""
    data = F.from_json(
        _col(text),
        "data struct<abuseConfidenceScore:int,usageType:string,totalReports:int,isp:string,"
        "isTor:boolean>",
    )["data"]
    return F.struct(
        data["abuseConfidenceScore"].cast("string").alias("abuseScore"),
        data["usageType"].alias("usageType"),
        data["totalReports"].cast("string").alias("totalReports"),
        data["isp"].alias("isp"),
        F.when(data["isTor"], "Yes").when(~data["isTor"], "No").alias("isTor"),
    )


def geo_report(text: Column | str) -> Column:
    """struct(country, city, region, org, asn, timezone) of a geo provider answer.

    ``asn`` may be text, taken as it is, or an object whose ``asn`` gets ``AS`` before it.
    """
    text = _col(text)
    top = F.from_json(
        text, "country string, city string, region string, org string, asn string, timezone string"
    )
    is_object = top["asn"].startswith("{")
    inner = F.get_json_object(top["asn"], "$.asn")
    asn = F.when(is_object, F.concat(F.lit("AS"), inner)).otherwise(top["asn"])
    return F.struct(
        *[top[c].alias(c) for c in ("country", "city", "region", "org")],
        asn.alias("asn"),
        top["timezone"].alias("timezone"),
    )


def threat_report(text: Column | str) -> Column:
    """struct(abuse_score, whitelisted, usage_type, total_reports) of a threat provider answer."""
    data = F.from_json(
        _col(text),
        "data struct<abuseConfidenceScore:int,isWhitelisted:boolean,usageType:string,"
        "totalReports:int>",
    )["data"]
    return F.struct(
        data["abuseConfidenceScore"].cast("string").alias("abuse_score"),
        data["isWhitelisted"].cast("string").alias("whitelisted"),
        data["usageType"].alias("usage_type"),
        data["totalReports"].cast("string").alias("total_reports"),
    )


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def cert_date(text: Column | str) -> Column:
    """``Jan 3 06:24:14 2026 GMT`` as ``01/3/2026 06:24``; unknown months leave it as it is."""
    names = F.array(*[F.lit(m.capitalize()) for m in P.MONTHS])

    def word(text: Column, i: int) -> Column:
        return F.coalesce(F.get(F.split(F.trim(text, F.lit(_BLANK)), r"\s+"), F.lit(i)), F.lit(""))

    def shown(text: Column) -> Column:
        month = F.array_position(names, word(text, 0))
        clock = word(text, 2)
        day = F.concat_ws("/", F.lpad(month.cast("string"), 2, "0"), word(text, 1), word(text, 3))
        time = F.when(F.length(clock) >= 5, F.substring(clock, 1, 5))
        return F.when(month > 0, F.concat_ws(" ", day, time)).otherwise(text)

    return _bound(_col(text), shown)


def _last_line(lines: Column, *tests) -> Column:
    """Last line that passes all tests."""

    def passes(line: Column) -> Column:
        ok = tests[0](line)
        for test in tests[1:]:
            ok = ok & test(line)
        return ok

    return F.try_element_at(F.filter(lines, passes), F.lit(-1))


def _holds(part: str):
    return lambda line: line.contains(part)


def _last_value(lines: Column, part: str) -> Column:
    """What follows the first colon of the last line that holds ``part``."""
    return _bound(_last_line(lines, _holds(part)), lambda line: _some(_after_colon(line)))


def _common_name(lines: Column, part: str) -> Column:
    """Common name in the last line that holds ``part`` and one; ``CN = `` comes before ``CN=``."""
    line = _last_line(lines, _holds(part), lambda x: x.contains("CN = ") | x.contains("CN="))

    def name(line: Column) -> Column:
        spaced = F.substr(line, F.instr(line, "CN = ") + 5)
        tight = F.substr(line, F.instr(line, "CN=") + 3)
        found = F.when(line.contains("CN = "), spaced).otherwise(tight)
        return _some(F.trim(F.substring_index(found, ",", 1), F.lit(_BLANK)))

    return _bound(line, name)


def certificate(text: Column | str, session: Column | str | None = None) -> Column:
    """struct of the tls_* fields of a certificate in text form.

    ``session`` is the text of the handshake, from which ``tls_version`` is read.
    """

    version = F.lit(None).cast("string") if session is None else tls_version(session)

    def fields(lines: Column) -> Column:
        start = F.array_position(F.transform(lines, _holds("Validity")), True)
        validity = F.when(start > 0, F.slice(lines, start, F.size(lines)))
        size = F.regexp_extract(_last_line(lines, _holds("Public-Key:")), r"\((.*?).bit", 1)
        named = {
            "tls_cn": _common_name(lines, "Subject:"),
            "tls_issuer": _common_name(lines, "Issuer:"),
            "tls_algorithm": _last_value(lines, "Signature Algorithm:"),
            "tls_created": cert_date(_last_value(validity, "Not Before:")),
            "tls_expires": cert_date(_last_value(validity, "Not After :")),
            "tls_version": version,
            "tls_keysize": _bound(F.trim(size, F.lit(_BLANK)), _some),
        }
        return F.struct(*[value.alias(name) for name, value in named.items()])

    return _bound(_lines(_col(text)), fields)


def tls_version(text: Column | str) -> Column:
    """Protocol of the session block of a handshake, else the first version named in it."""
    text = _col(text)
    at = F.instr(text, "SSL-Session:")
    block = F.substring_index(F.substr(text, at), "\n---", 1)
    line = F.get(F.filter(_lines(block), lambda x: x.contains("Protocol")), 0)
    stated = F.when((at > 0) & line.contains(":"), _some(_after_colon(line)))
    return F.coalesce(stated, _some(F.regexp_extract(text, r"TLSv[0-9]\.[0-9]", 0)))


def http_headers(text: Column | str, follow_redirects: bool = False) -> Column:
    """struct(http_status, http_server, http_csp) of the headers of one or more answers."""
    text = _col(text)
    codes = F.filter(
        F.transform(
            F.filter(_lines(text), lambda x: x.contains("HTTP/")),
            lambda x: F.regexp_extract(x, r"^\s*\S+\s+(\S+)", 1),
        ),
        lambda c: c.rlike("^[0-9]..$"),
    )
    last = F.try_element_at(codes, F.lit(-1))
    status = (
        F.when(F.size(codes) > 1, F.array_join(codes, "->")).otherwise(last)
        if follow_redirects
        else last
    )
    server = F.try_element_at(
        F.filter(_lines(text), lambda x: F.lower(x).startswith("server:")), F.lit(-1)
    )
    return F.struct(
        status.alias("http_status"),
        _some(_after_colon(server)).alias("http_server"),
        F.when(text.rlike("(?idm)^content-security-policy:"), "Yes").otherwise("No").alias("http_csp"),
    )


def html_title(html: Column | str) -> Column:
    """First line with a title tag, without tags; over 50 characters it is cut to 47 and dots."""
    line = F.get(F.filter(_lines(_col(html)), lambda x: F.lower(x).contains("<title")), 0)
    text = F.trim(F.regexp_replace(line, "<[^>]*>", ""), F.lit(_BLANK))
    cut = F.concat(F.substring(text, 1, 47), F.lit("..."))
    return _some(F.when(F.length(text) > 50, cut).otherwise(text))


def ping_summary(text: Column | str) -> Column:
    """``avg: 20.5ms jitter: 5.1ms`` of a ping text, or ``DEAD``."""
    text = _col(text)
    number = r"\s*([0-9.eE+-]+)\s*"
    rtt = rf"(?s)(?:rtt min/avg/max/mdev|round-trip min/avg/max).*?={number}/{number}/{number}/{number}"
    mean = F.regexp_extract(text, rtt, 2).try_cast("float")
    jitter = F.regexp_extract(text, rtt, 4).try_cast("float")
    # ties go to the even digit
    rounded = [F.bround(x.cast("double"), 1) for x in (mean, jitter)]
    shown = F.format_string("avg: %.1fms jitter: %.1fms", *rounded)
    alive = ~text.contains("100% packet loss") & mean.isNotNull() & jitter.isNotNull()
    return F.when(alive, shown).otherwise("DEAD")


def fill_template(template: Column | str, ip: Column | str, api_key: Column | str) -> Column:
    """Address template with ``{ip}``, then ``{api_key}``, filled in everywhere."""
    filled = F.replace(_col(template), F.lit("{ip}"), _col(ip))
    return F.replace(filled, F.lit("{api_key}"), _col(api_key))
