"""Extraction, dates, time arguments, text and networks on small cases."""

import datetime
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from addrsift.functions import addresses as A
from addrsift.functions import networks as NF
from addrsift.functions import responses as R
from addrsift.functions import text as X
from addrsift.functions import times as T
from addrsift.functions.lines import extract_date, login_status, search_flag


def values(spark, texts, column, schema="value string"):
    rows = [(i, *([t] if not isinstance(t, tuple) else t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_ipv4(spark):
    texts = {
        "peer 172.31.9.9 left at dawn": ["172.31.9.9"],
        "from 10.4.4.4 via 10.5.5.5": ["10.4.4.4", "10.5.5.5"],
        "edge 255.255.255.255 and 0.0.0.0": ["255.255.255.255", "0.0.0.0"],
        "bad 300.7.7.7 and 7.7.7.300": [],
        "none here": [],
        "1.2.3.4.5": ["1.2.3.4"],
        "v1.2.3.4.5": ["2.3.4.5"],
        "é1.2.3.4é": ["1.2.3.4"],
        "_1.2.3.4": [],
    }
    assert values(spark, texts, A.extract_ipv4("value")) == list(texts.values())


def test_ipv6_reference(spark):
    texts = {
        "at 2001:0db8:1111:2222:3333:4444:5555:6666 ok": ["2001:0db8:1111:2222:3333:4444:5555:6666"],
        "2001:db8::1": ["2001:db8::"],
        "fe80::1": ["fe80::"],
        "see ::1 now": [],
        "std::dead": ["::dead"],
        "::ffff:192.0.2.1": [],
        "time 10:11:12": [],
    }
    assert values(spark, texts, A.extract_ipv6("value")) == list(texts.values())


def test_ipv6_full(spark):
    texts = {
        "2001:db8::1 x": ["2001:db8::1"],
        "see ::1 now": ["::1"],
        "fe80::1, fe80::": ["fe80::1", "fe80::"],
        "std::dead": [],
        "a :: b": [],
        "00:11:22:33:44:55": [],
        "10:11:12": [],
        "1:2:3:4:5:6:7:8.": ["1:2:3:4:5:6:7:8"],
    }
    assert values(spark, texts, A.extract_ipv6("value", "full")) == list(texts.values())
    with pytest.raises(ValueError):
        A.extract_ipv6("value", "other")


def test_dates(spark):
    texts = {
        "2024-01-13 12:34:56 x": ("2024-01-13 12:34:56", 1705149296),
        "2024-01-13   12:34:56 x": ("2024-01-13   12:34:56", 1705149296),
        "2024-01-13T12:34:56Z": ("2024-01-13T12:34:56", 1705149296),
        "[13/Jan/2024:12:34:56 +0200]": ("13/Jan/2024:12:34:56", 1705149296),
        "jan  3 12:34:56 host": None,
        "on 2024-01-13": ("2024-01-13", 1705104000),
        "none": (None, 0),
        # pattern order beats place in the line
        "2024-01-01T00:00:00 2024-01-13 12:34:56": ("2024-01-13 12:34:56", 1705149296),
        # the first match of a pattern decides; a bad one falls through
        "2024-99-13 12:34:56 2024-01-13 12:34:56 [13/Jan/2024:12:34:56": ("13/Jan/2024:12:34:56", 1705149296),
        "Foo 13 12:34:56 and 2024-01-13": ("2024-01-13", 1705104000),
        "2024-02-31 00:00:60": ("2024-02-31 00:00:60", 1709337660),
        "2024-01-13 24:00:00": ("2024-01-13", 1705104000),
    }
    got = values(spark, texts, extract_date("value"))
    expected = dict(texts)
    stamps = {t: tuple(g) for t, g in zip(texts, got)}
    # 1900-01-03 12:34:56 UTC
    yearless = datetime.datetime(1900, 1, 3, 12, 34, 56, tzinfo=datetime.UTC).timestamp()
    expected["jan  3 12:34:56 host"] = ("jan  3 12:34:56", int(yearless))
    assert stamps == expected
    year = values(spark, ["Jan 13 12:34:56"], extract_date("value", assume_year=2024))
    assert tuple(year[0]) == ("Jan 13 12:34:56", 1705149296)


def test_login_and_search(spark):
    texts = ["Login FAILED", "Access Denied", "too many attempts", "all good", "unsuccessful"]
    assert values(spark, texts, login_status("value")) == [
        "failed", "failed", "failed", "success", "failed",
    ]
    assert values(spark, ["Foo", "bar"], search_flag("value", search="fOO")) == [True, False]
    assert values(spark, ["x9", "xx"], search_flag("value", "xx", r"X\d")) == [True, False]
    assert values(spark, ["x9"], search_flag("value")) == [True]


def test_private_and_reserved(spark):
    cases = {
        "10.1.2.3": (True, True), "172.16.0.1": (True, True), "172.32.0.1": (False, False),
        "192.168.0.1": (True, True), "127.0.0.1": (True, True), "169.254.1.1": (True, True),
        "0.1.2.3": (True, True), "8.8.8.8": (False, False), "192.0.2.1": (False, True),
        "198.51.100.1": (False, True), "203.0.113.9": (False, True), "203.0.114.9": (False, False),
        "224.0.0.1": (False, True), "255.255.255.255": (False, True), "223.1.1.1": (False, False),
        "010.001.1.1": (True, True), "::1": (True, True), "::": (False, True), "::0": (False, True),
        "FE80::1": (True, True), "febf::": (True, True), "fec0::": (False, False), "fd00::1": (True, True),
        "fc:1::": (True, True), "ff02::1": (False, True), "2001:DB8::1": (False, True),
        "2001:4860::1": (False, False), "::ffff:10.0.0.1": (False, True), "::ffff:8.8.8.8": (False, False),
        "nothing": (False, False), "10.1.2": (False, False), "10.1.2.300": (False, False),
    }
    assert values(spark, cases, A.is_private("value")) == [c[0] for c in cases.values()]
    assert values(spark, cases, A.is_reserved("value")) == [c[1] for c in cases.values()]


NOW = 1_700_000_000


def test_times(spark):
    spans = {
        "24hours": 86400, "1hour": 3600, "7days": 604800, "1day": 86400, "1week": 604800,
        "2weeks": 1209600, "1h": 3600, "30m": 1800, "7d": 604800, "2MO": 5184000, "1yr": 31536000,
        "5s": 5, "x": None, "5": None, "5 m": None, "": None,
    }
    assert values(spark, spans, T.window_seconds("value")) == list(spans.values())
    assert values(spark, spans, T.relative_ts("value", NOW)) == [
        None if v is None else NOW - v for v in spans.values()
    ]
    texts = {
        "1705136400": 1705136400, " 1hour ": NOW - 3600, "2024-01-13T12:34:56Z": 1705149296,
        "2024-01-13 12:34:56": 1705149296, "2024-01-13": 1705104000, "": 0, "  ": 0, "junk": None,
        "[13/Jan/2024:12:34:56": 1705149296,
    }
    assert values(spark, texts, T.time_expr_ts("value", NOW)) == list(texts.values())
    with pytest.raises(Exception, match="Invalid time format: junk"):
        values(spark, ["junk"], T.time_expr_ts("value", NOW, strict=True))


def test_time_ranges(spark):
    ranges = {
        "1700000000,1700000500": (1700000000, 1700000500),
        ",36hours": (None, NOW - 129600),
        "36hours,": (NOW - 129600, None),
        "2023-03-02 00:00:00,": (1677715200, None),
        ",": (None, None),
        "2023-03-02,2023-03-04": (1677715200, 1677888000),
        "9days,2days": (NOW - 777600, NOW - 172800),
        "1day,7days": None,
        "2023-03-02": None,
        "junk,": None,
    }
    got = values(spark, ranges, T.time_range("value", NOW))
    assert [None if g is None else tuple(g) for g in got] == list(ranges.values())
    with pytest.raises(Exception, match="Invalid time range"):
        values(spark, ["1day,7days"], T.time_range("value", NOW, strict=True))


def test_split_fields(spark):
    texts = {
        "a,b,c": ["a", "b", "c"], ",a,": ["", "a", ""], 'x,"a,b",y': ["x", "a,b", "y"],
        '"a""b", c ': ['a"b', "c"], '"a\tb": ""': ["a\tb:"], '""""': ['"'], 'a""b,c': ["ab", "c"],
        '"open, end': ["open, end"], '"abc""': ['abc"'], "": [""], '"",""': ["", ""],
        'a"b,c"d,e': ["ab,cd", "e"],
    }
    assert values(spark, texts, X.split_fields("value", ",")) == list(texts.values())
    assert values(spark, ["a|b,c"], X.split_fields("value", "|")) == [["a", "b,c"]]
    long, many = "x" * 3_000_000, '"q,"' * 50_000
    assert [len(x) for x in values(spark, [f'a,"{long}",{many}'], X.split_fields("value", ","))[0]] == [1, 3_000_000, 149_999]


def _by_rule(line, delimiter):
    """The splitting rule, one character at a time."""
    fields, field, inside, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"' and inside and line[i + 1:i + 2] == '"':
            field, i = field + '"', i + 1
        elif c == '"':
            inside = not inside
        elif c == delimiter and not inside:
            fields, field = [*fields, field.strip(" \t\r\n")], ""
        else:
            field += c
        i += 1
    return [*fields, field.strip(" \t\r\n")]


def test_split_fields_random(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice('ab,;" ') for _ in range(rng.randint(0, 14))) for _ in range(400)]
    assert values(spark, texts, X.split_fields("value", ",")) == [_by_rule(t, ",") for t in texts]


def test_domains(spark):
    hosts = {
        "www.example.com": "example.com", "a.b.example.co.uk": "example.co.uk",
        "example.co.uk": "example.co.uk", "co.uk": "co.uk", "localhost": "localhost", "": "",
        "a..example.COM.": "example.COM", "x.y.gov.us": "gov.us", "x.Com.AU": "x.Com.AU", "..": "..",
    }
    assert values(spark, hosts, X.registered_domain("value")) == list(hosts.values())


def test_address_keys_against_stdlib(spark):
    rng = random.Random(3)
    texts = ["::", "::1", "1::", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:8", "fe80::1:2", "1:2:3:4:5:6:1.2.3.4",
             "1::2::3", ":::", "1:2:3", "12345::", "g::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7:8:9", "1.2.3.4", "01.2.3.4", "1.2.3", "300.1.1.1", "", ":1", "1:2:3:4::5:6:7:8"]
    for _ in range(100):
        texts.append(str(ipaddress.IPv6Address(rng.getrandbits(128) & ~(0xFFFFFFFF << rng.randint(0, 96)))))

    def expected(text):
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return None
        n = int(a)
        signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
        return (a.version, signed(n >> 64), signed(n & (2**64 - 1)))

    got = values(spark, texts, NF.address_key("value"))
    assert [None if g is None else tuple(g) for g in got] == [expected(t) for t in texts]


def test_cidr_match_against_stdlib(spark):
    rng = random.Random(5)
    pairs = [("1.2.3.4", "1.2.3.4"), ("1.2.3.4", "1.2.3.4/33"), ("1.2.3.4", "::/0"), ("::1", "::1"),
             ("::1", "0:0::1"), ("::1", "::/0"), ("1.2.3.4", "0.0.0.0/0"), ("1.2.3.4", "1.2.3.0/x")]
    for _ in range(150):
        v = rng.choice([32, 128])
        make = ipaddress.IPv4Address if v == 32 else ipaddress.IPv6Address
        n = rng.getrandbits(v)
        plen = rng.randint(0, v)
        near = n ^ (1 << rng.randint(0, v - 1))
        pairs.append((str(make(near)), f"{make(n)}/{plen}"))

    def expected(ip, net):
        if "/" not in net:
            return ip == net
        try:
            return ipaddress.ip_address(ip) in ipaddress.ip_network(net, strict=False)
        except ValueError:
            return False

    got = values(spark, pairs, NF.cidr_match("ip", "net"), "ip string, net string")
    assert got == [expected(*p) for p in pairs]


def test_responses(spark):
    ping = {
        "rtt min/avg/max/mdev = 10.123/20.456/30.789/5.123 ms": "avg: 20.5ms jitter: 5.1ms",
        "round-trip min/avg/max/stddev = 1/20.25/3/0.75 ms": "avg: 20.2ms jitter: 0.8ms",
        "rtt min/avg/max/mdev = 1/2 ms": "DEAD", "100% packet loss": "DEAD", "": "DEAD",
    }
    assert values(spark, ping, R.ping_summary("value")) == list(ping.values())
    dates = {"Jan 13 06:24:14 2026 GMT": "01/13/2026 06:24", "Dec  3 1:2 2026": "12/3/2026", "Foo 1": "Foo 1"}
    assert values(spark, dates, R.cert_date("value")) == list(dates.values())
    titles = {
        "<html>\n<TITLE>Hello</TITLE></html>": "Hello", "<p>x": None,
        f"<title>{'x' * 51}</title>": "x" * 47 + "...", f"<title>{'x' * 50}</title>": "x" * 50,
    }
    assert values(spark, titles, R.html_title("value")) == list(titles.values())
    head = "HTTP/1.1 301 Moved\r\nServer: a\r\n\r\nHTTP/2 200\r\nserver:  b \r\ncontent-security-policy: x\r\n"
    assert tuple(values(spark, [head], R.http_headers("value", True))[0]) == ("301->200", "b", "Yes")
    assert tuple(values(spark, [head], R.http_headers("value"))[0]) == ("200", "b", "Yes")
    assert tuple(values(spark, ["nothing"], R.http_headers("value"))[0]) == (None, None, "No")
    assert values(spark, ["https://x/{ip}?k={api_key}&{ip}"], R.fill_template("value", F.lit("1.2.3.4"), F.lit("K"))) == [
        "https://x/1.2.3.4?k=K&1.2.3.4"
    ]
