"""Sources, statistics, joins, correlation, plan and streams."""

import bz2
import gzip
import ipaddress
import json
import os
import random

import pytest
from conftest import LOG
from pyspark.sql import Observation
from pyspark.sql import functions as F

from addrsift import dig, number_lines, read_lines, time_bounds
from addrsift.catalog import enrichment, statistics
from addrsift.catalog.inputs import frame, log_lines, spread
from addrsift.functions.networks import address_key
from addrsift.operators import correlate as C
from addrsift.operators import entries as E
from addrsift.operators import groups as G
from addrsift.operators import joins as J
from addrsift.operators import lookups as L
from addrsift.operators import networks as N
from addrsift.operators import stats as S
from addrsift.sinks import writers as W
from addrsift.sources.lines import codec_of
from addrsift.streaming import running as ST

GOLDEN = {
    "203.0.113.201": (3, 0, 3, "08:33", "08:39"), "10.77.0.1": (2, 2, 0, "08:30", "08:34"),
    "198.51.100.8": (2, 1, 1, "08:31", "08:35"), "172.20.3.4": (1, 1, 0, "08:36", "08:36"),
    "192.168.50.5": (1, 1, 0, "08:37", "08:37"), "10.77.0.250": (1, 1, 0, "08:38", "08:38"),
    "2001:db8:7::": (1, 1, 0, "08:32", "08:32"),
}


def golden(stats):
    return {
        r.ip: (r["count"], r.login_success_count, r.login_failed_count, r.first_seen[11:16], r.last_seen[11:16])
        for r in stats.collect()
    }


def test_golden_statistics(log):
    assert golden(dig(log, detect_login=True)) == GOLDEN


def test_codecs(spark, tmp_path):
    assert [codec_of(p) for p in ("a.log", "a.txt", "a.gz", "a.GZ", "a.bz2", "a.BZ2", "a.xz", "a.XZ")] == [
        None, None, "gzip", "gzip", "bzip2", "bzip2", "xz", "xz",
    ]
    text = LOG.replace("\n", "\r\n").encode()
    (tmp_path / "a.log").write_bytes(LOG.encode())
    (tmp_path / "b.log.GZ").write_bytes(gzip.compress(text))
    (tmp_path / "c.log.bz2").write_bytes(bz2.compress(text))
    (tmp_path / "bad.log.gz").write_bytes(b"no gzip at all 1.2.3.4\n")
    for name in ("a.log", "b.log.GZ", "c.log.bz2"):
        lines = read_lines(spark, str(tmp_path / name))
        assert [r.value for r in lines.orderBy("row_id").collect()] == LOG.splitlines(), name
        assert golden(dig(lines, detect_login=True)) == GOLDEN, name
    with pytest.warns(UserWarning, match="no such file"):
        both = read_lines(spark, [str(tmp_path / "a.log"), str(tmp_path / "absent.log")])
    assert both.count() == 10
    everything = read_lines(spark, str(tmp_path / "*.log*"), partitions=3)
    assert everything.count() == 30  # the broken file is skipped
    assert {r["count"] for r in E.extract_entries(everything).groupBy("filename").count().collect()} == {11}
    with pytest.warns(UserWarning, match="no such file"):
        assert dig(read_lines(spark, str(tmp_path / "absent"))).count() == 0


def test_line_numbers(spark, tmp_path):
    texts = {}
    for name, n in (("a.log", 400), ("b.log", 7)):
        texts[name] = [f"{name} line {i} from 10.0.0.{i % 250}" for i in range(1, n + 1)]
        (tmp_path / name).write_text("\n".join(texts[name]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        lines = read_lines(spark, str(tmp_path))
        assert lines.select("block_start").distinct().count() > 3
        numbered = number_lines(lines)
        for r in numbered.collect():
            assert texts[r.file_path.rsplit("/", 1)[1]][r.line_number - 1] == r.value
        assert numbered.count() == 407
        assert E.extract_entries(numbered).agg(F.max("line_number")).first()[0] == 400
        laid = C.with_layout(lines, C.csv_layouts(lines, header=True))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # another cut: loud, no lost line
        with pytest.raises(Exception, match="cut otherwise"):
            numbered.filter("line_number > 0").count()
        assert laid.count() in (405, 407)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def brute_stats(entries):
    """The statistics rule over entries in order."""
    out = {}
    for ip, date, ts in entries:
        if ip not in out:
            out[ip] = [date, date, 1, ts, ts]
            continue
        s = out[ip]
        s[2] += 1
        if ts > 0 and (s[3] == 0 or ts < s[3]):
            s[0], s[3] = date, ts
        if ts > 0 and (s[4] == 0 or ts > s[4]):
            s[1], s[4] = date, ts
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("correlated", [False, True])
def test_statistics_against_rule(spark, correlated):
    rng = random.Random(1)
    rows = [
        (f"ip{rng.randint(0, 40)}", f"d{i}", rng.choice([0, 0, -5, 7, 8, 9, 9, 12]), i) for i in range(600)
    ]
    df = spark.createDataFrame(rows, "ip string, date_string string, ts bigint, row_id bigint").repartition(7)
    df = df.withColumns({"pos": F.lit(0), "login_status": F.lit(None).cast("string"), "matches_search": F.lit(True)})
    if correlated:
        df = df.withColumn("correlation", F.concat(F.lit("v"), (F.col("row_id") % 3).cast("string")))
    got = S.ip_stats(df).collect()
    expected = brute_stats([r[:3] for r in rows])
    assert {r.ip: (r.first_seen, r.last_seen, r["count"], r.first_ts, r.last_ts) for r in got} == expected
    assert sum(r["count"] for r in got) == 600
    if correlated:
        values = {}
        for ip, _, _, i in rows:
            values.setdefault(ip, set()).add(f"v{i % 3}")
        assert {r.ip: r.correlation for r in got} == {k: ", ".join(sorted(v)) for k, v in values.items()}


def test_limits_come_before_the_time_range(log):
    bounds = dict(start_ts=1748939400, end_ts=1748939640)  # 08:30 to 08:34
    both = dig(log, top_limit=1, **bounds).collect()
    assert [(r.ip, r["count"]) for r in both] == [("203.0.113.201", 1)]
    assert dig(log, limit=2, **bounds).count() == 0
    top = {r.ip: r["count"] for r in dig(log, top_limit=3).collect()}
    assert top == {"203.0.113.201": 3, "10.77.0.1": 2, "198.51.100.8": 2}
    two = {r.ip: r["count"] for r in dig(log, top_limit=2, limit=3).collect()}
    assert two == {"203.0.113.201": 2, "10.77.0.1": 1}


def test_one_scan_top_equals_two_scans(log):
    entries = E.extract_entries(log)
    keep = E.in_time_range("ts", 1748939400, 1748939700)
    one = S.top_stats(entries, 3, keep)
    two = S.ip_stats(S.entries_of_top_ips(entries, 3).where(keep))
    assert sorted(one.collect()) == sorted(two.collect())


def test_time_filter(spark, lines):
    entries = E.extract_entries(lines("1.1.1.1", "2024-01-13 2.2.2.2", "Jan 13 00:00:00 3.3.3.3", "2024-01-14 4.4.4.4"))
    bounds = time_bounds(spark, "2024-01-13,2024-01-13", 0)
    seen = Observation()
    kept = E.filter_time_range(entries, bounds["start_ts"], bounds["end_ts"], observe=seen)
    assert [r.ip for r in kept.collect()] == ["2.2.2.2"]
    assert seen.get == {"excluded": 3, "no_timestamp": 1}
    open_start = E.filter_time_range(entries, None, bounds["end_ts"], include_missing=True)
    assert [r.ip for r in open_start.collect()] == ["1.1.1.1", "2.2.2.2", "3.3.3.3"]


def test_time_range_inside_extraction(lines):
    text = lines("1.1.1.1", "2024-01-13 2.2.2.2", "Jan 13 00:00:00 3.3.3.3", "2024-01-14 4.4.4.4")
    for bounds in ((1705104000, 1705104000, False), (None, 1705104000, True), (1705104001, None, False)):
        inside = E.extract_entries(text, time_range=bounds)
        outside = E.filter_time_range(E.extract_entries(text), *bounds)
        assert sorted(inside.collect()) == sorted(outside.collect())


def test_attack_edges(spark):
    rows = [
        ("ddos", 10, 0, 100, 400), ("slow", 10, 0, 100, 401), ("few", 9, 0, 100, 100), ("undated", 99, 99, 0, 0),
        ("force", 10, 10, 100, 100), ("spray", 6, 5, 100, 3099), ("late", 6, 5, 100, 3100), ("scan", 10, 0, 100, 160),
    ]
    stats = spark.createDataFrame(
        rows, "ip string, count bigint, login_failed_count bigint, first_ts bigint, last_ts bigint"
    )
    got = {
        r.ip: {n[3:] for n in ("is_ddos", "is_spray", "is_scan", "is_bruteforce") if r[n]}
        for r in S.with_attack_flags(stats).collect()
    }
    assert got == {
        "ddos": {"ddos"}, "slow": set(), "few": set(), "undated": set(), "force": {"ddos", "bruteforce"},
        "spray": {"spray"}, "late": set(), "scan": {"ddos", "scan"},
    }
    one = {r.ip for r in S.with_attack_flags(stats, threshold=1).where("is_spray").collect()}
    assert one == {"slow"}  # no failure is enough when half the threshold is 0


AUDIT = [
    "when;address;account;what",
    "2025-05-01 09:00:00;10.9.8.7;mona;open",
    "2025-05-01 09:20:00;10.9.8.6;omar;open",
    "2025-05-01 09:40:00;10.9.8.7;mona;close",
    "2025-05-01 09:50:00;10.9.8.7;piet;refused",
]


def test_correlation_by_user(lines):
    groups = dig(lines(*AUDIT), correlate_user="Account", output="groups").collect()
    assert [tuple(r) for r in groups] == [("mona, piet", 1, 3, "User"), ("omar", 1, 1, "User")]
    members = dig(lines(*AUDIT), correlate_user="account", output="members").collect()
    assert [(r.group_key, r.ip, r.first_seen) for r in members] == [
        ("mona, piet", "10.9.8.7", "2025-05-01 09:00:00"), ("omar", "10.9.8.6", "2025-05-01 09:20:00"),
    ]
    with pytest.raises(ValueError):
        dig(lines(*AUDIT), correlate_user="a", correlate_host="b")


def test_layout_edges(lines, log):
    assert C.csv_layouts(log).count() == 0  # not delimited: all lines are kept
    got = dig(log, correlate_user="user", output="groups").collect()
    assert [(r.correlation_value, r.total_events) for r in got] == [("unknown", 11)]
    # letters in half of the fields make the first line a header
    half = lines("alice,1.1.1.1", "bob,2.2.2.2")
    assert {r.ip for r in dig(half, correlate_user="x").collect()} == {"2.2.2.2"}
    assert {r.ip for r in dig(half, correlate_user="x", header=False).collect()} == {"1.1.1.1", "2.2.2.2"}
    assert C.csv_layouts(lines("a,b")).count() == 0
    ragged = lines("a,b", "a,b,c,d,e,f", "a,b", "1,2")
    assert C.csv_layouts(ragged).count() == 0
    twice = C.csv_layouts(lines("A;b;a", "1;2;3")).first()
    assert (twice.delimiter, twice.fields) == (";", {"b": 1, "a": 2})


def test_layout_of_files(spark, tmp_path):
    for name, d in (("a.csv", ","), ("b.csv", ";")):
        rows = [f"Time{d}User{d}IP"] + [f"2024-01-01{d}u{i}{d}1.1.1.{i % 200}" for i in range(300)]
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = read_lines(spark, str(tmp_path))
        laid = C.with_layout(lines, C.csv_layouts(lines), "user")
        entries = E.extract_entries(laid, correlation=C.user_value())
        assert entries.count() == 600
        assert entries.select("correlation").distinct().count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_heads_of_files_are_read_alone(spark, tmp_path):
    """A layout reads the beginnings of files: bytes read don't grow with them."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        none = jvm.java.util.ArrayList()
        found = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return {found.apply(i).stageId(): found.apply(i).inputBytes() for i in range(found.size())}

    def bytes_read(call):
        before = stages()
        call()
        return sum(n for stage, n in stages().items() if stage not in before)

    big = "Time,User,IP\n" + "".join(f"2024-01-01,u{i % 9},1.1.{i % 200}.7{' ' * 400}\n" for i in range(200_000))
    (tmp_path / "big.csv").write_text(big)
    (tmp_path / "short.csv").write_text("a;b\n1;2")
    (tmp_path / "empty.csv").write_text("")
    with gzip.open(tmp_path / "packed.csv.gz", "wt") as f:
        f.write("x|y\r\n1|2\r\n")
    lines = read_lines(spark, str(tmp_path))
    heads = []
    assert bytes_read(lambda: heads.append(C.sample_lines(lines))) < len(big) / 3  # what fits the pipes to the task
    rows = sorted((r.file_path.rsplit("/", 1)[1], r["rank"], r.value) for r in heads[0].collect())
    assert rows == [("big.csv", i + 1, x) for i, x in enumerate(big.split("\n")[:20])] + [
        ("packed.csv.gz", 1, "x|y"), ("packed.csv.gz", 2, "1|2"), ("short.csv", 1, "a;b"), ("short.csv", 2, "1;2")
    ]
    laid = C.with_layout(lines, C.csv_layouts(lines), "user")
    assert laid.count() == 200_000 + 2 and laid.where("value = 'Time,User,IP'").count() == 0


def test_repeats_of_a_header_that_holds_an_address_count(spark, tmp_path):
    rows = ["alice,1.1.1.1", "bob,2.2.2.2", "alice,1.1.1.1", "alice,1.1.1.1"] * 300
    (tmp_path / "a.csv").write_text("\n".join(rows))
    (tmp_path / "b.csv").write_text("name,host\n" + "\n".join(rows))
    lines = read_lines(spark, str(tmp_path))
    layouts = C.csv_layouts(lines)
    assert {r.file_path[-5:]: r.header_row is None for r in layouts.collect()} == {"a.csv": False, "b.csv": True}
    stats = dig(lines, correlate_user="alice").collect()
    assert {r.ip: r["count"] for r in stats} == {"1.1.1.1": 1799, "2.2.2.2": 600}


def test_halving_over_all_lengths(spark):
    """Networks of every length: the longest one is found in 6 and 8 lookups."""
    rng = random.Random(4)
    nets, ips = {}, set()
    for bits, make in ((32, ipaddress.IPv4Address), (128, ipaddress.IPv6Address)):
        for plen in range(bits + 1):
            for _ in range(2):
                n = rng.getrandbits(bits)
                nets[str(ipaddress.ip_network((n, plen), strict=False))] = f"c{len(nets)}"
                ips.add(str(make(n ^ rng.getrandbits(max(1, (bits - plen) // 2)))))
    ips |= {str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(50)}
    rows = spark.createDataFrame([(ip,) for ip in ips], "ip string")
    blocks = spark.createDataFrame(list(nets.items()), "network string, cc string")
    parsed = [(ipaddress.ip_network(n), cc) for n, cc in nets.items()]
    want = {ip: max(((n.prefixlen, cc) for n, cc in parsed if ipaddress.ip_address(ip) in n), default=(0, None))[1] for ip in ips}
    for halve in (False, True):
        assert {r.ip: r.cc for r in N.with_networks(rows, blocks, halve=halve).collect()} == want
    lengths = {4: list(range(33)), 6: list(range(129))}
    keys = rows.select("ip", address_key("ip").alias("_a"))
    assert N.cut_to_lengths(keys.where("_a.family = 4"), lengths).count() == 33 * keys.where("_a.family = 4").count()
    assert [len(lengths[f]).bit_length() for f in (4, 6)] == [6, 8]
    assert all(max(b) < p for k in range(1, 130) for p, b in N._halvings(k).items() if b)


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_network_joins_against_brute_force(spark, threshold, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    rng = random.Random(11)
    ips, nets = set(), {}
    for i in range(120):
        v = rng.choice([32, 128])
        make, bits = (ipaddress.IPv4Address, 32) if v == 32 else (ipaddress.IPv6Address, 128)
        base = rng.getrandbits(6) << (bits - 6)
        plen = rng.choice([0, 3, 6, 8, 30] if v == 32 else [0, 5, 6, 64, 120])
        n = base | rng.getrandbits(3)
        nets[str(ipaddress.ip_network((n, plen), strict=False))] = f"c{i}"
        ips.add(str(make(n | rng.getrandbits(4))))
    ips |= {"text", "01.2.3.4"}
    listed_ips = [*sorted(ips), None, None, *sorted(ips)[:7]]  # null and repeated addresses stay
    rows = spark.createDataFrame([(ip, i) for i, ip in enumerate(listed_ips)], "ip string, count int")
    blocks = spark.createDataFrame(list(nets.items()), "network string, cc string")

    def best(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None
        found = [ipaddress.ip_network(n) for n in nets if a in ipaddress.ip_network(n)]
        return nets[str(max(found, key=lambda n: n.prefixlen))] if found else None

    for halve in (False, True, None):
        placed = N.with_networks(rows, blocks, halve=halve).collect()
        assert {r.ip: r.cc for r in placed} == {ip: best(ip) for ip in ips} | {None: None}
    assert sorted((r["count"], str(r.ip)) for r in placed) == [(i, str(ip)) for i, ip in enumerate(listed_ips)]

    exact = sorted(ips)[:5]
    threats = blocks.select(
        F.when(F.expr("substr(cc, -1) < '5'"), "PeerDrop").otherwise("PhishTank").alias("list_name"), "network"
    ).union(spark.createDataFrame([("CINSBadRep", ip) for ip in exact], "list_name string, network string"))
    flags = N.with_threat_flags(rows, threats).collect()
    lists = [{r["count"]: (r.ip, r.lists) for r in N.with_networks(rows, threats=threats, halve=h).collect()} for h in (False, True)]
    assert lists[0] == lists[1] and len(lists[0]) == len(listed_ips)

    def listed(ip, name):
        for t in threat_rows:
            if t.list_name != name:
                continue
            if "/" not in t.network:
                if t.network == ip:
                    return "Yes"
                continue
            try:
                if ipaddress.ip_address(ip) in ipaddress.ip_network(t.network):
                    return "Yes"
            except ValueError:
                pass
        return "No"

    threat_rows = threats.collect()
    for r in flags:
        for name in ("PeerDrop", "PhishTank", "CINSBadRep", "NordVPN_v4"):
            assert r[name] == listed(r.ip, name), (r.ip, name)


def test_one_lookup_without_a_common_key(spark, log):
    """Places, networks and lists of any size come from one join on the network key."""
    blocks = spark.createDataFrame([("203.0.0.0/8", "DE")], "network string, cc string")
    asn = spark.createDataFrame([("203.0.113.0/24", 7, "x")], "network string, asn bigint, org string")
    threats = spark.createDataFrame([("PeerDrop", "203.0.113.0/30")], "list_name string, network string")
    rows = N.with_networks(S.ip_stats(E.extract_entries(log)), blocks, asn, threats)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and plan.count("_family") and "CartesianProduct" not in plan
    got = {r.ip: (r.cc, r.asn, r.org, r.lists) for r in rows.collect()}
    assert got["203.0.113.201"] == ("DE", "AS7", "x", []) and got["10.77.0.1"] == (None, None, None, [])


def test_ranges_of_any_number(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, -5, rng.randrange(1, 2_000_000), rng.randrange(1, 1 << 33)])) for i in range(300)]
    ranges = [("open", None, None), ("start", 1000, None), ("end", None, 1_000_000), ("none", 10, 9), ("point", rows[5][1], rows[5][1])]
    ranges += [(f"r{i}", x, x + rng.choice([0, 10, 100_000, 10_000_000])) for i, x in enumerate(rng.randrange(2_000_000) for _ in range(200))]
    entries = spark.createDataFrame(rows, "id int, ts bigint")
    table = spark.createDataFrame(ranges, "name string, start_ts bigint, end_ts bigint")
    for missing in (False, True):
        got = sorted((r.id, r.range_name) for r in E.match_ranges(entries, table, include_missing=missing).collect())
        assert got == sorted(
            (i, n) for i, ts in rows for n, a, b in ranges
            if (missing if ts == 0 else (a is None or ts >= a) and (b is None or ts <= b))
        )
        salted = E.match_ranges(entries, table, include_missing=missing, broadcast_rows=0)
        assert sorted((r.id, r.range_name) for r in salted.collect()) == got
    wrong = spark.createDataFrame([("w", 5, 1)], table.schema)
    assert {(r.ts, r.range_name) for r in E.match_ranges(entries, wrong, include_missing=True).collect()} <= {(0, "w")}
    many = spark.range(100_000).selectExpr("CAST(id AS STRING) AS name", "id * 10 AS start_ts", "id * 10 + 9 AS end_ts")
    assert E.match_ranges(entries.filter("ts > 0 AND ts < 1000000"), many).count() == sum(0 < t < 1_000_000 for _, t in rows)


def test_hot_buckets_are_dealt_over_tasks(spark):
    """Open-ended rules over entries of one day: as many rows in each task, about."""
    rules = spark.range(1000).selectExpr("CAST(id AS STRING) AS name", "id AS start_ts", "CAST(null AS BIGINT) AS end_ts")
    entries = spark.range(2000, numPartitions=8).selectExpr("id AS row_id", "1704067200 + id AS ts")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for most in (100_000, 0):  # broadcast, and dealt over the four shuffle partitions
            met = E.match_ranges(entries, rules, broadcast_rows=most)
            sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(sizes) == 2_000_000 and max(sizes) < 3 * sum(sizes) / (8 if most else 4)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_time_range_is_pushed_down(spark, log, tmp_path):
    E.extract_entries(log).write.parquet(str(tmp_path / "entries"))
    kept = E.filter_time_range(spark.read.parquet(str(tmp_path / "entries")), 10, 20)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,10)" in plan and "LessThanOrEqual(ts,20)" in plan


def test_salted_join_equals_plain(spark):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, v string")
    plain = left.join(right, "k", "left")
    salted = J.salted_join(left, right, ["k"], F.col("id"))
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def most_of_a_task(df):
    """Partitions, and rows of the largest one."""
    sizes = df.groupBy(F.spark_partition_id()).count().agg(F.count(F.lit(1)), F.max("count")).first()
    return sizes[0], sizes[1]


def test_captured_answers_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """However the files are cut and whatever the keys are."""
    monkeypatch.setattr("addrsift.catalog.inputs.ROWS_PER_TASK", 100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")  # splits by the dozen, of which one holds the rows
    try:
        for i, key in enumerate(("id", "nullif(id, id)", "7L")):
            spark.range(5000, numPartitions=1).selectExpr(
                f"{key} AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "'1-URGENT' AS o_orderpriority",
                "TIMESTAMP '2024-01-02 03:04:05' AS o_orderdate",
            ).write.parquet(str(tmp_path / f"{i}/orders.parquet"))
            n, most = most_of_a_task(frame(spark, str(tmp_path / str(i)), "tls_answers"))
            assert n == 50 and most < 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_log_lines_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    """However the files are cut, and the statistics stay those of all lines."""
    monkeypatch.setattr("addrsift.catalog.inputs.ROWS_PER_TASK", 100)
    spark.range(5000, numPartitions=1).selectExpr(
        "id AS event_id", "TIMESTAMP '2024-01-02 03:04:05' AS ts", "id % 4 AS user_id", "if(id % 5 = 0, 'error', 'signup') AS event_type",
    ).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        n, most = most_of_a_task(log_lines(spark, str(tmp_path)))
        assert n == 50 and most < 200
        stats = {r.ip: r for r in statistics.ip_stats_login(spark, str(tmp_path)).collect()}
        assert len(stats) == 5 and {stats[ip]["count"] for ip in stats if ip != "198.51.100.9"} == {1250}
        assert sum(r.login_failed_count for r in stats.values()) == 1000 + 5000 // 85 + 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_come_from_lines_dealt_by_rows(spark, tmp_path, monkeypatch):
    """Records of all lines, the statistics under them taken by tasks of few rows."""
    monkeypatch.setattr("addrsift.catalog.inputs.ROWS_PER_TASK", 100)
    spark.range(3000, numPartitions=1).selectExpr(
        "nullif(id, id) AS event_id", "TIMESTAMP '2024-01-02 03:04:05' AS ts", "4 * id + 2 AS user_id", "'error' AS event_type",
    ).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(25).selectExpr("id AS n_nationkey", "'N' AS n_name").write.parquet(str(tmp_path / "nation.parquet"))
    spark.range(3).selectExpr("id AS s_suppkey", "'S' AS s_name").write.parquet(str(tmp_path / "supplier.parquet"))
    assert enrichment.stats_json(spark, str(tmp_path)).count() == 0  # a line without an id is null
    spark.read.parquet(str(tmp_path / "events.parquet")).withColumn("event_id", F.lit(5)).write.parquet(str(tmp_path / "b/events.parquet"))
    for name in ("nation", "supplier"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).write.parquet(str(tmp_path / f"b/{name}.parquet"))
    n, most = most_of_a_task(log_lines(spark, str(tmp_path / "b")))  # one key in all rows
    assert n == 30 and most < 200
    records = [json.loads(r.value) for r in enrichment.stats_json(spark, str(tmp_path / "b")).collect()]
    assert [r["ip_address"] for r in records] == ["8.10.2.9", "8.14.2.9", "8.18.2.9", "8.2.2.9", "8.6.2.9"]
    assert {(r["count"], r["login_failed_count"], r["enrichment"]["city"]) for r in records} == {(600, 600, f"City {k}") for k in (2, 6, 10, 14, 18)}


def test_rows_are_dealt_by_their_places(spark, tmp_path, monkeypatch):
    """No row group is sorted before it is dealt, and files of one row each are dealt as evenly as one file."""
    monkeypatch.setattr("addrsift.catalog.inputs.ROWS_PER_TASK", 10)
    for name, rows, files in (("one", 1000, 1), ("many", 300, 300)):
        spark.range(rows, numPartitions=files).selectExpr("7L AS event_id", "nullif(id, id) AS user_id").write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        dealt = spread(table)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" in plan and "RoundRobinPartitioning" not in plan
        n, most = most_of_a_task(dealt)
        assert n > rows // 13 and most < 30
        assert dealt.columns == table.columns and dealt.exceptAll(table).isEmpty() and dealt.count() == rows


def test_groups_by_texts_of_any_length(spark):
    """Long keys are neither sampled nor broadcast, and their order is that of the whole texts."""
    start = "a, " * 200
    sets = [start + "x", start + "b", None, "unknown", "ä", start + "b", "", start]
    rows = [(f"8.8.{i % 3}.{i}", sets[i % len(sets)], 1 + i % 8 // 6, "t", None) for i in range(64)]
    stats = spark.createDataFrame(rows, "ip string, correlation string, count bigint, first_seen string, last_seen string")
    groups = {}
    for ip, text, n, *_ in rows:
        groups.setdefault("unknown" if text is None else text, []).append((ip, n))
    total = {k: sum(n for _, n in v) for k, v in groups.items()}
    utf8 = str.encode
    by_size = sorted(groups, key=lambda k: (-total[k], utf8(k)))

    members = G.members_with_totals(stats, "correlation")
    want = [(k, *m, "t", None, len(groups[k]), total[k]) for k in by_size for m in sorted(groups[k])]
    assert [tuple(r) for r in members.collect()] == want
    listed = G.group_members(stats, "correlation")
    assert [(r.group_key, r.ip) for r in listed.collect()] == [(k, m[0]) for k in sorted(groups, key=utf8) for m in sorted(groups[k])]
    sized = C.correlation_groups(stats)
    assert [(r.correlation_value, r.unique_ips, r.total_events) for r in sized.collect()] == [(k, len(groups[k]), total[k]) for k in by_size]
    nested = G.nested_groups(stats, "correlation")
    assert [r.group_key for r in nested.collect()] == sorted(groups, key=utf8)
    labels = G.label_totals(stats.fillna("unknown", "correlation"), "correlation")
    assert [(r.group_label, r.total_count) for r in labels.collect()] == [(k, total[k]) for k in by_size]
    for made in (members, listed, sized, nested, labels):
        plan = made._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.splitlines() if "rangepartitioning(" in x]
        assert dealt and all("substring(" in x or "_place" in x for x in dealt)
        assert "BroadcastExchange HashedRelationBroadcastMode(List(group_key" not in plan


def joined(folder):
    """The parts of a document by name, as one."""
    return json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))


def test_geo_filters_and_groups(spark, log, tmp_path):
    geo = spark.createDataFrame(
        [("198.51.100.0/24", "DE", "Germany", 1.5, 2.5), ("203.0.0.0/16", "no", "Norway", 3.0, 4.0)],
        "network string, cc string, country string, latitude double, longitude double",
    )
    assert {r.ip for r in dig(log, geo_blocks=geo, outside_eu=True).collect()} == set(GOLDEN) - {"198.51.100.8"}
    gdpr = dig(log, geo_blocks=geo, outside_gdpr=True)
    assert {r.ip for r in gdpr.collect()} == set(GOLDEN) - {"198.51.100.8", "203.0.113.201"}
    groups = dig(log, geo_blocks=geo, group_by="country", output="groups").collect()
    assert [(r.group_key, r.total_count, r.country) for r in groups] == [
        ("DE", 2, "Germany"), ("no", 3, "Norway"), ("unknown", 6, None),
    ]
    labels = dig(log, geo_blocks=geo, group_by="country", output="group_labels").collect()
    assert [r.group_label for r in labels] == ["Unknown Country", "Norway (no)", "Germany (DE)"]
    nested = G.nested_groups(dig(log, geo_blocks=geo), "country").collect()
    assert [len(r.ips) for r in nested] == [1, 1, 5]
    W.write_geojson_document(dig(log, geo_blocks=geo), str(tmp_path / "map"))
    document = joined(tmp_path / "map")
    assert [f["geometry"]["coordinates"] for f in document["features"]] == [[4.0, 3.0], [2.5, 1.5]]
    assert document["features"][0]["properties"]["cc"] == "no"
    assert "latitude" not in document["features"][0]["properties"]
    with pytest.raises(ValueError):
        dig(log, output="geojson")


def test_documents_and_writers(spark, lines, log, tmp_path):
    def document_of(stats, name):
        W.write_stats_document(stats, str(tmp_path / name))
        return joined(tmp_path / name)

    document = document_of(dig(log, detect_login=True), "a")
    assert document["total"] == 7 and document["statistics"][0]["ip_address"] == "203.0.113.201"
    assert document_of(dig(lines("nothing here")), "b") == {"statistics": [], "total": 0}
    undated = document_of(dig(lines("from 8.8.8.8")), "c")["statistics"][0]
    assert undated["first_seen"] is None and undated["first_timestamp"] == 0
    # any size, repeated rows too
    many = dig(lines("from 8.8.8.8")).drop("ip", "count").crossJoin(spark.range(300_000, numPartitions=9).select(
        F.concat(F.lit("10.0.0."), (F.col("id") % 250).cast("string")).alias("ip"), (F.col("id") % 7).alias("count")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several parts
    document = document_of(many, "d")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert document["total"] == len(document["statistics"]) == 300_000
    keys = [(-r["count"], r["ip_address"]) for r in document["statistics"]]
    assert keys == sorted(keys) and len(list((tmp_path / "d").glob("part-*"))) > 1
    W.write_stats_json(dig(log), str(tmp_path / "stats"))
    back = spark.read.json(str(tmp_path / "stats"))
    assert {r.ip_address for r in back.collect()} == set(GOLDEN)


def test_user_lookup_with_cache(spark, tmp_path):
    ips = spark.createDataFrame([("a",), ("b",), ("c",), ("c",), ("bad",)], "ip string")
    cache = spark.createDataFrame(
        [("a", "s", 900, {"k": "cached"}), ("b", "s", 0, {"k": "old"}), ("z", "s", 990, {"k": "other"})],
        L.CACHE_SCHEMA,
    )

    def lookup(ip):
        if ip == "bad":
            raise KeyError(ip)
        return {"k": ip.upper()}

    found = L.lookup_cached(ips, cache, "s", lookup, now=100_000, ttl_hours=27, concurrency=2)
    got = {r.ip: (r.data.get("k"), r.from_cache, r.error is None) for r in found.collect()}
    assert got == {
        "a": ("cached", True, True), "b": ("old", True, True), "c": ("C", False, True), "bad": (None, False, False),
    }
    found = L.lookup_cached(ips, cache, "s", lookup, now=101_000, ttl_hours=27, concurrency=2)
    assert {r.ip: r.from_cache for r in found.collect()}["b"] is False
    merged = L.merge_cache(cache, found.select("ip", "source", "cached_at", "data"))
    W.write_cache(merged, str(tmp_path / "cache"))
    back = {r.ip: r.data["k"] for r in spark.read.parquet(str(tmp_path / "cache")).collect()}
    assert back == {"a": "cached", "b": "B", "c": "C", "z": "other"}


def test_entries_enriched_once_per_ip(spark, log):
    entries = E.extract_entries(log)
    out = L.enrich_entries(entries, lambda ips: ips.withColumn("size", F.length("ip")))
    assert out.count() == 11
    assert all(r.size == len(r.ip) for r in out.collect())


def test_table_view_columns(log):
    view = dig(log, detect_login=True, output="table")
    assert view.columns == ["IP Address", "First Seen", "Last Seen", "Count", "Login", "DDoS", "Spray", "Scan", "BruteForce"]
    assert tuple(view.first())[:5] == ("203.0.113.201", "2025-06-03 08:33:00", "2025-06-03 08:39:00", 3, "OK:0 F:3")


def test_stream_equals_batch(spark, log, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate((LOG.splitlines()[:4], LOG.splitlines()[4:])):
        (folder / f"{i}.log").write_text("\n".join(part) + "\n")
    entries = ST.stream_entries(ST.stream_lines(spark, str(folder), 1), detect_login=True)
    stats = ST.running_stats(entries, threshold=2, window=600)
    query = (
        stats.writeStream.outputMode("complete").format("memory").queryName("running")
        .option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    streamed = spark.table("running")
    batch = S.with_attack_flags(
        S.ip_stats(E.extract_entries(log, detect_login=True)).drop("correlation"), threshold=2, window=600
    )
    assert sorted(map(str, streamed.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_windowed_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "0.log").write_text("2024-01-01 10:00:01 1.1.1.1\n2024-01-01 10:00:02 1.1.1.1\nno date 1.1.1.1\n")
    (folder / "1.log").write_text("2024-01-01 12:00:00 2.2.2.2\n")
    (folder / "2.log").write_text("2024-01-01 12:00:01 2.2.2.2\n")
    (folder / "3.log").write_text("2024-01-01 10:00:03 1.1.1.1\n2024-01-01 18:00:00 3.3.3.3\n")
    for i in range(4):  # files are taken in order of age
        os.utime(folder / f"{i}.log", (1000 + i, 1000 + i))
    entries = ST.stream_entries(ST.stream_lines(spark, str(folder), 1))
    windows = ST.windowed_stats(entries, "10 minutes", "5 minutes", threshold=2)
    query = (
        windows.writeStream.outputMode("append").format("memory").queryName("windows")
        .option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    )
    query.awaitTermination(90)
    got = {(r.ip, r["count"], r.is_ddos) for r in spark.table("windows").collect()}
    # the entry that comes after its window closed is dropped
    assert got == {("1.1.1.1", 2, True), ("2.2.2.2", 2, True)}
