"""The account of files and upserts of streams."""

import bz2
import gzip
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from addrsift.operators import entries as E
from addrsift.sources.accounts import file_account
from addrsift.streaming import running as R
from addrsift.streaming import upserts as U


def test_file_account(spark, tmp_path):
    rng = random.Random(3)
    text = "".join(f"line {i} {rng.random()} from 8.8.{i % 256}.1\n" for i in range(20_000))
    (tmp_path / "plain.log").write_text(text)
    (tmp_path / "no end.log").write_text("a\nb")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "two [1].gz").write_bytes(gzip.compress(text.encode()) + gzip.compress(b"more\n"))  # members one after the other
    (tmp_path / "cut.gz").write_bytes(gzip.compress(text.encode())[:-40_000])
    (tmp_path / "text.gz").write_text(text)
    (tmp_path / "whole.bz2").write_bytes(bz2.compress(text.encode()))
    broken = bytearray(bz2.compress(text.encode()))
    broken[len(broken) // 2] ^= 255
    (tmp_path / "broken.BZ2").write_bytes(broken)
    with pytest.warns(UserWarning, match="no such file"):
        account = file_account(spark, [str(tmp_path), str(tmp_path / "absent")])
    got = {unquote(r.file_path.rsplit("/", 1)[1]): r for r in account.collect()}
    assert {n for n, r in got.items() if not r.complete} >= {"cut.gz", "text.gz", "absent"}
    assert {n for n, r in got.items() if r.complete} >= {"plain.log", "no end.log", "empty.log", "two [1].gz", "whole.bz2"}
    assert all((r.error is None) == r.complete for r in got.values())
    n = len(text.splitlines())
    assert [(got[x].n_lines, got[x].text_bytes) for x in ("plain.log", "whole.bz2", "two [1].gz", "empty.log")] == [(n, len(text)), (n, len(text)), (n + 1, len(text) + 5), (0, 0)]
    assert got["plain.log"].file_bytes == len(text) and got["absent"].file_bytes is None
    assert 0 <= got["cut.gz"].n_lines < n and got["cut.gz"].codec == "gzip" and got["whole.bz2"].codec == "bzip2" and got["plain.log"].codec is None
    sound = file_account(spark, str(tmp_path / "*.log")).collect()
    assert len(sound) == 3 and all(r.complete for r in sound)
    with pytest.warns(UserWarning, match="no such file"):
        assert [r.complete for r in file_account(spark, str(tmp_path / "absent")).collect()] == [False]


def test_upserts(spark, tmp_path):
    """Later batches win, a repeated batch changes nothing, before and after merging."""
    rng = random.Random(8)
    path, want = str(tmp_path / "result"), {}
    with pytest.raises(ValueError):
        U.current(spark, path, ["ip"])
    for number in range(6):
        rows = {f"ip{rng.randrange(8)}": (number, rng.random()) for _ in range(4)}
        batch = spark.createDataFrame([(k, *v) for k, v in rows.items()], "ip string, n int, x double")
        want |= rows
        for _ in range(1 + number % 2):
            U.upsert(path)(batch, number)
        if number in (2, 4):
            assert U.merge(spark, path, ["ip"]) == number
        assert {r.ip: (r.n, r.x) for r in U.current(spark, path, ["ip"]).collect()} == want


def test_updates_equal_the_batch(spark, lines, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = [f"2024-01-{1 + i % 9:02d} 0{i % 9}:00:00 login failed from 10.0.0.{i % 5}" for i in range(40)]
    for k in range(3):
        (folder / f"{k}.log").write_text("\n".join(texts[k::3]) + "\n")
        stats = R.running_stats(R.stream_entries(R.stream_lines(spark, str(folder)), detect_login=True))
        writer = stats.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
        writer.foreachBatch(U.upsert(str(tmp_path / "result"))).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.ip: (r["count"], r.login_failed_count, r.first_seen, r.last_seen) for r in U.current(spark, str(tmp_path / "result"), ["ip"]).collect()}
    want = {}
    for i, t in enumerate(texts):
        seen = want.setdefault(f"10.0.0.{i % 5}", [])
        seen.append(t[:19])
    assert got == {ip: (len(s), len(s), min(s), max(s)) for ip, s in want.items()}


def test_observed_counts(spark, lines, tmp_path):
    entries = E.extract_entries(lines("2024-01-01 00:00:00 1.1.1.1", "2024-02-01 00:00:00 1.1.1.2", "none 1.1.1.3"))
    seen = E.write_time_range(entries, str(tmp_path / "out"), start=1706000000)
    assert seen == {"excluded": 2, "no_timestamp": 1}
    assert [r.ip for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("ip")).collect()] == ["1.1.1.2"]
