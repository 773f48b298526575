"""Manifest, fingerprints and hard negatives against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from addrsift.llm import fingerprints as fp
from addrsift.llm import manifest as mf
from addrsift.llm import negatives

LONG = "Lorem ipsum\ndolor  SIT " * 20_000


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# manifest


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    def lift(nodes):
        """Root, and per first node its steps of (left, right)."""
        steps, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for i, a in enumerate(at):
                run = a // 8 * 8
                steps[i].append(("".join(level[run:a]), "".join(level[a + 1 : run + 8])))
                at[i] = a // 8
            level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        return level[0], steps

    groups = {}
    for r in rows:
        leaf = sha("".join(map(encoded, r)))
        text = r[4]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, r, sha("".join(map(encoded, [*r[:4], text])))))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    told = {g: lift([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, above = lift([told[g][0] for g in names])
    out = []
    for g, over in zip(names, above, strict=True):
        for x, steps in zip(sorted(groups[g], key=lambda x: x[:3]), told[g][1], strict=True):
            folded = x[4]
            for left, right in [*steps, *over]:
                folded = sha(left + folded + right)
            out.append((x[3][0], x[2], told[g][0], root, sha("".join(a + b for a, b in [*steps, *over])), folded, folded == root))
    return out


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
EDGES = [
    (1, "s", "en", 3, "A b"), (1, "s", "en", 3, "A b"), (1, None, "en", None, None), (None, "s", "en", 3, "X"), (None, "s", "en", 3, "X"), (None, "t", "en", 3, ""),
    (-5, "s", "en", 3, "ÄÖ Ab"), (-64, "s", "en", 3, "x"), (2**63 - 1, "s", "en", 1, "Y"), (-(2**63), "s", "en", 1, "Y"), (63, "s", None, 1, "Y"), (64, "s", None, 1, "Y"),
    (7, "s", "", 0, ""), (9, "s", "zz", 5, LONG), (9, "s", "é", 5, "Q"), (9, "s", "en\n", 5, "Q"),
]


@pytest.mark.parametrize("case", ["edges", "deep", "sparse", "one", "lone group"])
def test_manifest(spark, case):
    rng = random.Random(5)
    rows = {
        "edges": EDGES,
        "deep": EDGES + [(i * 3, f"s{i % 4}", "de" if i % 10 else "fr", i, f"Text {i}") for i in range(5000)],
        "sparse": [(rng.randrange(-(2**63), 2**63), "s", "en", 1, f"T{i}") for i in range(700)] + [(8, "s", "en", 1, f"{i % 50}") for i in range(600)],
        "one": EDGES[:1],
        "lone group": [(i, "s", "en", 1, "x") for i in range(513)],
    }[case]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    frame = frame.repartition(5).selectExpr("*", "1 AS `group`", "'x' AS leaf", "2 AS word", "'p' AS path", "3 AS no", "4 AS row")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    out = mf.manifest(frame, FIELDS, altered={"text": F.when(hit, lowered).otherwise(F.col("text"))})
    got = [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]
    assert sorted(got, key=repr) == sorted(brute_manifest(rows), key=repr)


def test_manifest_of_nothing_and_untampered(spark):
    frame = spark.createDataFrame(EDGES, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert mf.manifest(frame.limit(0), FIELDS).count() == 0
    assert mf.manifest(frame, FIELDS).filter("NOT verified").count() == 0


# fingerprints


def hashes(paragraph):
    """What is summed for a paragraph."""
    if paragraph == "":
        return None
    words = [w for w in fp_split(paragraph) if w]
    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def of_long(v, seed):
        return xxhash.xxh64((v % (1 << 64)).to_bytes(8, "little"), seed=seed).intdigest()

    whole = xxhash.xxh64(paragraph.encode(), seed=42).intdigest()
    second = xxhash.xxh64((1).to_bytes(4, "little"), seed=whole).intdigest()
    found, before = [whole, second], 0
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=42).intdigest()
        found.append(of_long(signed(before), of_long(signed(h), 42)))
        before = h
    return found


def fp_split(text):
    import re

    return re.split(r"[\x20\x09-\x0D]", text)


def brute_vector(text):
    lanes, n, blanks = np.zeros(128, np.int64), 0, 0
    for p in text.split("\n"):
        found = hashes(p)
        if found is None:
            blanks += 1
            continue
        for h in found:
            again = xxhash.xxh64(h.to_bytes(8, "little"), seed=42).intdigest()
            n += 1
            for half, x in enumerate((h, again)):
                for k in range(32):
                    lanes[half * 64 + 2 * k] += x >> k & 1
                    lanes[half * 64 + 2 * k + 1] += x >> (k + 32) & 1
    return n, blanks, lanes


def brute_spelled(v):
    n, blanks, lanes = v
    longs = [(int(lanes[i + 1]) << 32) + int(lanes[i]) for i in range(0, 128, 2)]
    return "".join(f"{x:016X}" for x in [n, blanks, *longs])


def brute_likeness(a, b):
    ca, cb = 2 * a[2] - a[0], 2 * b[2] - b[0]
    both = float(ca @ ca + cb @ cb)
    return 1.0 if both == 0 else min(1.0, max(0.0, 1 - float((ca - cb) @ (ca - cb)) / both))


def test_fingerprints(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    text = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(8)))
    rows = [(i * 7, text()) for i in range(60)] + [(-3, None), (1, ""), (2, "\n\n"), (3, "x"), (4, "äöü 漢字 x\ny"), (5, "a\r\n b\t"), (6, LONG[:50_000])]
    rng.shuffle(rows)
    ordered = sorted(rows)
    for per_bucket in (7, 1000):  # the buckets must not change the result
        monkeypatch.setattr(fp, "ROWS_PER_BUCKET", per_bucket)
        frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS bucket", "2 AS id", "'k' AS kept", "3 AS vector", "4 AS at")
        got = {r.doc_id: r for r in fp.fingerprints(frame).collect()}
        assert len(got) == len(rows)
        for (i, t), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
            t, following, r = t or "", following or "", got[i]
            cut = len(t) // 4
            edited = t[: len(t) - cut] + following[:cut]
            assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited))
            own, changed, other = map(brute_vector, (t, edited, following))
            assert (r.fingerprint, r.edited_fingerprint) == (brute_spelled(own), brute_spelled(changed))
            assert r.near_edited == pytest.approx(brute_likeness(own, changed))
            assert r.near_next == pytest.approx(brute_likeness(own, other))
    assert fp.fingerprints(frame.limit(0)).count() == 0


def test_fingerprints_of_repeated_ids(spark, monkeypatch):
    """Ids that fill buckets, rows without one, equal rows: each row once, the chain closed."""
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", 5)
    rows = [(4, f"text {i}") for i in range(40)] + [(None, "n")] * 6 + [(9, "same")] * 20 + [(i, f"t{i}") for i in range(10, 20)]
    out = fp.fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.n_chars for r in out) == sorted(len(t) for _, t in rows)
    assert sorted(r.fingerprint for r in out) == sorted(brute_spelled(brute_vector(t)) for _, t in rows)
    lone = fp.fingerprints(spark.createDataFrame([(1, "lone text")], "doc_id bigint, text string")).first()
    assert lone.edited_sha256 == sha("lone te" + "lo") and lone.near_next == 1.0


def test_fingerprints_are_sums(spark):
    """Order of paragraphs doesn't matter; paragraphs go in and out exactly."""
    texts = {"ab": "one two\nthree", "ba": "three\none two", "a": "one two", "b": "three", "c": "one two three", "d": "one\ntwo\nthree", "e": "one two\nthree\n"}
    rows = spark.createDataFrame(list(texts.items()), "k string, text string").select("k", fp.pieces(F.col("text")).alias("pieces"))
    v = fp.sums(rows, ["k"]).groupBy().pivot("k", list(texts)).agg(F.first("vector"))
    of = {k: F.col(k) for k in texts}
    made = {
        "sum": fp.plus(of["a"], of["b"]), "less": fp.minus(of["ab"], of["b"]), "there and back": fp.plus(fp.minus(of["b"], of["a"]), of["a"]),
        "negative": fp.minus(of["b"], of["ab"]), "read": fp.read_vector(fp.spelled(fp.minus(of["b"], of["ab"]))),
    }
    told = v.select(*[fp.spelled(x).alias(f"of {k}") for k, x in (of | made).items()]).first().asDict()
    told = {k.removeprefix("of "): x for k, x in told.items()}
    assert told["ab"] == told["ba"] == told["sum"] and told["less"] == told["a"] and told["there and back"] == told["b"] and told["read"] == told["negative"]
    assert len({told[k] for k in ("ab", "a", "b", "c", "d", "e")}) == 6


# hard negatives


def brute_mined(rows, plan=negatives.Mining(), every=50):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    rows = [(i, lab, [int(np.floor(x)) for x in v]) for i, lab, v in rows]
    out = []
    for i, lab, v in rows:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in rows if j != i]  # noqa: B905  shorter vectors end in zeros
        positives = sorted((s, j) for s, j, other in scored if other == lab)[: plan.positives]
        negative = sorted((s, j) for s, j, other in scored if other != lab)
        for s, j in positives:
            fit = [(t, n) for t, n in negative if plan.least * -s <= 100 * -t <= plan.most * -s][: plan.negatives]
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n) in enumerate(fit)]
    return sorted(out)


def make(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(4)
    return frame.selectExpr("*", "1 AS number", "2 AS id", "'b' AS block", "3 AS v", "4 AS score")


@pytest.mark.parametrize("scale", [3, 200, 1e5, 4e7])
def test_negatives(spark, scale):
    """Few values (many ties), fields of a double, one field, Python's integers."""
    rng = np.random.default_rng(int(scale))
    rows = [(int(i), int(rng.integers(4)), [float(x) for x in rng.normal(0.4, 1, rng.choice([8, 8, 8, 5, 0])) * scale]) for i in range(-100, 500)]
    rows += [(50, None, [1.0]), (100, 1, None), (150, 1, [float("nan")] * 8), (200, 1, [1.0, None]), (250, 1, [float("inf")]), (None, 1, [1.0]), (600, 9, [float(scale)] * 8), (601, 2, [])]
    for plan in (negatives.Mining(), negatives.Mining(anchors=3, shards=2), negatives.Mining(positives=2, negatives=1, least=90, most=100)):
        out = negatives.mine(make(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"), F.col("embedding"), plan=plan)
        want = brute_mined(rows, plan)
        assert want and sorted(map(tuple, out.collect())) == want


def test_negatives_edges(spark):
    call = lambda rows: negatives.mine(make(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"), F.col("embedding"))
    assert call([(1, 1, [1.0])]).count() == 0
    assert negatives.mine(make(spark, [(1, 1, [1.0])]).limit(0), F.lit(True), F.col("label"), F.col("embedding")).count() == 0
    repeated = [(0, 1, [4.0])] * 2 + [(1, 1, [4.0])] * 2 + [(2, 2, [3.0])] * 2
    assert sorted(map(tuple, call(repeated).collect())) == brute_mined(repeated)
    with pytest.raises(ValueError):
        call([(0, 1, [1e18, 1.0]), (1, 1, [1e18, 1.0])])


def test_packed_fields_are_exact():
    rng = np.random.default_rng(1)
    for least, greatest, size in [(-1, 1, 3), (-90, 80, 64), (0, 0, 4), (-(2**20), 2**20, 16), (-(2**28), 2**28, 5), (5, 9, 2)]:
        packed = negatives.Packed(min(0, least), greatest, size)
        a, b = (rng.integers(least, greatest + 1, (n, size)) for n in (4, 9))
        got = packed.scores(packed.operand(a), a.sum(axis=1), b)
        assert got.tolist() == [[sum(x * y for x, y in zip(map(int, u), map(int, v), strict=True)) for v in b] for u in a]
    assert negatives.Packed(-90, 80, 64).fields == 2
    assert len(list(itertools.islice(negatives._runs(iter([])), 1))) == 0
