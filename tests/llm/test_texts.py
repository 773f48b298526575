"""Exact copies, quality rules, packing, near copies against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from addrsift.llm import exact, minhash, packing, quality
from addrsift.llm.components import components

LONG = "lorem ipsum dolor " * 40_000

#: null, empty, blank, ties, repeated rows, a null id, a very long text.
ROWS = [
    (1, "a b  c"), (2, "a b c"), (2, "a b c"), (3, " a b c"), (4, None), (5, ""), (None, "a\tb\nc"), (None, None), (7, "x"), (8, "X"), (9, LONG), (10, LONG + "\n"),
    (6, "a b"), (6, "a b c"),
]


@pytest.fixture
def docs(spark):
    """Documents with columns whose names the operators use themselves."""
    def make(rows):
        frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, digest int, keep_id string")
        return frame.withColumnsRenamed({}).selectExpr("*", "1 AS row", "2 AS kept", "3 AS stats", "'f' AS fp", "0 AS _row")

    return make


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(docs):
    groups = {}
    for i, t in ROWS:
        groups.setdefault(normal(t), []).append(i)
    for counters in (1, 2, 1000):  # what is frequent must not change the result
        rows = exact.exact_groups(docs(ROWS), counters=counters).collect()
        assert len(rows) == len(ROWS)
        kept = {}
        for r in rows:
            members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            ids = [i for i in members if i is not None]
            assert (r.keep_id, r.group_size) == (min(ids) if ids else None, len(members))
            kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
            assert not r.kept or r.doc_id == r.keep_id
        assert set(kept.values()) == {1} and len(kept) == len(groups)
        stays = exact.drop_copies(docs(ROWS), counters=counters)
        assert stays.columns == docs(ROWS).columns
        assert sorted(normal(r.text) for r in stays.collect()) == sorted(groups)
    assert exact.exact_groups(docs([])).count() == 0
    assert exact.drop_copies(docs([])).count() == 0


def test_misra_gries_names_all_frequent():
    rng = random.Random(3)
    for k in (1, 3, 10):
        stream = [rng.choice("abcdefgh") if rng.random() < 0.5 else rng.randrange(10_000) for _ in range(5000)]
        parts = [stream[i::7] for i in range(7)]
        summed = {}
        for part in parts:
            counts = {}
            for x in part:
                counts[x] = counts.get(x, 0) + 1
                counts = exact.shrink(counts, k)
            for x, n in counts.items():
                summed[x] = summed.get(x, 0) + n
        found = exact.shrink(summed, k)
        assert len(found) <= k
        assert {x for x in set(stream) if stream.count(x) > len(stream) / (k + 1)} <= set(found)


def brute_repeats(words, w=8):
    windows = [tuple(words[i : i + w]) for i in range(len(words) - w + 1)]
    covered = set()
    for i, x in enumerate(windows):
        if windows.count(x) > 1:
            covered.update(range(i, i + w))
    return len(covered)


def test_text_stats_match_brute_force():
    rng = random.Random(5)
    texts = ["", " \n\t", "a", "é# |x|\n\na b\na b\n a b\n", "w " * 30, LONG]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["a b", "é ü", "", " ", "$ <b>"]) for _ in range(20)) for _ in range(20)]
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = dict(zip(quality.COUNTS, quality.text_stats(t.encode()), strict=True))
        assert got["n_words"] == len(words)
        assert got["word_chars"] == sum(map(len, words))
        assert got["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert got["n_dup_lines"] == len(lines) - len(set(lines))
        if len(words) < 1000:
            assert got["n_repeat_words"] == brute_repeats(words)
    assert quality.text_stats(LONG.encode())[4] == 120_000


def test_decision_list(spark, docs):
    rng = random.Random(7)
    good = [(i, " ".join("word" + rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(40))) for i in range(400)]
    bad = [(i, " ".join("w###" + rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(40))) for i in range(1000, 1400)]
    labels = spark.createDataFrame(
        [(i, int(i < 1000), 0) for i, _ in good + bad] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int"
    )
    rules = quality.fit(docs(good + bad), labels)
    assert rules and all(r.precision >= 0.95 for r in rules)
    judged = {r._row.doc_id: r.kept for r in quality.judge(docs(good + bad), rules).collect()}
    assert sum(judged[i] for i, _ in good) > 390 and sum(judged[i] for i, _ in bad) < 10
    # nulls, empties, long repeats fail the base rules; rows stay whole
    odd = quality.judge(docs(ROWS), rules)
    assert [r for r in odd.collect() if r.kept] == [] and odd.count() == len(ROWS)
    assert quality.keep_good(docs(good), rules).columns == docs(good).columns
    # no labels, no documents: no rules, and the base rules alone decide
    assert quality.fit(docs([]), labels) == []
    assert quality.fit(docs(good), labels.filter("false")) == []
    assert quality.judge(docs([]), []).count() == 0
    assert quality.keep_good(docs(good + bad), []).count() == 800


def test_rules_are_tried_in_order():
    x = {"a": np.arange(300.0), "b": np.tile([0.0, 1.0], 150)}
    bad = (x["a"] < 60) | ((x["a"] > 200) & (x["b"] > 0))
    rules = quality.learn(x, bad)
    hit = np.zeros(300, bool)
    for r in rules:
        hit |= quality._holds(x, r.conditions, 300)
    assert len(rules) == 2 and (hit == bad).mean() > 0.97


def cost(lengths, edges):
    return sum(min(e for e in edges if e >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(11)
    for _ in range(60):
        lengths = [rng.randrange(12) for _ in range(rng.randrange(1, 25))]
        k = rng.randrange(1, 5)
        kinds = sorted(set(lengths))
        edges = packing.best_boundaries(kinds, [lengths.count(x) for x in kinds], k)
        assert len(edges) <= k and edges == sorted(edges) and edges[-1] == kinds[-1]
        least = min(cost(lengths, (*c, kinds[-1])) for n in range(k) for c in itertools.combinations(kinds, n))
        assert cost(lengths, edges) == least
    assert packing.best_boundaries([], [], 3) == []


def test_pack_keeps_every_token(docs):
    plan = packing.Packing(max_tokens=50, buckets=4, token_budget=120, shard_rows=7)
    rng = random.Random(13)
    rows = ROWS + [(100 + i, "w " * rng.randrange(130)) for i in range(200)] + [(300, "w w")] * 40
    out = packing.pack(docs(rows), plan=plan).collect()
    assert sum(r.n_tokens for r in out) == sum(len((t or "").split(" ")) - (t or "").split(" ").count("") if "\t" not in (t or "") and "\n" not in (t or "") else len((t or "").split()) for _, t in rows)
    batches = {}
    for r in out:
        assert r.n_tokens <= r.bucket_tokens <= 50
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for (bucket, batch), members in batches.items():
        room = max(1, 120 // max(1, members[0].bucket_tokens))
        assert sorted(m.slot for m in members) == list(range(len(members))) and len(members) <= room
        assert len(members) == room or (bucket, batch + 1) not in batches  # only the last may be short
    for b in {b for b, _ in batches}:
        assert {x for c, x in batches if c == b} == set(range(sum(c == b for c, _ in batches)))
    assert packing.pack(docs([])).count() == 0
    counted = packing.pack(docs(rows[:5]).selectExpr("doc_id", "text", "CAST(NULL AS INT) AS n"), length=__import__("pyspark").sql.functions.col("n"))
    assert [r.n_tokens for r in counted.collect()] == [0] * 5


def jp_brute(a, b):
    total = 0.0
    for i in a:
        if i in b:
            total += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b))
    return total


def test_similarity_and_registers():
    rng = np.random.default_rng(17)
    for _ in range(30):
        a = dict(zip(rng.integers(0, 40, 25).tolist(), rng.integers(1, 5, 25).tolist(), strict=True))
        b = dict(zip(rng.integers(0, 40, 25).tolist(), rng.integers(1, 5, 25).tolist(), strict=True))
        arrays = [(np.array(sorted(x), np.uint64), np.array([x[k] for k in sorted(x)])) for x in (a, b)]
        assert minhash.similarity(*arrays) == pytest.approx(jp_brute(a, b))
    # registers agree as often as the similarity says
    x = (np.arange(1, 101, dtype=np.uint64), np.arange(1, 101).astype(float))
    y = (np.arange(21, 121, dtype=np.uint64), np.arange(121, 21, -1).astype(float))
    k = 4000
    held = minhash.registers(
        minhash.mixed(np.concatenate([x[0], y[0]])), np.concatenate([x[1], y[1]]), np.repeat([0, 1], 100), 2, k
    )
    assert (held[0] == held[1]).mean() == pytest.approx(minhash.similarity(x, y), abs=0.03)
    one = minhash.registers(np.array([5], np.uint64), np.array([1.0]), np.array([0]), 1, 64)
    assert (one == 5).all()
    assert minhash.similarity((x[0][:0], x[1][:0]), (x[0][:0], x[1][:0])) == 1.0


def test_near_groups_match_brute_force(docs):
    rng = random.Random(19)
    base = [[f"w{rng.randrange(5000)}" for _ in range(120)] for _ in range(25)]
    rows = list(ROWS)
    for g, words in enumerate(base):
        for c in range(rng.randrange(1, 9)):
            copy = list(words)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(5000)}"
            rows.append((1000 + 20 * g + c, " ".join(copy)))
    shared = " ".join(f"p{i}" for i in range(60))  # a passage that isn't enough
    rows += [(5000 + i, shared + " " + " ".join(f"q{rng.randrange(9000)}" for _ in range(60))) for i in range(40)]
    sets = [minhash.shingles((t or "").lower().encode(), 5) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if minhash.similarity(sets[i], sets[j]) >= 0.8:
            parent[root(j)] = root(i)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(root(i), []).append(rows[i][0])
    want = sorted((i, min((x for x in m if x is not None), default=None), len(m)) for m in classes.values() for i in m if i is not None)
    got = minhash.near_groups(docs(rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(classes)
    stays = minhash.drop_near_copies(docs(rows))
    assert stays.columns == docs(rows).columns and stays.count() == len(classes)


def test_near_groups_of_nothing(docs):
    assert minhash.near_groups(docs([])).count() == 0
    assert minhash.drop_near_copies(docs([])).count() == 0


def test_components(spark):
    rng = random.Random(23)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def crowd(rng, n, passage, own, pairs, same):
    """n texts with a common passage and own words, then copies of the first
    ``pairs`` that keep ``same`` of their own words."""
    common = [f"p{i}" for i in range(passage)]
    words = [[f"q{rng.randrange(10**9)}" for _ in range(own)] for _ in range(n)]
    words += [w[:same] + [f"z{rng.randrange(10**9)}" for _ in range(own - same)] for w in words[:pairs]]
    return [(i, " ".join(common + w)) for i, w in enumerate(words)]


def plain_classes(rows, least):
    """Sizes of the classes of plain Jaccard similarity of five-word shingles."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    under = {i: i for i, _ in rows}
    for i, j in itertools.combinations(range(len(sets)), 2):
        common = len(sets[i] & sets[j])
        if common >= least * (len(sets[i]) + len(sets[j]) - common):
            a, b = under[i], under[j]
            under = {x: min(a, b) if y in (a, b) else y for x, y in under.items()}
    return under


def test_few_pairs_in_a_crowd_are_found(docs):
    rows = crowd(random.Random(29), 500, 250, 36, 4, 15)  # 0.77 to each other, the pairs 0.86
    want = plain_classes(rows, 0.8)
    assert sum(i != c for i, c in want.items()) == 4
    for plan in (minhash.Near(), minhash.Near(block=40)):
        assert {r.doc_id: r.class_id for r in minhash.near_groups(docs(rows), plan=plan).collect()} == want


def test_upper_bounds():
    rng = np.random.default_rng(31)
    sets = [
        (np.unique(rng.integers(0, 60, n)).astype(np.uint64), np.ones(0)) for n in rng.integers(5, 60, 40)
    ]
    for most in (2, 5):  # weights below it
        weighed = [(h, rng.integers(1, most, len(h))) for h, _ in sets]
        bounds = minhash.upper_bounds(weighed[:15], weighed[15:])
        exact = np.array([[minhash.similarity(x, y) for y in weighed[15:]] for x in weighed[:15]])
        assert (bounds >= exact - 1e-9).all() and bounds.shape == exact.shape
        assert most > 2 or np.allclose(bounds, exact)
