"""The pipeline over the smallest tables, each stage against brute force."""

import itertools
import os
import re

import pytest

import corpus_pipeline
from addrsift.llm import minhash, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    rules = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))

    def good(text):
        c = dict(zip(quality.COUNTS, quality.text_stats(text.encode()), strict=True))
        if c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]:
            return False

        def ratio(a, b):
            return c[a] / c[b] if c[b] else 0.0

        x = {
            "n_words": c["n_words"], "word_length": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"),
            "dup_lines": ratio("n_dup_lines", "n_lines"), "repeat_words": ratio("n_repeat_words", "n_words"), "upper": ratio("n_upper", "word_chars"),
            "digits": ratio("n_digits", "word_chars"), "marks_per_word": ratio("n_marks", "n_words"), "exclaims_per_word": ratio("n_exclaims", "n_words"),
            "stutters": ratio("n_stutters", "n_words"), "distinct": ratio("n_distinct", "n_words"), "words_per_line": ratio("n_words", "n_lines"),
        }
        return not any(all((x[k.feature] >= k.threshold) == k.above for k in r.conditions) for r in rules)

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "near dedup", "packing"]
    kept = corpus_pipeline.quality(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = {i: t for i, t in rows.items() if good(t)}
    assert {r.doc_id for r in kept.collect()} == set(rows)

    kept = corpus_pipeline.exact(spark, kept, SF)
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]), i)
    assert {r.doc_id for r in kept.collect()} == set(first.values()) and kept.columns == docs.columns
    rows = {i: rows[i] for i in first.values()}

    kept = corpus_pipeline.near(spark, kept, SF)
    sets = {i: minhash.shingles(t.lower().encode(), 5) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(sorted(rows), 2):
        if minhash.similarity(sets[i], sets[j]) >= 0.8:
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)
    left = {i for i in rows if root(i) == i}
    assert {r.doc_id for r in kept.collect()} == left and kept.columns == docs.columns

    packed = corpus_pipeline.packing(spark, kept, SF).collect()
    words = {i: len(rows[i].encode().split()) for i in left}
    assert {i: sum(r.n_tokens for r in packed if r.doc_id == i) for i in left} == words
    assert {r.doc_id for r in packed} == left
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed))
