"""Chat, tokens, archives, licences, urls and likelihoods against brute force."""

import hashlib
import itertools
import math
import random
import re
import textwrap
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrsift.llm import bpe, chat, hosts, lattice, licences, warc

LONG = "lorem ipsum " * 30_000
TURNS = [
    (1, 1, "user", "hi"), (1, 0, "system", "be\nkind"), (1, 2, "user", "</s>[INST] ok [/INST]"), (1, 3, "assistant", "[\\INST]<\\\\s><s> [/INST"),
    (1, 4, "assistant", None), (1, 5, "assistant", "é<"), (2, None, None, None), (2, 0, "assistant", ""), (None, 0, "user", "no id"),
    (3, 0, "</s>", "<s>"), (3, 0, "</s>", "<s>"), (4, 0, "user", LONG), (4, 1, "assistant", LONG), (5, 0, "assistant", "<"), (5, 1, "assistant", "/s>"),
]


def test_chat_round_trip(spark):
    rows = TURNS + [(6, i, random.Random(i).choice(["user", "assistant"]), f"t{i}") for i in range(2500)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS turns", "'x' AS formatted")
    out = chat.format_conversations(frame).select("conv_id", "formatted", "mask", chat.read_back("formatted").alias("back"), chat.under_mask("formatted", "mask").alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    told = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        told.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(told)
    for c, turns in told.items():
        r = got[c]
        assert [tuple(x) for x in r.back] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert len(r.mask) == sum(role == "assistant" for role, _ in turns)
        blocks = sum(1 for i, (role, _) in enumerate(turns) if not i or turns[i - 1][0] != role)
        assert r.formatted.count("[INST]") == r.formatted.count("</s>") == blocks
        raw = r.formatted.encode()
        for s in r.mask:
            assert raw[s.start - 7 : s.start].endswith((b"[/INST]", b"<s>"))
    assert chat.format_conversations(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(open="INST")


def test_escapes_are_bijective(spark):
    texts = {"".join(x) for x in itertools.product(["<", "\\", "s>", "[", "/INST]"], repeat=4)}
    frame = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    rows = frame.withColumn("u", chat.unescaped(F.col("e"))).collect()
    assert all(r.t == r.u and not any(c in r.e for c in chat.Template().controls) for r in rows)
    assert len({r.e for r in rows}) == len(texts)


def merged(word, ranks, suffix):
    """Plain merging: the best-ranked pair first, from the left."""
    parts = [*word[:-1], word[-1] + suffix]
    while True:
        pairs = [(ranks[p], i) for i, p in enumerate(itertools.pairwise(parts)) if p in ranks]
        if not pairs:
            return parts
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_automaton_equals_merging():
    rng = random.Random(29)
    for trial in range(30):
        alphabet, suffix = "abc", rng.choice(["", "$"])
        base = [*alphabet, *(c + "$" for c in alphabet if suffix)]
        vocab, merges = {s: i for i, s in enumerate(base)}, []
        while len(merges) < rng.randrange(1, 25):
            u, v = rng.choice(list(vocab)), rng.choice(list(vocab))
            if u.endswith("$") or u + v in vocab:
                continue
            merges.append((u, v))
            vocab[u + v] = len(vocab)
        automaton = bpe.Automaton(vocab, merges, suffix)
        ranks = {m: i for i, m in enumerate(merges)}
        for n in range(1, 8):
            for _ in range(60):
                word = "".join(rng.choice(alphabet) for _ in range(n))
                assert [automaton.labels[t] for t in automaton.walk(word)] == merged(word, ranks, suffix), (trial, merges, word)


def test_codec_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(31)
    texts = ["", None, " \n", LONG, "x" * 5000, "a<|endoftext|>B <|startoftext|> <|", "ΑΣ İ ﬁ e\u0301 é", "don't we'll 12,345!!!", "日本語 текст 🙂🙂", "\x1c\x85\u200b\u3000|"]
    texts += ["".join(rng.choice("aàbcdé'st !.19Zß") for _ in range(rng.randrange(40))) for _ in range(300)]
    frame = spark.createDataFrame([*enumerate(texts), (0, "")], "doc_id int, text string").selectExpr("*", "1 AS ids", "2 AS decoded")
    codec = bpe.Codec(spark, path)
    rows = codec.encoded(frame, decode=True).withColumn("again", codec.decoded("ids")).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want, texts[r.doc_id]
        assert r.decoded == r.again == library.decode(want, skip_special_tokens=False)
    assert codec.encoded(frame.limit(0)).count() == 0
    empty = spark.createDataFrame([(None,), ([],), ([3, 10**6],)], "ids array<int>").select(codec.decoded("ids").alias("t"))
    assert [r.t for r in empty.collect()] == ["", "", library.decode([3])]


def test_words_of_any_code_points_equal_the_library():
    """Code points of every Unicode version, those that later ones added above all."""
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    library, automaton = tokenizers.Tokenizer.from_file(path), bpe.load(path)
    every = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    marks = [c for c in every if unicodedata.combining(chr(c))]
    newer = [c for x in (bpe._NO_LETTERS, bpe._NO_NUMBERS, bpe._NO_MARKS) for a, b in bpe._ranges(x) for c in range(a, min(a + 30, b + 1))]
    pools = [every, every[:0x3000], marks, newer, list(bpe._LOWER), [32, 65, 97, 39, 115, 0xE9, 0x3A3, 0x301, 0x11935, 0x11930]]
    rng = random.Random(12)
    for _ in range(4000):
        few = rng.sample(pools, 2)
        text = "".join(chr(rng.choice(rng.choice(few))) for _ in range(rng.randrange(1, 20)))
        assert automaton.text(text) == library.encode(text, add_special_tokens=False).ids, [hex(ord(c)) for c in text]


PAGES = [
    (1, "http://a.b/x", "p" * 100), (3, "http://a.b/y?q#z", "p" * 100), (2, "http://a.b/z", "p" * 100), (4, None, "p" * 99), (5, "x", "p" * 99), (6, "http://c/", None),
    (7, "http://c", ""), (8, "http://d/\r\nX: y", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (9, "http://e/é", "é\r\n\r\n" + LONG), (1, "http://a.b/x", "p" * 100),
    (None, "http://n/", "p" * 100), (11, "u", "\r\n\r\nWARC/1.1\r\n"),
]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 AS digest", "'u' AS uri", "2 AS first")
    for compression in ("gzip", "none"):
        path = f"file://{tmp_path}/{compression}"
        warc.write_captures(warc.captures_of(pages).coalesce(2), path, compression=compression)
        records = warc.read_records(spark, path)
        assert records.count() == 3 * len(PAGES)
        rows = warc.assemble(records).collect()
        assert len(rows) == len(PAGES)
        by_uri = {r.uri: r for r in rows}
        seen = []
        for r in rows:
            assert len(r.requests) == len(r.metadata) == 1
            fields = dict(x.split(": ") for x in bytes(r.metadata[0].block).decode().split("\r\n"))
            i = int(fields["page_id"]) if "page_id" in fields else None
            head = by_uri[r.head.refers_to].head if r.head.type == "revisit" else r.head
            seen.append((i, r.head.type, bytes(head.payload).decode(), head.payload_digest, int(fields["length"])))
        want = []
        for i, _, html in PAGES:
            html = html or ""
            same = [j for j, _, h in PAGES if (h or "") == html and j is not None]
            kind = "revisit" if len(html) >= 100 and i != min(same) else "response"
            want.append((i, kind, html, hashlib.sha256(html.encode()).hexdigest(), len(html.encode())))
        assert sorted(seen, key=repr) == sorted(want, key=repr)
    nothing = f"file://{tmp_path}/nothing"
    warc.write_captures(warc.captures_of(pages.limit(0)), nothing)
    assert warc.assemble(warc.read_records(spark, nothing)).count() == 0


def test_warc_cut_file_is_an_error(spark, tmp_path):
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(whole + whole[:-7])
    with pytest.raises(Exception, match="ends before its Content-Length"):
        warc.read_records(spark, f"file://{tmp_path}/x.warc").count()


def test_assembly_of_chains_and_orphans(spark):
    empty = warc.read_records.__doc__ and [None] * 7
    rows = [
        ("r1", "response", None, *empty, "d"), ("q1", "request", "r1", *empty, "d"), ("m1", "metadata", "q1", *empty, "d"), ("m2", "metadata", "r1", *empty, "d"),
        ("m2", "metadata", "r1", *empty, "d"), ("q9", "request", "gone", *empty, "d"), ("w", "warcinfo", None, *empty, "d"), ("r2", "resource", None, *empty, "d"),
    ]
    got = {r.uri: r for r in warc.assemble(spark.createDataFrame([(*r[:10], r[10]) for r in rows], warc.RECORDS)).collect()}
    assert {u: (r.head is not None, [x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for u, r in got.items()} == {
        "r1": (True, ["q1"], ["m1", "m2"]), "gone": (False, ["q9"], []), "w": (False, [], ["w"]), "r2": (True, [], []),
    }


APACHE = '''/* Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.'''


def test_licence_sequences(spark):
    texts = {
        1: "Text about it.\nLicensed under the Apache License, Version 2.0.", 2: "no end\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", 3: None, 4: "",
        5: "This work is licensed under the GNU General Public License, version 3. " + LONG, 6: "a license that is not known. mit.",
        7: ". ".join(licences.SENTENCES[i] for i in ("MitGrant", "MitNotice", "MitAsIs")) + ".",
        8: ". ".join(licences.SENTENCES[i] for i in ("BsdGrant", "BsdSource", "BsdBinary", "BsdNames")),
        9: ". ".join([licences.SENTENCES["MitGrant"], "something else", licences.SENTENCES["MitNotice"], licences.SENTENCES["MitAsIs"]]),
        10: "All rights  reserved. ALL RIGHTS RESERVED!",
    }
    frame = spark.createDataFrame(list(texts.items()) + [(10, texts[10])], "doc_id bigint, text string").selectExpr("*", "1 AS ids", "2 AS told")
    got = {r.doc_id: (list(r.licences), r.n_unmatched) for r in licences.scan(frame).collect()}
    assert got == {
        1: (["Apache-2.0"], 0), 2: (["MIT", "CC-BY-NC-4.0"], 0), 3: ([], 0), 4: ([], 0), 5: (["GPL-3.0"], 0), 6: ([], 0), 7: (["MIT"], 0), 8: (["BSD-3-Clause"], 0),
        9: ([], 3), 10: (["All-Rights-Reserved"] * 2, 0),
    }
    assert licences.scan(frame).count() == 11 and licences.scan(frame.limit(0)).count() == 0


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GNU = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


MIT = """MIT License

Copyright (c) 2020 A Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.
"""
BSD = """Copyright (c) 2020, A Person

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS".
"""
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.
"""
AGPL = GNU.replace("GNU General", "GNU Affero General").replace("the Free Software Foundation, either", "the Free Software Foundation; either")
PRINTED = {
    "Apache-2.0": APACHE, "GPL-3.0-or-later": GNU, "GPL-2.0-or-later": GNU.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"),
    "ISC": ISC, "MPL-2.0": MPL, "MIT": MIT, "BSD-3-Clause": BSD, "BSD-2-Clause": "\n\n".join(p for p in BSD.split("\n\n") if not p.startswith("3.")),
    "LGPL-2.1-or-later": LGPL, "AGPL-3.0-or-later": AGPL, "Unlicense": "This is free and unencumbered software released into the public domain.\n",
    "Public-Domain": "This work is in the public domain.\n", "All-Rights-Reserved": "Copyright 2020 A Person\nAll rights reserved.\n",
}


def wrapped(text, width, margin):
    """Each paragraph wrapped anew, or on one line."""
    out = []
    for p in re.split(r"\n\s*\n", text.strip("\n")):
        lines = textwrap.wrap(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) if width else [" ".join(p.split())]
        out.append("\n".join(margin + x for x in lines))
    return f"\n{margin.rstrip()}\n".join(out) + "\n"


def test_licences_as_they_are_printed(spark):
    """Every licence of the rules, under any wrapping and margin."""
    assert set(PRINTED) == {x for x, _ in licences.TEXT_RULES} | {f"{x}-or-later" for x in licences.GNU_VERSIONS} - {"LGPL-3.0-or-later"}
    cases = [(x, w, m) for x in PRINTED for w in (0, *range(50, 91, 2)) for m in ("", "# ", " * ", "// ")]
    texts = [(i, "Some words before\n\n" + wrapped(PRINTED[x].replace("Person\nAll", "Person. All"), w, m)) for i, (x, w, m) in enumerate(cases)]
    texts += [(len(cases) + i, t) for i, t in enumerate(PRINTED.values())]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: list(r.licences) for r in licences.scan(frame).collect()}
    wrong = {(*cases[i], tuple(got[i])) for i in range(len(cases)) if got[i] != [cases[i][0]]}
    assert not wrong
    assert [got[len(cases) + i] for i in range(len(PRINTED))] == [[x] for x in PRINTED]


def test_licence_identifiers_and_notices(spark):
    texts = {
        1: "// SPDX-License-Identifier: Apache-2.0\n// Copyright X\nint main", 2: "/* SPDX-License-Identifier: GPL-2.0-or-later */", 3: "# SPDX-License-Identifier: (MIT OR X11)\n",
        4: "A library that is\nreleased under the MIT License. It is\ndistributed under the License of X.", 5: "no end\nThis work is licensed under the GNU General Public License, version 3.\nmore",
        6: "SPDX-License-Identifier: LGPL-3.0-only\r\nnext", 7: "of the software\nlicensed work under warranty\nAll rights reserved",
    }
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: list(r.licences) for r in licences.scan(frame).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["GPL-2.0-or-later"], 3: ["MIT"], 4: ["MIT"], 5: ["GPL-3.0"], 6: ["LGPL-3.0"], 7: ["All-Rights-Reserved"]}


def test_known_sentences_are_normal_and_anchored(spark):
    known = list(licences.sentence_ids())
    assert all(re.search("|".join(licences.ANCHORS), s) for s in known)
    frame = spark.createDataFrame([(s,) for s in known], "s string")
    assert frame.filter(licences.normalised(F.col("s")) != F.col("s")).count() == 0
    ids = set(licences.sentence_ids().values())
    assert {i for _, wanted in licences.rules() for i in wanted} == ids
    # a line that starts a sentence never stands inside a known one
    assert not [s for s in known for m in re.finditer(licences.STARTS, s) if m.start() > 0]


def test_urls(spark):
    urls = {
        1: "http://X.Example.ORG/es/1?a", 2: "https://example.org", 3: None, 4: "no scheme", 5: "a://b.com/fr/", 6: "http://org/x", 7: "http://notexample.org/es/1", 8: "http://b.com/de/1",
        9: "http://example.org/en/1x#y", 10: "http://c.net/?x://y", 11: "://h/é\n/p",
    }
    frame = spark.createDataFrame([*urls.items(), (1, urls[1])], "page_id bigint, url string").selectExpr("*", "1 AS host", "2 AS n", "3 AS rules")
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    none = spark.createDataFrame([], "page_id bigint, good int")
    rows = hosts.judge_urls(frame, none, listed).collect()
    assert len(rows) == 12
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[1] == ("x.example.org", "/es/1", "example.org/es/", "block") and got[2] == ("example.org", "", None, "allow")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("com/fr/", "allow") and got[6] == ("org", "/x", "org/", "allow")
    assert got[7][2:] == ("org/", "allow") and got[8][2:] == ("com/de/", "block") and got[9][2:] == ("example.org/en/1", "block")
    assert got[10][:2] == ("c.net", "/") and got[11][:2] == ("h", "/é\n/p")
    assert hosts.judge_urls(frame.limit(0), none, listed).count() == 0
    # a host with many bad pages is blocked, one with a single bad page isn't; an unseen one has its domain's rate
    pages = [(i, f"http://{'bad' if i < 200 else 'good'}.site{i % 3 if i >= 200 else 0}.net/{i}") for i in range(400)]
    pages += [(900, "http://once.other.net/"), (901, "http://new.site1.net/"), (None, "http://good.site1.net/")]
    votes = [(i, int(i >= 200)) for i in range(400)] + [(900, 0), (7, None), (None, 0)]
    judged = {r.page_id: r for r in hosts.judge_urls(
        spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(votes, "page_id bigint, good int"), listed.limit(0)
    ).collect()}
    assert judged[5].verdict == "block" and judged[300].verdict == "allow" and judged[900].verdict == "allow"
    assert judged[901].rate > 0.6 > judged[900].rate > judged[5].rate


def brute_lattice(word, pieces, logp):
    text = "▁" + word
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        p = 1.0
        for b, e in itertools.pairwise(at):
            i = pieces.index.get(text[b:e])
            if i is not None:
                p *= math.exp(logp[i])
            elif e == b + 1:
                p *= math.exp(sum(logp[k] for k in pieces.spelt(ord(text[b]))))
            else:
                p = 0.0
        total += p
    return math.log(total) + logp[pieces.end]


def small_pieces():
    strings = ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "abc", "bc"] + [f"<{b}>" for b in range(256)]
    return lattice.Pieces(strings, np.log(np.arange(1.0, len(strings) + 1)), list(range(9, 265)))


def test_forward_sums_all_segmentations():
    pieces = small_pieces()
    words = ["a", "ab", "abcab", "bababc", "cé", "日", "aab▁"]
    logp = pieces.scores
    got = lattice.spell([w.encode() for w in words], pieces, logp)
    assert got[:-1] == pytest.approx([brute_lattice(w, pieces, logp) for w in words[:-1]])
    for w in words:
        points = lattice.points_of(w.encode())
        assert lattice.forward_long(points, pieces, logp) == pytest.approx(lattice.forward(np.array([points]), pieces, logp)[0])
    assert np.isfinite(lattice.spell([b"x" * 100_000], pieces, logp)).all()


def test_scores(spark):
    rng = random.Random(37)
    rows = [(i, " ".join(rng.choice(["ab", "abc", "Ba", "a,", "é", "new" + str(i)]) for _ in range(rng.randrange(30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (201, ""), (None, "ab abc"), (202, "ab " * 50_000), (203, "x" * 70_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS block", "2 AS words", "3 AS held_out")
    pieces = small_pieces()
    out = lattice.score_texts(frame, pieces, lattice.is_held_out("doc_id"), plan=lattice.Learning(block_bytes=2000)).collect()
    assert len(out) == len(rows)
    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 5 == 1

    counts, ends = {}, 0
    for i, t in rows:
        if not held(i):
            ends += 1
            for w in (t or "").encode().lower().split():
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = min(max(once / (once + 2 * twice), 0.05), 0.95)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        words = (t or "").encode().lower().split()
        r = got[i][0]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(words) + 1, sum(w in counts for w in words) + 1, n)
        assert r.base_score == pytest.approx(base)
        if len(words) < 1000 and all(len(w) < 100 for w in words):
            # the word's own arc, and all segmentations for what the discount leaves
            own = [(max(counts.get(w, 0) - discount, 0) / n, math.exp(brute_lattice(w.decode(), pieces, pieces.scores))) for w in words]
            score = sum(math.log10(seen + discount * (v - 1) / n * spelt) for seen, spelt in own) + math.log10(ends / n)
            assert r.score == pytest.approx(score, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert lattice.score_texts(frame.limit(0), pieces, lattice.is_held_out("doc_id")).count() == 0
    untrained = lattice.score_texts(frame.limit(5), pieces, F.lit(True)).collect()
    assert len(untrained) == 5 and all(math.isfinite(r.score) and r.n_known == 0 and r.train_tokens == 0 for r in untrained)


def test_blocks_are_staged_as_small_rows(spark, monkeypatch):
    # one block of 400 texts and 8,000 words: a row for each, none that grows with the block
    kept, stage = {}, lattice.staged
    monkeypatch.setattr(lattice, "staged", lambda df, name: kept.setdefault(name, stage(df, name)))
    frame = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(400)], "doc_id bigint, text string")
    out = lattice.score_texts(frame.coalesce(1), small_pieces(), lattice.is_held_out("doc_id"))
    assert {r.doc_id: r.n_tokens for r in out.collect()} == dict.fromkeys(range(400), 21)
    blocks = kept["lattice-blocks"]
    assert blocks.select(F.max(F.length(F.to_json(F.struct("*"))))).first()[0] < 1000
    assert blocks.count() == 400 + 8000 and blocks.select("block").distinct().count() == 1


def test_packed_places_are_read_back():
    rng = np.random.default_rng(5)
    for most in (1, 2, 128, 20_000, 2**31 - 1):
        for sizes in ([], [0], [0, 0], [3, 0, 1, 400, 0], [1] * 50):
            flat = np.concatenate([np.zeros(0, np.int32), *(np.sort(rng.integers(0, most, n)).astype(np.int32) for n in sizes)])
            sizes = np.array(sizes, np.int64)
            values = lattice._packed(lattice._steps(flat, sizes), sizes).to_pylist()
            read = lattice._numbers(np.frombuffer(b"".join(values), np.uint8))
            assert len(values) == len(sizes) and (lattice._unstepped(read, sizes) == flat).all()
            assert all(len(lattice._numbers(np.frombuffer(v, np.uint8))) == n for v, n in zip(values, sizes, strict=True))
    edge = np.array([0, 127, 128, 16_383, 16_384, 2**31 - 1])
    assert lattice._numbers(lattice._varints(edge)[0]).tolist() == edge.tolist()


def test_word_probabilities_sum_to_less_than_one():
    pieces = small_pieces()
    totals = lattice.Totals(tokens=20, kinds=4, ends=5, discount=0.6)
    counts = {b"ab": 9, b"b": 5, b"abc": 1}
    words = ["".join(w).encode() for n in range(1, 8) for w in itertools.product("abc", repeat=n)]
    spelt = lattice.spell(words, pieces, pieces.scores)
    seen = np.array([counts.get(w, 0) for w in words])
    p = 10.0 ** totals.score(seen, spelt)
    assert 0.6 < p.sum() < 1 - totals.end + 1e-9
