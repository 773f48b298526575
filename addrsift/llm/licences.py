"""Licences of a text, from known sentences and rules over their order.

A text is cut into sentences, however its lines are wrapped; they are normalised
and looked up among known licence sentences.  The identifiers found, with a gap mark between those that
aren't neighbours, form a sequence; the ordered rules replace what they match
in it by a licence, longer rules first.  Everything is Spark expressions.
"""

from __future__ import annotations

from functools import cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# Names of licences as notices spell them, after normalisation.
NAMES = {
    "AGPL-3.0": ["gnu affero general public license version 3", "affero general public license version 3", "agpl 3.0", "agplv3"],
    "Apache-1.1": ["apache license version 1.1", "apache software license version 1.1"],
    "Apache-2.0": ["apache license version 2.0", "apache 2.0 license", "apache license 2.0", "apache-2.0 license"],
    "Artistic-2.0": ["artistic license 2.0", "artistic license version 2.0"],
    "BSD-2-Clause": ["bsd 2-clause license", "2-clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3-clause license", "3-clause bsd license", "new bsd license", "modified bsd license"],
    "BSL-1.0": ["boost software license version 1.0"],
    "CC0-1.0": ["cc0 1.0", "cc0 1.0 universal", "creative commons cc0 1.0 universal license"],
    "EPL-1.0": ["eclipse public license version 1.0", "eclipse public license 1.0"],
    "EPL-2.0": ["eclipse public license version 2.0", "eclipse public license 2.0"],
    "GFDL-1.3": ["gnu free documentation license version 1.3"],
    "GPL-2.0": ["gnu general public license version 2", "gpl version 2", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gpl version 3", "gplv3"],
    "ISC": ["isc license"],
    "LGPL-2.1": ["gnu lesser general public license version 2.1", "lgpl version 2.1", "lgplv2.1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl version 3", "lgplv3"],
    "MIT": ["mit license", "mit", "expat license"],
    "MPL-2.0": ["mozilla public license version 2.0", "mpl 2.0"],
    "Unlicense": ["unlicense"],
    "WTFPL": ["wtfpl"],
    "Zlib": ["zlib license"],
}
CC_KINDS = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

# Sentences of licence texts and headers, after normalisation.
SENTENCES = {
    "ApacheComply": "you may not use this file except in compliance with the license",
    "ApacheCopy": "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
    "ApacheAsIs": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheSee": "see the license for the specific language governing permissions and limitations under the license",
    "MitGrant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MitNotice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "IscGrant": "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "BsdGrant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BsdNames": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "MplForm": "this source code form is subject to the terms of the mozilla public license version 2.0",
    "ApacheCopyAt": "you may obtain a copy of the license at",
    "ApacheUrl": "http://www.apache.org/licenses/license-2.0",
    "GnuFree": "this program is free software",
    "GnuFreeLibrary": "this library is free software",
    "Reserved": "all rights reserved",
    "PublicDomain": "this work is in the public domain",
    "Unencumbered": "this is free and unencumbered software released into the public domain",
}

# Sentences of the GNU headers, after normalisation, and what they name.
GNU_FREE = "this {thing} is free software {terms}"
GNU_TERMS = (
    "you can redistribute it and/or modify it under the terms of the gnu {kind} public license as published by the free software foundation "
    "either version {version} of the license or at your option any later version"
)
GNU_OTHERS = {
    "GnuHope": "this {thing} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GnuSee": "see the gnu {kind} public license for more details",
    "GnuCopy": "you should have received a copy of the gnu {kind} public license along with this {thing}",
}
GNU_KINDS = {"GPL": "general", "LGPL": "lesser general", "AGPL": "affero general"}
GNU_THINGS = ["program", "library"]
GNU_VERSIONS = {"GPL-2.0": "2", "GPL-3.0": "3", "LGPL-2.1": "2.1", "LGPL-3.0": "3", "AGPL-3.0": "3"}

# Licences by the order of their sentences.
TEXT_RULES = [
    ("Apache-2.0", ["Under:Apache-2.0", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["Under:Apache-2.0", "ApacheComply", "ApacheCopy"]),
    ("Apache-2.0", ["Under:Apache-2.0", "ApacheComply", "ApacheCopyAt", "ApacheUrl", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["Under:Apache-2.0", "ApacheComply", "ApacheCopyAt", "ApacheUrl"]),
    ("Apache-2.0", ["ApacheHead", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheHead", "ApacheCopy"]),
    ("Apache-2.0", ["ApacheHead", "ApacheCopyAt", "ApacheUrl", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheHead", "ApacheCopyAt", "ApacheUrl"]),
    ("Apache-2.0", ["ApacheHead"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("ISC", ["IscGrant"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNames"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("MPL-2.0", ["MplForm"]),
    ("Unlicense", ["Unencumbered"]),
    ("Public-Domain", ["PublicDomain"]),
    ("All-Rights-Reserved", ["Reserved"]),
]

#: Every known sentence contains one of these, so other texts need no cutting.
ANCHORS = ["licen[cs]", "permi", "copyright", "redistribut", "warrant", "rights", "domain", "under", "apache", "agreed to in writing", "free software"]
_THINGS = "(work|file|software|project|program|code|document|text)"
_VERBS = "(licensed|released|distributed|published|available)"
_NAMED = "|".join(sorted({names[0].split()[0] for names in NAMES.values()} | {n.split()[0] for names in NAMES.values() for n in names} | {"cc", "creative"}))
#: What starts a sentence where a line starts, though the line before may have no end.
#: No known sentence has any of these further inside.
STARTS = (
    rf"(this {_THINGS} is |it is |made available )*{_VERBS} under (the terms of )?(the |an |a )?({_NAMED})\b|all rights reserved|permission is hereby granted"
    "|permission to use, copy|redistribution and use in|this (program|library) is free software|this source code form is|this is free and unencumbered"
    "|this work is in the public domain|spdx-license-identifier"
)
_MARGIN = r"[ \t#*/;%-]*"
#: Cutting of lower-cased text, pattern and replacement, in this order: blank lines, lines that
#: start a sentence, list numbers, identifiers alone on their line, colons at line ends; then
#: lines are joined, and what is left is cut at list numbers and ends of sentences.
BREAKS = [
    (rf"\n({_MARGIN}\r?\n)+", "\x01"), (rf"\n{_MARGIN}({STARTS})", "\x01\\1"), (rf"\n{_MARGIN}\(?[0-9]{{1,2}}[.)][ \t]+", "\x01"),
    (r"spdx-license-identifier:[ \t]*([^ \t\r\n]+)[^\n]*", "\x01spdx-license-identifier \\1\x01"), (r":[ \t\r]*\n", "\x01"),
    (r"[\s]*\n[ \t]*([#*;%]+|/[/*]+|--+)?[ \t]*", " "), (r"\bv\.[ \t]*([0-9])", "version \\1"),
    (r"([.;:])[ \t]+(and[ \t]+)?\(?[0-9]{1,2}[.)][ \t]+", "\\1\x01"), (r"([.!?])[\s\x01]+", "\\1\x01"),
]
#: Normalisation of a sentence, in lower case.
STEPS = [
    (r"[\"'`,()\[\]“”‘’*#%]", " "), (r"licence", "license"), (r"[;:](\s|$)", " "), (r"\s+", " "), (r"^[ /;-]+|[ .!?;:/-]+$", ""),
    (r"^(this (work|file|software|project|program|code|document|text) is |it is |(made )?available )*(licensed|released|distributed|published|available) under (the terms of )?(the |an |a )?", "under "),
]


@cache
def sentence_ids() -> dict[str, str]:
    """Normalised sentence to identifier; notices are built from the names, GNU
    headers from their parts, identifiers from all licences."""
    found = {s: i for i, s in SENTENCES.items()}
    kinds = [(kind, version) for kind in CC_KINDS for version in CC_VERSIONS]
    for licence, names in NAMES.items():
        found |= {f"under {name}{short}": f"Under:{licence}" for name in names for short in ("", " the license")}
    for kind, version in kinds:
        for name in (f"cc {kind} {version}", f"cc {kind} {version} license", f"creative commons {kind} {version} license"):
            found[f"under {name}"] = f"Under:CC-{kind.upper()}-{version}"
    for name in NAMES["Apache-2.0"]:  # a semicolon, so one sentence
        found |= {f"under {name}{short} {SENTENCES['ApacheComply']}": "ApacheHead" for short in ("", " the license")}
    for licence, version in GNU_VERSIONS.items():
        terms = GNU_TERMS.format(kind=GNU_KINDS[licence.split("-")[0]], version=version)
        found |= {terms: f"GnuTerms:{licence}"} | {GNU_FREE.format(thing=t, terms=terms): f"GnuFree:{licence}" for t in GNU_THINGS}
    for i, sentence in GNU_OTHERS.items():
        found |= {sentence.format(kind=kind, thing=thing): i for kind, thing in product(GNU_KINDS.values(), GNU_THINGS)}
    spelt = {x: x for x in [*NAMES, *(f"CC-{k.upper()}-{v}" for k, v in kinds)]}
    spelt |= {f"{x}-only": x for x in GNU_VERSIONS} | {f"{x}-or-later": f"{x}-or-later" for x in GNU_VERSIONS} | {f"{x}+": f"{x}-or-later" for x in GNU_VERSIONS}
    return found | {f"spdx-license-identifier {name.lower()}": f"Spdx:{licence}" for name, licence in spelt.items()}


@cache
def rules() -> list[tuple[str, list[str]]]:
    """(licence, sentence identifiers in order), longer ones first."""
    gnu = [
        (f"{licence}-or-later", [*head, *tail])
        for licence in GNU_VERSIONS
        for head in ([f"GnuFree:{licence}"], ["GnuFree", f"GnuTerms:{licence}"], ["GnuFreeLibrary", f"GnuTerms:{licence}"])
        for tail in (["GnuHope", "GnuSee", "GnuCopy"], ["GnuHope", "GnuSee"], ["GnuHope"], [])
    ]
    single = sorted({i for i in sentence_ids().values() if i.startswith(("Under:", "Spdx:"))})
    return sorted([*TEXT_RULES, *gnu, *((i.split(":")[1], [i]) for i in single)], key=lambda r: -len(r[1]))


def sentences(text: str | Column) -> Column:
    """Sentences of a text, lower-cased, those without a letter left out."""
    of = F.lower(text_of(text))
    for pattern, by in BREAKS:
        of = F.regexp_replace(of, pattern, by.replace("\\1", "$1"))
    return F.filter(F.split(of, "\x01"), lambda x: x.rlike("[a-z]"))


def normalised(sentence: Column) -> Column:
    for pattern, by in STEPS:
        sentence = F.regexp_replace(sentence, pattern, by)
    return sentence


def identified(found: Column) -> Column:
    """The identifiers of sentences, in order; "" for unknown ones."""
    known = F.create_map(*[F.lit(x) for pair in sentence_ids().items() for x in pair])
    return F.transform(
        found, lambda x: F.when(x.rlike("|".join(ANCHORS)), F.coalesce(F.element_at(known, normalised(x)), F.lit(""))).otherwise("")
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, sentence_ids, licences, n_unmatched.

    ``sentence_ids``: known licence sentences in order; ``licences``: what the
    rules found, in order, each as often as it stands there; ``n_unmatched``:
    known sentences that no rule took.  Of an SPDX expression the first name
    counts.  Null and empty texts, and texts without
    any, have empty arrays and 0.  A very long text is cut within its row.  Where
    two rules match, the one of more sentences wins.  Repeated rows are scanned
    alike; an empty table gives no rows; other columns take no part.
    """
    of = F.when(F.lower(text_of(text)).rlike("|".join(ANCHORS)), identified(sentences(text))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), of.alias("ids"))
    # unknown sentences are gaps; a rule's sentences must be neighbours
    told = F.array_join(F.transform("ids", lambda x: F.when(x == "", "_").otherwise(F.concat(F.lit("<"), x, F.lit(">")))), "")
    for licence, wanted in rules():
        told = F.replace(told, F.lit("".join(f"<{i}>" for i in wanted)), F.lit("{" + licence + "}"))
    rows = rows.select(
        "doc_id", F.array_remove("ids", "").alias("sentence_ids"),
        F.when(F.size(F.array_remove("ids", "")) > 0, told).otherwise(F.lit("")).alias("told"),
    )
    return rows.select(
        "doc_id", "sentence_ids", F.regexp_extract_all("told", F.lit(r"\{([^}]*)\}"), 1).alias("licences"),
        F.size(F.regexp_extract_all("told", F.lit(r"<([^>]*)>"), 1)).alias("n_unmatched"),
    )
