"""Byte-pair encoding by a deterministic automaton, and decoding by its labels.

The automaton reads tokens and accepts exactly the sequences that the merges
give.  It starts as one state on which every base symbol loops.  Each merge
u v -> t then builds a gadget: the state that all arcs labelled u lead to is
copied without its arc v, the arcs u are led to the copy, and wherever an arc
u leaves, an arc t is added that ends where v ended.  All arcs with one label
end in one state, so a state is kept as the label it was built for and the one
it lost, and whether an arc exists follows from the gadgets; arcs that were
asked for stay in a table.  A word's tokens are the only accepted path over its symbols.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: Entries after which a worker's table of words or arcs is started anew.
_TABLE = 150_000
#: Rows that are encoded before they are handed on.
_ROWS = 500
#: Longer words are encoded each time.
_LONG = 64


@cache
def byte_symbols() -> str:
    """The printable character for each byte: itself where Latin-1 prints it,
    the others in turn from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return "".join(chr(b) if b in plain else chr(next(others)) for b in range(256))


class Automaton:
    """Compiled merges.  labels: the string of each token id; suffix: what the
    last symbol of a word carries."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "", special: dict[str, int] | None = None):
        self.vocab, self.suffix, self.special = vocab, suffix, dict(special or {})
        self.labels = {i: s for s, i in [*vocab.items(), *self.special.items()]}
        near, far = {}, {}
        for label in vocab:
            bare = label.removesuffix(suffix) if suffix else label
            (near if len(bare) < 5 else far).setdefault(bare[: 3 if len(bare) < 5 else 5], set()).add(len(bare))
        #: How many symbols a label may have that starts with three symbols (up to four), or with five; longest first.
        self.near = {k: (*sorted(v, reverse=True), 2, 1) for k, v in near.items() if len(k) == 3}
        self.far = {k: (*sorted(v, reverse=True), *self.near.get(k[:3], (2, 1))) for k, v in far.items()}
        size = max(self.labels, default=-1) + 1
        #: By token: the merge that made it, its left part, the state its arcs end in.
        self.made, self.left, self.end = [-1] * size, [-1] * size, [0] * size
        #: By state: the merge whose gadget it is, and the label whose arcs it was built for.
        self.born, self.line = [-1], [-1]
        #: By label: its gadgets in order, the state they started from, and the merges that took a label from them.
        self.states: dict[int, list[int]] = {}
        self.births: dict[int, list[int]] = {}
        self.start: dict[int, int] = {}
        self.lost: dict[int, dict[int, int]] = {}
        known = {i for s, i in vocab.items() if len(s.removesuffix(suffix) if suffix else s) == 1}
        for number, (a, b) in enumerate(merges):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            if t in known:
                raise ValueError(f"two merges make {a + b!r}")
            known.add(t)
            self._gadget(number, u, v, t)
        self._reset()

    def _gadget(self, number: int, u: int, v: int, t: int) -> None:
        state = self.end[u]
        if state < 0 or not self._arc(state, v):
            self.end[t] = -1  # the pair never stands side by side
            return
        after = self.end[v]
        if u not in self.start:
            self.start[u], self.states[u], self.births[u], self.lost[u] = state, [], [], {}
        self.states[u].append(len(self.born))
        self.births[u].append(number)
        self.lost[u][v] = number
        self.end[u] = len(self.born)
        self.born.append(number)
        self.line.append(u)
        self.made[t], self.left[t], self.end[t] = number, u, after

    def _arc(self, state: int, token: int) -> bool:
        """Whether an arc with the label leaves the state."""
        if self.end[token] < 0:
            return False
        while True:
            made, line = self.made[token], self.line[state]
            if made >= self.born[state]:
                if made < 0:
                    return True  # a base symbol on the first state
                token = self.left[token]  # the gadget added it beside its left part
            elif self.lost[line].get(token, self.born[state] + 1) <= self.born[state]:
                return False
            else:  # back to the copy that stood when the label was made
                at = bisect_right(self.births[line], made)
                state = self.states[line][at - 1] if at else self.start[line]

    def _reset(self) -> None:
        self.arcs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("arcs", "words", "older")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def walk(self, symbols: str) -> tuple[int, ...]:
        """The tokens of one word, given as its symbols: the only accepted
        path, tried with the longest arcs first.  Places that lead nowhere are
        remembered, so the work is linear in the word."""
        n, vocab, arcs, ends, suffix = len(symbols), self.vocab, self.arcs, self.end, self.suffix
        width, near, far = len(ends), self.near, self.far
        if len(arcs) > _TABLE:
            arcs.clear()
        path: list[tuple[int, int, int, int]] = []
        dead: set[tuple[int, int]] = set()
        at, state, k = 0, 0, 0
        while at < n:
            sizes = far.get(symbols[at : at + 5]) or near.get(symbols[at : at + 3], (2, 1))
            while k < len(sizes):
                to = at + sizes[k]
                token = vocab.get(symbols[at:to]) if to < n else vocab.get(symbols[at:to] + suffix) if to == n else None
                if token is not None:
                    arc = state * width + token
                    there = arcs.get(arc)
                    if there is None:
                        there = arcs[arc] = self._arc(state, token)
                    if there and (to, ends[token]) not in dead:
                        break
                k += 1
            if k < len(sizes):
                path.append((at, state, k, token))
                at, state, k = to, ends[token], 0
            else:
                dead.add((at, state))
                if not path:
                    raise ValueError(f"no tokens for {symbols[:100]!r}")
                at, state, k, _ = path.pop()
                k += 1
        return tuple([step[3] for step in path])

    def word(self, word: str) -> tuple[int, ...]:
        """The tokens of one pre-split word.  Words seen lately are kept: when
        the table is full it becomes the older one, from which words that come
        again are taken over."""
        found = self.words.get(word)
        if found is None:
            found = self.older.get(word) or self.walk(word.encode("utf-8", "surrogatepass").decode("latin-1").translate(_SYMBOLS))
            if len(word) <= _LONG:
                if len(self.words) >= _TABLE:
                    self.older, self.words = self.words, {}
                self.words[word] = found
        return found

    def _plain(self, text: str) -> list[int]:
        known = self.words.get
        return list(chain.from_iterable([known(w) or self.word(w) for w in split_words(text)]))

    def text(self, text: str) -> list[int]:
        """The tokens of a text: special strings, then lower-case words."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        for part in regex.split("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")", text):
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(self._plain(part))
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one space between; unknown ids are skipped."""
        try:
            return " ".join(map(self.labels.__getitem__, ids))
        except KeyError:
            return " ".join(self.labels[i] for i in ids if i in self.labels)


_SYMBOLS = dict(enumerate(byte_symbols()))

# Fixed values of the tokenizer file: what its pre-tokenizer takes as a word.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")


# Code points, in hexadecimal, that the library takes otherwise than this
# module's Unicode tables, as they came with later versions.  Letters and numbers that are
# other signs to it; marks that it neither orders nor joins; capitals with the distance
# to their small letters.
_NO_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 "
    "1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_NO_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
_NO_MARKS = (
    "7FD 898-89F 8CA-8D3 9FE C3C D3B-D3C EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B "
    "1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE "
    "1E2EC-1E2EF 1E4EC-1E4EF"
)
_CAPITALS = "1C89:1 A7CB:-42343 A7CC:1 A7CE:1 A7D2:1 A7D4:1 A7DA:1 A7DC:-42561 10D50-10D65:32 16EA0-16EB8:27"


def _ranges(listed: str) -> list[tuple[int, int]]:
    ends = [x.split("-") for x in listed.split()]
    return [(int(x[0], 16), int(x[-1], 16)) for x in ends]


def _class(listed: str) -> str:
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in _ranges(listed)) + "]"


_LOWER = {c: chr(c + int(by)) for listed, by in (x.split(":") for x in _CAPITALS.split()) for a, b in _ranges(listed) for c in range(a, b + 1)}
_LETTER, _NUMBER = (rf"[{kind}--{_class(less)}]" for kind, less in ((r"\p{L}", _NO_LETTERS), (r"\p{N}", _NO_NUMBERS)))
_RARE_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|{_LETTER}+|{_NUMBER}|[^\p{{White_Space}}{_LETTER}{_NUMBER}]+", regex.V1)
_BARRIERS = re.compile(f"({_class(_NO_MARKS)})")
_PLANES = " 10000-10FFFF"
#: Texts without these need none of the lists above.
_RARE = re.compile(_class(" ".join(r for r in f"{_NO_LETTERS} {_NO_MARKS} {re.sub(':[-0-9]+', '', _CAPITALS)}".split() if _ranges(r)[0][0] < 0x10000) + _PLANES))


def split_words(text: str) -> list[str]:
    """Words, single digits and runs of other signs of a text, in composed
    lower-case form; each character is lowered for itself."""
    if text.isascii():
        return _WORDS.findall(text.lower())
    if not _RARE.search(text):
        return _WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
    text = "".join(unicodedata.normalize("NFC", part) for part in _BARRIERS.split(text))
    return _RARE_WORDS.findall(text.replace("Σ", "σ").translate(_LOWER).lower())


def load(path: str) -> Automaton:
    """Compiles a tokenizer file with merges and word ends."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return Automaton(model["vocab"], merges, model["end_of_word_suffix"] or "", special)


def _ids_array(rows: list[list[int]]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))))


class Codec:
    """Encodes and decodes columns with one automaton.

    The file is read and compiled by the driver and sent to the executors
    once; its size is that of the vocabulary, whatever the texts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._shared = spark.sparkContext.broadcast(load(path))

    def encoded(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", decode: bool = False) -> DataFrame:
        """doc_id, ids (array<int>) of every whole text, and with ``decode`` the
        text that they decode to, ``decoded``.

        Null and empty texts have no tokens and decode to "".  A very long
        text is encoded whole, within its row.  Of pairs that could merge the
        first in the file does, from the left.  Repeated rows are encoded each;
        an empty table gives no rows; other columns take no part.
        """
        shared = self._shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shared.value
            for whole in batches:
                for at in range(0, len(whole), _ROWS):
                    batch = whole.slice(at, _ROWS)
                    ids = [automaton.text(x.as_py()) for x in batch.column("text")]
                    columns = [batch.column("doc_id"), _ids_array(ids)]
                    if decode:
                        columns.append(pa.array([automaton.decode(x) for x in ids], pa.string()))
                    yield pa.RecordBatch.from_arrays(columns, names)

        rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
        names = ["doc_id", "ids", *(["decoded"] if decode else [])]
        return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decode)

    def decoded(self, ids: str | Column) -> Column:
        """The text of an array of ids; null and empty arrays give ""."""
        shared = self._shared

        @F.arrow_udf(T.StringType())
        def decode(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automaton = shared.value
            for array in arrays:
                yield pa.array((automaton.decode(x.as_py() or []) for x in array), pa.string())

        return decode(F.col(ids) if isinstance(ids, str) else ids)
