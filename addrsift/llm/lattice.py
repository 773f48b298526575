"""Language-model scores: words, and all segmentations of a word into pieces.

An existing vocabulary of pieces weights every segmentation of a word; the
log-space forward recursion over its lattice sums them to the marginal
probability of the spelling.  A word that the training texts hold has an arc
of its own, too, with its discounted share of the tokens; what the discount
leaves goes to the lattice of pieces.  So

    P(word) = max(c - d, 0) / N + d V / N * sum over segmentations of prod p(piece)

is a distribution over all words, seen or not; a text's probability is the
product over its words and its end.

Texts are first cut into blocks of bounded size, each with its own numbering of
distinct words.  Only (block, word) pairs meet the counts, so a word of every
text joins once per block and not once per text.  A block is staged as a row
per word and a row per text, never as one row: values of many MB fill the heap,
and pages of Parquet as large as they are take as much again beside it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

_P, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Stands for the mark of a word's start; a word's own U+2581 becomes _OTHER.
_START, _OTHER = 0x2581, 0x110000
_SLOTS = 19
#: Words with more characters are walked one by one.
_LONG = 64


@dataclass(frozen=True)
class Learning:
    """block_bytes: text of a block of documents (a longer text is one block);
    blocks_a_task: blocks that are scored together."""

    block_bytes: int = 16 << 20
    blocks_a_task: int = 2


def _hash(points: list[int]) -> int:
    h = 0
    for p in points:
        h = ((h + p + 1) * int(_P)) & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass
class Pieces:
    """A unigram vocabulary: strings with scores, byte pieces for the rest.

    ``strings``: pieces, those that start a word with U+2581; ``scores``: their
    natural log weights; ``bytes_at``: number of the piece of each byte.  The
    end of a word is one more piece, the last.
    """

    strings: list[str]
    scores: np.ndarray
    bytes_at: list[int]
    table: np.ndarray = field(init=False)
    numbers: np.ndarray = field(init=False)
    probes: int = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.strings), default=1)
        self.end = len(self.strings)
        self.starts = np.array([s.startswith("▁") for s in self.strings] + [False])
        of_bytes = set(self.bytes_at)
        self.index = {s: i for i, s in enumerate(self.strings) if i not in of_bytes}
        self.table = np.zeros(1 << _SLOTS, np.uint64)
        self.numbers = np.full(1 << _SLOTS, -1, np.int32)
        self.probes = 1
        for s, i in self.index.items():
            h = _hash([ord(c) for c in s])
            at, probe = self._slot(h), 1
            while self.numbers[at] >= 0:
                at, probe = (at + 1) % (1 << _SLOTS), probe + 1
            self.table[at], self.numbers[at] = h, i
            self.probes = max(self.probes, probe)
        self.scores = self.normalised(np.exp(np.append(self.scores, np.max(self.scores, initial=0.0))))

    @staticmethod
    def _slot(h: int) -> int:
        return ((h * int(_MIX)) & 0xFFFFFFFFFFFFFFFF) >> (64 - _SLOTS)

    def normalised(self, weights: np.ndarray) -> np.ndarray:
        """Log probabilities: word starts sum to 1, and so does all that may
        follow inside a word, its end included."""
        out = np.empty(len(weights))
        for part in (self.starts, ~self.starts):
            out[part] = np.log(weights[part]) - math.log(max(weights[part].sum(), 1e-300))
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The numbers of pieces with the hashes, -1 where there is none."""
        with np.errstate(over="ignore"):
            at = ((hashes * _MIX) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        found = np.where(self.table[at] == hashes, self.numbers[at], -1)
        for p in range(1, self.probes):
            more = (at + p) & ((1 << _SLOTS) - 1)
            found = np.where((found < 0) & (self.table[more] == hashes), self.numbers[more], found)
        return found

    def spelt(self, point: int) -> list[int]:
        """The byte pieces of a character that has no piece."""
        return [self.bytes_at[b] for b in chr(_START if point == _OTHER else point).encode("utf-8", "replace")]


def load_pieces(path: str) -> Pieces:
    """The vocabulary of a sentencepiece model.  Its scores are ranks, not
    probabilities; a piece starts with the weight 1 / (1 + rank)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    strings = [model.id_to_piece(i) for i in range(n)]
    at = {int(strings[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
    ranks = np.array([-model.get_score(i) for i in range(n)])
    return Pieces(strings, -np.log(1.0 + np.maximum(ranks, 0.0)), [at[b] for b in range(256)])


def points_of(word: bytes) -> list[int]:
    return [_START, *(_OTHER if c == "▁" else ord(c) for c in word.decode("utf-8", "replace"))]


def _lattice(points: np.ndarray, pieces: Pieces) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(start, end) to (rows, piece numbers) of the arcs of words of one length;
    -2 - k stands for the k-th character without a piece."""
    n, size = points.shape
    arcs = {}
    with np.errstate(over="ignore"):
        for i in range(size):
            h = np.zeros(n, np.uint64)
            for j in range(i + 1, min(size, i + pieces.longest) + 1):
                h = (h + points[:, j - 1].astype(np.uint64) + np.uint64(1)) * _P
                found = pieces.find(h)
                if j == i + 1:
                    found = np.where(found < 0, -2 - points[:, i], found)
                    arcs[i, j] = (slice(None), found)
                else:
                    rows = np.flatnonzero(found >= 0)
                    if len(rows):
                        arcs[i, j] = (rows, found[rows])
    return arcs


def _weights(found: np.ndarray, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    out = logp[np.maximum(found, 0)]
    for x in np.unique(found[found < 0]):
        out[found == x] = logp[pieces.spelt(int(-2 - x))].sum()
    return out


def forward(points: np.ndarray, pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Log marginal probabilities of words of one length, one per row: the
    forward recursion over all segmentations."""
    n, size = points.shape
    arcs = _lattice(points, pieces)
    alpha = np.full((size + 1, n), -np.inf)
    alpha[0] = 0.0
    for i, j in sorted(arcs, key=lambda k: (k[1], k[0])):
        rows, found = arcs[i, j]
        alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + _weights(found, pieces, logp))
    return alpha[size] + logp[pieces.end]


def forward_long(points: list[int], pieces: Pieces, logp: np.ndarray) -> float:
    """As ``forward``, for one word, in time linear in its length."""
    text = "".join(chr(p) if p != _OTHER else "\uffff" for p in points)
    alpha = [0.0]
    for j in range(1, len(points) + 1):
        ways = []
        for i in range(max(0, j - pieces.longest), j):
            at = pieces.index.get(text[i:j])
            if at is not None:
                ways.append(alpha[i] + float(logp[at]))
            elif i == j - 1:
                ways.append(alpha[i] + float(logp[pieces.spelt(points[i])].sum()))
        top = max(ways)
        alpha.append(top if top == -math.inf else top + math.log(sum(math.exp(w - top) for w in ways)))
    return alpha[-1] + float(logp[pieces.end])


def spell(words: list[bytes], pieces: Pieces, logp: np.ndarray) -> np.ndarray:
    """Log marginal probabilities of words, in order."""
    out = np.empty(len(words))
    by_size: dict[int, list[int]] = defaultdict(list)
    spelt = [points_of(w) for w in words]
    for i, p in enumerate(spelt):
        if len(p) > _LONG:
            out[i] = forward_long(p, pieces, logp)
        else:
            by_size[len(p)].append(i)
    for rows in by_size.values():
        out[rows] = forward(np.array([spelt[i] for i in rows], np.int64), pieces, logp)
    return out


def _varints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2 ** 35 in seven bits a byte, the low ones first and all
    bytes but the last marked; where each begins, and the end of all."""
    n = 1 + sum((x >> 7 * k > 0).astype(np.int64) for k in range(1, 5))
    at = np.append(0, np.cumsum(n))
    raw = np.empty(at[-1], np.uint8)
    for k in range(5):
        some = n > k
        raw[at[:-1][some] + k] = (x[some] >> 7 * k) & 127 | (n[some] > k + 1) << 7
    return raw, at


def _numbers(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.append(-1, last)[:-1] + 1
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        some = last - first >= k
        out[some] |= (raw[first[some] + k].astype(np.int64) & 127) << 7 * k
    return out


def _packed(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The first ``sizes[0]`` numbers as one value, the next ones as another."""
    raw, at = _varints(numbers.astype(np.int64))
    cuts = at[np.append(0, np.cumsum(sizes))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(raw)])


def _steps(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sorted numbers of each text as the first one and the differences."""
    out = np.diff(flat, prepend=flat[:1] * 0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    out[first] = flat[first]
    return out


def _unstepped(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(steps))
    return total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes)


def _blocks(block_bytes: int, id_type: pa.DataType):
    """(doc_id, held_out, text) to rows of words, with their counts among the
    training texts of the block, and rows of texts, whose ``pos`` is null: the
    sorted places of a text's words and how often each comes, as varints."""
    types = {
        "block": pa.int64(), "pos": pa.int32(), "word": pa.binary(), "n": pa.int64(), "doc_id": id_type, "held_out": pa.bool_(),
        "n_words": pa.int64(), "size": pa.int64(), "at": pa.binary(), "times": pa.binary(),
    }

    def rows(n: int, /, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, t) for c, t in types.items()], [*types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        known: dict[bytes, int] = {}
        ids, held, lengths, at, times, size = [], [], [], [], [], 0

        def block() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(x) for x in at], np.int64)
            flat = np.concatenate([np.zeros(0, np.int32), *at])
            often = np.concatenate([np.zeros(0, np.int32), *times])
            seen = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(flat[seen], often[seen], minlength=len(known)).astype(np.int64)
            yield rows(
                n := len(known), block=pa.array(np.full(n, number)), pos=pa.array(np.arange(n, dtype=np.int32)),
                word=pa.array(known, pa.binary()), n=pa.array(counts),
            )
            yield rows(
                n := len(ids), block=pa.array(np.full(n, number)), doc_id=pa.array(ids, id_type), held_out=pa.array(held, pa.bool_()),
                n_words=pa.array(lengths, pa.int64()), size=pa.array(sizes), at=_packed(_steps(flat, sizes), sizes), times=_packed(often, sizes),
            )

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for i, out, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), texts, strict=True):
                raw = text.as_py().lower()  # bytes: A-Z only
                found = Counter(raw.split())
                ids.append(i)
                held.append(out)
                lengths.append(sum(found.values()))
                places = np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found))
                order = np.argsort(places)
                at.append(places[order])
                times.append(np.fromiter(found.values(), np.int32, len(found))[order])
                size += len(raw) + 200
                if size >= block_bytes:
                    yield from block()
                    number += 1
                    known = {}
                    ids, held, lengths, at, times, size = [], [], [], [], [], 0
        if ids:
            yield from block()

    return run


def _spelt(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = spell(batch.column("word").to_pylist(), shared.value, shared.value.scores)
            yield batch.append_column("spelling", pa.array(total))

    return run


@dataclass(frozen=True)
class Totals:
    """tokens N, kinds V, ends (training texts) and discount d."""

    tokens: int
    kinds: int
    ends: int
    discount: float

    @property
    def left(self) -> float:
        """The share of the tokens that the discount leaves to spellings."""
        return self.discount * (self.kinds - 1) / self.tokens if self.kinds > 1 else 1.0 - self.end

    @property
    def end(self) -> float:
        return self.ends / self.tokens if self.tokens else 0.5

    def base(self, count):
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))

    def score(self, count, spelling):
        """Log10 of the discounted share of the tokens and, for the rest, of the
        spelling (natural log): a word's own arc and its lattice of pieces."""
        seen = np.maximum(count - self.discount, 0.0) / max(self.tokens, 1)
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(seen), math.log(self.left) + spelling) / math.log(10.0)


def _scored(totals: Totals):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        at = words.column("pos").to_numpy()
        count, spelling = np.zeros(len(at)), np.zeros(len(at))
        count[at], spelling[at] = words.column("n").to_numpy(), words.column("spelling").to_numpy()
        sizes = docs.column("size").to_numpy()
        places, often = (_numbers(np.frombuffer(b"".join(docs.column(c).to_pylist()), np.uint8)) for c in ("at", "times"))
        flat = _unstepped(places, sizes)
        n = len(sizes)
        owner = np.repeat(np.arange(n), sizes)

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.bincount(owner, values[flat] * often, minlength=n)

        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(docs.column("n_words").to_numpy() + 1),
            "n_known": pa.array(np.rint(per_text((count > 0).astype(float))).astype(np.int64) + int(totals.ends > 0)),
            "train_tokens": pa.array(np.full(n, totals.tokens)), "base_score": pa.array(per_text(totals.base(count)) + totals.base(totals.ends)),
            "score": pa.array(per_text(totals.score(count, spelling)) + math.log10(totals.end)),
        })

    return run


def is_held_out(doc_id: str | Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 5; null ids train."""
    of = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(of.cast("string")) % 5 == 1, F.lit(False))


def _totals(words: DataFrame, ends: int) -> Totals:
    found = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.count_if(c).alias(a) for a, c in (("v", F.col("n") > 0), ("n1", F.col("n") == 1), ("n2", F.col("n") == 2))]
    ).first()
    discount = min(max(found.n1 / (found.n1 + 2 * found.n2) if found.n1 else 0.5, 0.05), 0.95)
    return Totals(int(found.n) + ends, int(found.v) + (1 if ends else 0), ends, discount)


def score_texts(docs: DataFrame, pieces: Pieces, held_out: Column, doc_id: str = "doc_id", text: str = "text", plan: Learning = Learning()) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 of the probability of the whole text).

    Tokens are the words, A-Z lowered, and one end.  Texts that aren't held out
    are learned from.  A null or empty text is its end alone; a very long one is
    a block of its own; repeated rows count, and are scored, as often as they
    come; without training texts a word has the probability of its spelling and
    an end one half.  An empty table gives no rows, other columns take no part.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), text_of(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType
    schema = (
        f"block bigint, pos int, word binary, n bigint, doc_id {id_type.simpleString()}, held_out boolean, "
        "n_words bigint, size bigint, at binary, times binary"
    )
    blocks = staged(rows.mapInArrow(_blocks(plan.block_bytes, to_arrow_type(id_type)), schema), "lattice-blocks")
    met = blocks.filter("pos IS NOT NULL").select("block", "pos", "word", "n")
    texts = blocks.filter("pos IS NULL").select("block", "doc_id", "held_out", "n_words", "size", "at", "times")
    counted = met.groupBy("word").agg(F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast(pieces)  # as large as the vocabulary
    words = staged(counted.mapInArrow(_spelt(shared), "word binary, n bigint, spelling double"), "lattice-words")
    told = texts.agg(F.count_distinct("block").alias("blocks"), F.count_if(~F.coalesce("held_out", F.lit(False))).alias("ends")).first()
    totals = _totals(words, told.ends)
    tasks = max(1, -(-told.blocks // plan.blocks_a_task))
    found = met.select("block", "pos", "word").join(words, "word").select(F.col("block").alias("of"), "pos", "n", "spelling").repartition(tasks, "of")
    return texts.repartition(tasks, "block").groupBy("block").cogroup(found.groupBy("of")).applyInArrow(
        _scored(totals),
        f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
