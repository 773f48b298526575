"""Quality rules learned as an ordered decision list.

Sequential covering in the manner of incremental reduced error pruning: a rule
is a conjunction of thresholds on statistics of a text.  It is grown on two
thirds of the labelled rows by information gain, pruned on the rest, and kept
while it is precise; the rows it covers go and the next rule is learned.  The
rules become one conditional expression of Spark, tried in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: Words of a window that counts as repeated.
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = b"0123456789"
_MARKS = b"!?.,;:"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits",
    "n_marks", "n_exclaims", "n_stutters", "n_distinct",
)
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows which occur twice or more, first ones included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for j in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    mixed.sort()
    if not (mixed[1:] == mixed[:-1]).any():  # equal windows have equal hashes
        return 0
    known: dict[bytes, int] = {}
    exact = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    size = 1
    while size < window:  # windows of twice the size, numbered exactly
        exact = exact[:-size] * (int(exact.max()) + 1) + exact[size:]
        exact = np.unique(exact, return_inverse=True)[1].astype(np.int64)
        size *= 2
    starts = np.bincount(exact)[exact] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += starts
    edges[window : window + n] -= starts
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _without(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def text_stats(raw: bytes) -> tuple[int, ...]:
    """The counts named in ``COUNTS`` of a text in UTF-8."""
    words = raw.split()
    in_words = sum(map(len, words))
    n_chars = len(raw.decode("utf-8", "replace"))
    seen: set[bytes] = set()
    n_dup = n_lines = 0
    for line in raw.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in seen:
                n_dup += 1
            seen.add(line)
    stutters = sum(map(bytes.__eq__, words, words[1:]))
    return (
        len(words), n_chars - (len(raw) - in_words), _without(raw, SYMBOLS), n_dup, repeated_words(words), n_chars, n_lines,
        _without(raw, _UPPER), _without(raw, _DIGITS), _without(raw, _MARKS), raw.count(b"!"), stutters, len(set(words)),
    )


@F.arrow_udf(STATS_TYPE)
def _stats(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for array in texts:
        rows = [text_stats(x) for x in array.cast(pa.binary()).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))


def stats_of(text: str | Column) -> Column:
    """Statistics of a whole text, a struct of ``COUNTS``; null as empty."""
    return _stats(text_of(text))


def features(stats: str = "stats") -> dict[str, Column]:
    """What rules test: ratios of the counts, 0 where there is nothing to divide by."""
    def c(name: str) -> Column:
        return F.col(f"{stats}.{name}").cast("double")

    def ratio(a: str, b: str) -> Column:
        return F.when(c(b) > 0, c(a) / c(b)).otherwise(F.lit(0.0))

    return {
        "n_words": c("n_words"), "word_length": ratio("word_chars", "n_words"), "symbols_per_word": ratio("n_symbols", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"), "repeat_words": ratio("n_repeat_words", "n_words"),
        "upper": ratio("n_upper", "word_chars"), "digits": ratio("n_digits", "word_chars"), "marks_per_word": ratio("n_marks", "n_words"),
        "exclaims_per_word": ratio("n_exclaims", "n_words"), "stutters": ratio("n_stutters", "n_words"),
        "distinct": ratio("n_distinct", "n_words"), "words_per_line": ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    """Rejects where all conditions hold; covered and precision as pruned."""

    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def __str__(self) -> str:
        return " AND ".join(map(str, self.conditions))


@dataclass(frozen=True)
class Learning:
    """max_rows: labelled rows that are fitted on, at most (the bound of the
    sample); least_precision and least_covered: of a rule on the rows held back
    for pruning; thresholds: cut points tried for each feature."""

    max_rows: int = 20_000
    max_rules: int = 12
    max_conditions: int = 4
    least_precision: float = 0.95
    least_covered: int = 5
    thresholds: int = 64


def _holds(x: dict[str, np.ndarray], conditions: tuple[Condition, ...], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in conditions:
        out &= x[c.feature] >= c.threshold if c.above else x[c.feature] < c.threshold
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, plan: Learning) -> tuple[Condition, ...]:
    """Adds the condition of the highest information gain until none is wrong."""
    conditions: tuple[Condition, ...] = ()
    inside = np.ones(len(bad), bool)
    while len(conditions) < plan.max_conditions:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for name in sorted(x):
            values = x[name][inside]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, plan.thresholds + 1), method="nearest"))
            order = np.sort(values)
            hits = np.sort(values[bad[inside]])
            all_below, bad_below = np.searchsorted(order, cuts), np.searchsorted(hits, cuts)
            for above, tp, total in ((True, p - bad_below, p + n - all_below), (False, bad_below, all_below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(tp > 0, tp * (np.log2(tp / np.maximum(total, 1)) - before), 0.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(name, above, float(cuts[k])))
        if best[1] is None:
            break
        conditions += (best[1],)
        inside &= _holds(x, conditions[-1:], len(bad))
    return conditions


def _prune(x: dict[str, np.ndarray], bad: np.ndarray, conditions: tuple[Condition, ...]) -> tuple[tuple[Condition, ...], int, float]:
    """The shortest prefix of the conditions with the best worth (p - n) / (p + n)."""
    best = ((), 0, 0.0)
    worth = -np.inf
    for k in range(1, len(conditions) + 1):
        held = _holds(x, conditions[:k], len(bad))
        p, n = int((held & bad).sum()), int((held & ~bad).sum())
        if p + n and (p - n) / (p + n) > worth:
            worth, best = (p - n) / (p + n), (conditions[:k], p + n, p / (p + n))
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, plan: Learning = Learning()) -> list[Rule]:
    """The ordered rules that reject.  No rows, or none of one class: no rules."""
    rules: list[Rule] = []
    growing = np.arange(len(bad)) % 3 != 2
    left = np.ones(len(bad), bool)
    while len(rules) < plan.max_rules and (left & bad & growing).any():
        g, h = left & growing, left & ~growing
        conditions = _grow({k: v[g] for k, v in x.items()}, bad[g], plan)
        conditions, covered, precision = _prune({k: v[h] for k, v in x.items()}, bad[h], conditions)
        if covered < plan.least_covered or precision < plan.least_precision:
            break
        rules.append(Rule(conditions, covered, precision))
        left &= ~_holds(x, conditions, len(bad))
    return rules


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, plan: Learning) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Features and verdicts of at most ``max_rows`` labelled documents, chosen
    by a hash of the id.  Of several labels of an id the worst counts."""
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_label")).dropna()
        .groupBy("_id").agg(F.min("_label").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(plan.max_rows)
    )
    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
        .select("_id", "_label", stats_of("_text").alias("stats"))
        .select("_id", "_label", *[c.alias(n) for n, c in features().items()])
    )
    found = rows.orderBy(F.xxhash64("_id"), "_id", *features()).limit(plan.max_rows).toPandas()
    return {n: found[n].to_numpy(float) for n in features()}, found["_label"].to_numpy() == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", plan: Learning = Learning()) -> list[Rule]:
    """Learns the rules from documents and their labels (0 is bad)."""
    return learn(*labelled(docs, labels, doc_id, text, label, plan), plan)


def rejected_by(rules: list[Rule], stats: str = "stats") -> Column:
    """The number of the first rule that rejects, null where none does: an
    ordered conditional expression over the statistics."""
    column = F.lit(None).cast("int")
    of = features(stats)
    for i, rule in reversed(list(enumerate(rules))):
        tests = [of[c.feature] >= c.threshold if c.above else of[c.feature] < c.threshold for c in rule.conditions]
        test = tests[0]
        for t in tests[1:]:
            test = test & t
        column = F.when(test, F.lit(i)).otherwise(column)
    return column


def base_failed(stats: str = "stats", least_words: int = 20, most_repeated: int = 30) -> Column:
    n, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (n < least_words) | (100 * repeated > most_repeated * n)


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Adds to whole rows (``_row``): stats, base_failed, rule, kept.

    A null or empty text has no words and fails the base rules.  Repeated rows
    are judged alike.  A very long text is counted whole, in its own row.
    Where several rules hold the first decides.  An empty table gives no rows.
    """
    return (
        docs.select(F.struct("*").alias("_row"), stats_of(text).alias("stats"))
        .withColumn("base_failed", base_failed()).withColumn("rule", rejected_by(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows that neither the base rules nor the learned ones reject."""
    return judge(docs, rules, text).filter("kept").select("_row.*")
