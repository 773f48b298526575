"""Hard negatives by exact inner products, several per multiplication.

Components are integers.  With the least of all components taken off they are
not negative, so an inner product of two such vectors has a bounded number of
bits; several candidates' components then stand in separate fields of one wide
integer, one multiplication with an anchor's component serves them all, and the
fields of the sum are the candidates' products, from which the shares of the
bias are taken again.

Anchors meet all rows in blocks: each pair of an anchor block and a shard of the
rows is one sorted run of a partition, read as a stream with the anchors first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Bits of a whole number that a double carries exactly.
EXACT_BITS = 53
#: Candidates in one integer where a field is wider than a double (Python's integers have any width).
WIDE_FIELDS = 32


@dataclass(frozen=True)
class Mining:
    """positives and negatives kept; a negative's score lies between ``least``
    and ``most`` hundredths of its positive's; ``anchors`` of a block and
    ``shards`` of the rows (None: twice the cores, over all blocks) set the
    size of tasks, never the result."""

    positives: int = 5
    negatives: int = 3
    least: int = 50
    most: int = 95
    anchors: int = 4096
    shards: int | None = None


class Packed:
    """Exact inner products with fields of one wide integer."""

    def __init__(self, least: int, greatest: int, size: int):
        self.bias, self.size = -least, size
        self.bits = max(1, (size * (greatest - least) ** 2).bit_length())
        self.fields = EXACT_BITS // self.bits
        self.kind = np.float64 if self.fields else object
        self.fields = self.fields or WIDE_FIELDS

    def operand(self, rows: np.ndarray) -> np.ndarray:
        """Anchors, biased."""
        return (rows.astype(object) + self.bias if self.kind is object else rows + self.bias).astype(self.kind)

    def scores(self, anchors: np.ndarray, anchor_sums: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """int64 of anchors by rows; ``anchors`` as ``operand`` gives them."""
        biased = self.operand(rows)
        short = -len(rows) % self.fields
        if short:
            biased = np.concatenate([biased, np.zeros((short, biased.shape[1]), biased.dtype)])
        wide = sum(biased[f :: self.fields] * self.kind_of(1 << (self.bits * f)) for f in range(self.fields))
        product = anchors @ wide.T
        if self.kind is np.float64:
            product = product.astype(np.int64)
        mask = (1 << self.bits) - 1
        out = np.empty((len(anchors), len(biased)), np.int64)
        bias = self.bias * (anchor_sums.astype(object) if self.kind is object else anchor_sums)
        flat = self.size * self.bias * self.bias
        sums = np.concatenate([rows.sum(axis=1), np.zeros(short, np.int64)])
        for f in range(self.fields):
            field = (product >> (self.bits * f)) & mask
            own = sums[f :: self.fields] * self.bias if self.kind is not object else sums[f :: self.fields].astype(object) * self.bias
            out[:, f :: self.fields] = field - bias[:, None] - own[None, :] - flat
        return out[:, : len(rows)]

    def kind_of(self, value: int):
        return float(value) if self.kind is np.float64 else value


class Best:
    """The first ``k`` (score, id) of each of n lists, larger scores first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.held = np.zeros((n, k), bool)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Hits of lists ``at``; only lists with a hit are sorted anew."""
        if not len(at):
            return
        lists = np.unique(at)
        at = np.concatenate([np.repeat(lists, self.k)[self.held[lists].ravel()], at])
        score = np.concatenate([self.score[lists][self.held[lists]], score])
        ids = np.concatenate([self.id[lists][self.held[lists]], ids])
        order = np.lexsort((ids, ~score, at))
        at, score, ids = at[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        kept = rank < self.k
        self.held[lists] = False
        self.score[at[kept], rank[kept]], self.id[at[kept], rank[kept]], self.held[at[kept], rank[kept]] = score[kept], ids[kept], True

    def worst(self) -> np.ndarray:
        """The score below which nothing enters a list."""
        return np.where(self.held[:, -1], self.score[:, -1], np.iinfo(np.int64).min)


def vectors(rows: DataFrame, anchor: Column, vec_id: str, label: Column, embedding: Column) -> DataFrame:
    """number, id, label, v (integers), anchor: the rows that take part, written once."""
    one = rows.select(F.col(vec_id).cast("bigint").alias("id"), label.alias("label"), embedding.alias("v"), anchor.alias("anchor"))
    real = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    # decided before any value is made a whole number
    one = one.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & real)
    one = one.select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double")).cast("bigint")).alias("v"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    return staged(one.withColumn("number", F.monotonically_increasing_id()), "vectors")


def _met(anchors: DataFrame, rows: DataFrame, blocks: int, shards: int) -> DataFrame:
    """Both in partitions by (block, shard), sorted so that a block's anchors
    come before the rows of the shard."""
    nothing = F.lit(None).cast("array<bigint>")
    block = F.pmod(F.xxhash64("number"), F.lit(blocks)).cast("int")
    shard = F.pmod(F.xxhash64("number", F.lit(1)), F.lit(shards)).cast("int")
    wanted = F.col("wanted") if "wanted" in anchors.columns else nothing
    first = anchors.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(0).alias("kind"), "number", "id", "label", "v", wanted.alias("wanted"))
    then = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), shard.alias("shard"), F.lit(1).alias("kind"), "number", "id", "label", "v", nothing.alias("wanted"))
    both = first.unionByName(then)
    return both.repartition(max(1, blocks * shards), "block", "shard").sortWithinPartitions("block", "shard", "kind", "label")


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), size), np.int64)
    out[np.arange(size) < lengths[:, None]] = flat
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """Slices of one (block, shard, kind), in order."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("block", "shard", "kind")], axis=1)
        cuts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if b > a:
                yield tuple(keys[a]), batch.slice(a, b - a)


def _found(met: DataFrame, packed: Packed, plan: Mining, negative: bool) -> DataFrame:
    """number, place (of the positive), score, id: the first ones of each shard."""
    size, k = packed.size, plan.negatives if negative else plan.positives

    def search(batches):
        key, parts, block = None, [], None
        for (b, s, kind), batch in _runs(batches):
            if (b, s) != key:
                if block is not None:
                    yield from block.result()
                key, parts, block = (b, s), [], None
            if kind == 0:
                parts.append(batch)
            elif parts:
                if block is None:
                    block = _Block(pa.Table.from_batches(parts), packed, size, k, plan, negative)
                block.meet(batch)
        if block is not None:
            yield from block.result()

    return met.mapInArrow(search, "number bigint, place int, score bigint, id bigint")


class _Block:
    """A block of anchors and the best that it has met."""

    def __init__(self, anchors: pa.Table, packed: Packed, size: int, k: int, plan: Mining, negative: bool):
        self.packed, self.size, self.negative = packed, size, negative
        raw = _matrix(anchors.column("v"), size)
        self.number, self.ids, self.label = (anchors.column(c).to_numpy() for c in ("number", "id", "label"))
        self.vectors, self.sums = packed.operand(raw), raw.sum(axis=1)
        self.places = plan.positives if negative else 1
        self.best = Best(len(self.ids) * self.places, k)
        if negative:
            wanted = anchors.column("wanted").to_pylist()
            self.cap, self.floor = np.full((len(wanted), self.places), np.iinfo(np.int64).min), np.full((len(wanted), self.places), np.iinfo(np.int64).max)
            for i, scores in enumerate(wanted):
                for j, p in enumerate(scores or []):
                    self.cap[i, j], self.floor[i, j] = plan.most * p // 100, -(-plan.least * p // 100)

    def meet(self, batch: pa.RecordBatch) -> None:
        ids, label, rows = batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("v"), self.size)
        at, step = 0, 64
        while at < len(ids):  # a few rows first, so that most of the others are below what is held
            part = slice(at, at + step)
            self._meet(ids[part], label[part], rows[part])
            at, step = at + step, min(2 * step, max(64, (1 << 21) // len(self.ids)))

    def _meet(self, ids: np.ndarray, label: np.ndarray, rows: np.ndarray) -> None:
        if self.negative:
            scores = self.packed.scores(self.vectors, self.sums, rows)
            other = self.label[:, None] != label[None, :]
            for j in range(self.places):
                lists = np.arange(len(self.ids)) * self.places + j
                floor = np.maximum(self.floor[:, j], self.best.worst()[lists])
                hit = other & (scores <= self.cap[:, j, None]) & (scores >= floor[:, None])
                a, r = np.nonzero(hit)
                self.best.add(lists[a], scores[a, r], ids[r])
            return
        for one in np.unique(label):
            mine, theirs = np.flatnonzero(self.label == one), np.flatnonzero(label == one)
            if len(mine):
                scores = self.packed.scores(self.vectors[mine], self.sums[mine], rows[theirs])
                hit = (scores >= self.best.worst()[mine][:, None]) & (self.ids[mine][:, None] != ids[theirs][None, :])
                a, r = np.nonzero(hit)
                self.best.add(mine[a], scores[a, r], ids[theirs][r])

    def result(self) -> Iterator[pa.RecordBatch]:
        lists, rank = np.nonzero(self.best.held)
        yield pa.RecordBatch.from_pydict({
            "number": pa.array(self.number[lists // self.places], pa.int64()), "place": pa.array((lists % self.places).astype(np.int32)),
            "score": pa.array(self.best.score[lists, rank]), "id": pa.array(self.best.id[lists, rank]),
        })


def mine(rows: DataFrame, anchor: Column, label: Column, embedding: Column, vec_id: str = "vec_id", plan: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embedding`` is an array whose components' whole-number parts (floor) are
    taken; ``anchor`` tells which rows are anchors, each of which meets all
    rows.  Higher scores come first, equal ones by smaller id.  A positive of a
    score of which no whole number lies between the shares has no rows.

    Rows with a null id, label or vector, or with a null or non-finite
    component, take no part.  A shorter vector counts as 0 where it ends.
    Rows of one id are never each other's partners; repeated rows each take
    part, so they repeat in the result.  An empty table gives no rows, other
    columns take no part.  Where scores could leave 64 bits it is an error.
    """
    rows = vectors(rows, anchor, vec_id, label, embedding)
    told = rows.agg(F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("greatest"), F.max(F.size("v")).alias("size"), F.count_if("anchor").alias("anchors")).first()
    least, greatest, size = min(0, told.least or 0), max(0, told.greatest or 0), told["size"] or 0
    if size * max(-least, greatest) ** 2 * max(100, plan.most, plan.least) >= 100 << 63:
        raise ValueError(f"inner products of components from {least} to {greatest} don't fit 64 bits")
    packed = Packed(least, greatest, size)
    blocks = max(1, -(-told.anchors // plan.anchors))
    shards = plan.shards or max(1, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // blocks))
    anchors = rows.filter("anchor")
    near = _first(_found(_met(anchors, rows, blocks, shards), packed, plan, False), ["number"], plan.positives)
    near = staged(near.select("number", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = near.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score")))["positive_score"].alias("wanted"))
    asked = anchors.join(wanted, "number")
    far = _first(_found(_met(asked, rows, blocks, shards), packed, plan, True), ["number", "place"], plan.negatives)
    return (
        far.withColumn("place", F.col("place") + 1).join(near, ["number", "place"]).join(anchors.select("number", F.col("id").alias("anchor_id")), "number")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of what the shards have found."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
