"""Near copies by ProbMinHash over weighted word shingles.

Each shingle of a text is a Poisson process whose rate is its count.  Every
arrival falls into one of k registers, and a register keeps the shingle of its
first arrival; a text is done as soon as no later arrival can come first in
any register.  Registers of two texts agree with the probability Jaccard
similarity of their weights.  Bands of registers give candidates, and whole
texts are compared before two count as near.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of, whole_rows
from .components import components
from .exact import _RUN, _order

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Elements of a block of texts whose registers are filled together.
_BLOCK = 1_000_000


@dataclass(frozen=True)
class Near:
    """shingle: words of a shingle; similarity: of a link; bands x rows
    registers; block, block_bytes: about as many members of a bucket, and bytes
    of their texts, are compared with as many others in one piece."""

    shingle: int = 5
    similarity: float = 0.8
    bands: int = 32
    rows: int = 6
    block: int = 256
    block_bytes: int = 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingles(raw: bytes, size: int, ids: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text, hashed, and their counts.  A text of fewer
    words is one shingle; one without words has none."""
    words = raw.split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids = _WordIds() if ids is None else ids
    of = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    size = min(size, len(of))
    n = len(of) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = mixed(out * _GOLDEN + of[j : j + n])
    return np.unique(out, return_counts=True)


def registers(hashes: np.ndarray, weights: np.ndarray, owner: np.ndarray, owners: int, k: int) -> np.ndarray:
    """ProbMinHash of several texts at once: a row of k shingles for each.

    hashes, weights, owner: the elements, ``owner`` numbering the texts.
    Rows of texts without elements are 0.
    """
    first = np.full(owners * k, np.inf)
    holder = np.zeros(owners * k, np.uint64)
    time = np.zeros(len(hashes))
    drawn = 0
    with np.errstate(over="ignore"):
        while len(hashes):
            draws = int(np.clip(200_000 // len(hashes), 1, 32))
            at = np.arange(drawn + 1, drawn + draws + 1, dtype=np.uint64)
            bits = mixed(hashes[:, None] + at[None, :] * _GOLDEN)
            gaps = -np.log1p((bits >> np.uint64(11)).astype(np.float64) * -(2.0**-53))
            arrivals = time[:, None] + np.cumsum(gaps, axis=1) / weights[:, None]
            slot = owner[:, None] * k + (mixed(bits ^ _GOLDEN) % np.uint64(k)).astype(np.int64)
            slot, when = slot.ravel(), arrivals.ravel()
            better = np.flatnonzero(when < first[slot])
            slot, when = slot[better], when[better]
            np.minimum.at(first, slot, when)
            won = when == first[slot]
            holder[slot[won]] = hashes[better[won] // draws]
            time, drawn = arrivals[:, -1], drawn + draws
            alive = time < first.reshape(owners, k).max(axis=1)[owner]
            hashes, weights, owner, time = hashes[alive], weights[alive], owner[alive], time[alive]
    return holder.reshape(owners, k)


def band_keys(held: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One number for each band of each text."""
    with np.errstate(over="ignore"):
        keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _GOLDEN, (len(held), bands)).copy()
        for r in range(rows):
            keys = mixed(keys * _GOLDEN + held[:, r * bands : (r + 1) * bands])
    return keys.view(np.int64)


def _signed(plan: Near):
    """Adds the band keys to (.., text); takes the text away."""
    k = plan.bands * plan.rows

    def keys_of(texts: list[bytes]) -> list[np.ndarray]:
        ids = _WordIds()
        out: list[np.ndarray] = []
        block: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            sizes = [len(h) for h, _ in block]
            owner = np.repeat(np.arange(len(block)), sizes)
            held = registers(
                np.concatenate([h for h, _ in block]), np.concatenate([w for _, w in block]).astype(np.float64), owner, len(block), k
            )
            keys = band_keys(held, plan.bands, plan.rows)
            out.extend(keys[i] if n else keys[i, :0] for i, n in enumerate(sizes))
            block.clear()

        held_now = 0
        for raw in texts:
            block.append(shingles(raw, plan.shingle, ids))
            held_now += len(block[-1][0])
            if held_now >= _BLOCK or len(block) >= 20_000:
                flush()
                held_now = 0
        if block:
            flush()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch.column("text").cast(pa.binary()).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in rest], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*rest, "keys"]
            )

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two sets of weighted shingles, exactly: the sum
    over common ones of 1 / sum_j max(x_j / x_i, y_j / y_i).  1 for two empty."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    every, where = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[where[: len(a[0])]] = a[1]
    y[where[len(a[0]) :]] = b[1]
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    ranked = ratio[order]
    x_from = np.concatenate([np.cumsum(x[order][::-1])[::-1], [0.0]])
    y_below = np.concatenate([[0.0], np.cumsum(y[order])])
    common = np.flatnonzero((x > 0) & (y > 0))
    at = np.searchsorted(ranked, ratio[common])
    return float((1.0 / (x_from[at] / x[common] + y_below[at] / y[common])).sum())


def _compared(plan: Near):
    """Adds whether text_a and text_b are near; takes the texts away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, last = _WordIds(), (None, None)
            near = []
            for b, raw_a, raw_b in zip(
                batch.column("centre").to_pylist(), batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary()), strict=True
            ):
                if last[0] != b:
                    last = (b, shingles(raw_b.as_py(), plan.shingle, ids))
                near.append(similarity(shingles(raw_a.as_py(), plan.shingle, ids), last[1]) >= plan.similarity)
            yield batch.drop_columns(["text_a", "text_b"]).append_column("near", pa.array(near, pa.bool_()))

    return run


def _lowered(text: str | Column) -> Column:
    return F.lower(text_of(text))


def fingerprint(text: str | Column) -> Column:
    """128 bits of the sequence of lower-case words."""
    return F.unhex(F.md5(F.trim(F.regexp_replace(_lowered(text), _RUN, " "))))


def _first_pairs(members: DataFrame) -> DataFrame:
    """One pair (node, centre) for each node: the centre that it meets in the
    most buckets.  A bucket's centre is the member that meets the most others in
    all its buckets, which tends to be the text that the others were copied from.
    """
    centres = members.groupBy("key").agg(F.min(F.struct((-F.col("meets")).alias("o"), "node")).alias("c")).select("key", F.col("c.node").alias("centre"))
    met = members.join(centres, "key").filter("node <> centre").groupBy("node", "centre").agg(F.count("*").alias("n"))
    return met.groupBy("node").agg(F.max(F.struct("n", (-F.col("centre")).alias("c"))).alias("b")).select("node", (-F.col("b.c")).alias("centre"))


def _crossings(members: DataFrame, comps: DataFrame, plan: Near) -> DataFrame:
    """(key, kind, p, q, side, node, comp): the members of the buckets that hold
    several components, dealt to groups such that any two of a bucket that are of
    different components are together in one.

    Members of the bucket's largest component are blocks of their own, which
    meet the blocks of the others only (kind m); those meet each other too (kind
    o).  Buckets of the same members count once.
    """
    known = members.join(comps, "node").select("key", "node", "comp", "size")
    of_comp = known.groupBy("key", "comp").agg(
        F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("g")
    )
    buckets = of_comp.groupBy("key").agg(
        F.count("*").alias("comps"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"),
        F.max(F.struct("n", "comp", "bytes")).alias("most"),
    ).filter("comps > 1")
    buckets = buckets.groupBy("n", "h", "g").agg(F.min(F.struct("key", "bytes", "most")).alias("b")).select("n", "b.*")

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(n / plan.block), F.ceil(size / plan.block_bytes)).cast("int")

    cut = buckets.select(
        "key", F.col("most.comp").alias("major"), (blocks(F.col("n"), F.col("bytes")) == 1).alias("whole"),
        blocks(F.col("most.n"), F.col("most.bytes")).alias("ms"), blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("os"),
    )

    def group(kind: str, p: Column, q: Column, side: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))

    at = F.pmod(F.xxhash64("node", "key"), F.when(F.col("comp") == F.col("major"), F.col("ms")).otherwise(F.col("os"))).cast("int")
    to_m, to_o = F.sequence(F.lit(0), F.col("ms") - 1), F.sequence(F.lit(0), F.col("os") - 1)
    groups = (
        F.when(F.col("whole"), F.array(group("o", F.lit(0), F.lit(0), F.lit(0))))
        .when(F.col("comp") == F.col("major"), F.transform(to_o, lambda o: group("m", o, F.col("at"), F.lit(1))))
        .otherwise(F.concat(
            F.transform(to_o, lambda o: group("o", F.least(o, "at"), F.greatest(o, "at"), F.col("at") > o)),
            F.transform(to_m, lambda m: group("m", F.col("at"), m, F.lit(0))),
        ))
    )
    dealt = known.join(cut, "key").withColumn("at", at).select("key", "node", "comp", F.explode(groups).alias("to"))
    return dealt.select("key", "to.*", "node", "comp")


def upper_bounds(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of a and each of b a number that their similarity does not exceed,
    and equals where no shingle repeats: the sum of the larger weights of common
    shingles over that of all."""
    sizes = [len(h) for h, _ in a] + [len(h) for h, _ in b]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weights = np.concatenate([w for _, w in [*a, *b]]).astype(np.float64)
    total = np.bincount(owner, weights, len(sizes))
    _, column, held = np.unique(np.concatenate([h for h, _ in [*a, *b]]), return_inverse=True, return_counts=True)
    often = held > 1  # others are common to no two
    new = np.cumsum(often) - 1
    stays = often[column]
    column, owner, weights = new[column[stays]], owner[stays], weights[stays]
    order = np.argsort(column, kind="stable")
    column, owner, weights = column[order], owner[order], weights[order]
    least, larger = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    kind = np.float32 if total.max(initial=0) < 2**23 else np.float64  # sums are exact
    last = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, last, 4096):
        here = slice(*np.searchsorted(column, [start, start + 4096]))
        table = np.zeros((len(sizes), min(4096, last - start)), kind)
        table[owner[here], column[here] - start] = weights[here]
        has = (table > 0).astype(kind)
        heavy = np.flatnonzero(table.max(axis=0) > 1)
        light = has.copy()
        light[:, heavy] = 0
        n = len(a)
        both = light[:n] @ light[n:].T
        for c in heavy:
            both += np.minimum.outer(table[:n, c], table[n:, c])
        least += both
        larger += table[:n] @ has[n:].T + has[:n] @ table[n:].T - both
    return larger / (total[: len(a), None] + total[None, len(a) :] - least)


def _links_of(nodes: list[tuple[int, int, bytes]], plan: Near) -> list[tuple[int, int]]:
    """Links between the components of the members (side, component, text) of
    one group, as many as connect what is near."""
    ids = _WordIds()
    left = [(c, shingles(t, plan.shingle, ids)) for s, c, t in nodes if not s]
    right = [(c, shingles(t, plan.shingle, ids)) for s, c, t in nodes if s]
    other = right or left
    if not left:
        return []
    comp_a, comp_b = np.array([c for c, _ in left]), np.array([c for c, _ in other])
    untested = comp_a[:, None] != comp_b[None, :]
    if not right:
        untested &= np.tri(len(left), dtype=bool).T
    if untested.sum() > 3:
        bound = upper_bounds([x for _, x in left], [x for _, x in other])
        untested &= bound >= plan.similarity - 1e-6
        at = np.argwhere(untested)
        at = at[np.argsort(-bound[untested], kind="stable")]
    else:
        at = np.argwhere(untested)
    under: dict[int, int] = {}

    def root(c: int) -> int:
        while c in under:
            if under[c] in under:
                under[c] = under[under[c]]
            c = under[c]
        return c

    links = []
    for i, j in at.tolist():
        (a, x), (b, y) = left[i], other[j]
        if (ra := root(a)) != (rb := root(b)) and similarity(x, y) >= plan.similarity:
            under[ra] = rb
            links.append((a, b))
    return links


def _crossed(plan: Near):
    """Links (a, b) of components from sorted groups of (key, kind, p, q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

        now, members = None, []
        for batch in batches:
            links = []
            texts = batch.column("text").cast(pa.binary())
            columns = (batch.column(n).to_pylist() for n in ("key", "kind", "p", "q", "side", "comp"))
            for i, (*group, side, comp) in enumerate(zip(*columns, strict=True)):
                if group != now:
                    links += _links_of(members, plan)
                    now, members = group, []
                members.append((side, comp, texts[i].as_py()))
            if links:
                yield told(links)
        if links := _links_of(members, plan):
            yield told(links)

    return run


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components of nodes after links between them."""
    least = components(links).withColumnsRenamed({"a": "comp", "b": "under"})
    return comps.join(least, "comp", "left").withColumn("comp", F.coalesce("under", "comp")).drop("under")


def _classes(docs: DataFrame, text: str, rows: DataFrame, plan: Near) -> DataFrame:
    """(fp, comp) of the distinct texts in ``rows`` (fp, row, keys)."""
    nodes = staged(
        rows.groupBy("fp").agg(F.min("row").alias("node")), "near-nodes"
    )
    bands = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = staged(bands.join(shared, "key"), "near-met")
    members = staged(met.join(met.groupBy("node").agg(F.sum("n").alias("meets")), "node").select("key", "node", "meets"), "near-members")
    sought = nodes.join(members.select("node").distinct(), "node", "left_semi")
    texts = staged(
        docs.select(fingerprint(text).alias("fp"), _lowered(text).alias("text"))
        .join(sought, "fp").groupBy("node").agg(F.any_value("text").alias("text")),
        "near-texts",
    )
    comps = texts.select("node", F.col("node").alias("comp"), F.octet_length("text").alias("size"))
    compared = staged(
        _first_pairs(members)
        .join(texts.select("node", F.col("text").alias("text_a")), "node")
        .join(texts.select(F.col("node").alias("centre"), F.col("text").alias("text_b")), "centre")
        .select("node", "centre", "text_a", "text_b")
        .mapInArrow(_compared(plan), "node bigint, centre bigint, near boolean"),
        "near-compared",
    )
    comps = staged(_joined(comps, compared.filter("near").select(F.col("node").alias("a"), F.col("centre").alias("b"))), "near-comps")
    dealt = _crossings(members, comps, plan).join(texts, "node").select("key", "kind", "p", "q", "side", "comp", "text")
    links = staged(
        dealt.repartition("key", "kind", "p", "q").sortWithinPartitions("key", "kind", "p", "q").mapInArrow(_crossed(plan), "a bigint, b bigint"),
        "near-links",
    )
    comps = staged(_joined(comps, links), "near-comps")
    return nodes.join(comps.select("node", F.col("comp").alias("b")), "node", "left").select("fp", F.coalesce("b", "node").alias("comp"))


def _signed_rows(docs: DataFrame, doc_id: str, text: str, plan: Near) -> DataFrame:
    """row, doc_id, fp, keys of every row, staged."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), fingerprint(text).alias("fp"), _lowered(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    signed = rows.mapInArrow(_signed(plan), f"doc_id {kind}, fp binary, keys array<bigint>")
    return staged(signed.withColumn("row", F.monotonically_increasing_id()), "near-rows")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Near = Near()) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    A class is a connected component of links between texts whose word
    shingles have a probability Jaccard similarity of at least
    ``plan.similarity``; class_id is its smallest doc_id (nulls last), and
    exactly one row of a class is kept, with that id.

    Equal sequences of lower-case words are one text; so are all texts without
    words, null ones among them.  A text of fewer words than a shingle is one
    shingle.  Ties and repeated rows are members of their class, one kept.  A
    very long text has as many registers as others and is compared whole.  An
    empty table gives no rows; other columns take no part.  Candidates are texts that meet in a band; any two
    of a bucket are compared unless links already join them.
    """
    rows = _signed_rows(docs, doc_id, text, plan)
    slim = rows.select("row", "fp", _order(F.col("doc_id"), F.col("row")).alias("first"))
    classes = _classes(docs, text, rows, plan)
    by_text = slim.groupBy("fp").agg(F.min("first").alias("first"), F.count("*").alias("n")).join(classes, "fp")
    of = by_text.groupBy("comp").agg(F.min("first").alias("keep"), F.sum("n").alias("class_size"))
    of_text = staged(by_text.select("fp", "comp").join(of, "comp").select("fp", "keep", "class_size"), "near-classes")
    return slim.join(of_text, "fp").select(
        F.col("first.v0").alias("doc_id"), F.col("keep.v0").alias("class_id"), "class_size", (F.col("row") == F.col("keep.v1")).alias("kept")
    )


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", plan: Near = Near()) -> DataFrame:
    """The row that ``near_groups`` keeps of each class, with all its columns."""
    rows = _signed_rows(docs, doc_id, text, plan)
    classes = _classes(docs, text, rows, plan)
    by_text = rows.groupBy("fp").agg(F.min(_order(F.col("doc_id"))).alias("first")).join(classes, "fp")
    keep = staged(by_text.groupBy("comp").agg(F.min(F.struct("first", "fp")).alias("k")).select("k.fp", "k.first"), "near-kept")
    stays = whole_rows(docs, fp=fingerprint(text), first=_order(F.col(doc_id))).join(keep, ["fp", "first"], "left_semi")
    ranked = Window.partitionBy("fp").orderBy("first")
    return stays.withColumn("rank", F.row_number().over(ranked)).filter("rank = 1").select("_row.*")
