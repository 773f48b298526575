"""A Merkle manifest of a dataset: leaf places by bitmap rank, levels by slot arrays.

A leaf's place among the leaves of its group comes from no sort: the ids of a
group are merged into 64-bit words of a bitmap (only words with an id exist),
counts of the words are summed up along a directory of bounded fan-out, and a
place is the directory's count before the word plus the bits set before the id.
Leaves are then keyed by place into arrays of 512 slots, each reduced by up to
three levels at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Nodes under one node, and levels reduced per slot array (8 ** 3 slots).
FAN_BITS, STEPS = 3, 3
_SLOT_BITS = FAN_BITS * STEPS
#: Bits of an id inside a word; bits of a directory entry under its parent.
_WORD_BITS, _ENTRY_BITS, _DIRECTORY = 6, 15, 3
#: The word of rows without an id, before all others.
_NO_ID = -(2**63)
_BEFORE = (Window.unboundedPreceding, -1)


def encoded(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*fields: Column) -> Column:
    """Hex SHA-256 over the encoded fields."""
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def _shift(name: str, value: Column, by: Column | int) -> Column:
    return F.call_function(name, value, by if isinstance(by, Column) else F.lit(by))


def leaves(docs: DataFrame, leaf: Column, given: Column, doc_id: str = "doc_id", group: str = "lang") -> DataFrame:
    """group, doc_id, leaf, given (the leaf a verifier is shown), written once.

    Groups are told apart with null as one of its own, before all others.
    """
    one = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("group"),
        F.col(doc_id).cast("bigint").alias("doc_id"), leaf.alias("leaf"), given.alias("given"),
        F.monotonically_increasing_id().alias("row"),
    )
    word = F.coalesce(_shift("shiftright", F.col("doc_id"), _WORD_BITS), F.lit(_NO_ID))
    bit = F.coalesce(F.col("doc_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int")
    return staged(one.withColumn("word", word).withColumn("bit", bit), "leaves")


def bitmaps(rows: DataFrame) -> DataFrame:
    """group, word, bits, n: the bitmap of each group's ids, word by word, and
    the rows in each; words without ids have no row."""
    bit = _shift("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    return rows.groupBy("group", "word").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"))


def directory(words: DataFrame) -> DataFrame:
    """The words with ``start``, the rows of their group before each.

    Counts are summed up three times over up to 2 ** 15 entries; then the sums
    before an entry go down again, so no window holds more than that (ids
    have 64 bits, the last has 2 ** 13 entries at most).
    """
    levels = [words]
    for _ in range(_DIRECTORY):
        above = _shift("shiftright", F.col("word"), _ENTRY_BITS)
        levels.append(levels[-1].groupBy("group", above.alias("word")).agg(F.sum("n").alias("n")))
    last = Window.partitionBy("group").orderBy("word").rowsBetween(*_BEFORE)
    starts = levels[-1].withColumn("start", F.coalesce(F.sum("n").over(last), F.lit(0)))
    for level in reversed(levels[:-1]):
        among = Window.partitionBy("group", "parent").orderBy("word").rowsBetween(*_BEFORE)
        starts = (
            level.withColumn("parent", _shift("shiftright", F.col("word"), _ENTRY_BITS))
            .withColumn("before", F.coalesce(F.sum("n").over(among), F.lit(0)))
            .join(starts.select("group", F.col("word").alias("parent"), "start"), ["group", "parent"])
            .withColumn("start", F.col("start") + F.col("before")).drop("before", "parent")
        )
    return starts


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``number`` of each row in the order, from range partitions and their counts."""
    low = (1 << 33) - 1
    rows = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id()), "numbered")
    part, inside = _shift("shiftright", F.col("m"), 33), F.col("m").bitwiseAND(F.lit(low))
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row per partition
    starts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("before"))
    return rows.withColumn("part", part).join(starts, "part").withColumn("number", F.col("before") + inside).drop("m", "part", "before")


def placed(rows: DataFrame, words: DataFrame) -> DataFrame:
    """group, no, digest, and the payload ``doc_id, given``: the place of each leaf.

    Where a bitmap word has more rows than bits (repeated ids, or none), its
    rows alone are put in order of id, leaf and row.
    """
    joined = rows.join(directory(words), ["group", "word"])
    full = F.col("n") > F.bit_count("bits")
    below = F.bitwise_not(_shift("shiftleft", F.lit(-1).cast("bigint"), F.col("bit")))
    out = joined.filter(~full).withColumn("no", F.col("start") + F.bit_count(F.col("bits").bitwiseAND(below)))
    keep = ("group", "no", F.col("leaf").alias("digest"), "doc_id", "given")
    if words.filter(full).isEmpty():
        return out.select(*keep)
    crowd = _numbered(joined.filter(full), "group", "word", "doc_id", "leaf", "row")
    first = crowd.groupBy("group", "word").agg(F.min("number").alias("first"))
    crowd = crowd.join(first, ["group", "word"]).withColumn("no", F.col("start") + F.col("number") - F.col("first"))
    return out.select(*keep).unionByName(crowd.select(*keep))


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _up(nodes: Column) -> Column:
    """The level over an array of nodes."""
    runs = F.sequence(F.lit(0), ((F.size(nodes) - 1) / 8).cast("int"))
    return F.transform(runs, lambda i: F.sha2(_joined(F.slice(nodes, i * 8 + 1, 8)), 256))


@dataclass
class Tree:
    """Rounds of slot arrays, and each group's count, depth and root."""

    rounds: list[DataFrame]
    roots: DataFrame

    @classmethod
    def over(cls, nodes: DataFrame, counts: DataFrame) -> Tree:
        """Of nodes (group, no, digest, more), ``no`` from 0 without gaps in a
        group, and counts (group, total).  A round shuffles what is left of the
        nodes once and leaves one in 512 of them."""
        depth = sum((F.col("total") > 8**k).cast("int") for k in range(21))
        counts = staged(counts.select("group", "total", depth.alias("depth")), "depths")
        deepest = counts.agg(F.max("depth")).first()[0] or 0
        rounds, roots = [], []
        for r in range(max(1, -(-deepest // STEPS))):
            slot = F.struct(F.col("no").bitwiseAND(F.lit((1 << _SLOT_BITS) - 1)).cast("int").alias("slot"), *[c for c in nodes.columns if c not in ("group", "no")])
            block = _shift("shiftright", F.col("no"), _SLOT_BITS).alias("block")
            arrays = nodes.select("group", block, slot.alias("slot")).groupBy("group", "block").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
            arrays = (
                arrays.join(counts.select("group", "depth"), "group")
                .withColumn("steps", F.least(F.lit(STEPS), F.col("depth") - STEPS * r))
                .withColumn("level0", F.col("slots.digest"))
            )
            for k in range(STEPS):
                arrays = arrays.withColumn(f"level{k + 1}", F.when(F.col("steps") > k, _up(F.col(f"level{k}"))))
            top = F.element_at(F.array(*[F.get(f"level{k}", F.lit(0)) for k in range(STEPS + 1)]), F.col("steps") + 1)
            done = F.col("depth") <= STEPS * (r + 1)
            arrays = staged(arrays.withColumn("top", top).withColumn("done", done).drop(f"level{STEPS}"), "slots")
            rounds.append(arrays)
            roots.append(arrays.filter("done").select("group", F.col("top").alias("root")))
            nodes = arrays.filter("NOT done").select("group", F.col("block").alias("no"), F.col("top").alias("digest"))
        found = roots[0]
        for more in roots[1:]:
            found = found.unionByName(more)
        return cls(rounds, found)

    def paths(self, above: DataFrame) -> DataFrame:
        """The first nodes with ``path``: per level what stands left and right
        of the node, from the node to the top.

        ``above`` has group, root and the path over each group's root.  Paths
        are made per slot array and opened per node where they are used.
        """
        down = None
        for arrays in reversed(self.rounds):
            rows = arrays.filter("done").join(above, "group")
            if down is not None:
                under = down.select("group", F.col("no").alias("block"), "root", "path")
                rows = rows.unionByName(arrays.filter("NOT done").join(under, ["group", "block"]))
            opened = rows.select("*", F.posexplode("slots").alias("at", "node"))
            steps = []
            for k in range(STEPS):
                i = _shift("shiftright", F.col("at"), FAN_BITS * k)
                inside = i.bitwiseAND(F.lit(7))
                left = F.slice(f"level{k}", i - inside + 1, inside)
                right = F.slice(f"level{k}", i + 2, 7 - inside)
                steps.append(F.struct(_joined(left).alias("left"), _joined(right).alias("right")))
            own = F.slice(F.array(*steps), F.lit(1), F.col("steps"))
            down = opened.select(
                "group", (F.col("block") * (1 << _SLOT_BITS) + F.col("at")).alias("no"), "root", F.concat(own, "path").alias("path"), "node",
            )
        return down


def folded(path: Column | str, leaf: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda d, p: F.sha2(F.concat(p["left"], d, p["right"]), 256))


def manifest(docs: DataFrame, fields: list[str], doc_id: str = "doc_id", group: str = "lang", altered: dict[str, Column] | None = None) -> DataFrame:
    """Leaf, root of the group, root of all and proof of each row.

    Returns doc_id, group (with ``=`` before it; empty for null), leaf, subroot,
    root, path, proof_sha256, folded_root and verified.  ``altered`` names
    fields as a verifier finds them; folded_root comes from those and the
    unaltered siblings.

    Nulls in fields are ``-``; a null group is a group; an empty or very long
    text is one leaf like any other.  Rows without an id come first in their
    group and rows that repeat an id stand together, both by leaf (equal leaves
    are alike, so which comes first shows nowhere but in the path).  An empty
    table gives no rows.  Other columns take no part.
    """
    columns = {c: F.col(c) for c in fields}
    whole = leaf_of(*columns.values())
    given = leaf_of(*(columns | altered).values()) if altered else whole
    rows = leaves(docs, whole, given, doc_id, group)
    words = staged(bitmaps(rows), "bitmaps")
    groups = staged(words.groupBy("group").agg(F.sum("n").alias("total")), "groups")
    tree = Tree.over(placed(rows, words), groups)
    # one node per group: their order is that of the groups' names
    ranks = tree.roots.select(F.lit("").alias("group"), (F.row_number().over(Window.orderBy("group")) - 1).cast("bigint").alias("no"), F.col("root").alias("digest"), F.col("group").alias("name"))
    crown = Tree.over(ranks, groups.agg(F.lit("").alias("group"), F.count("*").alias("total")))
    start = F.array().cast("array<struct<left:string,right:string>>")
    over = crown.paths(crown.roots.select("group", "root", start.alias("path")))
    above = over.select(F.col("node.name").alias("group"), F.struct(F.col("node.digest").alias("subroot"), "root").alias("root"), "path")
    return (
        tree.paths(staged(above, "subroots"))
        .select(
            F.col("node.doc_id").alias("doc_id"), "group", F.col("node.digest").alias("leaf"), "root.subroot", "root.root", "path",
            F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256).alias("proof_sha256"),
            folded("path", F.col("node.given")).alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
