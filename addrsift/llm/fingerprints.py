"""Order-free fingerprints of documents: sums of wide vectors hashed from paragraphs.

A paragraph is hashed to 128 lanes of 32 bits; a document's fingerprint is
their sum, lane by lane modulo 2 ** 32, with the count of what was summed.
Sums don't depend on the order of paragraphs, and a paragraph is added to or
taken from a fingerprint without reading the others.

A paragraph's vector is itself a sum of bit vectors: of two hashes of the whole
paragraph (which tell any two paragraphs apart) and of each of its words with
the word before it.  A lane less half the count is a sum of random signs, so
the squared length of a difference of two fingerprints estimates how many
words in context the two documents don't share.  Blank lines are only counted,
as hashing them would make all texts with many of them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, staged, text_of

#: Two lanes of 32 bits share a long: a lane counts to 2 ** 31, more than a text has bytes.
_PAIR = (1 << 32) + 1
_LONGS = 64
_LOW = (1 << 32) - 1
#: The piece of a blank line.
_BLANK = 0
#: Rows of a bucket in id order, and the most buckets.  Both only set how large tasks are.
ROWS_PER_BUCKET, MOST_BUCKETS = 4096, 1 << 16


def _hashes(paragraph: Column) -> Column:
    """What is summed for a paragraph, as 64-bit hashes."""
    words = F.transform(F.filter(F.split(paragraph, BLANK), lambda w: w != ""), lambda w: F.xxhash64(w))
    pairs = F.transform(F.array(words), lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.coalesce(F.get(w, i - 1), F.lit(0).cast("bigint")))))
    whole = F.array(F.xxhash64(paragraph), F.xxhash64(paragraph, F.lit(1)))
    return F.when(paragraph == "", F.array(F.lit(_BLANK).cast("bigint"))).otherwise(F.concat(whole, F.get(pairs, F.lit(0))))


def pieces(text: Column) -> Column:
    """The hashes of all paragraphs (lines, blank ones too) of a text."""
    return F.flatten(F.transform(F.split(text, "\n"), _hashes))


def sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vector (n, blanks, 64 longs of two lanes) over rows of keys and ``pieces``.

    Bit k and bit k + 32 of a hash go to the two lanes of one long; a hash of
    the hash gives the other half of the lanes.  Each hash is a row only
    inside a task: sums are formed before any shuffle.
    """
    blank = F.col("piece") == _BLANK
    each = rows.select(*keys, F.explode("pieces").alias("piece")).withColumn("again", F.when(blank, F.lit(0).cast("bigint")).otherwise(F.xxhash64("piece")))
    lanes = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_PAIR))).alias(f"{h}{k}") for h in ("piece", "again") for k in range(32)]
    found = each.groupBy(*keys).agg(F.sum((~blank).cast("bigint")).alias("n"), F.sum(blank.cast("bigint")).alias("blanks"), *lanes)
    longs = F.array(*[f"{h}{k}" for h in ("piece", "again") for k in range(32)])
    return found.select(*keys, F.struct("n", "blanks", longs.alias("lanes")).alias("vector"))


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _put_together(high: Column, low: Column) -> Column:
    return F.shiftleft(_low(high), 32).bitwiseOR(_low(low))


def _combined(a: Column, b: Column, sign: int) -> Column:
    lanes = F.zip_with(a["lanes"], b["lanes"], lambda x, y: _put_together(_high(x) + sign * _high(y), _low(x) + sign * _low(y)))
    return F.struct((a["n"] + sign * b["n"]).alias("n"), (a["blanks"] + sign * b["blanks"]).alias("blanks"), lanes.alias("lanes"))


def plus(a: Column, b: Column) -> Column:
    """The vector of two multisets of paragraphs together; null is an empty one."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(_combined(a, b, 1))


def minus(a: Column, b: Column) -> Column:
    """The vector without the paragraphs of the other."""
    return F.when(b.isNull(), a).otherwise(_combined(a, b, -1))


def spelled(vector: Column) -> Column:
    """A vector as hex text: the counts, then the lanes two by two."""
    longs = F.concat(F.array(vector["n"], vector["blanks"]), vector["lanes"])
    return F.array_join(F.transform(longs, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def read_vector(fingerprint: Column) -> Column:
    """The vector of a fingerprint's text."""
    def half(at):
        return F.conv(F.substring(fingerprint, at, F.lit(8)), 16, 10).cast("bigint")

    def long(i):
        return _put_together(half(i * 16 + 1), half(i * 16 + 9))

    return F.struct(long(F.lit(0)).alias("n"), long(F.lit(1)).alias("blanks"), F.transform(F.sequence(F.lit(2), F.lit(_LONGS + 1)), long).alias("lanes"))


def square(vector: Column) -> Column:
    """Sum of squares of (twice a lane less the count) over all lanes."""
    def one(total, x):
        low, high = ((2 * f(x) - vector["n"]).cast("double") for f in (_low, _high))
        return total + low * low + high * high

    return F.aggregate(vector["lanes"], F.lit(0.0), one)


def likeness(a: Column, b: Column, a_square: Column, b_square: Column) -> Column:
    """Twice what two vectors share over what both have (0 to 1), estimated
    from 128 lanes: about 0.09 off where nothing is shared, exact where equal."""
    n = a["n"] - b["n"]

    def apart(f):
        return F.zip_with(a["lanes"], b["lanes"], lambda x, y: (2 * (f(x) - f(y)) - n).cast("double"))

    distance = F.aggregate(F.concat(apart(_low), apart(_high)), F.lit(0.0), lambda t, d: t + d * d)
    both = a_square + b_square
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / both)))


def _in_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """bucket, id, doc_id, text, guest: rows in buckets that follow each other
    by id, and in each bucket a guest, the first row of the next one (of the
    first, in the last).

    Bounds are approximate quantiles of the ids.  Rows of an id that fills
    several buckets are dealt over those by a hash of the text.
    """
    whole = F.col(doc_id).cast("bigint")
    rows = docs.select(F.coalesce(whole, F.lit(-(2**63))).alias("id"), whole.alias("doc_id"), text_of(text).alias("text"))
    wanted = max(1, min(MOST_BUCKETS, -(-rows.count() // ROWS_PER_BUCKET)))
    bounds = []
    if wanted > 1:
        bounds = rows.agg(F.percentile_approx("id", [k / wanted for k in range(1, wanted)], max(10_000, 10 * wanted)).alias("b")).first()["b"]
    low, high = (_count_below(bounds, F.col("id"), equal) for equal in (False, True))
    rows = rows.withColumn("bucket", low + F.pmod(F.xxhash64("text"), F.greatest(high - low, F.lit(1))).cast("int"))
    least = rows.groupBy("bucket").agg(F.min("id").alias("id"))  # MOST_BUCKETS rows at most
    firsts = rows.join(F.broadcast(least), ["bucket", "id"]).groupBy("bucket").agg(F.min(F.struct("id", "text", "doc_id")).alias("r"))
    everywhere = Window.partitionBy()  # over a row per bucket
    before = F.coalesce(F.lag("bucket").over(everywhere.orderBy("bucket")), F.max("bucket").over(everywhere))
    guests = staged(firsts.select(before.alias("bucket"), "r.id", "r.doc_id", "r.text", F.lit(True).alias("guest")), "guests")
    return rows.select("bucket", "id", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests)


def _count_below(bounds: list[int], value: Column, equal: bool) -> Column:
    """How many of the sorted bounds are below (or equal): a binary search."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def step(at, stride):
        bound = F.get(table, at + stride - 1)
        return F.when(bound <= value if equal else bound < value, at + stride).otherwise(at)

    return F.aggregate(strides, F.lit(0), step)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: int = 4) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, whose last
    ``floor(n_chars / part)`` code points are replaced by the first ones of the
    next document in order of id (after the last, the first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next.  The edited fingerprint comes from the text's by
    incremental update: the paragraphs from the cut on are replaced.

    A null text is empty; an empty text's one blank line is counted, and two
    texts without hashed paragraphs are alike (1).  A very long text is split
    into hashes within its task and summed there.  Rows without an id come
    first; rows of one id are in order of text, or of a hash of it where the id
    fills several buckets; equal rows follow each other.  A single row's next
    row is itself.  An empty table gives no rows, other columns take no part.

    One shuffle, by bucket, carries the texts; neighbours, sums and likeness
    need no other.
    """
    order = Window.partitionBy("bucket").orderBy("guest", "id", "text")
    rows = _in_order(docs, doc_id, text).select(
        "bucket", "doc_id", "guest", "text", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next"), F.length("text").cast("bigint").alias("n_chars")
    )
    cut = F.floor(F.col("n_chars") / part).cast("int")
    rows = rows.withColumn("kept", F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut)).withColumn("edited", F.concat("kept", F.substring("next", F.lit(1), cut)))
    # paragraphs that end before the cut are the same in both texts
    same = F.length("kept") - F.length(F.substring_index("kept", "\n", -1))
    rows = rows.withColumn("same", same)
    tail = [F.substring(c, F.col("same") + 1, F.length(c)) for c in ("text", "edited")]
    parts = [
        F.struct(F.lit(0).alias("kind"), F.when(F.col("same") > 0, pieces(F.substring("text", F.lit(1), F.col("same") - 1))).alias("pieces")),
        *[F.struct(F.lit(k).alias("kind"), pieces(t).alias("pieces")) for k, t in ((1, tail[0]), (2, tail[1]))],
    ]
    keys = ["bucket", "at", "doc_id", "guest", "n_chars", "edited_digest"]
    digest = F.unhex(F.sha2("edited", 256)).alias("edited_digest")
    opened = rows.select(*keys[:-1], digest, F.explode(F.array(*parts)).alias("part")).select(*keys, "part.kind", "part.pieces")
    summed = sums(opened, [*keys, "kind"])
    told = summed.groupBy(*keys).agg(F.collect_list(F.struct("kind", "vector")).alias("parts"))  # three at most
    head, old, new = (F.get(F.filter("parts", lambda p: p["kind"] == k), F.lit(0))["vector"] for k in range(3))
    told = (
        told.withColumn("head", head).withColumn("old", old).withColumn("new", new)
        .select(*keys, plus(F.col("head"), F.col("old")).alias("vector"), plus(F.col("head"), F.col("new")).alias("changed"))
        .withColumn("square", square(F.col("vector"))).withColumn("changed_square", square(F.col("changed")))
    )
    along = Window.partitionBy("bucket").orderBy("at")
    told = told.withColumn("follower", F.lead(F.struct("vector", "square")).over(along)).filter("NOT guest")
    return told.select(
        "doc_id", "n_chars", F.lower(F.hex("edited_digest")).alias("edited_sha256"),
        spelled(F.col("vector")).alias("fingerprint"), spelled(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("changed"), F.col("square"), F.col("changed_square")).alias("near_edited"),
        likeness(F.col("vector"), F.col("follower.vector"), F.col("square"), F.col("follower.square")).alias("near_next"),
    )
