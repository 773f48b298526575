"""Joins of addresses to networks: membership and longest prefix.

A prefix match is an equi-join once the prefix length is known: an address cut to
that many bits is looked up by (family, plen, hi, lo).  There are two ways to the
lengths, with the same result:

* every address is cut to each length that the tables really have (at most 33 for
  IPv4 and 129 for IPv6) and all of these are looked up at once;
* where there are many lengths, many networks and still more addresses, the lengths
  are searched by halving.  Markers among the networks say where longer ones
  exist, and every entry knows what all networks around it say, so an address makes
  6 lookups at most for IPv4 and 8 for IPv6.

Only hits go on; they are joined back to the rows, so a row stays whatever its
address is: null, repeated, or in no network.  Tables may have any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.networks import address_key, network_key, prefix_key
from ..session import pinned

_KEY = ["_family", "_plen", "_hi", "_lo"]


def keyed_networks(networks: DataFrame, column: str = "network") -> DataFrame:
    """Rows that name a network, with its key columns."""
    # exploding an array without nulls computes a key once and drops rows that have none
    key = F.explode(F.array_compact(F.array(network_key(column)))).alias("_k")
    parts = [F.col(f"_k.{name[1:]}").alias(name) for name in _KEY]
    return networks.select("*", key).select("*", *parts).drop("_k")


def _lengths(table: DataFrame) -> dict[int, list[int]]:
    """The prefix lengths of each family; one aggregate of at most 162 rows."""
    found = table.select("_family", "_plen").distinct().collect()
    return {f: sorted(r["_plen"] for r in found if r["_family"] == f) for f in (4, 6)}


def _ints(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<int>")


def cut_to_lengths(rows: DataFrame, lengths: dict[int, list[int]], up_to: Column | None = None) -> DataFrame:
    """Rows with ``_a`` (an address key), one for each length of its family, with the
    key of the address cut to it."""
    family = F.col("_a.family")
    plens = F.when(family == 4, _ints(lengths[4])).when(family == 6, _ints(lengths[6])).otherwise(_ints([]))
    if up_to is not None:
        plens = F.filter(plens, lambda p: p <= up_to)
    kept = [c for c in rows.columns if c != "_a"]
    return (
        rows.select(*kept, "_a", F.explode(plens).alias("_len"))
        .select(*kept, F.col("_len").alias("_plen"), prefix_key("_a", "_len").alias("_c"))
        .select(*kept, F.col("_c.family").alias("_family"), "_plen", F.col("_c.hi").alias("_hi"), F.col("_c.lo").alias("_lo"))
    )


def _halvings(k: int) -> dict[int, list[int]]:
    """For each place among k sorted lengths, the places before it that halving asks
    on its way there."""
    asked = {}
    for place in range(k):
        low, high, before = 0, k - 1, []
        while low <= high:
            mid = (low + high) // 2
            if mid < place:
                before.append(mid)
            if mid <= place:
                low = mid + 1
            else:
                high = mid - 1
        asked[place] = before
    return asked


def marked(table: DataFrame, lengths: dict[int, list[int]]) -> DataFrame:
    """Keys of the networks and, with a number, of the markers that lead to them."""
    keys = table.select(*_KEY)
    parts = [keys]
    for family, own in lengths.items():
        leads = {own[place]: [own[m] for m in before] for place, before in _halvings(len(own)).items() if before}
        if leads:
            of = F.create_map(*[x for plen, before in leads.items() for x in (F.lit(plen), _ints(before))])
            here = keys.where(F.col("_family") == family).select(
                F.struct(F.col("_family").alias("family"), F.col("_hi").alias("hi"), F.col("_lo").alias("lo")).alias("_a"), F.explode(of[F.col("_plen")]).alias("_len")
            )
            cut = here.select(F.col("_len").alias("_plen"), prefix_key("_a", "_len").alias("_c"))
            parts.append(cut.select(F.col("_c.family").alias("_family"), "_plen", F.col("_c.hi").alias("_hi"), F.col("_c.lo").alias("_lo")))
    entries = parts[0]
    for more in parts[1:]:
        entries = entries.unionByName(more)
    return pinned(entries.distinct().withColumn("_entry", F.monotonically_increasing_id()))


def halved(ips: DataFrame, entries: DataFrame, lengths: dict[int, list[int]]) -> DataFrame:
    """(ip, _entry): the longest entry that holds an address, found by halving.

    Each turn looks every address up once.  One that has ended early is given a key
    of its own that nothing has, so that such rows don't meet in one task.
    """
    found = None
    for family, own in lengths.items():
        if not own:
            continue
        state = ips.select("ip", address_key("ip").alias("_a")).where(F.col("_a.family") == family).select(
            "ip", "_a", F.lit(0).alias("low"), F.lit(len(own) - 1).alias("high"), F.lit(None).cast("bigint").alias("best")
        )
        table = entries.where(F.col("_family") == family).select("_plen", "_hi", "_lo", "_entry")
        for _ in range(len(own).bit_length()):
            active = F.col("low") <= F.col("high")
            mid = F.when(active, F.shiftright(F.col("low") + F.col("high"), 1))
            asked = state.withColumn("mid", mid).withColumn("_len", F.coalesce(F.get(_ints(own), F.col("mid")), F.lit(0)))
            cut = asked.withColumn("_c", prefix_key("_a", "_len")).select(
                "ip", "_a", "low", "high", "best", "mid", F.coalesce(F.when(F.col("mid").isNotNull(), F.col("_len")), F.lit(-1)).alias("_plen"),
                F.when(F.col("mid").isNull(), F.xxhash64("ip")).otherwise(F.col("_c.hi")).alias("_hi"), F.col("_c.lo").alias("_lo"),
            )
            met = cut.join(table, ["_plen", "_hi", "_lo"], "left")
            hit, going = F.col("_entry").isNotNull(), F.col("mid").isNotNull()
            state = met.select(
                "ip", "_a", F.when(hit, F.col("mid") + 1).otherwise(F.col("low")).alias("low"),
                F.when(going & ~hit, F.col("mid") - 1).otherwise(F.col("high")).alias("high"), F.coalesce("_entry", "best").alias("best"),
            )
        told = state.where("best IS NOT NULL").select("ip", F.col("best").alias("_entry"))
        found = told if found is None else found.unionByName(told)
    return found


#: Fewer lengths, or networks that may be broadcast, are looked up at once: halving would
#: save little there.  Measured with a million addresses and 300,000 networks of 33 lengths:
#: 39 s at once and 29 s by halving where both are shuffled, 14 s and 24 s where the
#: networks are broadcast.
MANY_LENGTHS, MANY_NETWORKS = 7, 200_000


def _found(ips: DataFrame, table: DataFrame, results: list[Column], halve: bool | None) -> DataFrame:
    """ip and what the networks say about it, for distinct addresses in any.

    Spark broadcasts the table if its bytes allow; else addresses of a network that
    holds very many of them are split by the adaptive join.
    """
    lengths = _lengths(table)
    if halve is None:
        halve = max(map(len, lengths.values())) >= MANY_LENGTHS and (n := table.count()) > MANY_NETWORKS and ips.count() > n
    if not halve or not any(lengths.values()):
        candidates = cut_to_lengths(ips.select("ip", address_key("ip").alias("_a")), lengths)
        return candidates.join(table, _KEY).groupBy("ip").agg(*results)
    entries = marked(table, lengths)
    own = F.struct(F.col("_family").alias("family"), F.col("_hi").alias("hi"), F.col("_lo").alias("lo"))
    around = cut_to_lengths(entries.select("_entry", F.col("_plen").alias("_most"), own.alias("_a")), lengths, F.col("_most"))
    said = pinned(around.join(table, _KEY).groupBy("_entry").agg(*results))
    return halved(ips, entries, lengths).join(said, "_entry").drop("_entry")


GEO_COLUMNS = {
    "cc": "string", "country": "string", "city": "string", "latitude": "double",
    "longitude": "double", "asn": "string", "org": "string",
}


def _tagged(tables: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, list[Column]]:
    """Keyed networks of several tables in one, and what an address gets of each.

    ``tables`` maps a tag to (blocks, value columns): the values of the longest
    prefix win.  Threat lists come under the tag ``lists`` and are gathered.
    """
    parts: list[tuple[str, DataFrame]] = []
    results: list[Column] = []
    for tag, (blocks, values) in tables.items():
        own = F.col("_list") if tag == "lists" else F.struct(*values)
        keyed = keyed_networks(blocks).select(*_KEY, own.alias(tag))
        parts.append((tag, keyed))
        if tag == "lists":
            results.append(F.flatten(F.collect_list(tag)).alias(tag))
        else:
            results.append(F.max_by(tag, F.when(F.col(tag).isNotNull(), F.col("_plen"))).alias(tag))
    union = parts[0][1]
    for _, keyed in parts[1:]:
        union = union.unionByName(keyed, allowMissingColumns=True)
    merged = [(F.collect_set(t) if t == "lists" else F.min(t)).alias(t) for t, _ in parts]
    return union.groupBy(*_KEY).agg(*merged), results


def with_networks(
    rows: DataFrame,
    geo_blocks: DataFrame | None = None,
    asn_blocks: DataFrame | None = None,
    threats: DataFrame | None = None,
    halve: bool | None = None,
) -> DataFrame:
    """Add what places, networks and threat lists say about ``ip`` in one lookup.

    Adds cc, country, city, latitude, longitude, asn and org if there are blocks,
    and ``lists``, the sorted names of the lists that hold the address, if there
    are threats.  ``geo_blocks`` may carry asn and org as well; where
    ``asn_blocks`` knows the address its values take their place.  A numeric asn
    gets the prefix ``AS``.  Threat entries without a prefix are compared as text.
    The rows, mostly one per address, are written once, as they are used twice.
    ``halve`` says how lengths are looked up (see the module); without it what is
    counted decides.
    """
    rows = pinned(rows)
    tables: dict[str, tuple[DataFrame, list[str]]] = {}
    found: dict[str, list[Column]] = {name: [] for name in GEO_COLUMNS}
    for tag, blocks in (("_asn", asn_blocks), ("_geo", geo_blocks)):
        if blocks is None:
            continue
        known = [c for c in GEO_COLUMNS if c in blocks.columns]
        if "asn" in known and blocks.schema["asn"].dataType.typeName() != "string":
            blocks = blocks.withColumn("asn", F.concat(F.lit("AS"), F.col("asn").cast("string")))
        tables[tag] = (blocks.select("network", *known), known)
        for c in known:
            found[c].append(F.col(f"{tag}.{c}"))
    out = rows
    exact = None
    if threats is not None:
        is_net = F.col("network").contains("/")
        tables["lists"] = (threats.where(is_net).select("network", F.col("list_name").alias("_list")), [])
        exact = threats.where(~is_net).groupBy(F.col("network").alias("ip")).agg(F.collect_set("list_name").alias("_exact"))
    if tables:
        keyed, results = _tagged(tables)
        table = pinned(keyed)
        ips = rows.select("ip").where(F.col("ip").isNotNull()).distinct()
        out = rows.join(_found(ips, table, results, halve), "ip", "left")
    columns = list(rows.columns)
    added = []
    if geo_blocks is not None or asn_blocks is not None:
        added += [F.coalesce(*found[c], F.lit(None)).cast(t).alias(c) for c, t in GEO_COLUMNS.items()]
    if exact is not None:
        none = F.array().cast("array<string>")
        out = out.join(exact, "ip", "left")
        added.append(F.array_sort(F.array_union(F.coalesce("_exact", none), F.coalesce("lists", none))).alias("lists"))
    return out.select(*columns, *added)


def with_geo(stats: DataFrame, geo_blocks: DataFrame | None, asn_blocks: DataFrame | None = None) -> DataFrame:
    """Add cc, country, city, latitude, longitude, asn and org; see :func:`with_networks`."""
    if geo_blocks is None and asn_blocks is None:
        return stats.select("*", *[F.lit(None).cast(t).alias(c) for c, t in GEO_COLUMNS.items()])
    return with_networks(stats, geo_blocks, asn_blocks)


def with_threat_lists(stats: DataFrame, threats: DataFrame) -> DataFrame:
    """Add ``lists``: the sorted names of the lists that hold ``ip``."""
    return with_networks(stats, threats=threats)


def wanted_threats(threats: DataFrame, lists: list[str] | None = None) -> DataFrame:
    return threats.where(F.col("list_name").isin(P.THREAT_LISTS if lists is None else lists))


def threat_flags(lists: list[str] | None = None) -> list[Column]:
    """One Yes/No column per list, from the column ``lists``."""
    return [
        F.when(F.array_contains("lists", n), "Yes").otherwise("No").alias(n)
        for n in (P.THREAT_LISTS if lists is None else lists)
    ]


def with_threat_flags(stats: DataFrame, threats: DataFrame, lists: list[str] | None = None) -> DataFrame:
    """Add one Yes/No column per list."""
    return with_threat_lists(stats, wanted_threats(threats, lists)).select(*stats.columns, *threat_flags(lists))
