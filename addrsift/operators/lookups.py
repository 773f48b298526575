"""Lookups by address: host names, cached results, user functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pinned

CACHE_SCHEMA = "ip string, source string, cached_at bigint, data map<string,string>"


def with_hostname(stats: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``rdns`` from ``names(ip, hostname)``; empty names and echoes of the address go.

    Of several names of an address the smallest is taken.
    """
    usable = names.where((F.col("hostname") != "") & (F.col("hostname") != F.col("ip")))
    return stats.join(
        usable.groupBy("ip").agg(F.min("hostname").alias("rdns")), "ip", "left"
    )


def enrich_entries(entries: DataFrame, lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Look every distinct address up once and attach the result to all its entries.

    ``lookup`` maps a table of distinct ``ip`` to one row per ``ip``.  Its result is
    written once; Spark broadcasts it if its bytes allow and else splits the entries
    of a frequent address.
    """
    found = pinned(lookup(entries.select("ip").distinct()))
    return entries.join(found, "ip", "left")


def not_enriched(stats: DataFrame, enriched: DataFrame, marker: str) -> DataFrame:
    """Addresses without a row in ``enriched`` that has the ``marker`` field."""
    done = enriched.where(F.col(marker).isNotNull()).select("ip")
    return stats.join(done, "ip", "left_anti")


def fresh_cache(cache: DataFrame, now: int | Column, ttl_hours: int) -> DataFrame:
    """Newest cached row per (ip, source) whose age in whole hours is within the limit."""
    now = now if isinstance(now, Column) else F.lit(int(now)).cast("bigint")
    age = F.floor((now - F.col("cached_at")) / 3600)
    return (
        cache.where(age <= ttl_hours)
        .groupBy("ip", "source")
        .agg(F.max("cached_at").alias("cached_at"), F.max_by("data", F.struct("cached_at", F.to_json("data"))).alias("data"))
    )


def cache_misses(ips: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """Addresses the fresh cache does not know for ``source``."""
    return ips.select("ip").join(fresh.where(F.col("source") == source), "ip", "left_anti")


def merge_cache(fresh: DataFrame, fetched: DataFrame) -> DataFrame:
    """Cache contents after a run: the newest row per (ip, source); empty results are not kept."""
    usable = fetched.where(F.size("data") > 0)
    both = fresh.select("ip", "source", "cached_at", "data").unionByName(
        usable.select("ip", "source", "cached_at", "data")
    )
    return both.groupBy("ip", "source").agg(
        F.max("cached_at").alias("cached_at"), F.max_by("data", F.struct("cached_at", F.to_json("data"))).alias("data")
    )


def merge_data(first: Column, second: Column) -> Column:
    """Map of both maps where the second wins; a null map counts as empty."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    first, second = F.coalesce(first, empty), F.coalesce(second, empty)
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def usable_providers(providers: DataFrame) -> DataFrame:
    """Provider rows that are enabled and have a key and an address template."""
    return providers.where(
        F.col("enabled") & (F.coalesce("api_key", F.lit("")) != "")
        & (F.coalesce("url_template", F.lit("")) != "")
    )


def fetch(
    ips: DataFrame,
    source: str,
    lookup: Callable[[str], Mapping[str, str]],
    now: int,
    concurrency: int = 8,
    pause_seconds: float = 0.0,
) -> DataFrame:
    """Run a user function once per distinct address.

    Gives (ip, source, cached_at, data, error).  A failing address is reported in
    ``error`` and the others go on.  ``concurrency`` is the number of partitions, so
    it caps calls at a time; ``pause_seconds`` is the pause after each call.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, errors = [], []
            for ip in batch["ip"]:
                try:
                    data.append({str(k): str(v) for k, v in lookup(ip).items()})
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001 - any failure is that row's result
                    data.append({})
                    errors.append(f"{type(problem).__name__}: {problem}")
                if pause_seconds:
                    time.sleep(pause_seconds)
            yield pd.DataFrame(
                {"ip": batch["ip"], "source": source, "cached_at": now, "data": data, "error": errors}
            )

    distinct = ips.select("ip").distinct().repartition(concurrency, "ip")
    return distinct.mapInPandas(run, f"{CACHE_SCHEMA}, error string")


def lookup_cached(
    ips: DataFrame,
    cache: DataFrame,
    source: str,
    lookup: Callable[[str], Mapping[str, str]],
    now: int,
    ttl_hours: int = 24,
    concurrency: int = 8,
    pause_seconds: float = 0.0,
) -> DataFrame:
    """Results for all addresses: fresh cache rows first, the rest from ``lookup``.

    The distinct addresses are written first, as hits and misses both start from them,
    and so is what was fetched: the service is called once per address, however often
    the result is used.
    """
    wanted = pinned(ips.select("ip").distinct())
    fresh = fresh_cache(cache.where(F.col("source") == source), now, ttl_hours)
    hits = fresh.join(wanted, "ip", "left_semi").select(
        "ip", "source", "cached_at", "data",
        F.lit(None).cast("string").alias("error"), F.lit(True).alias("from_cache"),
    )
    fetched = pinned(
        fetch(cache_misses(wanted, fresh, source), source, lookup, now, concurrency, pause_seconds)
    )
    return hits.unionByName(fetched.withColumn("from_cache", F.lit(False)))
