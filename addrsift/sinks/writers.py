"""Writers: JSON records, GeoJSON features, single documents, cache tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookups import CACHE_SCHEMA
from ..session import pinned
from .views import geo_features, stats_json


def write_stats_json(stats: DataFrame, path: str, search_hits: bool = False, mode: str = "error") -> None:
    """Newline-delimited JSON records in count order, one file per range of the order."""
    stats_json(stats, search_hits).write.mode(mode).text(path)


def write_geojson(stats: DataFrame, path: str, search_hits: bool = False, mode: str = "error") -> None:
    """Newline-delimited GeoJSON features in count order."""
    features = geo_features(stats.orderBy(F.desc("count"), "ip"), search_hits)
    features.select(F.col("feature").alias("value")).write.mode(mode).text(path)


def write_groups(members: DataFrame, path: str, mode: str = "error") -> None:
    """Long-form group members as JSON records."""
    members.write.mode(mode).json(path)


def write_cache(cache: DataFrame, path: str, mode: str = "error") -> None:
    """Cache rows as Parquet by source; write to a new path, then switch readers to it."""
    cache.repartition("source", "ip").write.mode(mode).partitionBy("source").parquet(path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are whole: Spark's mark is written last."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The cache as the last whole version has it; empty before the first."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(f"{path}/version={versions[-1]}")


def write_store(cache: DataFrame, path: str) -> int:
    """Writes the cache as the next version and returns its number.

    A version counts once its mark is there, which is one step: readers see the version
    before or this one, and a run that breaks leaves the one before in place.  Two runs at
    once can't both write a number; the later one fails.
    """
    number = max(_versions(cache.sparkSession, path), default=0) + 1
    write_cache(cache, f"{path}/version={number}", "error")
    return number


def _write_document(records: DataFrame, head: str, tail: Callable[[int], str], path: str, mode: str) -> None:
    """Text parts that are one JSON document if joined by name.

    The sorted records are written with their places first; then all but the first get
    a comma, and head and tail their places before and after.  Nothing passes the driver
    but the count and the first place.
    """
    placed = pinned(records.withColumn("_at", F.monotonically_increasing_id()))
    told = placed.agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first")).first()
    ends = [(-1, head), ((1 << 63) - 1, tail(told.n))]
    rows = placed.select("_at", F.concat(F.when(F.col("_at") != told["first"], ",").otherwise(""), "value").alias("value"))
    both = rows.unionByName(records.sparkSession.createDataFrame(ends, "_at bigint, value string"))
    both.orderBy("_at").select("value").write.mode(mode).text(path)


def write_stats_document(stats: DataFrame, path: str, search_hits: bool = False, mode: str = "error") -> None:
    """One JSON document of a result of any size, as text parts in order of their names."""
    _write_document(stats_json(stats, search_hits), '{"statistics":[', lambda n: f'],"total":{n}}}', path, mode)


def write_geojson_document(stats: DataFrame, path: str, search_hits: bool = False, mode: str = "error") -> None:
    """One FeatureCollection of a result of any size, as text parts in order of their names."""
    features = geo_features(stats, search_hits).orderBy(F.desc("count"), "ip").select(F.col("feature").alias("value"))
    _write_document(features, '{"type":"FeatureCollection","features":[', lambda _: "]}", path, mode)
