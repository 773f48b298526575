"""The changing result of a stream in update mode, kept as the rows that each batch changed.

Every batch writes only what it changed, to a folder under its number; writing it again
after a failure replaces the same rows by themselves.  A key's row is that of its latest
batch.  Now and then the batches so far are merged to a state, which readers then start from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(path: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` of a query in update mode."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")

    return write


def _parts(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise


def _rows(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """All rows that may be current, with the number of their batch, and the largest number."""
    state, changes = _parts(spark, f"{path}/state"), _parts(spark, f"{path}/changes")
    if changes is None:
        raise ValueError(f"no batch has been written to {path}")
    upto = -1
    if state is not None:
        upto = state.agg(F.max("upto")).first()[0]
        changes = changes.where(F.col("batch") > upto)
        merged = state.where(F.col("upto") == upto).withColumnRenamed("upto", "batch")
        changes = changes.unionByName(merged)
    last = changes.agg(F.max("batch")).first()[0]
    return changes, upto if last is None else last


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest row of each key."""
    rows, _ = _rows(spark, path)
    values = [c for c in rows.columns if c not in ("batch", *keys)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_r")).select(*keys, "_r.*")


def merge(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Writes the state after all batches so far and returns the number of the last.

    Folders of batches and states up to it may then be deleted; readers of before go on
    with the ones they have listed.
    """
    rows, last = _rows(spark, path)
    current(spark, path, keys).write.mode("overwrite").parquet(f"{path}/state/upto={last}")
    return last
