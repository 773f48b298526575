"""What several operators share: staged tables, whole rows, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: White space between words, as fixed by the contracts: ASCII space and 0x09-0x0D.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    Cuts the lineage: rows are computed once, and what was numbered or drawn
    stays as it was written, whichever executors are lost later.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def whole_rows(df: DataFrame, **extra: Column) -> DataFrame:
    """All columns as one struct ``_row`` beside the named ones, so that no
    name of the caller's can clash with an operator's own."""
    return df.select(F.struct("*").alias("_row"), *[c.alias(n) for n, c in extra.items()])


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
