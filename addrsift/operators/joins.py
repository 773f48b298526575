"""Joins and sorts that stay safe when a side is skewed, outgrows a broadcast or has long texts as keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "left") -> DataFrame:
    """Join of a left side with known hot keys to a right side with one row per key.

    ``spread`` splits every left key over ``SALTS`` sub-keys against copies of the
    right row, so one hot key cannot land in a single task.  Where no key is known
    to be hot a plain join does: Spark broadcasts by bytes and splits skewed keys.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


#: Characters of a text by which rows are dealt in its order.
PREFIX = 256


def sorted_by_text(df: DataFrame, text: str, *before: Column) -> DataFrame:
    """Rows in the order of ``before``, then of ``text``, which may be of any length.

    A plain sort takes samples of whole keys to the driver.  Here they are cut: rows are
    dealt by ``before`` and a prefix, and compared as a whole in their partition, where
    rows that agree in both meet.  For tables with one row per text.
    """
    return df.repartitionByRange(*before, F.substring(text, 1, PREFIX)).sortWithinPartitions(*before, text)
