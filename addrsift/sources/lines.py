"""Line sources: text files of any supported codec, or a string column.

Every source gives the same columns: ``value``, ``file_path``, ``block_start``
(byte offset of the file split) and ``row_id``, which grows with the position of
a line inside its file.  Lines of different files have no order among each other
beyond being stable for one read.
"""

from __future__ import annotations

import os
import uuid
import warnings
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, pinned

LINE_COLUMNS = ["value", "file_path", "block_start", "row_id"]
#: Under this key the column file_path says which paths its lines were read from.
PATHS = "text_paths"
CODECS = {".gz": "gzip", ".bz2": "bzip2", ".xz": "xz"}


def codec_of(path: str) -> str | None:
    """Codec by file extension, any case; None for plain text."""
    return CODECS.get(os.path.splitext(path.lower())[1])


def from_lines(
    df: DataFrame, column: str, order: str | Column | None = None, name: str = "(stdin)"
) -> DataFrame:
    """Lines from any DataFrame with a string column.

    ``order`` is an integer column that gives the input order; without it the
    order of the rows as read is used.
    """
    if order is None:
        row_id = F.monotonically_increasing_id()
    else:
        row_id = (F.col(order) if isinstance(order, str) else order).cast("bigint")
    return df.select(
        F.col(column).alias("value"),
        F.lit(name).alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"),
        row_id.alias("row_id"),
    )


def read_lines(
    spark: SparkSession,
    paths: str | Iterable[str],
    skip_failing: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Lines of files, directories and globs in one scan.

    gzip and bzip2 are decoded by extension; Spark has no codec for xz.  Missing
    paths are reported and skipped, corrupt files skipped from where they break
    (:func:`file_account` tells which), unless ``skip_failing`` is off.  One gzip file
    is one task; ``partitions`` redistributes the lines after the scan where a few
    such files hold most of the data.
    """
    lines, present = load_present(spark, expanded(paths), skip_failing, _text_reader)
    if lines is None:
        return spark.createDataFrame(
            [], "value string, file_path string, block_start bigint, row_id bigint"
        )
    read_from = {PATHS: present, "skip_failing": skip_failing}
    lines = lines.select(
        "value", F.col("file_path").alias("file_path", metadata=read_from), "block_start",
        F.monotonically_increasing_id().alias("row_id"),
    )
    return lines.repartition(partitions) if partitions else lines


def _text_reader(spark: SparkSession, paths: list[str], skip_failing: bool) -> DataFrame:
    raw = (
        spark.read.option("lineSep", "\n")
        .option("ignoreCorruptFiles", skip_failing)
        .option("ignoreMissingFiles", skip_failing)
        .text(paths)
    )
    # compressed files lose one CR per line, plain ones keep it
    return raw.selectExpr(
        r"CASE WHEN endswith(value, '\r') AND lower(_metadata.file_path) RLIKE r'\.(gz|bz2)$'"
        " THEN substr(value, 1, length(value) - 1) ELSE value END AS value",
        "_metadata.file_path AS file_path",
        "_metadata.file_block_start AS block_start",
    )


def expanded(paths: str | Iterable[str]) -> list[str]:
    """The paths, ``~`` at their start replaced."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return [os.path.expanduser(p) if p.startswith("~") else p for p in paths]


def load_present(spark, paths, skip_failing, reader):
    """One read of all paths, and the paths; if one is missing, leave it out with a warning."""
    try:
        return reader(spark, paths, skip_failing), paths
    except AnalysisException as problem:
        if not skip_failing or "PATH_NOT_FOUND" not in str(problem):
            raise
    present = []
    for path in paths:
        try:
            reader(spark, [path], skip_failing)
            present.append(path)
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            warnings.warn(f"skipped, no such file: {path}", stacklevel=3)
    return (reader(spark, present, skip_failing) if present else None), present


def file_heads(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` lines of each file: value, file_path and rank, written once.

    For lines of :func:`read_lines` the files are opened once more, each as one
    task that ends as soon as it has its lines, so little is read whatever the
    size of the files.  Lines of a column have no beginning to read: their row ids
    alone are scanned for the least ones, and then those rows are taken.
    """
    found = lines.schema["file_path"].metadata
    if PATHS in found:
        return _heads_of_files(lines.sparkSession, found[PATHS], found["skip_failing"], n)
    order = Window.partitionBy("file_path").orderBy("row_id")
    ids = lines.select("file_path", "row_id", F.row_number().over(order).alias("rank")).where(F.col("rank") <= n)
    last = lines.groupBy("file_path").agg(F.max("row_id").alias("last_id"))
    least = pinned(ids.join(last, "file_path"))
    return pinned(
        lines.join(least, ["file_path", "row_id"]).select("value", "file_path", "rank", "row_id", "last_id")
    )


def _heads_of_files(spark: SparkSession, paths: list[str], skip_failing: bool, n: int) -> DataFrame:
    reading = spark.newSession()  # for its settings, by which a task has one file
    for key in ("maxPartitionBytes", "openCostInBytes"):
        reading.conf.set(f"spark.sql.files.{key}", str(1 << 50))
    lines = _first_of_each_task(_text_reader(reading, paths, skip_failing).select("value", "file_path"), n)
    rank = (F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")
    path = f"{checkpoint_dir(spark)}/heads-{uuid.uuid4().hex}"
    lines.withColumn("rank", rank).write.parquet(path)
    none = F.lit(None).cast("bigint")
    return spark.read.schema("value string, file_path string, rank int").parquet(path).select("*", none.alias("row_id"), none.alias("last_id"))


def _first_of_each_task(df: DataFrame, n: int) -> DataFrame:
    """The first half of ``limit``: n rows of each task, which then stops reading.

    DataFrames offer only the whole of it.  A Python function can't do this, as
    Spark feeds it all input even if it has returned.
    """
    session = df.sparkSession
    plan = df.limit(n)._jdf.queryExecution().analyzed().child()
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)


def split_table(lines: DataFrame) -> DataFrame:
    """One row per file split: first_id, last_id, n_rows, and first_line, the 1-based
    number of its first line in the file."""
    splits = lines.groupBy("file_path", "block_start").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("row_id").alias("first_id"), F.max("row_id").alias("last_id")
    )
    before = Window.partitionBy("file_path").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1
    )
    return splits.withColumn("first_line", F.coalesce(F.sum("n_rows").over(before), F.lit(0)) + 1)


def split_first(row_id: Column, first_id: Column, last_id: Column) -> Column:
    """Distance of a line from the first of its split, as an earlier pass saw it.

    Row ids hang on how Spark cuts files into tasks.  A line outside the rows that
    the earlier pass saw means that the cut has changed in between: an error.
    """
    at = row_id - first_id
    wrong = first_id.isNull() | (at < 0) | F.coalesce(row_id > last_id, F.lit(False))
    return F.when(wrong, F.raise_error(F.lit("files were cut otherwise than in the pass before")).cast("bigint")).otherwise(at)


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_number``, 1-based per file.

    One pass counts the lines of every file split; the running sums of that small
    table give each split its first number, and a line adds its distance from the
    first row of its split.  No sort of lines, no window over a file.  If Spark cuts
    the files otherwise in the second pass that is an error, and no line is lost.
    """
    table = pinned(split_table(lines))
    place = split_first(F.col("row_id"), F.col("first_id"), F.col("last_id"))
    return (
        lines.join(table, ["file_path", "block_start"], "left")
        .withColumn("line_number", place + F.col("first_line"))
        .select(*lines.columns, "line_number")
    )
