"""What became of each file of a read: its size, what was read, whether its end was reached."""

from __future__ import annotations

import re
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import pinned
from .lines import CODECS, expanded, load_present

_FAILURES = (PySparkException, Py4JJavaError)


def _path(path: Column) -> Column:
    """Local paths are named in two ways; here they have one slash."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _listing(spark: SparkSession, paths: list[str], skip_failing: bool) -> DataFrame:
    """Files and sizes; no content is read, as no column of it is asked for.  Scans leave
    empty files out, so the names are those of the listing, which the driver holds anyway."""
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", skip_failing).load(paths)
    known = [(n.replace("file:///", "file:/", 1),) for n in sorted(files.inputFiles())]
    names = spark.createDataFrame(known, "file_path string")
    sizes = files.select(_path(F.col("_metadata.file_path")).alias("file_path"), F.col("length").alias("file_bytes"))
    return names.join(sizes.distinct(), "file_path", "left").withColumn("file_bytes", F.coalesce("file_bytes", F.lit(0).cast("bigint")))


def _texts(spark: SparkSession, paths: list[str], skip_failing: bool) -> DataFrame:
    reader = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", skip_failing).option("ignoreMissingFiles", skip_failing)
    return reader.text(paths)


def _counted(spark: SparkSession, paths: list[str], skip_failing: bool) -> DataFrame:
    rows = _texts(spark, paths, skip_failing).select(_path(F.col("_metadata.file_path")).alias("file_path"), F.octet_length("value").alias("n"))
    counted = rows.groupBy("file_path").agg(F.count("*").alias("n_lines"), (F.sum("n") + F.count("*")).alias("text_bytes"))
    return pinned(counted)


def _reason(problem: Exception) -> str:
    """The innermost cause that Spark names."""
    lines = str(problem).splitlines()
    causes = [x.split("Caused by: ", 1)[1] for x in lines if x.startswith("Caused by: ")] or lines[:1]
    return causes[-1][:200]


def _literal(path: str) -> str:
    """A path as it was found, for reading it again: no percent signs, and no glob but
    one sign for each that would begin one."""
    return re.sub(r"[][{}*?\\]", "?", unquote(path))


def _broken(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """The files that can't be read to their end, with the reason.

    All are tried at once, then halves of what fails, so the jobs are about
    twice the broken files times the logarithm of all.
    """
    try:
        _texts(spark, [_literal(f) for f in files], False).write.format("noop").mode("overwrite").save()
        return {}
    except _FAILURES as problem:
        if len(files) == 1:
            return {files[0]: _reason(problem)}
    half = len(files) // 2
    return _broken(spark, files[:half]) | _broken(spark, files[half:])


def codec_column(path: Column) -> Column:
    """Codec of a path by its extension, as :func:`codec_of` tells it."""
    of = F.lower(path)
    out = F.lit(None).cast("string")
    for extension, codec in CODECS.items():
        out = F.when(of.endswith(extension), codec).otherwise(out)
    return out


def file_account(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row for each file under ``paths``, whatever became of it: file_path, codec,
    file_bytes, n_lines, text_bytes (of the lines, their ends included), complete, error.

    A file is complete if Spark reads it to its end without an error; of others the
    lines before the break are counted, which are those that
    :func:`read_lines` gives.  A path that isn't there is a row with an error.  Where
    all files are sound this is one pass over them; else the compressed ones are
    read again in halves to find the broken ones.
    """
    paths = expanded(paths)
    files, present = load_present(spark, paths, True, _listing)
    absent = [(p, None, None, 0, 0, False, "no such file") for p in paths if p not in present]
    schema = "file_path string, codec string, file_bytes bigint, n_lines bigint, text_bytes bigint, complete boolean, error string"
    missing = spark.createDataFrame(absent, schema)
    if files is None:
        return missing
    broken: dict[str, str] = {}
    try:
        counts = _counted(spark, present, False)
    except _FAILURES:
        counts = _counted(spark, present, True)
        packed = files.where(codec_column(F.col("file_path")).isNotNull()).select("file_path")
        broken = _broken(spark, sorted({r.file_path for r in packed.collect()}))  # names only, as the listing has them
    wrong = spark.createDataFrame(list(broken.items()), "file_path string, error string")
    zero = F.lit(0).cast("bigint")
    return (
        files.join(counts, "file_path", "left").join(wrong, "file_path", "left")
        .select(
            "file_path", codec_column(F.col("file_path")).alias("codec"), "file_bytes", F.coalesce("n_lines", zero).alias("n_lines"),
            F.coalesce("text_bytes", zero).alias("text_bytes"), F.col("error").isNull().alias("complete"), "error",
        )
        .unionByName(missing)
    )
