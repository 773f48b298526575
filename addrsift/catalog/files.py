"""Queries over text files, which Spark writes from the given tables and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import correlate as C
from ..operators import entries as E
from ..session import checkpoint_dir, pinned
from ..sinks.writers import write_geojson_document, write_stats_document
from ..sources.accounts import file_account
from ..sources.lines import codec_of, number_lines, read_lines
from .base import query
from .checks import HITS, LINES, with_
from .enrichment import GEO_BODY, PLACED, STATS_BODY, placed_stats
from .inputs import check_sql, csv_lines, frame

#: Lines of one file of the logs.
FILE_LINES = 2000
_CHUNKS = f"chunks AS (SELECT *, event_id // {FILE_LINES} AS chunk FROM log_lines)"


def _new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def _logs(spark: SparkSession, sf_dir: str, *codecs: str) -> str:
    """A new folder with the log lines as files of one codec each, in order."""
    path = _new_folder(spark)
    rows = frame(spark, sf_dir, "log_lines").select(F.floor(F.col("event_id") / FILE_LINES).alias("chunk"), "event_id", "line")
    for codec in codecs:
        (
            rows.repartition("chunk").sortWithinPartitions("chunk", "event_id").select("chunk", "line")
            .write.partitionBy("chunk").option("compression", codec).text(f"{path}/{codec}")
        )
    return path


def _with_chunk(lines: DataFrame) -> DataFrame:
    return lines.withColumn("chunk", F.regexp_extract("file_path", r"chunk=(\d+)", 1).cast("bigint"))


_READ = with_(LINES, _CHUNKS, "SELECT chunk, line, count(*) AS n FROM chunks GROUP BY ALL")


def _lines_of_chunks(lines: DataFrame) -> DataFrame:
    return _with_chunk(lines).groupBy("chunk", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(_READ)
def read_plain(spark, sf_dir):
    """Lines of plain files under a folder."""
    return _lines_of_chunks(read_lines(spark, _logs(spark, sf_dir, "none") + "/none"))


@query(_READ)
def read_gzip(spark, sf_dir):
    """Lines of gzip files named by a glob."""
    return _lines_of_chunks(read_lines(spark, _logs(spark, sf_dir, "gzip") + "/gzip/chunk=*/*.gz"))


@query(_READ)
def read_bzip2(spark, sf_dir):
    """Lines of bzip2 files named by two globs, beside a path that isn't there."""
    path = _logs(spark, sf_dir, "bzip2")
    return _lines_of_chunks(read_lines(spark, [f"{path}/bzip2/chunk=*[02468]", f"{path}/absent", f"{path}/bzip2/chunk=*[13579]"]))


@query(with_(LINES, HITS, f"""SELECT ip, codec, count(*) AS "count", count(DISTINCT event_id // {FILE_LINES}) AS files
FROM hits, (VALUES ('gzip'), ('bzip2'), (NULL)) c(codec) GROUP BY ALL"""))
def union_of_files(spark, sf_dir):
    """Entries per address and codec of one read over files of all codecs."""
    entries = E.extract_entries(read_lines(spark, _logs(spark, sf_dir, "none", "gzip", "bzip2") + "/*/chunk=*"))
    codec = F.regexp_extract("filename", r"\.(gz|bz2)$", 1)
    named = F.when(codec == "gz", codec_of("x.gz")).when(codec == "bz2", codec_of("x.bz2"))
    return entries.groupBy("ip", named.alias("codec")).agg(F.count(F.lit(1)).alias("count"), F.count_distinct("filename").alias("files"))


@query(with_(LINES, _CHUNKS, """SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY event_id) AS line_number, line FROM chunks"""))
def numbered_lines(spark, sf_dir):
    """Line numbers of files that Spark may cut into several splits."""
    lines = number_lines(read_lines(spark, _logs(spark, sf_dir, "none") + "/none"))
    return _with_chunk(lines).select("chunk", "line_number", F.col("value").alias("line"))


_CUT = 1_000_000_000


def _cut_file(spark: SparkSession, folder: str) -> None:
    """Beside the files, one that ends in the middle of another's bytes."""
    hadoop, io = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.commons.io.IOUtils
    source = hadoop.Path(f"{folder}/chunk=0/*.gz")
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(fs.globStatus(source)[0].getPath())
    whole = io.toByteArray(stream)
    stream.close()
    out = fs.create(hadoop.Path(f"{folder}/chunk={_CUT}/cut.txt.gz"))
    out.write(whole[: len(whole) // 2])
    out.close()


@query(with_(LINES, _CHUNKS, f"""SELECT chunk, 'gzip' AS codec, count(*) AS n_lines, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS text_bytes, true AS complete
FROM chunks GROUP BY chunk UNION ALL SELECT {_CUT}, 'gzip', NULL, NULL, false"""))
def broken_files(spark, sf_dir):
    """The account of gzip files, of which one ends too early."""
    folder = _logs(spark, sf_dir, "gzip") + "/gzip"
    _cut_file(spark, folder)
    account = _with_chunk(file_account(spark, folder))
    return account.select("chunk", "codec", *[F.when(F.col("complete"), F.col(c)).alias(c) for c in ("n_lines", "text_bytes")], "complete")


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the delimited files, written one by one under their names."""
    path = _new_folder(spark)
    rows = csv_lines(spark, sf_dir).withColumnRenamed("file_path", "name")
    rows.repartition("name").sortWithinPartitions("name", "row_id").select("name", "value").write.partitionBy("name").text(path)
    return read_lines(spark, path)


def _name() -> Column:
    return F.regexp_extract("file_path", "name=([^/]*)", 1)


ROWS = check_sql("csv_rows")


@query(with_(ROWS, """SELECT file_path AS name, d AS delimiter, CAST(5 AS INTEGER) AS field_count, true AS has_header,
  'Time' || d || 'IP' || d || 'User' || d || ' Host ' || d || 'action' AS header_line FROM csv_rows GROUP BY ALL"""))
def layout_of_files(spark, sf_dir):
    """Layouts of files, of which only the beginnings are read."""
    return C.csv_layouts(_tables(spark, sf_dir)).select(_name().alias("name"), "delimiter", "field_count", "has_header", "header_line")


@query(with_(ROWS, """SELECT file_path AS name, ip, lower(user_name) AS correlation, count(*) AS "count" FROM csv_rows GROUP BY ALL"""))
def correlate_files(spark, sf_dir):
    """Users of addresses over files that are read once, beside their beginnings."""
    lines, value = C.correlate(_tables(spark, sf_dir), user="user")
    entries = E.extract_entries(lines, correlation=value)
    return entries.groupBy(F.regexp_extract("filename", "name=([^/]*)", 1).alias("name"), "ip", "correlation").agg(F.count(F.lit(1)).alias("count"))


def _in_order(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a document's parts, numbered through all parts in order of their names."""
    lines = pinned(number_lines(read_lines(spark, path)).select("file_path", "line_number", "value"))
    sizes = lines.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))  # a row per part
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(sizes.select("file_path", before.alias("before")), "file_path").select(
        (F.col("before") + F.col("line_number")).alias("line_number"), "value"
    )


def _document_check(head: str, tail: str, body: str) -> str:
    return f"""SELECT 1 AS line_number, '{head}' AS value UNION ALL
SELECT rn + 1, CASE WHEN rn > 1 THEN ',' ELSE '' END || value FROM ({body})
UNION ALL SELECT count(*) + 2, {tail} FROM ({body})"""


@query(with_(PLACED, _document_check('{"statistics":[', """'],"total":' || count(*) || '}'""", STATS_BODY)))
def stats_document(spark, sf_dir):
    """One JSON document in parts."""
    write_stats_document(placed_stats(spark, sf_dir), path := _new_folder(spark))
    return _in_order(spark, path)


@query(with_(PLACED, _document_check('{"type":"FeatureCollection","features":[', "']}'", GEO_BODY)))
def geojson_document(spark, sf_dir):
    """One FeatureCollection in parts."""
    write_geojson_document(placed_stats(spark, sf_dir), path := _new_folder(spark))
    return _in_order(spark, path)
