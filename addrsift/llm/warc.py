r"""WARC archives: captures to records, records to files, and back.

A capture is a response or revisit with its request and metadata, which name it
in WARC-Concurrent-To.  Spark's text writer makes the files, with the blank
lines after a record as its separator; its reader cuts them at the version
line, so files of any size and store are streamed.  A payload that holds a
version line itself is put together again by its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"

RECORDS = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, warc_date string, "
    "content_type string, block binary, payload binary, payload_bytes bigint, payload_digest string"
)
#: Types that stand for a capture; others accompany one.
HEADS = ("response", "revisit", "resource")


def record_uri(*parts: Column) -> Column:
    """A urn of the values of the columns; equal rows have equal ones."""
    told = F.to_json(F.struct(*[p.cast("string").alias(f"p{i}") for i, p in enumerate(parts)]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(told), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: str | Column, fields: dict[str, Column], block: Column) -> Column:
    """A whole record; fields that are null are left out."""
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.array_join(F.filter(F.array(*lines), lambda x: x.isNotNull()), _EOL), F.lit(_EOL * 2), block)


def captures_of(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 100) -> DataFrame:
    """page_id, url, html, digest, uri, and for revisits the uri and url of the
    response they refer to (first_uri, first_url).

    Of pages with equal payloads of at least ``least_bytes`` the one with the
    smallest id (nulls last) is the response; rows that repeat it are
    responses too.  A null html is empty, a null url left out of the record; a
    very long page is one record.  An empty table gives no captures.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), text_of(html).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("uri", record_uri(F.col("page_id"), F.col("url"), F.col("digest")))
    first = F.struct(F.col("page_id").isNull().alias("n"), "page_id", "uri", "url")
    groups = (
        rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest")
        .agg(F.min(first).alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    )
    revisit = F.col("first").isNotNull() & ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    return rows.join(groups, "digest", "left").select(
        "page_id", "url", "html", "digest", "uri",
        F.when(revisit, F.col("first.uri")).alias("first_uri"), F.when(revisit, F.col("first.url")).alias("first_url"),
    )


def write_captures(captures: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip", file_records: int = 300_000) -> None:
    """Writes three records for each capture: response or revisit, request,
    metadata.  Line breaks in urls are percent-encoded.  A revisit has the
    headers of its answer but no payload."""
    c = F.col
    line = lambda x: F.replace(F.replace(x, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = c("first_uri").isNotNull()
    uri, own = line(c("url")), {"WARC-Date": F.lit(date)}
    answer = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "),
        F.octet_length("html").cast("string"), F.lit(_EOL * 2), F.when(revisit, F.lit("")).otherwise(c("html")),
    )
    rest = F.coalesce(F.regexp_extract(uri, r"://([^/?#]*)(.*)$", 2), F.lit(""))
    asked = F.concat(
        F.lit("GET "), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)),
        F.lit(f" HTTP/1.1{_EOL}Host: "), F.coalesce(F.regexp_extract(uri, r"://([^/?#]*)", 1), F.lit("")), F.lit(_EOL * 2),
    )
    told = F.array_join(F.array_compact(F.array(
        F.concat(F.lit("page_id: "), c("page_id").cast("string")), F.concat(F.lit("length: "), F.octet_length("html").cast("string"))
    )), _EOL)
    head = _record(
        F.when(revisit, "revisit").otherwise("response"),
        {"WARC-Record-ID": c("uri"), **own, "WARC-Target-URI": uri, "WARC-Payload-Digest": F.concat(F.lit("sha256:"), c("digest")),
         "WARC-Profile": F.when(revisit, F.lit(_PROFILE)), "WARC-Refers-To": c("first_uri"), "WARC-Refers-To-Target-URI": F.when(revisit, line(c("first_url"))),
         "Content-Type": F.lit("application/http; msgtype=response")},
        answer,
    )
    beside = {**own, "WARC-Target-URI": uri, "WARC-Concurrent-To": c("uri")}
    request = _record(
        "request", {"WARC-Record-ID": record_uri(F.lit("request"), c("uri")), **beside, "Content-Type": F.lit("application/http; msgtype=request")}, asked
    )
    metadata = _record(
        "metadata", {"WARC-Record-ID": record_uri(F.lit("metadata"), c("uri")), **beside, "Content-Type": F.lit("application/warc-fields")}, told
    )
    (
        captures.select(F.explode(F.array(head, request, metadata)).alias("value")).write.option("lineSep", _EOL * 2)
        .option("compression", compression).option("maxRecordsPerFile", file_records).text(path)
    )


_FIELD = re.compile(rb"^([^\r\n:]+):[ \t]*([^\r\n]*)", re.M)


def _parsed(header: bytes, block: bytes) -> dict:
    fields = {k.lower(): v.strip().decode("utf-8", "replace") for k, v in _FIELD.findall(header)}
    payload = block
    if fields.get(b"content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    return {
        "record_id": fields.get(b"warc-record-id"), "type": fields.get(b"warc-type"), "concurrent_to": fields.get(b"warc-concurrent-to"),
        "refers_to": fields.get(b"warc-refers-to"), "target_uri": fields.get(b"warc-target-uri"), "warc_date": fields.get(b"warc-date"),
        "content_type": fields.get(b"content-type"), "block": block, "payload": payload, "payload_bytes": len(payload),
        "payload_digest": hashlib.sha256(payload).hexdigest(),
    }


def _length(header: bytes) -> int:
    found = re.search(rb"^Content-Length:[ \t]*(\d+)", header, re.M | re.I)
    if not found:
        raise ValueError(f"a record without Content-Length: {header[:200]!r}")
    return int(found[1])


def _assembled(version: bytes, batch_bytes: int = 16 << 20):
    """Pieces of files, in order, to records."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.binary() if x.endswith("binary") else pa.int64() if x.endswith("bigint") else pa.string() for x in RECORDS.split(", ")]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, header, parts, missing = None, b"", [], 0
        for path, piece in pieces(batches):
            if missing > 0 and path == at:  # the version line was part of a payload
                parts += [version, piece]
                missing -= len(version) + len(piece)
            elif missing > 0:
                break
            elif not piece.strip():
                continue
            else:
                header, _, rest = piece.partition(b"\r\n\r\n")
                at, parts, missing = path, [rest], _length(header) - len(rest)
            if missing <= 0:
                yield _parsed(header, b"".join(parts)[: _length(header)])
        if missing > 0:
            raise ValueError(f"a record of {at} ends before its Content-Length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for r in records(batches):
            rows.append(r)
            held += 2 * len(r["block"])
            if held >= batch_bytes or len(rows) >= 5000:
                yield batch(rows)
                rows, held = [], 0
        if rows:
            yield batch(rows)

    return run


def read_records(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """One row per record of the archives under ``path`` (plain or compressed
    as a whole): the fields of ``RECORDS``.

    ``payload`` is the block, for HTTP without its headers; digests are of what
    was read.  A record shorter than its Content-Length, whether its file was
    cut or a version line in a payload met the end of a split, is an error,
    never a lost record.  Empty archives give no rows.  A record is one row, so
    a very long one must fit it (2 GB).
    """
    mark = version + _EOL
    pieces = spark.read.option("lineSep", mark).text(path).select("_metadata.file_path", F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(_assembled(mark.encode()), RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: uri, head, requests, metadata.

    Records that are no head (response, revisit, resource) belong to the head
    that WARC-Concurrent-To names, or to that of the record it names.  Those
    whose head isn't there form captures with a null head; equal records count
    once among companions.  Heads without companions have empty arrays; heads
    that repeat an id are rows of their own.
    """
    whole = F.struct(*records.columns)
    heads = records.filter(F.col("type").isin(*HEADS)).select(F.col("record_id").alias("uri"), whole.alias("head"))
    others = records.filter(~F.coalesce(F.col("type").isin(*HEADS), F.lit(False)))
    hops = others.select(F.col("record_id").alias("concurrent_to"), F.col("concurrent_to").alias("further")).dropna().distinct()
    beside = (
        others.join(hops, "concurrent_to", "left").withColumn("uri", F.coalesce("further", "concurrent_to", "record_id"))
        .groupBy("uri").agg(
            F.sort_array(F.collect_set(F.when(F.col("type") == "request", whole))).alias("requests"),
            F.sort_array(F.collect_set(F.when(F.coalesce(F.col("type") != "request", F.lit(True)), whole))).alias("metadata"),
        )
    )
    none = F.array().cast(beside.schema["requests"].dataType)
    found = heads.join(beside, "uri", "left").select(
        "uri", "head", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata")
    )
    lost = beside.join(heads.select("uri"), "uri", "left_anti").select("uri", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), "requests", "metadata")
    return found.unionByName(lost)


def field_of(block: Column, name: str) -> Column:
    """A field of an application/warc-fields block."""
    found = F.regexp_extract(block.cast("string"), rf"(?m)^{re.escape(name)}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)
