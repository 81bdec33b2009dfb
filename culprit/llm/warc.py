"""WARC archives: written from pages, read back record by record, joined to captures."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culprit.llm.shared import settled, shared_dir, small, tidied

VERSION = "WARC/1.1"
CRLF = "\r\n"
END = CRLF + CRLF

# The end of a record, and the version line of the next.
NEXT = re.compile(rb"\r\n\r\nWARC/\d+\.\d+\r\n")

# Payloads shorter than this are always written out, as a reference would take as much.
LEAST_SHARED = 100

DATE = "2024-01-01T00:00:00Z"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "record_id string, warc_type string, concurrent_to string, refers_to string, uri string, "
    "payload_digest string, fields string, payload binary"
)


def _urn(*parts: Column) -> Column:
    """A record id that depends on what the record stands for, so that retries agree."""
    told = [F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]
    h = F.md5(F.to_json(F.array(*told)))
    dashed = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *dashed), F.lit(">"))


def _record(kind: str, headers: list[Column], content: str, block: Column) -> Column:
    """A record without the empty lines that end it; null headers are left out."""
    head = [
        F.lit(VERSION),
        F.lit(f"WARC-Type: {kind}"),
        *headers,
        F.lit(f"WARC-Date: {DATE}"),
        F.lit(f"Content-Type: {content}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(END), block)


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def write_warc(pages: DataFrame, path: str) -> None:
    """Archives of pages (page_id, url, html) below `path`, gzipped, whole records.

    Every page is a capture of three records: the request and the metadata name the
    response, or the revisit, as the one they are concurrent to.  Of captures with equal
    payloads of 100 bytes or more the one with the smallest page_id (nulls last, then url)
    is written out, the others are revisits that refer to it.  Rows that repeat page_id,
    url and html are captures of their own, told apart by a running number.  A null html
    is an empty payload; a null url leaves the target header out; line ends in a url are
    escaped.
    """
    line_safe = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    captures = (
        pages.select(
            F.col("page_id").cast("string").alias("page"),
            "page_id",
            line_safe.alias("url"),
            F.coalesce("html", F.lit("")).alias("payload"),
        )
        .groupBy("page", "page_id", "url", "payload")
        .agg(F.count("*").alias("copies"))
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        .withColumns(
            {
                "digest": F.sha2("payload", 256),
                "who": F.struct(
                    F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url")
                ),
            }
        )
    )
    own = pages.select(
        "page_id", line_safe.alias("url"), F.coalesce("html", F.lit("")).alias("payload")
    ).where(F.octet_length("payload") >= LEAST_SHARED)
    firsts = own.select(
        F.sha2("payload", 256).alias("digest"),
        F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url")).alias(
            "who"
        ),
    ).groupBy("digest").agg(F.min("who").alias("first"), F.count("*").alias("n"))
    firsts = settled(firsts.where("n > 1").select("digest", "first"))
    told = captures.join(small(firsts), "digest", "left")
    response = _urn(F.lit("r"), F.col("page_id"), F.coalesce("url", F.lit("")), F.col("digest"), F.col("nth"))
    first = _urn(F.lit("r"), F.col("first.page_id"), F.col("first.url"), F.col("digest"), F.lit(1))
    ids = told.withColumns(
        {
            "id": response,
            "again": F.col("first").isNotNull() & ((F.col("first") != F.col("who")) | (F.col("nth") > 1)),
            "first_id": first,
        }
    )
    target = F.when(F.col("url").isNotNull(), _field("WARC-Target-URI", F.col("url")))
    concurrent = _field("WARC-Concurrent-To", F.col("id"))
    payload_digest = _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("payload"),
        F.lit(END),
    )
    host = F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    request = _record(
        "request",
        [_field("WARC-Record-ID", _urn(F.lit("q"), F.col("id"))), concurrent, target],
        "application/http; msgtype=request",
        F.concat(F.lit(f"GET / HTTP/1.1{CRLF}Host: "), host, F.lit(END)),
    )
    whole = _record(
        "response",
        [_field("WARC-Record-ID", F.col("id")), target, payload_digest],
        "application/http; msgtype=response",
        F.concat(http, F.col("payload")),
    )
    revisit = _record(
        "revisit",
        [
            _field("WARC-Record-ID", F.col("id")),
            target,
            payload_digest,
            F.lit(f"WARC-Profile: {IDENTICAL}"),
            _field("WARC-Refers-To", F.col("first_id")),
        ],
        "application/http; msgtype=response",
        http,
    )
    fields = F.coalesce(F.concat(F.lit("page: "), F.col("page")), F.lit(""))
    metadata = _record(
        "metadata",
        [_field("WARC-Record-ID", _urn(F.lit("m"), F.col("id"))), concurrent, target],
        "application/warc-fields",
        F.concat(fields, F.lit(CRLF)),
    )
    records = ids.select(
        F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(whole), metadata)).alias("value")
    )
    # Each record is one "line" that ends in the two empty lines of the format.
    records.write.option("lineSep", END).option("compression", "gzip").text(path)


def _header(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(END.encode())
    fields = {}
    for line in head.split(CRLF.encode()):
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return fields, rest


def _parsed(part: bytes) -> tuple[dict, bytes] | None:
    """The record that a part begins with and what follows it; None if its block goes on."""
    head, block = _header(part)
    length = int(head.get("content-length", 0))
    if len(block) < length:
        return None
    block, rest = block[:length], block[length:]
    http = head.get("content-type", "").startswith("application/http")
    payload = _header(block)[1] if http and head.get("warc-type") == "response" else None
    if http and head.get("warc-type") == "response" and b"\r\n\r\n" not in block:
        payload = b""
    record = {
        "record_id": head.get("warc-record-id"),
        "warc_type": head.get("warc-type"),
        "concurrent_to": head.get("warc-concurrent-to"),
        "refers_to": head.get("warc-refers-to"),
        "uri": head.get("warc-target-uri"),
        "payload_digest": head.get("warc-payload-digest"),
        "fields": block.decode("utf-8", "replace") if head.get("warc-type") == "metadata" else None,
        "payload": payload,
    }
    return record, rest


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of files read as stretches between version lines, in file order.

    A version line inside a block splits its record.  The block is then shorter than its
    header says, and the next stretches of the file belong to it.  A block that ends in
    empty lines makes the separator overlap itself, and where a read buffer ends inside
    it the line reader misses it: one stretch then holds several records, and what comes
    after a block and begins with a version line is the next record.
    """
    schema = pa.schema(
        [
            (name, pa.binary() if kind == "binary" else pa.string())
            for name, kind in (x.split() for x in RECORD.split(", "))
        ]
    )
    joint = f"{END}{VERSION}{CRLF}".encode()
    held, held_file = b"", None
    for batch in batches:
        rows = []
        for file, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and file == held_file:
                part = held + joint + part
            held, held_file = b"", file
            while part.strip():
                told = _parsed(part)
                if told is None:
                    held = part
                    break
                row, rest = told
                rows.append(row)
                begun = NEXT.match(rest)
                part = rest[begun.end() :] if begun else b""
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below `path`, one row each, form `RECORD`.

    Files are read as text whose lines end where a record's version line begins, so a
    task holds a record or a batch of them, never a file.  Gzipped files are not split;
    keep plain archives gzipped, or one record's parts could be dealt to two tasks.
    A record that its file cuts off is left out.
    """
    parts = (
        spark.read.option("lineSep", f"{END}{VERSION}{CRLF}")
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("part"))
    )
    return parts.mapInArrow(tidied(_records), RECORD)


def assemble(records: DataFrame, carry: tuple[str, ...] = ("payload",)) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata.

    Request and metadata records meet the response, or revisit, that they are concurrent
    to; several metadata records of one capture become an array.  `carry` names the
    columns of responses to keep beside the headers.  Records whose response is absent
    have no capture; a capture without request or metadata has null or an empty array.
    """
    own = ("record_id", "warc_type", "refers_to", "uri", "payload_digest", *carry)
    answers = records.where(F.col("warc_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.struct(*own).alias("response")
    )
    asked = (
        records.where("warc_type = 'request' and concurrent_to is not null")
        .groupBy(F.col("concurrent_to").alias("capture_id"))
        .agg(F.min(F.struct("record_id", "uri")).alias("request"))
    )
    said = (
        records.where("warc_type = 'metadata' and concurrent_to is not null")
        .groupBy(F.col("concurrent_to").alias("capture_id"))
        .agg(F.array_sort(F.collect_list(F.struct("record_id", "fields"))).alias("metadata"))
    )
    return answers.join(asked, "capture_id", "left").join(said, "capture_id", "left")


def resolved(captures: DataFrame, carry: tuple[str, ...] = ("payload",)) -> DataFrame:
    """Captures with what revisits leave out taken from the response that they refer to.

    `captures` is read twice: settle it first.
    """
    held = captures.where("response.warc_type = 'response'").select(
        F.col("capture_id").alias("first_id"),
        F.col("metadata").alias("first_metadata"),
        *(F.col(f"response.{c}").alias(f"first_{c}") for c in carry),
    )
    whole = captures.withColumn("first_id", F.col("response.refers_to")).join(held, "first_id", "left")
    return whole.select(
        "capture_id",
        "response",
        "request",
        "metadata",
        "first_id",
        "first_metadata",
        *(F.coalesce(F.col(f"response.{c}"), F.col(f"first_{c}")).alias(c) for c in carry),
    )


def meta(column: str, name: str) -> Column:
    """A field of a capture's first metadata record."""
    text = F.get(F.col(column), F.lit(0))["fields"]
    found = F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(found != "", found)


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages, read the archives back: one row per page.

    page_id, payload_bytes, payload_digest, record_type, refers_to (see write_warc).
    Of repeated rows the first is the response, if it may be one.  An empty table gives an empty
    result, other columns are ignored.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    carry = ("payload_bytes", "payload_sha256")
    records = read_records(spark, path).withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("long"),
            "payload_sha256": F.sha2("payload", 256),
        }
    )
    slim = settled(records.drop("payload"))
    told = resolved(settled(assemble(slim, carry)), carry)
    return told.select(
        meta("metadata", "page").cast("long").alias("page_id"),
        "payload_bytes",
        F.col("payload_sha256").alias("payload_digest"),
        F.col("response.warc_type").alias("record_type"),
        meta("first_metadata", "page").cast("long").alias("refers_to"),
    )
