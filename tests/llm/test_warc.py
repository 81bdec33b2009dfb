import gzip
import hashlib
from pathlib import Path

import pyarrow as pa
from cases import collected
from pyspark.sql import functions as F

from culprit.llm import warc

PAGES = "page_id long, url string, html string"


def page_rows():
    big = "<p>" + "same payload " * 20
    return [
        (5, "http://a.org/5", big),
        (3, "http://a.org/3", big),
        (9, "http://b.org/9", big),
        (9, "http://b.org/9", big),
        (3, "http://a.org/3", big),
        (None, None, big),
        (None, "http://c.org/", big + "!"),
        (1, None, None),
        (2, "http://a.org/2\r\nWARC-Type: x", ""),
        (6, "http://a.org/6", "short"),
        (7, "http://a.org/7", "short"),
        (8, "http://a.org/8", "é😀" * 30_000),
        (10, "http://a.org/10", "trap\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1\r\n end" + "y" * 99),
        (11, "http://a.org/11", "\r\n\r\n" * 40),
    ]


def plain(rows):
    first = {}
    for key, _, html in rows:
        rank = (key is None, key)
        html = html or ""
        if html not in first or rank < first[html]:
            first[html] = rank
    made, seen = [], set()
    for key, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        html = html or ""
        raw = html.encode()
        again = len(raw) >= 100 and html in seen
        seen.add(html)
        made.append(
            (key, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response",
             first[html][1] if again else None)
        )
    return sorted(made, key=repr)


def test_round_trip_against_plain(spark, tmp_path):
    rows = page_rows()
    df = spark.createDataFrame(rows, PAGES).repartition(3).withColumn("payload", F.lit("own")).withColumn("copy", F.lit(1))
    got = warc.round_trip(df, str(tmp_path / "w"))
    assert collected(got) == plain(rows)


def test_round_trip_empty(spark, tmp_path):
    assert collected(warc.round_trip(spark.createDataFrame([], PAGES), str(tmp_path / "w"))) == []


def test_files_are_archives(spark, tmp_path):
    """Records follow each other by their stated lengths, as any reader takes them."""
    warc.write_warc(spark.createDataFrame(page_rows(), PAGES).repartition(2), str(tmp_path / "w"))
    kinds, ids = [], []
    for file in Path(tmp_path / "w").glob("*.gz"):
        data, at = gzip.decompress(file.read_bytes()), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:])
            assert data.startswith(b"WARC/1.1\r\n", at)
            at = end + 4 + int(head[b"Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            kinds.append(head[b"WARC-Type"].decode())
            ids.append(head[b"WARC-Record-ID"])
    assert len(ids) == len(set(ids))
    captures = len(page_rows())
    assert kinds.count("request") == kinds.count("metadata") == captures
    assert kinds.count("response") + kinds.count("revisit") == captures


def test_capture_is_one_nested_row_with_its_payload(spark, tmp_path):
    warc.write_warc(spark.createDataFrame(page_rows(), PAGES), str(tmp_path / "w"))
    captures = warc.assemble(warc.read_records(spark, str(tmp_path / "w")))
    found = warc.resolved(captures.cache()).where("response.uri = 'http://b.org/9'").collect()
    assert len(found) == 2
    told = found[0]
    assert told.response.warc_type == "revisit" and told.response.payload is None
    assert told.payload.decode() == page_rows()[0][2]
    assert told.request.uri == "http://b.org/9"
    assert [m.fields for m in told.metadata] == ["page: 9\r\n"]


def test_records_of_others_without_request_or_metadata(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http\r\n"
    cut = head + b"Content-Length: 999\r\n\r\nfile ends here"
    whole = head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole + cut))
    captures = warc.assemble(warc.read_records(spark, str(tmp_path))).collect()
    assert [(c.response.payload, c.request, c.metadata) for c in captures] == [(bytearray(b"hello"), None, None)]


def test_records_given_as_one_part():
    def record(name, block):
        head = b"WARC-Type: metadata\r\nWARC-Record-ID: <urn:%s>\r\nContent-Length: %d\r\n\r\n"
        return head % (name, len(block)) + block

    joint = b"\r\n\r\nWARC/1.1\r\n"
    trap = b"a" + joint + b"b\r\n\r\n"
    parts = [
        b"WARC/1.1\r\n" + record(b"1", b"x\r\n\r\n") + joint + record(b"2", b"") + joint + record(b"3", b"y"),
        record(b"4", b"z\r\n\r\n") + joint + record(b"5", trap).partition(joint)[0],
        record(b"5", trap).partition(joint)[2] + joint + record(b"6", b"end") + b"\r\n\r\n",
    ]
    batch = pa.record_batch({"file": pa.array(["f"] * 3), "part": pa.array(parts)})
    got = [(r["record_id"], r["fields"]) for out in warc._records(iter([batch])) for r in out.to_pylist()]
    want = ["x\r\n\r\n", "", "y", "z\r\n\r\n", trap.decode(), "end"]
    assert got == [(f"<urn:{i + 1}>", fields) for i, fields in enumerate(want)]


def test_round_trip_over_many_read_buffers(spark, tmp_path):
    rows = [(i, f"http://a.org/{i}", "<p>" + "x" * (i % 173) + ("\r\n\r\n" if i % 3 else "")) for i in range(2000)]
    size = spark.conf.get("io.file.buffer.size", None)
    spark.conf.set("io.file.buffer.size", "509")
    try:
        got = collected(warc.round_trip(spark.createDataFrame(rows, PAGES).repartition(2), str(tmp_path / "w")))
        parts = spark.read.option("lineSep", "\r\n\r\nWARC/1.1\r\n").text(str(tmp_path / "w")).count()
    finally:
        spark.conf.unset("io.file.buffer.size") if size is None else spark.conf.set("io.file.buffer.size", size)
    assert parts < 3 * len(rows)
    assert got == plain(rows)
