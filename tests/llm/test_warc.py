"""WARC archives: round trips, revisits, and ranges of bytes."""

import base64
import gzip
import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataspark.llm import warc


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [
    (1, "http://a/1", "<p>same</p>"),
    (2, "http://a/2", "<p>other é \U0001f600</p>"),
    (7, "http://a/7", "<p>same</p>"),
    (5, "http://a/5", "<p>same</p>"),
    (8, None, None),
    (9, "http://a/9", ""),
    (10, "http://a/long", "long " * 400_000),
    (None, "http://a/none", "<p>same</p>"),
    (11, "http://a/\r\nWARC-Type: x", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n"),
    (12, "http://a/12", "tie"),
    (12, "http://a/12b", "tie"),
]
SCHEMA = "page_id long, url string, html string, row_id string, payload string, is_revisit int"


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


def expected(rows, least=0):
    largest = {}
    for page, _, html in rows:
        key = (html or "").encode()
        if page is not None:
            largest[key] = max(largest.get(key, page), page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        first = largest.get(payload)
        later = len(payload) >= least and first is not None and (page is None or page < first)
        out.append(
            (page, len(payload), digest(payload), "revisit" if later else "response", first if later else None)
        )
    return sorted(out, key=repr)


def found(spark, folder, **options):
    records = warc.read_archives(spark, folder, **options).where("record_type <> 'warcinfo'")
    rows = records.select(
        warc.row_of("record_id"), "payload_bytes", F.substring("payload_digest", 6, 32), "record_type",
        warc.row_of("refers_to"),
    )
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def test_written_and_read_back(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    warc.write_archives(pages(spark), folder)
    assert found(spark, folder) == expected(PAGES)
    payloads = warc.read_archives(spark, folder).where("record_type = 'response'")
    kept = {r.record_id: bytes(r.payload).decode() for r in payloads.collect()}
    assert kept["<urn:x-row:2>"] == PAGES[1][2] and kept["<urn:x-row:7>"] == "<p>same</p>"
    assert kept["<urn:x-row:10>"] == PAGES[6][2]
    assert not list(tmp_path.glob("out/_*"))


def test_short_payloads_are_all_responses(spark, tmp_path):
    folder = str(tmp_path / "out")
    warc.write_archives(pages(spark), folder, min_bytes=4)
    assert found(spark, folder) == expected(PAGES, 4)


def test_payloads_too_many_to_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "fits_broadcast", lambda df: False)
    warc.write_archives(pages(spark), str(tmp_path / "out"), min_bytes=4)
    assert found(spark, str(tmp_path / "out")) == expected(PAGES, 4)


def test_any_range_gives_every_record_once(spark, tmp_path):
    draw = random.Random(5)
    rows = [(i, f"http://h/{i}", "".join(draw.choices("abc <>", k=draw.randrange(0, 3000)))) for i in range(300)]
    folder = str(tmp_path / "out")
    warc.write_archives(pages(spark, rows), folder, archiveBytes="40000")
    assert len(list((tmp_path / "out").glob("*.warc.gz"))) > 3
    for size in (511, 4096, 30000, 10**9):
        assert found(spark, folder, rangeBytes=str(size)) == expected(rows)


def test_archives_are_plain_gzip(spark, tmp_path):
    warc.write_archives(pages(spark), str(tmp_path / "out"))
    for file in (tmp_path / "out").glob("*.warc.gz"):
        text = gzip.decompress(file.read_bytes())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        assert b"http://a/ WARC-Type: x" in text or b"http://a/\r\n" not in text


def stream(data):
    return pa.BufferReader(data)


def starts(data, size):
    """Record starts that ranges of a size find, each once."""
    out = []
    for at in range(0, len(data), size):
        out += [r.start for r in warc.records_in(stream(data), len(data), at, min(at + size, len(data)))]
    return out


def record(payload, number=1):
    return warc.record_bytes(number, "u", payload, digest(payload), False, None, None)


def test_members_inside_a_payload_are_no_records():
    """A payload that is an archive itself, stored without compression, byte for byte."""
    draw = random.Random(2)
    inner = b"".join(warc._member(record(draw.randbytes(900), i), 9) for i in range(400))
    assert len(inner) > 300_000
    outer = [warc._member(record(inner), 0), warc._member(record(b"after" * 50), 0)]
    assert inner[:500] in outer[0]
    data = b"".join(outer)
    for size in (1000, 20_000, 70_001, 10**7):
        assert starts(data, size) == [0, len(outer[0])]


def test_magic_numbers_in_payloads_and_damage_between_members():
    draw = random.Random(3)
    noise = b"".join(b"\x1f\x8b\x08\x00" + draw.randbytes(50) for _ in range(2000))
    members = [warc._member(record(noise, i), 0) for i in range(3)]
    whole = b"".join(members)
    wanted = [0, len(members[0]), len(members[0]) * 2]
    for size in (777, 50_000):
        assert starts(whole, size) == wanted
    damaged = members[0] + draw.randbytes(300_000) + b"".join(members[1:])
    at = len(members[0]) + 300_000
    for size in (5000, 10**7):
        assert starts(damaged, size) == [0, at, at + len(members[1])]
    cut = whole[: -len(members[2]) // 2]
    assert starts(cut, 10**7) == wanted[:2]


def test_what_is_no_record():
    assert warc.parse_record(b"HTTP/1.1 200 OK\r\n\r\n") is None
    assert warc.parse_record(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nshort") is None
    assert warc.parse_record(b"WARC/1.1\r\nno colon\r\n\r\n") is None
    other = gzip.compress(b"some other file")
    assert starts(other + warc._member(record(b"x"), 6), 10**6) == [len(other)]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert starts(packer.compress(b"WARC/1.1\r\n") + packer.flush(), 100) == []


def test_no_rows(spark, tmp_path):
    warc.write_archives(pages(spark).limit(0), str(tmp_path / "out"))
    assert found(spark, str(tmp_path / "out")) == []
    assert found(spark, str(tmp_path / "nowhere")) == []


def test_base32(spark):
    texts = [("",), ("abc",), ("\x00" * 70,)] + [(str(i),) for i in range(200)]
    df = spark.createDataFrame(texts, "t string").select("t", warc.base32_sha1(F.col("t").cast("binary")).alias("d"))
    for row in df.collect():
        assert row.d == digest(row.t.encode())


def test_failed_job_leaves_nothing(spark, tmp_path):
    bad = pages(spark).withColumn("html", F.when(F.col("page_id") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("html")))
    with pytest.raises(Exception, match="no"):
        warc.write_archives(bad, str(tmp_path / "out"))
    assert found(spark, str(tmp_path / "out")) == []


def test_first_record_of_a_stream_of_blocks():
    data = warc._member(record(b"y" * 700_000), 1)
    (only,) = warc.records_in(stream(data), len(data), 0, len(data))
    assert (only.start, only.end) == (0, len(data)) and only.block.endswith(b"y" * 1000)
    assert only.fields["warc-type"] == "response"
