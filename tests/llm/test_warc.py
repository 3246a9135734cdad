"""WARC archives: what is written, read back, and refused."""

import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from spokeframe.llm import common, warc

SCHEMA = "page_id long, url string, html string, digest string, of long, n long"


def odd_pages(spark):
    long = "<p>long page</p>\r\n\r\n" * 80
    rows = [(1, "http://a/x", long), (7, "http://b/ü?q=\r\n1", long), (3, None, long), (4, "http://c", "short"), (5, "http://c", "short"), (6, "http://d", None), (8, "", ""), (None, "http://e", long + "x"), (None, "http://e", long + "x"), (9, "http://f", "é" * 499), (10, "http://f", "é" * 499), (11, "u", "é" * 500), (12, "u", "é" * 500), (12, "u", "é" * 500), (13, "big", "z" * 3_000_000)]
    return spark.createDataFrame([(*r, "d", 0, 0) for r in rows], SCHEMA)


def test_round_trip(spark):
    pages = odd_pages(spark)
    rows = pages.collect()
    last = {}
    for r in rows:
        if r.page_id is not None:
            last[r.html or ""] = max(last.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in rows:
        raw, of = (r.html or "").encode(), last.get(r.html or "")
        repeat = len(raw) >= 1000 and of is not None and of != r.page_id
        want.append((r.page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if repeat else "response", of if repeat else None))
    got = warc.archive_round_trip(pages)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    folder = common.shared_dir(spark) + "/w"
    pages = odd_pages(spark)
    manifest = warc.write_archives(pages, folder)
    assert manifest.agg({"records": "sum"}).first()[0] == pages.count() and manifest.count() > 3
    warc.check_archives(spark, folder, manifest)
    for wrong in (manifest.limit(2), manifest.withColumn("bytes", manifest["bytes"] + 1), manifest.unionByName(manifest.limit(1).withColumn("name", F.lit("part-9.warc.zst")))):
        with pytest.raises(ValueError):
            warc.check_archives(spark, folder, wrong)
    got = {r.page_id: r for r in warc.read_archives(spark, folder).collect()}
    assert got[13].payload == b"z" * 3_000_000 and got[4].payload == b"short" and got[1].payload == b""
    assert got[3].url is None and got[7].url == "http://b/ü?q=%0D%0A1"


def test_a_dictionary_leads_and_each_record_is_a_frame():
    records = [warc.make_record(i, f"http://x/{i}", b"some page %d" % i, hashlib.sha1(b"some page %d" % i).hexdigest(), None) for i in range(300)]
    data = warc.make_archive(records)
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    assert list(warc.frames(data)) == records
    assert list(warc.frames(data + struct.pack("<II", 0x184D2A53, 3) + b"abc")) == records
    assert list(warc.frames(zstandard.compress(b"a") + zstandard.compress(b"b"))) == [b"a", b"b"]
    for bad in (data[:-3], data[:20], data + b"junk", data[:-200] + b"\0" * 200):
        with pytest.raises(ValueError):
            list(warc.frames(bad))


def test_broken_records():
    digest = hashlib.sha1(b"page").hexdigest()
    good = warc.make_record(1, "http://x", b"page", digest, None)
    assert warc.parse_page(*warc.parse_record(good))[:6] == (1, "http://x", 4, digest, "response", None)
    for a, b in ((b"WARC/1.1", b"WRC/1.1"), (b"WARC-Date: ", b"Date: "), (b": response\r\n", b": answer\r\n"), (b"Content-Length: ", b"Content-Length: 9"), (b"\r\npage", b"\r\npagE"), (b"WARC-Date:", b"WARC Date:"), (b"Content-Length: ", b"Content-Length: x")):
        with pytest.raises(ValueError):
            warc.parse_page(*warc.parse_record(good.replace(a, b)))
    for bad in (good[:-1], good + b"\r\n", good[:50], b""):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
