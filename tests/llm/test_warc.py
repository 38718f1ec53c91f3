import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from granary.llm import common, warc as W

ROWS = [(5, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://b/é\r\nX: y", "<p>same</p>"), (1, "http://b/2", None), (3, None, ""), (7, "http://b/3", "é" * 300_000), (8, "http://c", "x"), (8, "http://c", "x"), (None, "http://n", "z")]


def pages(spark):
    return spark.createDataFrame([(*r, "c", "c") for r in ROWS], "page_id long, url string, html string, digest string, n string")


def test_archived_pages(spark):
    got = sorted(map(tuple, W.archived_pages(pages(spark)).collect()), key=str)
    want = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        first = min((j for j, _, g in ROWS if (g or "") == (h or "") and j is not None), default=None)
        want.append((i, len(data), W.digest(data), "response" if i == first else "revisit", None if i == first else first))
    assert got == sorted(want, key=str) and len(W.digest(b"")) == 32
    assert W.archived_pages(pages(spark).limit(0)).count() == 0


def test_small_payloads_can_be_left_alone(spark):
    got = {r.page_id: r.record_type for r in W.archived_pages(pages(spark), min_bytes=5).collect()}
    assert got[3] == got[1] == "response" and got[5] == "revisit"


def test_payloads_and_pushed_predicates(spark):
    path = common.new_path(spark, "warc-test")
    assert W.write_warc(pages(spark), path) == len(ROWS)
    df = W.read_warc(spark, path)
    rows = {r.record_id: r for r in df.collect()}
    assert rows["<urn:page:7>"].payload == ("é" * 300_000).encode() and rows["<urn:page:5>"].payload is None and rows["<urn:page:5>"].payload_length == 11
    assert rows["<urn:page:9>"].target_uri == "http://b/é%0D%0AX: y" and rows["<urn:page:2>"].headers["content-type"].startswith("application/http")
    pushed = df.where((F.col("record_type") == "revisit") & F.col("refers_to").isin("<urn:page:2>", "<urn:page:x>") & F.col("target_uri").startswith("http://b"))
    assert [r.record_id for r in pushed.collect()] == ["<urn:page:9>"]
    assert W.read_warc(spark, path, payloads=False).where("payload IS NOT NULL").count() == 0


def test_reader_skips_unwanted_records(tmp_path, monkeypatch):
    data = b"".join(W.record_bytes(i, f"http://h/{i}", bytes([i]) * 200_000, None) for i in range(20))
    (tmp_path / "x.warc.gz").write_bytes(data)
    inflated = []
    real = W.zlib.decompressobj

    class Counted:
        def __init__(self, *a):
            self.d = real(*a)

        def decompress(self, *a):
            out = self.d.decompress(*a)
            inflated.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.d, name)

    monkeypatch.setattr(W.zlib, "decompressobj", Counted)
    rows = list(W.records(f"file://{tmp_path}/x.warc.gz", lambda r: r["target_uri"] == "http://h/7"))
    assert [r["payload"] for r in rows] == [b"\x07" * 200_000] and sum(inflated) < 200_000 + 21 * (W.HEAD_BYTES + 1000)


def test_archives_of_other_writers(tmp_path):
    head = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/warc-fields\r\nContent-Length: 9\r\n\r\nformat: x\r\n\r\n"
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(head) + W.record_bytes(1, "u", b"p", None))
    rows = list(W.records(f"file://{tmp_path}/y.warc.gz"))
    assert [(r["record_type"], r["payload"]) for r in rows] == [("warcinfo", b"format: x"), ("response", b"p")]
    (tmp_path / "y.warc.gz").write_bytes(W.record_bytes(1, "u", b"p" * 999, None)[:-20])
    with pytest.raises(Exception):
        list(W.records(f"file://{tmp_path}/y.warc.gz"))


def test_many_copies(spark):
    rows = [(i, f"http://h/{i}", "copy" if i % 3 else f"own {i}") for i in range(600)]
    got = {r.page_id: r for r in W.archived_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all((r.record_type == "revisit") == (i % 3 != 0 and i != 1) and r.refers_to == (1 if i % 3 and i != 1 else None) for i, r in got.items())
    assert len(got) == 600 and hashlib.sha1(b"copy").digest() and got[2].payload_bytes == 4


def test_plain_archives_are_refused_instead_of_left_out(spark, tmp_path):
    import pytest

    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    with pytest.raises(Exception, match="aren't compressed"):
        W.read_warc(spark, f"file://{tmp_path}").collect()
    (tmp_path / "a.warc").unlink()
    assert W.read_warc(spark, f"file://{tmp_path}").count() == 0
