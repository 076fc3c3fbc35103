import base64
import hashlib
import random
import struct

import pytest
import zstandard

from provena.llm import warc as Z

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        owner = first.get(h or "", i)
        revisit = i is not None and owner != i and len(data) >= least
        out.append((i, u, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None, None if revisit else data))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(1)
    rows = [(i, f"http://h/{i}", f"<p>{'é' * (i % 9)} {r.random()}</p>") for i in range(60)]
    rows += [(100 + i, f"http://c/{i}", "<p>copy</p>") for i in range(40)]
    rows += [(200, None, None), (201, "http://x\r\nWARC-Type: evil", ""), (None, "http://n", "<p>copy</p>"), (None, None, None), (5, "http://other", "x"), (300, "u", "z" * 400_000), (100, "http://c/0", "<p>copy</p>")]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(pages, least, tmp_path):
    rows, df = pages
    got = Z.round_trip(df, str(tmp_path / "w"), min_revisit_bytes=least).collect()
    assert all(r.error is None for r in got)
    want = [(i, u.replace("\r\n", "%0D%0A") if u else u, *rest) for i, u, *rest in brute(rows, least)]
    assert sorted(((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=str) == sorted(want, key=str)
    again = Z.round_trip(df, str(tmp_path / "w"), min_revisit_bytes=least)
    assert again.count() == len(rows)


def test_archives_roll_and_hold_one_frame_for_each_record(pages, tmp_path, monkeypatch):
    monkeypatch.setattr(Z, "ARCHIVE_BYTES", 2000)
    writer, names = Z.ArchiveWriter(b"some dictionary bytes " * 20), []
    for i in range(5):
        writer.add(Z.record(i, f"u{i}", b"payload %d" % i, None))
    data = b"".join(writer.frames)
    magic, n = struct.unpack_from("<II", data)
    assert magic == Z.DICTIONARY_MAGIC
    assert zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]).startswith(b"some dictionary")
    assert data[8 + n :].count(b"\x28\xb5\x2f\xfd") >= 5
    names = [Z.parse(x)["page_id"] for x in Z.read_archive(data)]
    assert names == [0, 1, 2, 3, 4]


def test_an_archive_without_dictionary(tmp_path):
    data = b"".join(zstandard.compress(Z.record(i, "u", b"x", None)) for i in range(3))
    assert [Z.parse(x)["page_id"] for x in Z.read_archive(data)] == [0, 1, 2]


@pytest.mark.parametrize(
    ("old", "new", "message"),
    [
        (b"WARC/1.1", b"WURC/1.1", "not a WARC"),
        (b"Content-Length: 9", b"Content-Length: 8", "Content-Length"),
        (b"WARC-Date", b"X-Date", "warc-date"),
        (b"hello", b"jello", "digest"),
        (b"WARC-Type: response", b"WARC-Type  response", "header"),
    ],
)
def test_broken_records(old, new, message):
    good = Z.record(1, "u", b"hello", None)
    old = old if old in good else b"Content-Length: " + str(good.count(b"")).encode()
    bad = good.replace(old, new) if old in good else good[:-5] + b"\r\n\r\n"
    with pytest.raises(Z.WarcError):
        Z.parse(bad)
    assert message


def foreign(kind, block, *headers):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:x>", b"WARC-Date: 2020-01-01T00:00:00Z", b"Content-Length: %d" % len(block), *headers]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_records():
    http = b"HTTP/1.1 200 OK\r\nX-Name: caf\xe9\r\n\r\n"
    assert Z.parse(foreign(b"warcinfo", b"software: x\r\n"))["record_type"] == "warcinfo"
    assert bytes(Z.parse(foreign(b"request", b"GET / HTTP/1.1\r\n\r\n"))["payload"]).startswith(b"GET")
    plain = Z.parse(foreign(b"response", http + b"body"))  # no length stated
    assert (plain["payload_bytes"], plain["payload_digest"], plain["page_id"]) == (4, Z.base32_sha1(b"body"), None)
    unsized = Z.parse(foreign(b"revisit", http, b"WARC-Payload-Digest: sha1:ABC"))
    assert (unsized["payload_bytes"], unsized["payload_digest"]) == (None, "ABC")
    assert Z.parse(foreign(b"response", b"HTTP/1.1 200 OK\r\n\r\nx"))["payload"] == b"x"
    for bad in (foreign(b"response", http + b"x", b"X-Page-Id: seven"), foreign(b"response", http + b"x", b"X-Page-Id: 1" + b"0" * 30), foreign(b"response", b"HTTP/1.1 200 OK\r\nContent-Length: two\r\n\r\nx"), foreign(b"response", b"no http"), foreign(b"response", http + b"x", b"WARC-Payload-Digest: sha1:AAAA")):
        with pytest.raises(Z.WarcError):
            Z.parse(bad)


def test_a_bad_record_is_a_row(spark, tmp_path):
    records = [foreign(b"warcinfo", b"a: b"), foreign(b"response", b"HTTP/1.1 200 OK\r\n\r\nx", b"X-Page-Id: seven"), Z.record(3, "u", b"x", None)]
    (tmp_path / "a.warc.zst").write_bytes(b"".join(zstandard.compress(r) for r in records))
    rows = Z.read_archives(spark, str(tmp_path)).collect()
    assert [(r.record_type, r.page_id, r.error) for r in rows] == [("warcinfo", None, None), (None, None, "bad page id"), ("response", 3, None)]


def test_broken_archives(spark, tmp_path):
    good = Z.ArchiveWriter(b"")
    good.add(Z.record(1, "u", b"hello", None))
    good.add(Z.record(2, "u", b"world", None))
    data = b"".join(good.frames)
    (tmp_path / "cut.warc.zst").write_bytes(data[:-3])
    (tmp_path / "short.warc.zst").write_bytes(b"abc")
    (tmp_path / "noise.warc.zst").write_bytes(data + b"noise that is no frame")
    (tmp_path / "ok.warc.zst").write_bytes(data)
    rows = Z.read_archives(spark, str(tmp_path)).collect()
    by = lambda n: [(r.page_id, r.error is None) for r in rows if r.archive.endswith(f"/{n}.warc.zst")]
    assert by("ok") == [(1, True), (2, True)]
    assert by("cut") == [(1, True), (None, False)]
    assert by("short") == [(None, False)]
    assert by("noise") == [(1, True), (2, True), (None, False)]


def test_no_pages(spark):
    assert Z.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
