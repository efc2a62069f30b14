import base64
import hashlib
import io
import os
import struct
import zipfile

import pytest

from quirefold.llm import warc
from quirefold.session import scratch_path

SCHEMA = "page_id long, url string, html string, record_type string, __digest string, package string, digest string, keeper string"


def rows_of():
    html = [None, "", "", "<p>one</p>", "<p>two</p>\r\n\r\nWARC/1.1", "<p>one</p>", "é漢字" * 5000, "x" * 400000, "<p>one</p>"]
    rows = [(k, f"http://h/{k}?a=b c\r\nX: y" if k % 2 else None, h, "t", "d", "p", "g", "k") for k, h in enumerate(html)]
    return [*rows, rows[8], (None, "u", "<p>one</p>", "", "", "", "", ""), (None, None, "alone", "", "", "", "", "")]


def expected(rows):
    payload = lambda r: (r[2] or "").encode()
    groups = {}
    for r in rows:
        groups.setdefault(payload(r), []).append(r[0])
    out = []
    for r in rows:
        ids = [x for x in groups[payload(r)] if x is not None]
        keeper = max(ids) if ids else None
        revisit = len(groups[payload(r)]) > 1 and keeper is not None and keeper != r[0]
        digest = base64.b32encode(hashlib.sha1(payload(r)).digest()).decode()
        out.append((r[0], len(payload(r)), digest, "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 4])
def test_round_trip(spark, partitions):
    rows = rows_of()
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(partitions), scratch_path(spark, "warc"))
    assert found.filter("not valid").count() == 0
    got = found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_payloads_and_small_packages(spark):
    rows = rows_of()
    folder = scratch_path(spark, "warc")
    packages = warc.write_packages(spark.createDataFrame(rows, SCHEMA), folder, package_bytes=300, force_zip64=True)
    assert packages.count() > 1 and packages.agg({"records": "sum"}).first()[0] == len(rows)
    records = warc.read_records(warc.read_index(packages)).filter("record_type = 'response' and record_id <> 'urn:page:'").collect()
    by_id = {f"urn:page:{r[0]}": (r[2] or "").encode() for r in rows}
    assert all(bytes(r["payload"]) == by_id[r["record_id"]] and r["valid"] for r in records)
    assert {r["uri"] for r in records} >= {None, "http://h/7?a=b%20c%0D%0AX:%20y"}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), scratch_path(spark, "warc")).count() == 0


CONTENTS = {"a/x": b"first", "b": b"", "c": os.urandom(500)}


def _package(comment=b"", prefix=b"", zip64=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, content in CONTENTS.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(content)
        z.comment = comment
    return prefix + out.getvalue()


@pytest.mark.parametrize("comment", [b"", b"note PK\x05\x06 inside", b"PK\x05\x06" * 9])
@pytest.mark.parametrize("prefix", [b"", b"#!/bin/sh\n"])
@pytest.mark.parametrize("zip64", [False, True])
def test_directory(comment, prefix, zip64):
    raw = _package(comment, prefix, zip64)
    package = warc.Package(lambda at, n: raw[at:at + n], len(raw))
    assert list(package.members) == list(CONTENTS)
    for name, content in CONTENTS.items():
        at, n = package.locate(name)
        assert raw[at:at + n] == content


def test_zip64_end_record_and_wide_entries():
    """A directory with all values in the 64-bit fields, as archives beyond 4 GB have it."""
    name, content = b"archive/data.warc.gz", b"payload"
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name
    local += struct.pack("<HHQQ", 1, 16, len(content), len(content)) + content
    pad = b"\0" * 100
    entry = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 33, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 36, 0, 0, 0, 0, 0xFFFFFFFF)
    entry += name + struct.pack("<HHI", 0x5455, 4, 7) + struct.pack("<HHQQQ", 1, 24, len(content), len(content), len(pad))
    at = len(pad) + len(local)
    end = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<IIQI", 0x07064B50, 0, at + len(entry), 1)
    last = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for prefix in (b"", b"#!/bin/sh\n" * 50):
        raw = prefix + pad + local + entry + end + locator + last
        package = warc.Package(lambda a, n: raw[a:a + n], len(raw))
        a, n = package.locate("archive/data.warc.gz")
        assert raw[a:a + n] == content


def test_not_a_package():
    with pytest.raises(ValueError):
        warc.Package(lambda at, n: (b"x" * 90)[at:at + n], 90)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"y" * 100)
    raw = out.getvalue()
    with pytest.raises(ValueError):
        warc.Package(lambda at, n: raw[at:at + n], len(raw)).locate("a")


def test_broken_packages_among_good_ones(spark, tmp_path):
    """Packages of other makers, one compressed, one without an index, one cut off, one with a broken index line and one with broken records."""
    record = warc.record_of("urn:x:1", "http://a.example/x", b"hello", warc.digest_of(b"hello"))
    packed = warc._gzip(record)
    line = lambda at, n, name="part-1.warc.gz": f'com,example)/ 20240102030405 {{"url": "http://a.example/x", "mime": "text/html", "filename": "{name}", "offset": {at}, "length": "{n}"}}'

    def package(members, method=zipfile.ZIP_STORED, cut=None):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            for name, content in members.items():
                z.writestr(name, content)
        return out.getvalue()[:cut]

    good = {"datapackage.json": "{}", "archive/part-1.warc.gz": b"\0" * 7 + packed, "indexes/index.cdxj": line(7, len(packed))}  # no line end
    files = {
        "good": package(good), "prefixed": b"MZ" * 40 + package(good), "compressed": package(good, zipfile.ZIP_DEFLATED), "cut": package(good, cut=-30),
        "no index": package({"archive/part-1.warc.gz": packed}), "no archive": package({"indexes/index.cdxj": line(0, 9)}),
        "outside": package(good | {"indexes/index.cdxj": line(9, len(packed))}), "no json": package(good | {"indexes/index.cdxj": "com,example)/ 2024\n"}),
        "no record": package(good | {"indexes/index.cdxj": line(0, 7)}), "empty": b"", "text": b"just text " * 20,
    }
    for name, raw in files.items():
        (tmp_path / f"{name}.wacz").write_bytes(raw)
    uris = spark.createDataFrame([(f"file://{tmp_path}/{name}.wacz",) for name in files], "package string")
    index = warc.read_index(uris)
    name = lambda r: r["package"].rpartition("/")[2][:-5]
    found = {name(r): r["error"] for r in index.collect()}
    assert len(found) == len(files) and {k for k, v in found.items() if v is None} == {"good", "prefixed", "no record"}
    records = warc.read_records(index).collect()
    assert sorted((r["record_type"], r["valid"], r["record_id"]) for r in records if r["record_id"]) == [("response", True, "urn:x:1")] * 2
    assert [r["record_type"] for r in records if not r["valid"]] == ["broken"]
    assert warc.read_index(uris.limit(0)).count() == 0


def test_index_lines_and_stores():
    assert warc.search_key("http://www.A.example:80/Path?q=B") == "example,a,www)/path?q=b" and warc.search_key(None) == "-"
    writer = warc.PackageWriter()
    for uri in ("http://b.example/", None, "http://a.example/"):
        writer.add(uri, "ABC", uri is None, b"raw")
    raw = writer.package()
    package = warc.Package(lambda at, n: raw[at:at + n], len(raw))
    at, n = package.locate(warc.INDEX)
    lines = raw[at:at + n].decode().splitlines()
    assert [x.split(" ")[0] for x in lines] == ["-", "example,a)/", "example,b)/"] and all(x.split(" ")[1] == "20000101000000" for x in lines)
    assert [x[3] for part in warc.index_lines(package, lambda a, k: raw[a:a + k]) for x in part] == ["revisit", "response", "response"]
    assert warc.SCHEMES["s3a"] == "s3"
