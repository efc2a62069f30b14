"""WARC records in ZIP packages: a writer, and a reader that finds records by the packages' directories and indexes.

A package holds two stored members: ``archive/data.warc.gz``, one gzip member per record, and ``indexes/index.cdxj``, a line of key,
timestamp and JSON with the place of every record. The reader parses the end record, the ZIP64 records and the central directory,
finds the members' bytes, reads the indexes in ranges and then reads records as ranges of the package; nothing is extracted.
Packages of other makers are read as well, if their archives and CDXJ indexes are stored members; one that cannot be read gives
a row with the reason. Packages are read and written through pyarrow's file systems, so any shared store that these know will do.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import pieces, spread, utf8
from quirefold.session import broadcast_if_small, materialize

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
PACKAGE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
#: Hadoop's names of stores that pyarrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
MIME_REVISIT = "warc/revisit"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_of(record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record: a response with ``payload``, or a revisit of the record ``refers_to`` that holds the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[:int(fields["content-length"])]


def _gzip(raw: bytes) -> bytes:
    maker = zlib.compressobj(6, zlib.DEFLATED, 31)
    return maker.compress(raw) + maker.flush()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder or file as Spark names it, and the path in it."""
    scheme, mark, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{mark}{rest}".replace(" ", "%20"))


def search_key(uri: str | None) -> str:
    """The address as indexes sort it: host parts from the last to the first, then path and query, in lower case."""
    host, _, rest = re.sub(r"[\x00-\x20\x7f]", "", uri or "").lower().partition("://")[2].partition("/")
    return ",".join(reversed(host.split(":")[0].split("."))) + ")/" + rest if host else "-"


class PackageWriter:
    """Collects records up to the size of one package."""

    def __init__(self):
        self.data, self.lines = io.BytesIO(), []

    def add(self, uri: str | None, digest: str, revisit: bool, raw: bytes) -> None:
        packed = _gzip(raw)
        place = {"length": str(len(packed)), "offset": str(self.data.tell()), "filename": DATA.rpartition("/")[2]}
        told = {"url": uri or "", "mime": MIME_REVISIT if revisit else "text/html", "status": "200", "digest": f"sha1:{digest}", **place}
        self.lines.append(f"{search_key(uri)} {re.sub('[^0-9]', '', DATE)} {json.dumps(told)}")
        self.data.write(packed)

    def package(self, force_zip64: bool = False) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
            for name, content in ((DATA, self.data.getvalue()), (INDEX, ("\n".join(sorted(self.lines)) + "\n").encode())):
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                with package.open(info, "w", force_zip64=force_zip64) as member:
                    member.write(content)
        return out.getvalue()


@dataclass
class Member:
    name: str
    method: int
    size: int
    header: int


class Package:
    """The directory of a ZIP package behind ``read(offset, length)``; ``size`` is the package's length."""

    def __init__(self, read, size: int):
        self.read = read
        self.members = {m.name: m for m in self._directory(size)}

    def _directory(self, size: int) -> Iterator[Member]:
        tail_at = max(0, size - 65557 - 20)
        tail = self.read(tail_at, size - tail_at)
        end = len(tail)
        while True:  # the last signature whose comment fills the rest of the file
            end = tail.rfind(b"PK\x05\x06", 0, end + 3 if end < len(tail) else end)
            if end < 0:
                raise ValueError("no end of central directory")
            if len(tail) - end >= 22 and struct.unpack_from("<H", tail, end + 20)[0] == len(tail) - end - 22:
                break
            end -= 1
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        at = tail_at + end
        if end >= 20 and tail[end - 20:end - 16] == b"PK\x06\x07":
            at = struct.unpack_from("<Q", tail, end - 12)[0]
            record = self.read(at, 56) if at + 56 <= size else b""
            if record[:4] != b"PK\x06\x06":  # bytes in front of the package: the record lies before its locator all the same
                place = tail.rfind(b"PK\x06\x06", 0, end - 20)
                if place < 0:
                    raise ValueError("broken ZIP64 end record")
                at, record = tail_at + place, tail[place:place + 56]
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.shift = at - length - start  # bytes before the package proper
        directory, k = self.read(start + self.shift, length), 0
        for _ in range(count):
            if directory[k:k + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, = struct.unpack_from("<H", directory, k + 10)
            packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", directory, k + 20)
            header, = struct.unpack_from("<I", directory, k + 42)
            name = directory[k + 46:k + 46 + n_name].decode("utf-8", "replace")
            extra = directory[k + 46 + n_name:k + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:  # 64-bit values for those that do not fit, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    full, packed, header = (next(wide) if v == 0xFFFFFFFF else v for v in (full, packed, header))
                extra = extra[4 + n:]
            yield Member(name, method, packed, header)
            k += 46 + n_name + n_extra + n_comment

    def locate(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes in the package."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed, not stored")
        local = self.read(member.header + self.shift, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        return member.header + self.shift + 30 + sum(struct.unpack_from("<HH", local, 26)), member.size


def _opened(uri: str):
    store, path = file_system(uri)
    file = store.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return file, read


def keepers(pages: DataFrame, id_col: str, html_col: str, least_bytes: int = 0) -> DataFrame:
    """``(__digest, __bytes, __keeper)`` of payloads that several rows share: the largest id holds the payload."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.sha1(html).alias("__digest"), F.octet_length(html).alias("__bytes"))
    return rows.filter(F.col("__bytes") >= least_bytes).groupBy("__digest", "__bytes").agg(
        F.max("id").alias("__keeper"), F.count("*").alias("n")
    ).filter("n > 1").drop("n")


def write_packages(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = 0, package_bytes: int = PACKAGE_BYTES, force_zip64: bool = False,
) -> DataFrame:
    """Writes a record per row below ``folder`` and returns ``(package, records)`` of the packages to read.

    Rows with the largest id of their payload are responses (so are repeated rows of that id), the others revisit it; null html is
    an empty payload. A package's name is new in every attempt of a task, and only committed attempts are in the result.
    """
    shared = materialize(keepers(pages, id_col, html_col, least_bytes), "keepers")
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = spread(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest")))
    rows = rows.join(
        broadcast_if_small(shared), (F.col("digest") == F.col("__digest")) & (F.octet_length("html") == F.col("__bytes")), "left"
    ).select("id", "url", "html", F.col("__keeper").cast("long").alias("keeper"))

    def name(page: int | None) -> str:
        return f"urn:page:{'' if page is None else page}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        writer = PackageWriter()

        def close() -> pa.RecordBatch:
            at = f"{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{root}/{at}") as out:
                out.write(writer.package(force_zip64))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{at}"]), pa.array([len(writer.lines)], pa.int64())], names=["package", "records"])

        for batch in pieces(batches):
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist()]
            for page, url, payload, keeper in zip(*columns):
                target = name(keeper) if keeper is not None and keeper != page else None
                digest = digest_of(payload)
                writer.add(url, digest, target is not None, record_of(name(page), url, payload, digest, target))
                if writer.data.tell() >= package_bytes:
                    yield close()
                    writer = PackageWriter()
        if writer.lines:
            yield close()

    return materialize(rows.mapInArrow(run, "package string, records long"), "packages")


def index_lines(package: Package, read) -> Iterator[list[tuple[int, int, str | None, str]]]:
    """(place in the package, length, address, type) of the records that the package's CDXJ indexes name, a range of lines at a time."""
    indexes = [n for n in package.members if n.startswith("indexes/") and n.endswith(".cdxj")]
    if not indexes:
        raise ValueError("no CDXJ index")
    archives: dict[str, tuple[int, int]] = {}
    for name in indexes:
        at, size = package.locate(name)
        left = b""
        for k in range(0, size, RANGE_BYTES):
            *lines, left = (left + read(at + k, min(RANGE_BYTES, size - k))).split(b"\n")
            yield [_place(package, archives, x) for x in lines if x.strip()]
        if left.strip():
            yield [_place(package, archives, left)]


def _place(package: Package, archives: dict[str, tuple[int, int]], line: bytes) -> tuple[int, int, str | None, str]:
    told = json.loads(line[line.index(b"{"):])
    name = f"archive/{told['filename']}"
    if name not in archives:
        archives[name] = package.locate(name)
    begin, size = archives[name]
    at, length = int(told["offset"]), int(told["length"])
    if at < 0 or length <= 0 or at + length > size:
        raise ValueError("an index line names bytes outside its archive")
    return begin + at, length, told.get("url") or None, "revisit" if told.get("mime") == MIME_REVISIT else "response"


def read_index(packages: DataFrame) -> DataFrame:
    """``(package, at, length, uri, record_type, error)`` of every record; ``at`` is its place in the package.

    A package that cannot be read (no ZIP, compressed or missing members, a broken index) has no records but one row with the reason
    in ``error``, and the others are not affected. A folder without packages gives no rows.
    """
    names = ["package", "at", "length", "uri", "record_type", "error"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                file, read = _opened(uri)
                with file:
                    try:  # the whole index first: a package is read whole or not at all
                        parts = [made([(uri, *x, None) for x in lines]) for lines in index_lines(Package(read, file.size()), read)]
                    except (ValueError, KeyError, StopIteration, RuntimeError, struct.error) as fault:
                        parts = [made([(uri, None, None, None, None, f"{type(fault).__name__}: {fault}"[:200])])]
                yield from parts

    cores = packages.sparkSession.sparkContext.defaultParallelism
    dealt = packages.select("package").repartition(max(cores, 1))
    return dealt.mapInArrow(run, "package string, at long, length long, uri string, record_type string, error string")


def read_records(index: DataFrame, keep_payload: bool = True) -> DataFrame:
    """``(record_id, record_type, refers_to, uri, payload_bytes, payload_digest, valid, payload)`` of the index's records.

    Neighbouring records are read in one range. A revisit has no payload: its digest is the one it states, its size null.
    ``valid`` says whether a response's payload has the digest that it states. Bytes that are no record give a row of the type
    ``broken`` that is not valid; the rows of packages that could not be read give none.
    """
    columns = ["record_id", "record_type", "refers_to", "uri", "payload_bytes", "payload_digest", "valid", "payload"]

    def read_range(rows: list[tuple[str, int, int]]) -> Iterator[tuple]:
        file, read = _opened(rows[0][0])
        with file:
            begin = rows[0][1]
            raw = read(begin, rows[-1][1] + rows[-1][2] - begin)
        for _, at, length in rows:
            try:
                fields, block = parse_record(zlib.decompress(raw[at - begin:at - begin + length], 31))
            except (ValueError, KeyError, zlib.error):
                yield None, "broken", None, None, None, None, False, None
                continue
            payload = block.partition(b"\r\n\r\n")[2]
            stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
            revisit = fields.get("warc-type") == "revisit"
            digest = stated if revisit else digest_of(payload)
            yield (
                fields.get("warc-record-id", "").strip("<>"), fields.get("warc-type"), fields.get("warc-refers-to", "").strip("<>") or None,
                fields.get("warc-target-uri"), None if revisit else len(payload), digest, digest == stated, payload if keep_payload and not revisit else None,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

        def made(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*read_range(rows)), kinds)], names=columns)

        held: list[tuple[str, int, int]] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3))):
                near = held and row[0] == held[0][0] and held[-1][1] + held[-1][2] == row[1] and row[1] + row[2] - held[0][1] <= RANGE_BYTES // 4
                if held and not near:
                    yield made(held)
                    held = []
                held.append(row)
        if held:
            yield made(held)

    cores = index.sparkSession.sparkContext.defaultParallelism
    dealt = index.filter("at is not null").select("package", "at", "length").repartition(max(8, 2 * cores), "package", F.floor(F.col("at") / RANGE_BYTES))
    return dealt.sortWithinPartitions("package", "at").mapInArrow(
        run, "record_id string, record_type string, refers_to string, uri string, payload_bytes long, payload_digest string, valid boolean, payload binary"
    )


def round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages' packages, reads them back, and gives revisits the size and digest of the payload that they refer to.

    Null html is an empty payload. Rows without an id revisit the largest id of their payload, and are responses if there is
    none; repeated rows of the largest id are all responses. An empty table gives no rows; further columns are not read.
    """
    packages = write_packages(pages, folder, id_col, url_col, html_col)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^urn:page:(.*)$", 1), F.lit("")).cast("long")
    found = materialize(
        read_records(read_index(packages), keep_payload=False)
        .select(page("record_id").alias("page_id"), "record_type", page("refers_to").alias("refers_to"), "payload_bytes", "payload_digest", "valid"), "records",
    )
    held = found.filter("record_type = 'response'").groupBy(F.col("page_id").alias("held"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("bytes"))
    revisits = found.filter("record_type = 'revisit'").join(held, (F.col("refers_to") == F.col("held")) & (F.col("payload_digest") == F.col("digest")), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid"]
    return found.filter("record_type = 'response'").select(columns).union(
        revisits.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.col("held").isNotNull().alias("valid"))
    )
