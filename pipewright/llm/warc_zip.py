"""WARC records in ZIP packages, written and read back by range (operator 8).

A package holds three stored (not compressed) members: ``archive/data.warc.gz``, one gzip member for
each record; ``indexes/index.cdxj``, one line for each record with its place; ``datapackage.json``. The
reader goes from the end of the file to the central directory (by way of the ZIP64 records where they
are needed), finds the members there, and reads records by their ranges. Nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, new_folder, open_fs, settle, slices, texts

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PACKAGE_BYTES = 32 << 20  # of records in a package, about
READ_BYTES = 4 << 20  # that are read at once
LEAST_REVISIT = 100  # payload bytes
URN = "urn:pipewright:page:"


# ------------------------------------------------------------------ WARC
def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, gzipped by itself. A revisit has the headers of its response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<{URN}{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = http + (payload if refers_to is None else b"")
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode().split("\r\n")[1:])}


def parse_record(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload bytes, payload digest, type, page referred to) of one record; the payload is checked against its digest."""
    raw = zlib.decompress(raw, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it states")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = warc["warc-payload-digest"].partition(":")[2], int(_headers(http)["content-length"])
    number = lambda s: int(s) if (s := s.strip("<>").removeprefix(URN)) else None
    if warc["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload that is not what its record states")
    return number(warc["warc-record-id"]), size, digest, warc["warc-type"], number(warc["warc-refers-to"]) if "warc-refers-to" in warc else None


# ------------------------------------------------------------------ ZIP
def write_zip(out, members: list[tuple[str, list[bytes]]], zip64: bool = False) -> None:
    """Write stored members; with ``zip64``, or where a number needs it, with ZIP64 fields."""
    place, central = 0, b""
    for name, chunks in members:
        size, crc = sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        wide = zip64 or size >= 0xFFFFFFFF or place >= 0xFFFFFFFF
        raw, short = name.encode(), 0xFFFFFFFF if wide else size
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        local = struct.pack("<4s5H3I2H", b"PK\3\4", 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", 1, 24, size, size, place) if wide else b""
        central += struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if wide else place) + raw + extra
        out.write(local)
        for c in chunks:
            out.write(c)
        place += len(local) + size
    out.write(central)
    n, wide = len(members), zip64 or place >= 0xFFFFFFFF
    if wide:
        out.write(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(central), place))
        out.write(struct.pack("<4sIQI", b"PK\6\7", 0, place + len(central), 1))
    out.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, min(len(central), 0xFFFFFFFF), 0xFFFFFFFF if wide else place, 0))


def zip_members(file) -> dict[str, tuple[int, int]]:
    """(place, size) of the data of each stored member of a ZIP file, from its directory."""
    size = file.size()
    tail = file.read_at(min(size, 65_557), max(0, size - 65_557))
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, place, _ = struct.unpack("<4s4H2IH", tail[at : at + 22])
    end = max(0, size - 65_557) + at
    if n == 0xFFFF or length == 0xFFFFFFFF or place == 0xFFFFFFFF:
        sign, _, where, _ = struct.unpack("<4sIQI", file.read_at(20, end - 20))
        if sign != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        sign, _, _, _, _, _, _, n, length, place = struct.unpack("<4sQ2H2I4Q", file.read_at(56, where))
        if sign != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
    raw, i, out = file.read_at(length, place), 0, {}
    for _ in range(n):
        sign, _, _, _, method, _, _, _, packed, plain, name_n, extra_n, note_n, _, _, _, local = struct.unpack("<4s6H3I5H2I", raw[i : i + 46])
        if sign != b"PK\1\2":
            raise ValueError("a broken central directory")
        name = raw[i + 46 : i + 46 + name_n].decode()
        extra, j = raw[i + 46 + name_n : i + 46 + name_n + extra_n], 0
        while j + 4 <= len(extra):
            kind, width = struct.unpack("<HH", extra[j : j + 4])
            if kind == 1:  # holds just those numbers that don't fit above, in this order
                wide = iter(struct.unpack(f"<{width // 8}Q", extra[j + 4 : j + 4 + width // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            j += 4 + width
        i += 46 + name_n + extra_n + note_n
        if method == 0 and not name.endswith("/"):
            sign, name_n, extra_n = struct.unpack("<4s22xHH", file.read_at(30, local))
            if sign != b"PK\3\4" or packed != plain:
                raise ValueError(f"{name} is not where the directory has it")
            out[name] = (local + 30 + name_n + extra_n, plain)
    return out


def read_package(file) -> Iterator[bytes]:
    """The records of a package in the order of its index, still gzipped, by range."""
    members = zip_members(file)
    for name, (place, size) in members.items():
        if name.startswith("indexes/"):
            held, first = b"", 0  # a stretch of the archive and where it begins
            for line in file.read_at(size, place).decode().splitlines():
                entry = json.loads(line.split(" ", 2)[2])
                at, n = entry["offset"], entry["length"]
                data, whole = members[entry["filename"]]
                if not first <= data + at or data + at + n > first + len(held):
                    first = data + at
                    held = file.read_at(min(max(n, READ_BYTES), whole - at), first)
                yield held[data + at - first : data + at - first + n]


# ------------------------------------------------------------------ distributed write and read
def _writer(uri: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (filesystem, root), part, step = open_fs(uri), TaskContext.get().partitionId(), 0
        records, lines, place = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal records, lines, place, step
            path = f"{root}/part-{part:06d}-{step:04d}-{uuid.uuid4().hex}.wacz"
            note = json.dumps({"profile": "data-package", "resources": [{"path": DATA, "bytes": place}, {"path": INDEX}]}).encode()
            with filesystem.open_output_stream(path) as out:
                write_zip(out, [(DATA, records), (INDEX, ["".join(lines).encode()]), (PACKAGE, [note])], zip64=step % 2 == 1)
            n, records, lines, place, step = len(records), [], [], 0, step + 1
            return pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

        for batch in batches:
            _, offsets = texts(batch.column(2))
            for i, j in slices(offsets, 4 << 20):
                for page_id, url, html, digest, first in zip(*(c.slice(i, j - i).to_pylist() for c in batch.columns), strict=True):
                    refers_to = None if first is None or page_id is None or first == page_id else first
                    raw = _record(page_id, url, (html or "").encode(), digest, refers_to)
                    lines.append(f"{'-' if page_id is None else page_id} 19700101000000 " + json.dumps({"digest": f"sha256:{digest}", "offset": place, "length": len(raw), "filename": DATA}) + "\n")
                    records.append(raw)
                    place += len(raw)
                    if place >= PACKAGE_BYTES:
                        yield flush()
        if records:
            yield flush()

    return write


def _reader(uri: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, _ = open_fs(uri)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with filesystem.open_input_file(path) as file:
                    rows = [parse_record(raw) for raw in read_package(file)]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return read


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page into packages in a folder; one row per package (path, records).

    Of pages with equal payloads of at least 100 bytes the one of the smallest id is a response and the
    others are revisits of it. Payloads are told apart by SHA-256 in the JVM; a payload many pages share
    is summed up before the shuffle, and only digests and ids are shuffled. Null html is an empty payload;
    a null url is left out; a page of null id is a response. Rows repeated with one id are alike: all
    responses, or all revisits. Each attempt of a task writes files of its own, and only those of the
    attempt that succeeds are listed. Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    equal = rows.where((F.octet_length("html") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    shared = settle(equal.where("first < last").select("digest", "first"), "digests", few=True)
    filesystem, root = open_fs(folder)
    filesystem.create_dir(root, recursive=True)
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", "digest", "first").mapInArrow(lean(_writer(folder)), "path string, records long")


def warc_round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write all pages into packages, then read every record back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    The list of packages, in memory on the driver, has some bytes for each task or 32 MB of records. An
    empty table gives no packages and no rows.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    paths = [(r["path"],) for r in write_packages(pages, folder, **columns).collect()]
    return spark.createDataFrame(paths, "path string").repartition(max(1, len(paths))).mapInArrow(lean(_reader(folder)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
