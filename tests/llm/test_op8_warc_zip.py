import gzip
import hashlib
import io
import zipfile

import pytest

from pipewright.llm import warc_zip as wz
from pipewright.llm.common import new_folder, open_fs

from .helpers import table

SCHEMA = "page_id long, url string, html string, digest string"
ROWS = [
    (5, "http://a.example/x y\r\nz", "<p>" + "same " * 50, "d"), (3, "http://b.example", "<p>" + "same " * 50, "d"), (9, None, "<p>" + "same " * 50, "d"),
    (4, "u", "short", "d"), (2, "u", "short", "d"), (7, "u", None, "d"), (8, "u", "", "d"), (10, "u", "é" * 50, "d"), (11, "u", "é" * 50, "d"),
    (12, "u", "x" * 99, "d"), (13, "u", "x" * 99, "d"), (14, "u", "\r\n\r\nWARC/1.1\r\n" * 20_000, "d"), (None, "u", "<p>" + "same " * 50, "d"), (9, None, "<p>" + "same " * 50, "d"),
]


def want(rows):
    out = []
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        equal = [r[0] for r in rows if r[0] is not None and (r[2] or "").encode() == raw]
        first = min(equal) if equal and len(raw) >= 100 and page_id is not None else page_id
        revisit = page_id is not None and first != page_id
        out.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = wz.warc_round_trip(table(spark, ROWS, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == want(ROWS)
    assert wz.warc_round_trip(table(spark, [], SCHEMA)).collect() == []


def test_other_tools_read_the_packages(spark):
    folder = new_folder(spark, "warc")
    packages = wz.write_packages(table(spark, ROWS, SCHEMA).coalesce(1), folder).collect()
    assert sum(p.records for p in packages) == len(ROWS)
    for p in packages:
        with zipfile.ZipFile(p.path) as z:
            assert z.testzip() is None and set(z.namelist()) == {wz.DATA, wz.INDEX, wz.PACKAGE}
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            text = gzip.decompress(z.read(wz.DATA))
            assert text.count(b"WARC-Type: ") == p.records and b"http://a.example/x%20y%0D%0Az" in text
    assert open_fs(folder)[1] in packages[0].path


class File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("zip64", [False, True])
def test_directories(zip64):
    members = [("a/b", [b"one", b"two"]), ("é", [b""]), ("c", [b"x" * 70_000])]
    out = io.BytesIO()
    wz.write_zip(out, members, zip64)
    f = File(out.getvalue())
    assert {k: f.read_at(n, at) for k, (at, n) in wz.zip_members(f).items()} == {k: b"".join(v) for k, v in members}
    assert (b"PK\6\6" in out.getvalue()) == zip64


def test_foreign_zips():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("stored", b"abc")
        z.writestr(zipfile.ZipInfo("dir/"), b"")
        z.writestr("packed", b"abc" * 100, zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as w:
            w.write(b"wide")
        z.comment = b"PK a comment"
    f = File(raw.getvalue())
    found = wz.zip_members(f)
    assert set(found) == {"stored", "wide"} and f.read_at(4, found["wide"][0]) == b"wide"
    with pytest.raises(ValueError):
        wz.zip_members(File(b"nothing here"))


def test_broken_records():
    good = wz._record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert wz.parse_record(good) == (1, 7, hashlib.sha256(b"payload").hexdigest(), "response", None)
    with pytest.raises(ValueError):
        wz.parse_record(wz._record(1, "u", b"payload", "0" * 64, None))
