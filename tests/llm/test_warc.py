import gzip
import hashlib
import io
import random
import zipfile
import zlib

import pytest

from metricmart.llm import warc as W


class Bytes:
    def __init__(self, data):
        self.data, self.size, self.asked = data, len(data), 0

    def read(self, offset, n):
        assert 0 <= offset and offset + n <= self.size
        self.asked += n
        return self.data[offset:offset + n]


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def sample():
    rnd = random.Random(4)
    say = lambda n: "".join(rnd.choice("abcé <>\r\n日") for _ in range(n))
    big, small = say(1500), "x" * 999
    rows = [(1, "http://a.b/c?d=1", big), (9, "http://A.b/", big), (4, None, big), (5, "x\r\ny", small), (6, "u", small),
            (7, "u", None), (8, "u", ""), (None, "u", big), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (11, "u", "y" * 1000)]
    return rows + [(100 + i, f"https://h{i}.org/p", say(rnd.randint(0, 4000))) for i in range(60)]


def test_written_and_read_back(spark, sf):
    rows = sample()
    got = W.op5_warc(spark, sf(pages=pages_of(spark, rows))).collect()
    payloads = {}
    for i, _, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000 and i is not None:
            payloads[payload] = max(i, payloads.get(payload, i))
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        keeper = payloads.get(payload)
        again = keeper is not None and keeper != i
        want.append((i, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", keeper if again else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_payloads_and_urls_survive(spark, scratch):
    rows = sample()
    W.write_packages(pages_of(spark, rows), scratch + "/out", package_bytes=20_000)
    records = W.read_packages(spark, scratch + "/out").collect()
    assert all(r.intact for r in records) and len({r.path for r in records}) > 2
    for i, url, html in rows[11:]:
        (r,) = [r for r in records if r.record_id == f"{W.ID}{i}"]
        assert (r.url, r.payload.decode()) == (url, html)


def test_packages_are_valid_zip64(spark, scratch, tmp_path):
    W.write_packages(pages_of(spark, sample()).coalesce(1), scratch + "/out")
    files = [r.path for r in spark.read.format("binaryFile").load(scratch + "/out").select("path", "length").filter("length > 0").collect()]
    for path in files:
        with zipfile.ZipFile(path.removeprefix("file:")) as z:
            assert z.testzip() is None and z.namelist() == [W.RECORDS, W.INDEX] and z.comment == b"\n"
            assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            assert gzip.decompress(z.read(W.RECORDS)).startswith(b"WARC/1.1\r\n")


def record(i):
    payload = f"<p>{i}</p>".encode() * (i + 1)
    return zlib.compress(W.page_record(str(i), "u", payload, hashlib.sha1(payload).hexdigest(), None, ""), wbits=31)


@pytest.mark.parametrize("front", [b"", b"#!/bin/sh\n" * 50])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 decoy"])
@pytest.mark.parametrize("wide", [False, True])
def test_other_writers_packages(front, comment, wide):
    """Classic and ZIP64 entries, data in front, comments, other members, no index."""
    out = io.BytesIO()
    data = [record(i) for i in range(5)]
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.comment = comment
        z.writestr("readme.txt", "not an archive", compress_type=zipfile.ZIP_DEFLATED)
        with z.open("archive/a.warc.gz", "w", force_zip64=wide) as m:
            m.write(b"".join(data))
    f = Bytes(front + out.getvalue())
    places = list(W.entries(f))
    records = [W.parse_record(zlib.decompress(f.read(*p), 31)) for p in places]
    assert [r["record_id"] for r in records] == [f"{W.ID}{i}" for i in range(5)]
    assert all(r["intact"] for r in records)


def test_ranges_only(monkeypatch):
    data = [record(i) for i in range(200)]
    lines, at = "", 0
    for d in data:
        lines += f'k 1 {{"offset": "{at}", "length": "{len(d)}", "filename": "data.warc.gz"}}\n'
        at += len(d)
    whole = W.package([(W.RECORDS, b"".join(data)), (W.INDEX, lines.encode()), ("other.bin", bytes(500_000))]) + b"\n"
    f = Bytes(whole)
    places = list(W.entries(f))
    assert W.parse_record(zlib.decompress(f.read(*places[77]), 31))["record_id"] == f"{W.ID}77"
    assert f.asked < 0.3 * len(whole)


def test_refusals():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", record(1) * 50)
    with pytest.raises(ValueError, match="compressed"):
        list(W.entries(Bytes(out.getvalue())))
    with pytest.raises(ValueError, match="end of a ZIP"):
        W.members(Bytes(b"no zip" * 100))
    broken = W.page_record("1", "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None, "")
    assert not W.parse_record(broken)["intact"]


def test_empty_table(spark, sf):
    assert W.op5_warc(spark, sf(pages=pages_of(spark, []))).count() == 0


def plain(i, n=20):
    return W.page_record(str(i), f"http://p/{i}", b"z" * n, hashlib.sha1(b"z" * n).hexdigest(), None, "")


def test_plain_archives_are_scanned(monkeypatch):
    monkeypatch.setattr(W, "HEAD_BYTES", 50)
    data = [plain(i, n) for i, n in enumerate([0, 7, 9000, 20])]
    whole = W.package([("archive/a.warc", b"".join(data)), ("archive/empty.warc", b"")]) + b"\n"
    f = Bytes(whole)
    assert [f.data[at:at + n] for at, n in W.entries(f)] == data
    for bad in (b"".join(data)[:-1], b"no record\r\n\r\n", b"x" * 300):
        with pytest.raises(ValueError):
            list(W.entries(Bytes(W.package([("a.warc", bad)]) + b"\n")))


@pytest.mark.parametrize("indexed", [True, False])
def test_archives_of_one_name_in_two_folders(indexed):
    one, two = [gzip.compress(plain(i)) for i in range(3)], [gzip.compress(plain(i, 500)) for i in range(10, 15)]
    lines = "".join(
        f'k 1 {{"offset": "{len(b"".join(data[:k]))}", "length": "{len(r)}", "filename": "{name}"}}\n'
        for name, data in (("a/data.warc.gz", one), ("b/data.warc.gz", two)) for k, r in enumerate(data))
    parts = [("a/data.warc.gz", b"".join(one)), ("b/data.warc.gz", b"".join(two))]
    f = Bytes(W.package(parts + [("indexes/index.cdxj", lines.encode())] * indexed) + b"\n")
    assert [f.data[at:at + n] for at, n in W.entries(f)] == one + two


def test_unclear_index_entries_are_refused():
    line = b'k 1 {"offset": "0", "length": "1", "filename": "data.warc.gz"}\n'
    for names in (["a/data.warc.gz", "b/data.warc.gz"], ["other.warc.gz"]):
        with pytest.raises(ValueError):
            list(W.entries(Bytes(W.package([(n, gzip.compress(plain(1))) for n in names] + [("index.cdxj", line)]) + b"\n")))
