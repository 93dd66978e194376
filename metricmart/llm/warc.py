"""WARC records in ZIP packages: written by Spark, read back by ranges.

A package is a ZIP file whose members are stored, not compressed:
``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj``
(offset and length of every record). The reader never extracts a package: it
reads the end of the file, follows the central directory (ZIP64 included),
finds where the stored members start, reads the index, and then each record's
byte range, spread over tasks by package and offset. An archive without an index
is scanned record by record, in bounded pieces: a ``.warc.gz`` by its gzip members, a
``.warc`` by the lengths in its records' headers. An archive that can be read in
neither way, or an index entry that fits no archive or several, is an error.

Packages are committed by Spark's own file writer, one row a file, so a retried
or speculative task leaves no half package. That writer ends a row with a line
feed, which is the ZIP comment here.

Of pages with equal payloads of ``REVISIT_BYTES`` or more, the one with the
largest page_id is a response and the others revisit it.

Defined results: a NULL html is an empty payload; a NULL page_id is written as
an id of "" and read back as NULL, and never is the largest unless all are NULL
(then refers_to is NULL); equal rows that share the largest page_id are all
responses; an empty table writes no package and reads back no record; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricmart.llm.common import materialise, runs, table
from metricmart.session import checkpoint_root

REVISIT_BYTES = 1000
#: A package is closed once its records reach this size, so a task holds little more.
PACKAGE_BYTES = 16 << 20
#: Bytes fetched at once; adjacent records are read together up to this.
READ_BYTES = 1 << 20
#: Bytes fetched at once where only a record's header is wanted.
HEAD_BYTES = 4096
#: Package bytes that a reading task gets, on average.
TASK_BYTES = 16 << 20
GZIP_LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"


# ---- records ------------------------------------------------------------------------------------

def _clean(value: str) -> str:
    """A header value without line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def page_record(page_id: str, url: str, payload: bytes, digest_hex: str, refers_to: str | None, refers_url: str) -> bytes:
    """A response record, or a revisit record (HTTP headers only) if ``refers_to`` is given."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    headers = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{_clean(page_id)}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {digest}",
        "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(),
    ]
    if refers_to is not None:
        headers += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{_clean(refers_to)}>",
                    f"WARC-Refers-To-Target-URI: {_clean(refers_url)}", f"WARC-Refers-To-Date: {DATE}"]
    headers.append(f"Content-Length: {len(block)}")
    return "\r\n".join([*headers, "", ""]).encode() + block + b"\r\n\r\n"


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n")[1:])
    return {k.decode().strip().lower(): v.decode().strip() for k, _, v in pairs}


def _digest_hex(value: str | None) -> str | None:
    """Lower-case hex of a labelled SHA-1 in base32 or hex."""
    if not value or not value.lower().startswith("sha1:"):
        return None
    digits = value[5:]
    return base64.b32decode(digits.upper()).hex() if len(digits) == 32 else digits.lower()


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed WARC record; digests are checked against the bytes read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record at this place")
    named = _headers(head)
    block = rest[: int(named["content-length"])]
    if len(block) < int(named["content-length"]):
        raise ValueError("a WARC record ends early")
    http, payload = {}, block
    if named.get("content-type", "").startswith("application/http"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(top)
    revisit = named["warc-type"] == "revisit"
    stated = _digest_hex(named.get("warc-payload-digest"))
    own = hashlib.sha1(payload).hexdigest()
    stated_block = _digest_hex(named.get("warc-block-digest"))
    whole = stated_block is None or stated_block == hashlib.sha1(block).hexdigest()
    return {
        "record_type": named["warc-type"], "record_id": named.get("warc-record-id", "").strip("<>"),
        "url": named.get("warc-target-uri"), "refers_to": named.get("warc-refers-to", "").strip("<>") or None,
        # a revisit states the digest and length of the payload that it leaves out
        "payload_digest": stated if revisit else own,
        "payload_bytes": int(http.get("content-length", 0)) if revisit else len(payload),
        "payload": None if revisit else payload,
        "intact": whole and (revisit or stated is None or stated == own),
    }


# ---- ZIP packages -------------------------------------------------------------------------------

def _member(name: bytes, data_crc: int, size: int, offset: int) -> tuple[bytes, bytes]:
    """Local and central header of a stored member, sizes and offset in ZIP64 fields."""
    common = struct.pack("<HHHHH", 0x0800, 0, 0, 0x21, data_crc & 0xFFFF) + struct.pack("<HII", data_crc >> 16, 0xFFFFFFFF, 0xFFFFFFFF)
    local_extra = struct.pack("<HHQQ", 1, 16, size, size)
    central_extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
    local = b"PK\x03\x04" + struct.pack("<H", 45) + common + struct.pack("<HH", len(name), len(local_extra)) + name + local_extra
    central = b"PK\x01\x02" + struct.pack("<HH", 45, 45) + common + struct.pack(
        "<HHHHHII", len(name), len(central_extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + central_extra
    return local, central


def package(members: list[tuple[str, bytes]], comment: bytes = b"\n") -> bytes:
    """A ZIP64 file of stored members. The comment is left for the writer to append."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        local, central = _member(name.encode(), zlib.crc32(data), len(data), len(out))
        out += local + data
        directory += central
    at, n = len(out), len(members)
    end = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(directory), at)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, at + len(directory), 1)
    classic = b"PK\x05\x06" + struct.pack("<HHHHIIH", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment))
    return bytes(out + directory + end + locator + classic)


class RangeFile:
    """Reads byte ranges of a file in any store that Arrow's file systems reach."""

    def __init__(self, path: str):
        path = re.sub(r"^file:/+", "file:///", re.sub(r"^s3a:", "s3:", path))
        if "://" in path:
            system, path = fs.FileSystem.from_uri(path)
        else:
            system = fs.LocalFileSystem()
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(n)
        if len(data) < n:
            raise ValueError("a range reaches beyond the file")
        return data

    def close(self) -> None:
        self.file.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    size: int
    stored_size: int
    header: int

    @property
    def stored(self) -> bool:
        return self.method == 0 and not self.flags & 1


def directory_range(f) -> tuple[int, int, int]:
    """Offset and size of the central directory, and how far all offsets are shifted by data in front."""
    tail = f.read(max(0, f.size - 65557), min(f.size, 65557))
    at = len(tail)
    while (at := tail.rfind(b"PK\x05\x06", 0, at)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    if at < 0:
        raise ValueError("no end of a ZIP central directory")
    end = f.size - len(tail) + at
    size, offset = struct.unpack_from("<II", tail, at + 12)
    locator = f.read(end - 20, 20) if end >= 20 else b""
    if locator[:4] == b"PK\x06\x07":
        stated = struct.unpack_from("<Q", locator, 8)[0]
        # data in front shifts it: it then stands right before its locator
        for place in (stated, end - 20 - 56):
            record = f.read(place, 56) if 0 <= place <= end - 20 - 56 else b""
            if record[:4] == b"PK\x06\x06":
                size, offset = struct.unpack_from("<QQ", record, 40)
                return offset + place - offset - size, size, place - size - offset
        raise ValueError("no ZIP64 end of the central directory")
    return end - size, size, end - size - offset


def members(f) -> list[Member]:
    """The central directory's entries, with the real places of their headers."""
    start, size, shift = directory_range(f)
    data, out, at = f.read(start, size), [], 0
    while at < size:
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("a damaged ZIP central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        stored, real = struct.unpack_from("<II", data, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # ZIP64: the fields that the entry leaves full, in this order
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                real = next(wide) if real == 0xFFFFFFFF else real
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + length
        out.append(Member(name, method, flags, real, stored, header + shift))
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(f, member: Member) -> int:
    """Where a stored member's bytes start; its local header has name and extra lengths of its own."""
    if not member.stored:
        raise ValueError(f"{member.name} is compressed or encrypted and can't be read by ranges")
    header = f.read(member.header, 30)
    if header[:4] != b"PK\x03\x04":
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", header, 26))


def scan_gzip(f, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member in a range, read piece by piece."""
    at, end, begin, inflate, buffer = start, start + size, start, zlib.decompressobj(31), b""
    while at < end or buffer:
        if not buffer:
            buffer = f.read(at, min(READ_BYTES, end - at))
            at += len(buffer)
        inflate.decompress(buffer)
        buffer = inflate.unused_data
        if inflate.eof:
            stop = at - len(buffer)
            yield begin, stop - begin
            begin, inflate = stop, zlib.decompressobj(31)
        else:
            buffer = b""
    if begin != end:
        raise ValueError("a gzip member ends early")


def scan_plain(f, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of each record in a range that isn't compressed; only the headers are read."""
    at, end = start, start + size
    while at < end:
        head, stop = b"", -1
        while stop < 0:
            if at + len(head) == end or len(head) >= READ_BYTES:
                raise ValueError("a WARC record's header has no end")
            head += f.read(at + len(head), min(HEAD_BYTES, end - at - len(head)))
            stop = head.find(b"\r\n\r\n")
        length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", head[: stop + 2])
        if not head.startswith(b"WARC/") or not length:
            raise ValueError("no WARC record where one should start")
        n = stop + 4 + int(length[1]) + 4
        if at + n > end or f.read(at + n - 4, 4) != b"\r\n\r\n":
            raise ValueError("a WARC record ends early")
        yield at, n
        at += n


def archive_of(name: str, archives: list[Member]) -> Member:
    """The archive that an index entry names: by its path, the end of its path or its base name, if that fits one only."""
    base = name.rpartition("/")[2]
    for fits in (lambda m: m.name == name, lambda m: m.name.endswith(f"/{name}"), lambda m: m.name.rpartition("/")[2] == base):
        found = [m for m in archives if fits(m)]
        if len(found) == 1:
            return found[0]
        if found:
            break
    raise ValueError(f"the index names {name}, which fits {len(found)} archives")


def entries(f) -> Iterator[tuple[int, int]]:
    """(offset in the file, length) of every record in a package's stored archives."""
    listed = members(f)
    archives = [m for m in listed if re.search(r"\.warc(\.gz)?$", m.name)]
    places: dict[str, tuple[Member, int]] = {}  # of each name in the indexes
    for m in listed:
        if re.search(r"\.cdxj?$", m.name):
            start = data_start(f, m)
            for line in f.read(start, m.size).splitlines():
                if b"{" not in line:
                    continue
                entry = json.loads(line[line.index(b"{") :])
                if entry["filename"] not in places:
                    archive = archive_of(entry["filename"], archives)
                    places[entry["filename"]] = archive, data_start(f, archive)
                yield places[entry["filename"]][1] + int(entry["offset"]), int(entry["length"])
    indexed = {archive.header for archive, _ in places.values()}
    for m in archives:
        if m.header not in indexed:
            scan = scan_gzip if m.name.endswith(".gz") else scan_plain
            yield from scan(f, data_start(f, m), m.size)


# ---- Spark jobs ---------------------------------------------------------------------------------

def _url_key(url: str) -> str:
    host = urlsplit(url).hostname or "" if "://" in url else ""
    return re.sub(r"\s", "%20", ",".join(reversed(host.lower().split("."))) + ")" + url.partition("://")[2].partition("/")[2]) or "-"


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html (bytes), digest, refers_to, refers_url of each page."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    # a second, independent hash: SHA-1 alone can be made to collide
    pages = pages.select("*", F.sha1("html").alias("digest"), F.xxhash64("html").alias("check"), F.octet_length("html").alias("n"))
    keys = ["digest", "check", "n"]
    known = pages.filter(F.col("n") >= least_bytes).groupBy(*keys).agg(
        F.count("*").alias("copies"), F.max("page_id").alias("keeper"), F.max_by("url", "page_id").alias("refers_url"))
    # written: small beside the pages, and a payload with very many copies can be split in the join
    known = materialise(known.filter("copies > 1").drop("copies"), "warc-repeats")
    revisits = F.col("n") >= least_bytes
    joined = pages.join(known, keys, "left")
    again = revisits & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "html", "digest", F.when(again, F.col("keeper").cast("string")).alias("refers_to"),
                         F.coalesce("refers_url", F.lit("")).alias("refers_url"))


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> None:
    """Write ZIP packages of the pages' records to ``folder``, in any store that Spark writes to."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, index = bytearray(), []

        def closed() -> pa.RecordBatch:
            lines = "".join(f"{k} {DATE.translate({45: None, 58: None, 84: None, 90: None})} {json.dumps(v)}\n" for k, v in sorted(index, key=lambda x: x[0]))
            data = package([(RECORDS, bytes(records)), (INDEX, lines.encode())])
            records.clear()
            index.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

        for batch in batches:
            for run in runs(batch, "html"):
                for row in run.to_pylist():
                    page_id = "" if row["page_id"] is None else row["page_id"]
                    raw = page_record(page_id, row["url"], row["html"], row["digest"], row["refers_to"], row["refers_url"])
                    gzip = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    member = gzip.compress(raw) + gzip.flush()
                    kind = "text/html" if row["refers_to"] is None else "warc/revisit"
                    index.append((_url_key(row["url"]), {
                        "url": row["url"], "mime": kind, "status": "200", "digest": f"sha1:{row['digest']}",
                        "offset": str(len(records)), "length": str(len(member)), "filename": RECORDS.rpartition("/")[2]}))
                    records += member
                    if len(records) >= package_bytes:
                        yield closed()
        if index:
            yield closed()

    rows = with_revisits(pages).withColumn("page_id", F.col("page_id").cast("string"))
    packages = rows.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value"))
    packages.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(folder)


RECORD = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("intact", T.BooleanType()),
])


def read_packages(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record of the packages below ``folder``, range-read by tasks that share out the offsets."""
    def list_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                if not size:
                    continue  # the writer's file of a task without rows
                f, rows = RangeFile(path), []
                for offset, length in entries(f):
                    rows.append((path, offset, length))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                f.close()
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)]],
            names=["path", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, opened, held, begin = None, None, b"", 0
        for batch in batches:
            places = [tuple(r.values()) for r in batch.to_pylist()]
            out, size = [], 0
            for i, (path, offset, length) in enumerate(places):
                if path != opened:
                    if f:
                        f.close()
                    f, opened, held, begin = RangeFile(path), path, b"", 0
                if not begin <= offset <= offset + length <= begin + len(held):
                    stop, k = offset + length, i + 1
                    while k < len(places) and places[k][:2] == (path, stop) and stop + places[k][2] - offset <= READ_BYTES:
                        stop, k = stop + places[k][2], k + 1
                    held, begin = f.read(offset, stop - offset), offset
                raw = held[offset - begin : offset - begin + length]
                record = parse_record(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                record = {"path": path, "offset": offset, "length": length, **record}
                if not with_payload:
                    record["payload"] = None
                out.append(record)
                size += len(record["payload"] or b"") + 200
                if size >= READ_BYTES:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if f:
            f.close()

    arrow = pa.schema([
        ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()),
        ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
        ("payload", pa.binary()), ("intact", pa.bool_())])
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    places = files.repartition("path").mapInArrow(list_records, "path string, offset bigint, length bigint")
    # the places are few bytes, what they point to isn't: the number of tasks follows the packages' size
    total = files.agg(F.sum("length")).first()[0] or 0
    part = F.floor(F.col("offset") / (4 * READ_BYTES))
    return places.repartition(1 + total // TASK_BYTES, "path", part).sortWithinPartitions("path", "offset").mapInArrow(read, RECORD)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record in a ZIP package and read back by ranges."""
    folder = f"{checkpoint_root(spark)}/metricmart-llm/warc-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    write_packages(pages, folder)
    page = lambda c: F.when(F.col(c) != ID, F.substring(c, len(ID) + 1, 1 << 30)).cast(kind)
    return read_packages(spark, folder, with_payload=False).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP5_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages
), k AS (
  SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY html) END AS keeper FROM p
)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
FROM k
"""
