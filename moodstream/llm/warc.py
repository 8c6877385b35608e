"""WARC records inside ZIP packages: written once per task, read back by ranges without unpacking."""

import base64
import io
import re
import struct
import zipfile
import zlib
from hashlib import sha1
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodstream.llm.hashing import pieces
from moodstream.llm.shared import stored, table
from moodstream.session import fresh_dir

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: A package is closed, and a range read at once, at about so many bytes.
PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it. The folder must be one that all executors share."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def _digest(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def _record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Package:
    """One ZIP package that is being written: records first, then their index, both stored."""

    def __init__(self, folder: str):
        self.files, root = opened(folder)
        self.files.create_dir(root, recursive=True)
        self.name = f"{uuid4().hex}.zip"
        self.out = self.files.open_output_stream(f"{root}/{self.name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.size, self.index = 0, io.BytesIO()

    def add(self, record: bytes) -> None:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = squeeze.compress(record) + squeeze.flush()
        self.member.write(data)
        self.index.write(b"%d %d\n" % (self.size, len(data)))
        self.size += len(data)

    def close(self) -> str:
        self.member.close()
        self.zip.writestr(INDEX, self.index.getvalue())
        self.zip.close()
        self.out.close()
        return self.name


def written(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(path, records) of the ZIP packages in `folder` that hold a record for each row of `pages` (page_id, url, html).

    Of rows with equal payloads of at least `least` bytes, those with the smallest page_id are responses, the others
    revisits of it; smaller payloads are all responses. The payload is the html in UTF-8; null is empty; a null page_id
    counts as larger than any, and its record names none. Each task writes packages of its own under fresh names, and
    only those that the stored list names count, so a task that is lost or run twice leaves no wrong record behind.
    """
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html"))
    key = source.select("page_id", F.sha1("html").alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= least)
    first = key.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = key.join(first.select("sha", "size", "first"), ["sha", "size"]).where("page_id is null or page_id != first")
    again = again.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "first").distinct()
    same = F.col("page_id").eqNullSafe(F.col("p")) & (F.sha1("html") == F.col("s"))
    rows = source.join(again, same, "left").select("page_id", "url", "html", "first")

    def each(batches):
        package, count, out = None, 0, []
        for whole in batches:
            for batch in pieces(whole, "html"):
                for page_id, url, html, refers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    package = package or _Package(folder)
                    package.add(_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers, date))
                    count += 1
                    if package.size >= PACKAGE_BYTES:
                        out.append((f"{folder}/{package.close()}", count))
                        package, count = None, 0
        if package:
            out.append((f"{folder}/{package.close()}", count))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["path", "records"])

    return stored(rows.mapInArrow(each, "path string, records long"), "packages")


def directory(source: pa.NativeFile, size: int) -> list[tuple[str, int, int, int]]:
    """(name, method, bytes, place of the data) of each member, from the central directory at the end of a ZIP file."""

    def at(place: int, length: int) -> bytes:
        source.seek(place)
        return source.read(length)

    tail_at = max(0, size - 22 - 0xFFFF)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file: it has no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if (count == 0xFFFF or 0xFFFFFFFF in (length, start)) and tail_at + end >= 20:
        sign, _, place, _ = struct.unpack("<4sIQI", at(tail_at + end - 20, 20))
        if sign == b"PK\x06\x07":
            sign, *_, count, length, start = struct.unpack("<4sQHHIIQQQQ", at(place, 56))
            if sign != b"PK\x06\x06":
                raise ValueError("a broken ZIP64 end of central directory")
    entries, found, pos = at(start, length), [], 0
    for _ in range(count):
        if entries[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("a broken entry in the central directory")
        flags, method = struct.unpack("<HH", entries[pos + 8 : pos + 12])
        packed, plain, names, extras, comments = struct.unpack("<IIHHH", entries[pos + 20 : pos + 34])
        (header,) = struct.unpack("<I", entries[pos + 42 : pos + 46])
        name = entries[pos + 46 : pos + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[pos + 46 + names : pos + 46 + names + extras]
        while len(extra) >= 4:
            kind, span = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: 64-bit values for those fields that are all ones, in this order
                wide = list(struct.unpack(f"<{span // 8}Q", extra[4 : 4 + span // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + span :]
        own_names, own_extras = struct.unpack("<HH", at(header + 26, 4))
        found.append((name, method, packed, header + 30 + own_names + own_extras))
        pos += 46 + names + extras + comments
    return found


def records(packages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of every record in the packages (path).

    A task per package reads its central (or ZIP64) directory and the stored index members; the ranges they name are dealt
    out by package and place, and each is read and unpacked by itself. Members that are not stored are an error. A
    revisit has no payload of its own: its size and digest come from its headers.
    """

    def ranges(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, name = opened(path)
                with files.open_input_file(name) as source:
                    members = {n: (m, s, p) for n, m, s, p in directory(source, source.size())}
                    if any(m for m, *_ in members.values()):
                        raise ValueError(f"{path}: members must be stored")
                    (_, _, data), (_, size, at) = members[ARCHIVE], members[INDEX]
                    source.seek(at)
                    lines, read = b"", 0
                    while read < size:
                        part = source.read(min(RANGE_BYTES, size - read))
                        read += len(part)
                        *full, lines = (lines + part).split(b"\n")
                        pairs = [tuple(map(int, x.split())) for x in full if x]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path] * len(pairs)), pa.array([data + o for o, _ in pairs], pa.int64()), pa.array([n for _, n in pairs], pa.int64())],
                            ["path", "place", "size"],
                        )

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches):
        source, held = None, None
        for batch in batches:
            out, size = [], 0
            for path, place, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != held:
                    if source:
                        source.close()
                    files, name = opened(path)
                    source, held, window, start = files.open_input_file(name), path, b"", 0
                if not start <= place <= place + length <= start + len(window):
                    source.seek(place)
                    start, window = place, source.read(max(length, RANGE_BYTES))
                out.append(_parsed(zlib.decompress(window[place - start : place - start + length], 31)))
                size += out[-1][1]
                if size > RANGE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if source:
            source.close()

    found = packages.select("path").repartition("path").mapInArrow(ranges, "path string, place long, size long")
    found = stored(found, "ranges")
    # The number of tasks follows the bytes to read: the ranges themselves are too small for a merge at run time to tell.
    share = 4 * RANGE_BYTES
    tasks = (found.agg(F.sum("size")).first()[0] or 0) // share + 1
    found = found.repartition(tasks, "path", F.floor(F.col("place") / share)).sortWithinPartitions("path", "place")
    return found.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _parsed(record: bytes) -> tuple:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = re.fullmatch("<urn:page:(.*)>", fields["WARC-Record-ID"])[1]
    kind = fields["WARC-Type"]
    if kind == "revisit":
        size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
        return int(page) if page else None, size, digest, kind, int(re.fullmatch("<urn:page:(.*)>", fields["WARC-Refers-To"])[1]), None
    if _digest(payload) != digest:
        raise ValueError(f"the payload of page {page} does not match its digest")
    return int(page) if page else None, len(payload), digest, kind, None, payload


def op2_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, as its record reads after packing."""
    packages = written(table(spark, sf_dir, "pages"), fresh_dir(spark, "warc"))
    return records(packages).drop("payload")


QUERIES = {"op2_zip_warc": op2_zip_warc}
_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVES = " || ".join(f"substr('{_ABC}', cast(floor(v / {32**k}) as int) % 32 + 1, 1)" for k in (3, 2, 1, 0))
SQL = {
    "op2_zip_warc": f"""
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as sha from pages),
f as (select sha, min(page_id) as first from p group by sha),
b as (select page_id, i, cast('0x' || substr(sha, i * 5 + 1, 5) as bigint) as v from (select page_id, sha, unnest(range(0, 8)) as i from p)),
d as (select page_id, string_agg({_FIVES}, '' order by i) as digest from b group by page_id)
select p.page_id, p.n as payload_bytes, d.digest as payload_digest,
  case when p.page_id = f.first then 'response' else 'revisit' end as record_type, case when p.page_id <> f.first then f.first end as refers_to
from p join f using (sha) join d using (page_id)""",
}
