"""WARC archives with a two-level capture index.

Archives. Every page is one record, a gzip member of its own, in a ``.warc.gz`` file of about ``ARCHIVE_BYTES``. Of pages with
equal payloads of at least ``min_bytes`` that with the least page_id (null last; ties: least url, then row) is a ``response``,
the others are ``revisit`` records that keep the HTTP headers and refer to it. Which is which is settled by one aggregation
over digests and one join by row, so that a payload that a third of all pages share costs no task more than others.

Index. Captures are sorted by reversed-host URL key (``com,example,blog)/path?query``) and dealt into index parts of like size.
A part is a file: zlib-compressed blocks of ``BLOCK_LINES`` lines of JSON, behind them its sparse directory (the first
key, offset and length of each block), at the end the directory's place. A lookup takes distinct keys to the parts whose
key range holds them, searches the directory by bisection, and reads and decompresses only the blocks that may hold a key.
Captures found are read by range from the archives, neighbours in one read.

Files are written below the session's shared folder through ``pyarrow.fs``; every attempt of a task has file names of its own,
and only names in the table that Spark has committed count, so a lost executor leaves at most a file that nothing names. The
driver holds one line an index part.

Defined results: a null html is the empty payload; a null or unreadable url has the key ``)`` and the url as it is; line ends
in a url are written as percent escapes in the record, and as they are in the index; null page_ids are kept; repeated rows
are pages of their own; payloads under ``min_bytes`` are all responses; an empty table gives no archives, no index
parts and no rows; a page is one value of a row, as in the input; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import step_path
from .common import cut, partitions, small_batches, table

ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 1000
LEVEL = 3
#: Bytes between two records that are read over, and the most that one read takes.
GAP, READ = 1 << 16, 8 << 20
#: Bytes of an archive that one task reads records from.
STRETCH = 64 << 20
DATE = "1970-01-01T00:00:00Z"
#: Fixed by the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FOOTER = "<QQ4s"
MARK = b"CIX1"
CAPTURE = "key string, url string, page_id long, archive string, offset long, length long, digest string, type string"
_CAPTURE = pa.schema([("key", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string()), ("type", pa.string())])
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_URL = re.compile(r"(?:([A-Za-z][A-Za-z0-9+.-]*):)?//([^/?#]*)([^#]*)", re.S)
_PORTS = {"http": "80", "https": "443"}


def url_key(url: str | None) -> str:
    """The URL with its host reversed; without scheme, user, leading www, usual port and fragment."""
    found = _URL.match(url or "")
    if not found or not found[2]:
        return ")" + (url or "")
    scheme, place, rest = found.groups()
    host, colon, port = place.rpartition("@")[2].lower().partition(":")
    labels = host.strip(".").split(".")
    if len(labels) > 2 and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    port = "" if not port or port == _PORTS.get((scheme or "http").lower()) else ":" + port
    return ",".join(reversed(labels)) + port + ")" + (rest if rest.startswith("/") else "/" + rest)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _files(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, given as a URI or a local path."""
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _record_id(row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, row)}>"


def _plain(value: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def _record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = [f"{k}: {_plain(v)}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None]
    member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    head = ("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode("utf-8", "surrogatepass")
    return member.compress(head + block + b"\r\n\r\n") + member.flush()


def page_record(row: str, page_id: int | None, url: str | None, html: str | None, first: dict | None) -> tuple[bytes, str]:
    """The compressed record of a page and its payload's digest; ``first`` is the page (row, page_id, url) that it revisits."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    number = lambda x: None if x is None else str(x)
    headers = [
        ("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", _record_id(row)), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", "sha1:" + digest), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", number(page_id)),
    ]
    if first:
        headers += [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first["row"])), ("WARC-Refers-To-Target-URI", first["url"]),
            ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", number(first["page_id"])),
        ]
    return _record(headers, http if first else http + payload), digest


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines if x)}


def read_record(member: bytes) -> Record:
    """A compressed record, its lengths checked."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    headers = _fields(head)
    size = int(headers["content-length"])
    if len(rest) != size + 4 or not head.startswith(b"WARC/1.1\r\n"):
        raise ValueError("a WARC record is damaged")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return Record(headers, _fields(http) if http.startswith(b"HTTP/") else {}, payload)


# ---------------------------------------------------------------- archives


def _with_rows(pages: DataFrame) -> DataFrame:
    """row, page_id, url, html; ``row`` is the place in the files that the table is read from, and where it has none, in a copy of it."""
    own = [F.col(c) for c in ("page_id", "url", "html")]
    try:
        return pages.select(F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("row"), *own)
    except AnalysisException:
        copy = cut(pages.select(*own), "pages")
        return copy.select(F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("row"), *own)


def _revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """row, first (row, page_id, url) of every page whose payload another page has written."""
    payload = F.coalesce("html", F.lit(""))
    marks = cut(rows.where(F.octet_length(payload) >= min_bytes).select("row", "page_id", "url", F.sha1(payload).alias("sha1")), "payloads")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("url").isNull().alias("no_url"), "url", "row")
    first = marks.groupBy("sha1").agg(F.min(order).alias("first"), F.count("*").alias("held")).where("held > 1")
    both = marks.join(first, "sha1").where(F.col("row") != F.col("first.row"))
    return cut(both.select("row", F.struct("first.row", "first.page_id", "first.url").alias("first")), "revisits")


def _archive(root: str, limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _files(root)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page in batch.to_pylist():
                    if out is None or at >= limit:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                        at = out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(name)), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    first = page["first"]
                    member, digest = page_record(page["row"], page["page_id"], page["url"], page["html"], first)
                    out.write(member)
                    rows.append({"key": url_key(page["url"]), "url": page["url"], "page_id": page["page_id"], "archive": name, "offset": at, "length": len(member), "digest": digest, "type": "revisit" if first else "response"})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(rows, _CAPTURE)
        finally:
            if out is not None:
                out.close()

    return work


@dataclass
class Archives:
    """A folder of archives, and its captures: key, url, page_id, archive, offset, length, digest, type."""

    root: str
    captures: DataFrame


def _new_folder(spark: SparkSession, name: str) -> str:
    root = step_path(spark, name)
    system, folder = _files(root)
    system.create_dir(folder, recursive=True)
    return root


def write_archives(pages: DataFrame, min_bytes: int = 0, limit: int = ARCHIVE_BYTES) -> Archives:
    """Writes every page (page_id, url, html) as a record."""
    spark = pages.sparkSession
    small_batches(spark, 128)
    root = _new_folder(spark, "warc")
    rows = _with_rows(pages.select("*"))
    marked = rows.join(_revisits(rows, min_bytes), "row", "left").select("row", F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), "first")
    return Archives(root, cut(marked.mapInArrow(_archive(root, limit), CAPTURE), "captures"))


# ---------------------------------------------------------------- index


def _index(root: str, lines: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _files(root)
        held: list[str] = []
        directory: list[tuple[str, int, int]] = []
        first = last = None
        out, name, at, n = None, "", 0, 0

        def close() -> None:
            nonlocal at
            block = zlib.compress("\n".join(held).encode("utf-8", "surrogatepass"), 6)
            directory.append((json.loads(held[0])[0], at, len(block)))
            at += out.write(block)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.cix"
                    out, first = system.open_output_stream(f"{folder}/{name}", compression=None), row[0]
                held.append(json.dumps(row))
                last, n = row[0], n + 1
                if len(held) >= lines:
                    close()
        if out is None:
            return
        if held:
            close()
        sparse = zlib.compress(json.dumps(directory).encode(), 6)
        out.write(sparse)
        out.write(struct.pack(FOOTER, at, len(sparse), MARK))
        out.close()
        yield pa.RecordBatch.from_pylist([{"name": name, "first": first, "last": last, "captures": n, "blocks": len(directory)}])

    return work


@dataclass
class CaptureIndex:
    """Index parts in key order: (file, first key, last key)."""

    root: str
    parts: list[tuple[str, str, str]]
    table: DataFrame


def write_index(archives: Archives, lines: int = BLOCK_LINES) -> CaptureIndex:
    """Sorts captures into parts of blocks. Places in the archives part equal keys, so that no key is too much for one part."""
    spark = archives.captures.sparkSession
    small_batches(spark, 2048)
    root = _new_folder(spark, "index")
    order = ["key", "archive", "offset"]
    dealt = archives.captures.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    names = ["key", "url", "page_id", "archive", "offset", "length", "digest", "type"]
    parts = cut(dealt.select(*names).mapInArrow(_index(root, lines), "name string, first string, last string, captures long, blocks long"), "index-parts")
    # UTF-8 order, as Spark sorts
    listed = sorted(((r["name"], r["first"], r["last"]) for r in parts.collect()), key=lambda p: (_bytes(p[1]), _bytes(p[2])))
    return CaptureIndex(root, listed, parts)


def _bytes(key: str) -> bytes:
    return key.encode("utf-8", "surrogatepass")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])


def _route(parts: list[tuple[str, str, str]]):
    """key -> the parts whose range holds it."""
    firsts, lasts = [_bytes(p[1]) for p in parts], [_bytes(p[2]) for p in parts]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str]] = []
            for key in batch.column(0).to_pylist():
                raw = _bytes(key)
                out += [(k, key) for k in range(bisect.bisect_left(lasts, raw), bisect.bisect_right(firsts, raw))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.string())], names=["part", "key"])

    return work


class IndexPart:
    """An index part, open: its directory in memory, its blocks read as they are needed."""

    def __init__(self, system: pafs.FileSystem, path: str) -> None:
        self.file = system.open_input_file(path)
        self.file.seek(self.file.size() - struct.calcsize(FOOTER))
        at, size, mark = struct.unpack(FOOTER, self.file.read(struct.calcsize(FOOTER)))
        if mark != MARK:
            raise ValueError(f"{path} is no index part")
        self.directory = json.loads(zlib.decompress(self._range(at, size)))
        self.firsts = [_bytes(first) for first, _, _ in self.directory]
        self.at, self.lines, self.keys, self.reads = -1, [], [], 0

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _block(self, k: int) -> None:
        if k != self.at:
            _, at, size = self.directory[k]
            self.lines = [json.loads(x) for x in zlib.decompress(self._range(at, size)).decode("utf-8", "surrogatepass").split("\n")]
            self.keys = [_bytes(x[0]) for x in self.lines]
            self.at, self.reads = k, self.reads + 1

    def captures(self, key: str) -> Iterator[list]:
        """Captures of a key: from the last block that begins before it up to the last one that begins with it."""
        raw = _bytes(key)
        for k in range(max(0, bisect.bisect_left(self.firsts, raw) - 1), bisect.bisect_right(self.firsts, raw)):
            self._block(k)
            yield from self.lines[bisect.bisect_left(self.keys, raw) : bisect.bisect_right(self.keys, raw)]


def _find(root: str, parts: list[tuple[str, str, str]]):
    names = [p[0] for p in parts]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _files(root)
        number, part, found = None, None, []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _CAPTURE, strict=True)]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, schema=_CAPTURE)

        for batch in batches:
            for k, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != number:
                    number, part = k, IndexPart(system, f"{folder}/{names[k]}")
                for capture in part.captures(key):
                    found.append(capture)
                    if len(found) >= 2048:
                        yield out()
        if found:
            yield out()

    return work


def lookup(index: CaptureIndex, urls: DataFrame, url: str = "url") -> DataFrame:
    """The captures of all distinct keys of ``urls``: key, url, page_id, archive, offset, length, digest, type."""
    spark = urls.sparkSession
    small_batches(spark, 2048)
    keys = urls.select(F.col(url).cast("string").alias("url")).mapInArrow(_keys, "key string").distinct()
    routed = keys.mapInArrow(_route(index.parts), "part int, key string")
    dealt = routed.repartition(max(1, min(partitions(spark), len(index.parts))), "part").sortWithinPartitions("part", "key")
    return dealt.mapInArrow(_find(index.root, index.parts), CAPTURE)


# ---------------------------------------------------------------- reading


def _read(root: str, payloads: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _files(root)
        name, file = None, None
        for batch in batches:
            wanted = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            k = 0
            while k < len(wanted):
                archive, begin, length = wanted[k]
                end, stop = begin + length, k + 1
                while stop < len(wanted) and wanted[stop][0] == archive and 0 <= wanted[stop][1] - end <= GAP and wanted[stop][1] + wanted[stop][2] - begin <= READ:
                    end, stop = wanted[stop][1] + wanted[stop][2], stop + 1
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, system.open_input_file(f"{folder}/{archive}")
                file.seek(begin)
                raw = file.read(end - begin)
                yield pa.RecordBatch.from_pylist([_row(read_record(raw[o - begin : o - begin + n]), payloads) for _, o, n in wanted[k:stop]], _RECORD)
                k = stop
        if file is not None:
            file.close()

    return work


def _row(record: Record, payloads: bool) -> dict:
    of = record.headers.get
    digest = of("warc-payload-digest").removeprefix("sha1:")
    revisit = of("warc-type") == "revisit"
    size = int(record.http["content-length"])
    if not revisit and (len(record.payload) != size or digest_of(record.payload) != digest):
        raise ValueError(f"the payload of {of('warc-record-id')} does not have its digest")
    number = lambda x: None if x is None else int(x)
    return {
        "page_id": number(of("x-page-id")), "url": of("warc-target-uri"), "record_type": of("warc-type"), "payload_bytes": size, "payload_digest": digest,
        "refers_to": number(of("x-refers-to-page-id")), "payload": record.payload if payloads and not revisit else None,
    }


def read_records(archives: Archives, captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``captures``, read by range: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (of responses)."""
    spark = captures.sparkSession
    small_batches(spark, 256)
    stretch = F.floor(F.col("offset") / STRETCH)
    dealt = captures.select("archive", "offset", "length").repartition("archive", stretch).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read(archives.root, payloads), RECORD)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived, indexed, looked up by URL and read back."""
    pages = table(spark, sf_dir, "pages")
    archives = write_archives(pages)
    index = write_index(archives)
    found = lookup(index, pages.select("url"))
    return read_records(archives, found, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
