"""WARC archives with a two-level capture index.

Archives hold one gzip member per record. The index sorts captures by their
reversed-host key into compressed blocks of lines; every index part keeps a
sparse directory with the first key of each block. A lookup binary-searches the
parts, then the directory, reads one block, binary-searches its lines, and
reads only the bytes of the records it names.

All files lie below a folder that driver and executors share; tasks reach it
through ``pyarrow.fs`` by its URI (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import new_folder, stored

c = F.col
CAPTURES = "surt string, page_id long, file string, offset long, length long"
PARTS = "surt string, page_id long, file string, lines long"
RECORDS = (
    "surt string, page_id long, url string, record_type string, payload_digest string, "
    "payload_bytes long, refers_to long, payload binary"
)
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FLUSH = 8 << 20


def surt(url: str | None) -> str:
    """The reversed-host key of a URL: ``com,example,blog)/path?query``; ``-`` for none.

    Scheme, user and fragment go, the host is lower-cased, white space and
    control characters are escaped. What does not parse as a URL is its own key.
    """
    if not url:
        return "-"
    url = clean_url(url)
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def clean_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f\x85\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def order(key: str, page_id: int | None) -> tuple:
    """Sort key of a capture, as Spark orders the two columns (null first)."""
    return key, page_id is not None, page_id or 0


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """One WARC record, compressed; with ``first`` a revisit of that page's response."""
    digest = base32(hashlib.sha1(payload).digest())
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}:{digest}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean_url(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(first)}", f"X-Refers-To-Page: {first}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one compressed record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    warc = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(warc["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    return warc, dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), payload


@dataclass(frozen=True)
class Archive:
    """Where an archive lies: its folder and the parts of its index."""

    folder: str
    parts: tuple[tuple, ...]  # (surt, page_id, file) of the first line of each part


def _firsts(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages whose payload another one holds first."""
    keys = pages.where(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = keys.join(first, "digest").where("page_id > refers_to or page_id is null and refers_to is not null")
    return later.select("page_id", "digest", "refers_to").distinct()


def write_archive(
    df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0,
    date: str = "2025-01-01T00:00:00Z", file_bytes: int = 256 << 20, block_lines: int = 3000, most_parts: int = 4096,
) -> Archive:
    """Writes a record per row and the capture index.

    The payload is the html in UTF-8 (null: empty). Of records with equal
    payloads of ``min_bytes`` or more the one with the smallest page_id is a
    response, the others revisit it; rows that repeat that page_id are
    responses too. A row without page_id revisits a page that has one, and is
    never referred to. A null url has the key ``-``.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "warc")
    pages = df.select(
        c(page_id).cast("long").alias("page_id"), c(url).alias("url"),
        F.coalesce(c(html).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.concat(F.unhex(F.sha1("payload")), F.octet_length("payload").cast("string").cast("binary")))
    later = stored(_firsts(pages, min_bytes), "revisits").withColumnsRenamed({"page_id": "p", "digest": "d"})
    full = pages.join(later, c("page_id").eqNullSafe(c("p")) & (c("digest") == c("d")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, rows = None, []
        for b in batches:
            for x in (y for i in range(0, b.num_rows, 256) for y in b.slice(i, 256).to_pylist()):
                if out is None:  # a name of its own: a task that runs again never meets its old file
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at = store.open_output_stream(f"{root}/{name}", compression=None), 0
                data = record(x["page_id"], x["url"], x["payload"], x["refers_to"], date)
                out.write(data)
                rows.append({"surt": surt(x["url"]), "page_id": x["page_id"], "file": name, "offset": at, "length": len(data)})
                at += len(data)
                if at >= file_bytes:
                    out.close()
                    out = None
            if out is not None and len(rows) >= 5000:
                yield from _batch(rows, CAPTURE_SCHEMA)
                rows = []
        if out is not None:
            out.close()
        yield from _batch(rows, CAPTURE_SCHEMA)

    captures = stored(full.select("page_id", "url", "payload", "refers_to").mapInArrow(write, CAPTURES), "captures")
    n = captures.count()
    spread = max(1, min(most_parts, n // 100_000 + 1))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, directory, lines, total, at = f"{uuid.uuid4().hex}.cdx", [], [], 0, 0
        out = None

        def block() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join(map(json.dumps, lines)).encode())
            out.write(data)
            directory.append([lines[0][0], lines[0][1], at, len(data)])
            at += len(data)
            lines = []

        for b in batches:
            out = out or store.open_output_stream(f"{root}/{name}", compression=None)
            for x in b.to_pylist():
                lines.append([x["surt"], x["page_id"], x["file"], x["offset"], x["length"]])
                total += 1
                if len(lines) == block_lines:
                    block()
        if out is None:
            return
        if lines:
            block()
        out.close()
        with store.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
            f.write(zlib.compress(json.dumps(directory).encode()))
        yield from _batch([{"surt": directory[0][0], "page_id": directory[0][1], "file": name, "lines": total}], PART_SCHEMA)

    ordered = captures.repartitionByRange(spread, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    parts = stored(ordered.mapInArrow(index, PARTS), "parts").collect()  # most_parts rows or a few more
    return Archive(folder, tuple(sorted(((p["surt"], p["page_id"], p["file"]) for p in parts), key=lambda p: order(p[0], p[1]))))


CAPTURE_SCHEMA = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
PART_SCHEMA = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("lines", pa.int64())])
RECORD_SCHEMA = pa.schema([
    ("surt", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
])


def _batch(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


class Reader:
    """Looks captures up in the index and reads their records."""

    def __init__(self, archive: Archive) -> None:
        self.store, self.root = fs.FileSystem.from_uri(archive.folder)
        self.files = [p[2] for p in archive.parts]
        self.firsts = [order(p[0], p[1]) for p in archive.parts]
        self.part = self.block = None
        self.directory: list = []
        self.lines: list = []
        self.open: dict = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[name] = self.store.open_input_file(f"{self.root}/{name}")
        return self.open[name].read_at(length, offset)

    def captures(self, key: tuple) -> Iterator[list]:
        """Index lines of a key, by binary search over parts, directory and block."""
        part = bisect_right(self.firsts, key) - 1
        if part < 0:
            return
        if part != self.part:
            with self.store.open_input_stream(f"{self.root}/{self.files[part]}.dir", compression=None) as f:
                self.directory = json.loads(zlib.decompress(f.read()))
            self.part, self.block = part, None
            self.starts = [order(x[0], x[1]) for x in self.directory]
        at = max(0, bisect_left(self.starts, key) - 1)  # the key may begin in the block before
        while at < len(self.starts) and self.starts[at] <= key:
            if at != self.block:
                data = self.read(self.files[part], *self.directory[at][2:])
                self.lines = [json.loads(x) for x in zlib.decompress(data).split(b"\n")]
                self.keys = [order(x[0], x[1]) for x in self.lines]
                self.block = at
            yield from self.lines[bisect_left(self.keys, key):bisect_right(self.keys, key)]
            at += 1


def lookup(archive: Archive, keys: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the captures ``surt, page_id``, each key asked once.

    Gives ``surt, page_id, url, record_type, payload_digest, payload_bytes,
    refers_to, payload``. Digest and length of a response are taken from the
    bytes read, those of a revisit, whose payload is null, from its headers. A
    key without a capture gives no row. Keys are sorted by range, so a task
    reads each block once.
    """
    spark = keys.sparkSession
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, size = Reader(archive), [], 0
        for b in batches:
            for x in b.to_pylist():
                for key, page, name, offset, length in reader.captures(order(x["surt"], x["page_id"])):
                    warc, http, body = parse(reader.read(name, offset, length))
                    kind = warc["WARC-Type"]
                    response = kind == "response"
                    rows.append({
                        "surt": key, "page_id": page, "url": warc.get("WARC-Target-URI"), "record_type": kind,
                        "payload_digest": base32(hashlib.sha1(body).digest()) if response else warc["WARC-Payload-Digest"].removeprefix("sha1:"),
                        "payload_bytes": len(body) if response else int(http["Content-Length"]),
                        "refers_to": int(warc["X-Refers-To-Page"]) if not response else None,
                        "payload": body if payload and response else None,
                    })
                    size += len(body) if payload else 200
                    if size >= FLUSH:
                        yield from _batch(rows, RECORD_SCHEMA)
                        rows, size = [], 0
        yield from _batch(rows, RECORD_SCHEMA)

    asked = keys.select("surt", c("page_id").cast("long").alias("page_id")).distinct()
    return asked.repartitionByRange(spread, "surt", "page_id").sortWithinPartitions("surt", "page_id").mapInArrow(run, RECORDS)


def capture_keys(df: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``surt, page_id`` of pages or of any list of addresses."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([surt(x) for x in b.column("url").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([keys, b.column("page_id")], ["surt", "page_id"])

    return df.select(c(url).alias("url"), c(page_id).cast("long").alias("page_id")).mapInArrow(run, "surt string, page_id long")
