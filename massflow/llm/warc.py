"""WARC archives with a two-level capture index.

``write_archive`` stores one record a page in gzip members of WARC files in the
shared folder; of equal payloads of at least ``REVISIT_BYTES`` bytes the one with
the least page_id is a response, the others are revisits of it.  ``write_index``
sorts the captures by reversed-host URL key into index shards: compressed blocks
of ``BLOCK_LINES`` lines, and a sparse directory of the blocks' first keys at the
shard's end.  ``lookup`` finds a URL's captures by binary search in the shards'
heads, a shard's directory and a block; ``read_records`` fetches captures by
range reads, neighbouring ranges in one.

Only shard heads (a key and a file name of each of at most ``SHARDS`` shards)
come to the driver.  Files are written and read through pyarrow's file systems,
under the folder of spark.checkpoint.dir; a retried task writes files of another name, and
nothing refers to those of the failed one.  Captures and records are written as
tables once, so a lost executor never repeats a write that others have read.

Defined results: null html is an empty payload; a null or odd URL has the key
of its text; pages with equal page_id and payload are all responses; a null
page_id is never chosen over another for response; empty tables give empty
archives and results; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import BROADCAST_ROWS, SLICE_ROWS, map_arrow, materialise, table
from massflow.operators.joins import join_spread
from massflow.session import fresh_path

REVISIT_BYTES = 100
BLOCK_LINES = 512
SHARDS = 4096
FILE_BYTES = 64 << 20
#: Ranges of a file closer than this are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 16 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 2


def url_key(url: str | None) -> str:
    """com,example,www)/path?query of a URL, without scheme and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return re.sub(r"[\x00-\x20]", "", url or "")
    if port in (None, 80, 443):
        port = ""
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"[\x00-\x20]", "", key)


def file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else uri)


def member(kind: str, page: int | None, url: str | None, html: bytes, size: int, digest: str, first: int | None) -> bytes:
    """A gzip member with one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + html
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if page is None else page}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub('[\\x00-\\x20]', '', url or '')}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Refers-To: <urn:x-page:{first}>", f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []), f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(data: bytes) -> dict:
    """The record of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is broken")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    full = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    page = lambda k: int(m[1]) if (m := re.search(r"x-page:(-?\d+)", fields.get(k, ""))) else None
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": page("warc-record-id"), "url": fields["warc-target-uri"], "record_type": fields["warc-type"], "payload": None if revisit else payload,
        "full_bytes": full, "digest": fields["warc-payload-digest"].partition(":")[2], "refers_to": page("warc-refers-to"),
    }


def classify(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null for revisits), bytes, digest, first (the
    response's page_id, for revisits)."""
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"bytes": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    narrow = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).select("page_id", F.octet_length("html").alias("bytes"), F.sha2("html", 256).alias("digest"))
    groups = narrow.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("least"))
    groups = materialise(groups.filter("n > 1"), "repeats")
    few = groups.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    if few["k"] <= BROADCAST_ROWS:
        both = own.join(F.broadcast(groups.drop("n")), "digest", "left")
    else:
        both = join_spread(own, groups, "digest", "n", few["n"], "left")
    first = F.when(F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    return both.withColumn("first", first).select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), "bytes", "digest", "first")


def write_archive(pages: DataFrame) -> DataFrame:
    """Writes the WARC files; returns the captures: key, page_id, file, at, size."""
    spark = pages.sparkSession
    root = fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page, url, html, size, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                data = member("response" if first is None else "revisit", page, url, (html or "").encode(), size, digest, first)
                out.write(data)
                rows.append((url_key(url), page, name, at, len(data)))
                at += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "at", "size"])
        if out is not None:
            out.close()

    made = map_arrow(classify(pages), run, "key string, page_id long, file string, at long, size long")
    captures = materialise(made, "captures")
    return captures.withColumn("file", F.concat(F.lit(f"{root}/"), "file"))


def sort_key(key: str, page: int | None) -> bytes:
    return key.encode() + b"\0" + (b"" if page is None else b"%020d" % (page + 2**63))


def write_index(captures: DataFrame) -> tuple[str, list[tuple[bytes, bytes, str]]]:
    """Writes the index; returns its folder and (first, last, file) of each
    shard in order."""
    spark = captures.sparkSession
    root = fresh_path(spark, "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        fs.create_dir(base, recursive=True)
        out, directory, block, at, first, last = None, [], [], 0, b"", b""
        name = f"{uuid.uuid4().hex}.idx"

        def flush() -> None:
            nonlocal at
            data = zlib.compress(b"\n".join(k + b" " + v for k, v in block))
            directory.append((block[0][0], at, len(data)))
            out.write(data)
            at += len(data)
            block.clear()

        for batch in batches:
            for key, page, file, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = sort_key(key, page)
                if out is None:
                    out, first = fs.open_output_stream(f"{base}/{name}", compression=None), last
                block.append((last, f"{start} {size} {file}".encode()))
                if len(block) == BLOCK_LINES:
                    flush()
        if out is not None:
            if block:
                flush()
            tail = zlib.compress(b"\n".join(k + b" %d %d" % (a, n) for k, a, n in directory))
            out.write(tail + struct.pack(">Q", len(tail)))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((first, pa.binary()), (last, pa.binary()), (f"{root}/{name}", pa.string()))], names=["first", "last", "file"])

    cols = captures.select("key", "page_id", "file", "at", "size")
    parts = min(SHARDS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = cols.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    heads = materialise(map_arrow(dealt, run, "first binary, last binary, file string"), "heads")
    return root, sorted((bytes(r[0]), bytes(r[1]), r[2]) for r in heads.collect())


class Shard:
    """The directory of an index shard, and its last block read."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        (n,) = struct.unpack(">Q", self.file.read_at(8, size - 8))
        rows = [r.rsplit(b" ", 2) for r in zlib.decompress(self.file.read_at(n, size - 8 - n)).split(b"\n")]
        self.first = [r[0] for r in rows]
        self.where = [(int(r[1]), int(r[2])) for r in rows]
        self.held, self.lines = -1, []

    def find(self, low: bytes, high: bytes) -> Iterator[tuple[bytes, int, int, str]]:
        """Captures with low <= key < high."""
        block = max(0, bisect.bisect_right(self.first, low) - 1)
        while block < len(self.first) and self.first[block] < high:
            if block != self.held:
                at, n = self.where[block]
                self.held, self.lines = block, [r.split(b" ", 1) for r in zlib.decompress(self.file.read_at(n, at)).split(b"\n")]
            keys = [r[0] for r in self.lines]
            for i in range(bisect.bisect_left(keys, low), bisect.bisect_left(keys, high)):
                at, n, file = self.lines[i][1].decode().split(" ", 2)
                yield keys[i], int(at), int(n), file
            block += 1


def lookup(urls: DataFrame, heads: list[tuple[bytes, bytes, str]]) -> DataFrame:
    """All captures (key, file, at, size) of the distinct keys of ``urls.url``."""
    lasts, firsts = [h[1] for h in heads], [h[0] for h in heads]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shards = [], []
            for key in {url_key(u) for u in batch.column(0).to_pylist()}:
                low, high = key.encode() + b"\0", key.encode() + b"\1"
                for i in range(bisect.bisect_left(lasts, low), bisect.bisect_left(firsts, high)):
                    keys.append(key)
                    shards.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shards, pa.int32())], names=["key", "shard"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "file", "at", "size"])

        number, shard = -1, None
        for batch in batches:
            rows: list[tuple] = []
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i != number:
                    number, shard = i, Shard(heads[i][2])
                for _, at, n, file in shard.find(key.encode() + b"\0", key.encode() + b"\1"):
                    rows.append((key, file, at, n))
                    if len(rows) == SLICE_ROWS:
                        yield pack(rows)
                        rows = []
            if rows:
                yield pack(rows)

    routed = map_arrow(urls.select("url"), route, "key string, shard int").distinct()
    dealt = routed.repartition("shard").sortWithinPartitions("shard", "key")
    return map_arrow(dealt, search, "key string, file string, at long, size long")


def read_records(captures: DataFrame) -> DataFrame:
    """The records at (file, at, size), read by ranges."""
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload": pa.binary(), "full_bytes": pa.int64(), "digest": pa.string(), "refers_to": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, file = "", None

        def fetch(group: list[tuple[int, int]]) -> pa.RecordBatch:
            start = group[0][0]
            data = file.read_at(group[-1][0] + group[-1][1] - start, start)
            rows = [parse(data[a - start : a - start + n]) for a, n in group]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))

        for batch in batches:
            group: list[tuple[int, int]] = []
            for name, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (name != opened or at - sum(group[-1]) > GAP_BYTES or at + n - group[0][0] > READ_BYTES):
                    yield fetch(group)
                    group = []
                if name != opened:
                    fs, path = file_system(name)
                    opened, file = name, fs.open_input_file(path)
                group.append((at, n))
            if group:
                yield fetch(group)

    near = F.floor(F.col("at") / READ_BYTES)
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes here stand for many to read
    dealt = captures.select("file", "at", "size").repartition(parts, "file", near).sortWithinPartitions("file", "at")
    return map_arrow(dealt, run, "page_id long, url string, record_type string, payload binary, full_bytes long, digest string, refers_to long")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write, index, look up and read back every page: page_id, payload_bytes,
    payload_digest, record_type, refers_to.  The bytes and digest of a response
    are those of the payload read; a revisit's are those its record states."""
    captures = write_archive(pages)
    _, heads = write_index(captures)
    read = read_records(lookup(pages, heads))
    return read.select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), "full_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "digest").alias("payload_digest"), "record_type", "refers_to",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS n, sha256(h) AS digest FROM p),
r AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM r
"""
