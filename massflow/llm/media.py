"""Media columns: PNG images in binary columns, checked and hashed.

``encode`` stores bytes as an 8-bit RGB image, 64 pixels (192 bytes) a row,
padded with blanks to whole rows; ``decode`` walks the chunks, tests every
checksum, inflates, undoes the row filters with numpy and returns the samples
with a hash of the low-frequency cosine terms of the image.

Defined results: null and empty texts are one row of blanks; repeated rows get
equal results; a broken image (signature, checksum, order of chunks, length,
filter, other than 8-bit grey or RGB, interlaced) gives nulls and a message in
``error``; an empty table gives an empty result; a long text is one image, whole in
memory while it is made and read; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from massflow.llm.common import map_text, table

WIDTH, CHANNELS = 64, 3
ROW = WIDTH * CHANNELS
LEVEL = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SIDE, LOW = 32, 8

_cos = np.cos(np.pi * (2 * np.arange(SIDE)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    return data + b" " * (-len(data) % ROW or (0 if data else ROW))


def png(payload: bytes, filters: str = "choose") -> bytes:
    """An RGB image of a payload of whole rows.  Each row takes, of none, left
    and up, the filter of least sum of absolute differences; ``filters`` = 'none'
    stores rows as they are."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    if filters == "none":
        kind, body = np.zeros(len(rows), np.uint8), rows
    else:
        left = rows.copy()
        left[:, CHANNELS:] -= rows[:, :-CHANNELS]
        up = rows.copy()
        up[1:] -= rows[:-1]
        made = np.stack([rows, left, up])
        cost = np.abs(made.view(np.int8).astype(np.int16)).sum(2)
        kind = cost.argmin(0).astype(np.uint8)
        body = made[kind, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    data = zlib.compress(np.hstack([kind[:, None], body]).tobytes(), LEVEL)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", data) + _chunk(b"IEND", b"")


def unfilter(kind: np.ndarray, body: np.ndarray, bpp: int) -> np.ndarray:
    """Undo the five filters; rows of filter none and left at once, the rest in
    order from the first that needs its upper neighbour."""
    rows, width = body.shape
    out = body.copy()
    left = np.flatnonzero(kind == 1)
    if len(left):
        out[left] = np.cumsum(body[left].reshape(len(left), -1, bpp), axis=1, dtype=np.uint8).reshape(len(left), width)
    zero = np.zeros(width, np.uint8)
    for r in np.flatnonzero(kind > 1).tolist():
        above = out[r - 1] if r else zero
        if kind[r] == 2:
            out[r] = body[r] + above
            continue
        line, up, raw = np.zeros(width, np.int64), above.astype(np.int64), body[r].astype(np.int64)
        for i in range(0, width, bpp):
            a = line[i - bpp : i] if i else np.zeros(bpp, np.int64)
            b, c = up[i : i + bpp], (up[i - bpp : i] if i else np.zeros(bpp, np.int64))
            if kind[r] == 3:
                guess = (a + b) // 2
            else:
                p = a + b - c
                pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
            line[i : i + bpp] = (raw[i : i + bpp] + guess) % 256
        out[r] = line
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples, (rows, width, channels); ValueError says what is wrong."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, head, parts, ended = 8, None, [], False
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut chunk")
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if at + 12 + n > len(data) or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("wrong checksum of a chunk")
        if (head is None) != (kind == b"IHDR") or ended:
            raise ValueError("chunks out of order")
        if kind == b"IHDR":
            if n != 13:
                raise ValueError("wrong header")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            ended = True
        elif not kind[0] & 32:
            raise ValueError("unknown critical chunk")
        at += 12 + n
    if head is None or not ended:
        raise ValueError("chunks are missing")
    width, rows, depth, colour, *rest = head
    if depth != 8 or colour not in (0, 2) or any(rest):
        raise ValueError("only 8-bit grey or RGB without interlacing")
    bpp = 1 if colour == 0 else 3
    try:
        raw = zlib.decompress(b"".join(parts))
    except zlib.error as e:
        raise ValueError(f"zlib: {e}") from e
    if len(raw) != rows * (1 + width * bpp):
        raise ValueError("wrong length of samples")
    grid = np.frombuffer(raw, np.uint8).reshape(rows, 1 + width * bpp)
    if rows and grid[:, 0].max() > 4:
        raise ValueError("unknown filter")
    return unfilter(grid[:, 0], grid[:, 1:], bpp).reshape(rows, width, bpp)


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest cosine terms of the image, averaged
    to 32 x 32, exceed their median (the constant term aside)."""
    grey = samples.mean(2)
    for axis in (0, 1):
        n = grey.shape[axis]
        edge = np.arange(SIDE) * n // SIDE
        if n >= SIDE:
            size = np.diff(np.r_[edge, n])
            grey = np.add.reduceat(grey, edge, axis=axis) / (size[:, None] if axis == 0 else size)
        else:
            grey = grey.take(edge, axis=axis)
    terms = np.round((_cos @ grey @ _cos.T).ravel(), 6)
    return np.packbits(terms > np.median(terms[1:])).tobytes().hex()


def encode(docs: DataFrame, filters: str = "choose") -> DataFrame:
    """doc_id, n_bytes and the binary column ``media`` of every whole text."""

    def make():
        def fn(texts: list[bytes | None], _: pa.RecordBatch) -> list[pa.Array]:
            raw = [t or b"" for t in texts]
            return [pa.array([len(t) for t in raw], pa.int64()), pa.array([png(pad(t), filters) for t in raw], pa.binary())]

        return fn

    return map_text(docs.select("doc_id", "text"), ["doc_id"], make, [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


FEATURES = [
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType()),
]


def describe(media: bytes | None) -> tuple:
    if media is None:
        return (None, None, None, None, None, None, "no media")
    own = (len(media), hashlib.sha256(media).hexdigest())
    try:
        samples = read_png(media)
    except ValueError as e:
        return (None, None, None, *own, None, str(e))
    payload = samples.tobytes()
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, cosine_hash(samples) if samples.size else None, None)


def decode(stored: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """``keep`` columns and what the stored images hold."""

    def make():
        def fn(blobs: list[bytes | None], _: pa.RecordBatch) -> list[pa.Array]:
            cols = list(zip(*map(describe, blobs), strict=True)) or [()] * len(FEATURES)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            return [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]

        return fn

    return map_text(stored, keep, make, FEATURES, text=media)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(encode(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"]).drop("error")
