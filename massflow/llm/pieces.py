"""Sampled SentencePiece segmentation, and lossless decoding.

A text's lattice has an edge for each piece of the model that matches at a
place, and single-byte edges inside characters that have no piece.  A path has
the probability proportional to the product of its edges' weights: forward
filtering sums the weights of all paths to every place, and backward sampling
walks from the end, choosing each edge in proportion to weight times forward sum.

No piece crosses from a non-blank to a blank or holds a newline, so the lattice
is a chain of pre-tokens' lattices: forward sums are filled once per distinct
pre-token of a chunk, for all of one length at once, and the backward steps of
all occurrences are taken together.  The uniform number of a step is a hash of
(seed, row key, byte offset), so a segmentation depends on the row alone, not on
partitions, batches or retries.

The model orders pieces by merge rank instead of giving probabilities, so a
piece of rank r weighs (r + RANK_OFFSET) ** -alpha, and a byte BYTE_WEIGHT.

Decoding joins the pieces' bytes.  A blank is one marker byte that no UTF-8 text
holds, so a text's own U+2581 (which no piece matches then) comes back as itself.

Defined results: null text gives null ids and null text; an empty text gives no
ids; an empty table gives an empty result; a null row key counts as 0; repeated rows
get equal results; a pre-token over ``LONG`` bytes takes the same sums one place at a
time, as logarithms, and so gets the same pieces but for rounding; a long text is
sampled whole, alone in its chunk; bytes that are not UTF-8 are replaced by U+FFFD
first; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massflow.llm.common import map_arrow, map_text, table
from massflow.llm.token_counts import default_model, load

ALPHA = 1.0
SEED = 2024
RANK_OFFSET = 16.0
BYTE_WEIGHT = 1e-6
LONG = 48
CHUNK_BYTES = 8 << 20
#: Keeps forward sums near 1: every byte of an edge multiplies its weight.
LIFT = 24.0

_PRE = re.compile(rb"\xff+[^\xff\n]*|\n+|[^\xff\n]+")
_MULT = np.uint64(0x100000001B3)
#: Slots of the filter that most substrings which are no piece fail.
_FILTER_BITS = 21
_tables: dict[tuple[str, float], Pieces] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniforms(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """In [0, 1): one number for each row key and byte offset."""
    return (mix64(key ^ mix64(place.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)) * 2.0**-53


def row_keys(ids: list[int | None], seed: int) -> np.ndarray:
    own = np.array([(i or 0) % 2**64 for i in ids], np.uint64)
    return mix64(own + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64))


class Pieces:
    """The lattice tables of a model."""

    def __init__(self, path: str, alpha: float):
        m = load(path)
        n = m.get_piece_size()
        self.text: list[bytes] = [b""] * n
        self.weight = np.zeros(n)
        self.ids: dict[bytes, int] = {}
        self.byte = np.zeros(256, np.int32)
        rank = 0
        for i in range(n):
            if m.is_byte(i):
                b = int(m.id_to_piece(i)[1:-1], 16)
                self.byte[b], self.text[i], self.weight[i] = i, bytes([b]), BYTE_WEIGHT**alpha * LIFT
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                raw = m.id_to_piece(i).replace("▁", "\0mark").encode().replace(b"\0mark", b"\xff")
                self.text[i], self.ids[raw] = raw, i
                self.weight[i] = (rank + RANK_OFFSET) ** -alpha * LIFT ** len(raw)
                rank += 1
        self.longest = max(map(len, self.ids))
        self.joined = np.array(self.text, object)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {len(p) for p in self.ids}:
            own = [p for p in self.ids if len(p) == k]
            raw = np.frombuffer(b"".join(own), np.uint8).reshape(-1, k)
            h = np.zeros(len(own), np.uint64)
            for j in range(k):
                h = h * _MULT + raw[:, j] + np.uint64(1)
            self.seen[self._slot(h)] = True
            order = np.argsort(h)
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces have one hash")
            self.by_length[k] = (h[order], np.array([self.ids[own[i]] for i in order], np.int32))

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _FILTER_BITS)

    def matches(self, words: list[bytes], n: int) -> np.ndarray:
        """piece[word, start, length - 1] of words of n bytes, -1 for none."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        most = min(n, self.longest)
        piece = np.full((len(words), n, most), -1, np.int32)
        for i in range(n):
            h = np.zeros(len(words), np.uint64)
            for k in range(1, min(most, n - i) + 1):
                h = h * _MULT + raw[:, i + k - 1] + np.uint64(1)
                if k in self.by_length:
                    keys, ids = self.by_length[k]
                    row = np.flatnonzero(self.seen[self._slot(h)])
                    own = h[row]
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    hit = keys[at] == own
                    piece[row[hit], i, k - 1] = ids[at[hit]]
        # bytes of characters that are no piece
        size = np.select([raw < 0x80, raw < 0xC0, raw < 0xE0, raw < 0xF0, raw < 0xF8], [1, 0, 2, 3, 4], 1)
        for c in range(1, min(4, n) + 1):
            lone = (size == c) & (piece[:, :, c - 1] < 0)
            for j in range(c):
                w, i = np.nonzero(lone[:, : n - j])
                piece[w, i + j, 0] = self.byte[raw[w, i + j]]
        return piece


def pieces_of(path: str, alpha: float) -> Pieces:
    if (path, alpha) not in _tables:
        _tables[path, alpha] = Pieces(path, alpha)
    return _tables[path, alpha]


def forward(p: Pieces, piece: np.ndarray) -> np.ndarray:
    """edge[word, end, length - 1]: cumulative weight times forward sum of the
    edges into an end, shortest first."""
    w, n, most = piece.shape
    weight = np.where(piece >= 0, p.weight[piece], 0.0)
    reach = np.zeros((w, n + 1))
    reach[:, 0] = 1
    edge = np.zeros((w, n + 1, most))
    for end in range(1, n + 1):
        for k in range(1, min(most, end) + 1):
            edge[:, end, k - 1] = reach[:, end - k] * weight[:, end - k, k - 1]
        np.cumsum(edge[:, end], axis=1, out=edge[:, end])
        reach[:, end] = edge[:, end, -1]
    return edge


def sample_long(p: Pieces, word: bytes, key: np.uint64, place: int) -> list[tuple[int, int]]:
    """(end, piece) of one pre-token, backwards; sums are kept as logarithms."""
    n = len(word)
    lone = bytearray(n)
    i = 0
    while i < n:
        b = word[i]
        c = 1 if b < 0xC0 or b >= 0xF8 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        if word[i : i + c] not in p.ids:
            lone[i : i + c] = b"\1" * len(word[i : i + c])
        i += c
    log = np.log(np.maximum(p.weight, 1e-300)).tolist()
    reach = array("d", [-math.inf]) * (n + 1)
    reach[0] = 0.0

    def edges(end: int) -> list[tuple[float, int, int]]:
        found = []
        for k in range(1, min(p.longest, end) + 1):
            i = p.ids.get(word[end - k : end])
            if i is None and k == 1 and lone[end - 1]:
                i = int(p.byte[word[end - 1]])
            if i is not None and reach[end - k] > -math.inf:
                found.append((reach[end - k] + log[i], k, i))
        return found

    for end in range(1, n + 1):
        if own := edges(end):
            top = max(own)[0]
            reach[end] = top + math.log(sum(math.exp(x - top) for x, _, _ in own))
    out, end = [], n
    while end:
        own = edges(end)
        top = max(own)[0]
        u = float(uniforms(np.array([key], np.uint64), np.array([place + end]))[0]) * sum(math.exp(x - top) for x, _, _ in own)
        for x, k, i in own:
            u -= math.exp(x - top)
            if u < 0:
                break
        out.append((end, i))
        end -= k
    return out


def sample_chunk(p: Pieces, texts: list[bytes], keys: np.ndarray) -> list[np.ndarray]:
    """Ids of each nonempty text, whose blanks are marker bytes already."""
    code: dict[bytes, int] = {}
    words: list[int] = []
    counts = []
    for t in texts:
        own = _PRE.findall(t)
        counts.append(len(own))
        words += [code.setdefault(w, len(code)) for w in own]
    distinct = list(code)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    of = np.array(words, np.int64)
    length = size[of]
    text_size = np.fromiter(map(len, texts), np.int64, len(texts))
    text_start = np.cumsum(text_size) - text_size
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.cumsum(length) - length
    place = start - text_start[owner]  # within the text
    key = keys[owner]
    ends = np.full(int(text_size.sum()) + 1, -1, np.int32)
    by_length = np.argsort(length, kind="stable")
    bounds = np.flatnonzero(np.r_[True, np.diff(length[by_length]) > 0, True])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        occ = by_length[a:b]
        n = int(length[occ[0]])
        if n > LONG:
            for o in occ.tolist():
                for end, i in sample_long(p, distinct[of[o]], key[o], int(place[o])):
                    ends[start[o] + end] = i
            continue
        own, back = np.unique(of[occ], return_inverse=True)
        step = max(1, (8 << 20) // (8 * (n + 1) * min(n, p.longest)))
        order = np.argsort(back, kind="stable") if len(own) > step else np.arange(len(occ))
        sorted_back = back[order]
        for lo in range(0, len(own), step):
            x, y = np.searchsorted(sorted_back, [lo, lo + step]) if len(own) > step else (0, len(occ))
            sel = order[x:y]
            piece = p.matches([distinct[i] for i in own[lo : lo + step]], n)
            edge = forward(p, piece)
            word, at = back[sel] - lo, np.full(len(sel), n)
            base, k0, o0 = start[occ[sel]], key[occ[sel]], place[occ[sel]]
            while len(word):
                cum = edge[word, at]
                u = uniforms(k0, o0 + at) * cum[:, -1]
                k = (cum <= u[:, None]).sum(1)
                ends[base + at] = piece[word, at - k - 1, k]
                at = at - k - 1
                go = at > 0
                if not go.all():
                    word, at, base, k0, o0 = word[go], at[go], base[go], k0[go], o0[go]
    spot = np.flatnonzero(ends >= 0)
    cut = np.searchsorted(spot, text_start + text_size, "right")
    return np.split(ends[spot], cut[:-1])


def sample(p: Pieces, texts: list[bytes | None], keys: np.ndarray) -> list[np.ndarray | None]:
    """Ids of each text; None for None."""
    out: list[np.ndarray | None] = [None if t is None else np.zeros(0, np.int32) for t in texts]
    block: list[int] = []
    ready: list[bytes] = []
    held = 0

    def flush() -> None:
        for i, ids in zip(block, sample_chunk(p, ready, keys[block]), strict=True):
            out[i] = ids
        block.clear()
        ready.clear()

    for i, t in enumerate(texts):
        if t:
            if b"\xff" in t or b"\xfe" in t:
                t = t.decode("utf-8", "replace").encode()
            block.append(i)
            ready.append(b"\xff" + t.replace(b" ", b"\xff"))
            held += len(t)
            if held > CHUNK_BYTES:
                flush()
                held = 0
    if block:
        flush()
    return out


def encode(docs: DataFrame, keep: list[str], model: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``keep`` columns and ``ids``, a sampled segmentation of every whole text."""
    path = model or default_model()
    src = docs if "doc_id" in keep else docs.select(*keep, "doc_id", "text")
    names = keep if "doc_id" in keep else [*keep, "doc_id"]
    at = names.index("doc_id")

    def make():
        p = pieces_of(path, alpha)

        def fn(texts: list[bytes | None], batch: pa.RecordBatch) -> list[pa.Array]:
            found = sample(p, texts, row_keys(batch.column(at).to_pylist(), seed))
            sizes = np.array([0 if x is None else len(x) for x in found], np.int64)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32(), mask=np.r_[[x is None for x in found], False])
            flat = [x for x in found if x is not None and len(x)]
            return [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))]

        return fn

    made = map_text(src, names, make, [T.StructField("ids", T.ArrayType(T.IntegerType()))], rows=8192)
    return made.select(*keep, "ids")


def decode(coded: DataFrame, keep: list[str], model: str | None = None) -> DataFrame:
    """``keep`` columns and ``text``, decoded from ``ids``."""
    path = model or default_model()
    src = coded.select(*keep, "ids")
    schema = T.StructType([src.schema[k] for k in keep] + [T.StructField("text", T.StringType())])

    def run(batches):
        p = pieces_of(path, ALPHA)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = part.column(len(keep))
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                pieces, out, at = p.joined[flat].tolist(), [], 0
                for n in ids.value_lengths().to_pylist():
                    if n is None:
                        out.append(None)
                        continue
                    raw = b"".join(pieces[at : at + n]).replace(b"\xff", b" ")
                    out.append(raw[1:].decode())
                    at += n
                yield pa.RecordBatch.from_arrays([part.column(j) for j in range(len(keep))] + [pa.array(out, pa.string())], names=schema.fieldNames())

    return map_arrow(src, run, schema)


def round_trip(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_hash (XXH64 of the ids), decoded_sha256
    and lossless (decoding gave the text back) of every row, after the columns
    ``keep``, which have none of these names."""
    src = docs.select(*keep, "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("own"))
    coded = encode(src, [*keep, "doc_id", "n_bytes", "own"], model)
    coded = coded.select(*keep, "doc_id", "n_bytes", "own", "ids", F.size(F.coalesce("ids", F.array().cast("array<int>"))).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"))
    back = decode(coded, [*keep, "doc_id", "n_bytes", "own", "n_pieces", "ids_hash"], model)
    sha = F.sha2("text", 256)
    return back.select(*keep, "doc_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "n_pieces", "ids_hash", sha.alias("decoded_sha256"), sha.eqNullSafe(F.col("own")).alias("lossless"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
