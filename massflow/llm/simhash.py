"""SimHash near-duplicates with BK-trees.

A document's fingerprint is the bitwise majority of the XXH64 hashes of its
word shingles.  Distinct fingerprints are routed to shards by the pigeonhole
principle (two fingerprints at ``RADIUS`` = 3 or fewer differing bits agree in
at least one of four 16-bit blocks), and every shard is searched with a BK-tree: children are
keyed by their integer Hamming distance to the parent, and a query follows only
edges within the radius of its own distance.

The trees of all shards grow with the corpus, so a driver broadcast of them has
no bound; each shard's tree travels through the shuffle to the one task that
searches it.  A shard over ``TREE_MAX`` fingerprints is split by four 12-bit
blocks of its other bits, and what is still larger by pairs of chunks of about
``TREE_MAX``, so no task holds an unbounded group and no link is lost.
A shard emits a spanning forest of its links (at most one row a fingerprint),
never all pairs; forests are merged by hooking and contraction.

Defined results: null text, empty text and text without words have fingerprint
zero and link like any other; repeated rows get equal results; a null doc_id is
ignored for component_id unless the whole component has none (then null);
an empty table gives an empty result; a long text has its words in memory once and
its bits are counted in pieces; extra columns are ignored.  Joins on fingerprints
and components deal a key with many rows to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massflow.llm.common import free_name, map_arrow, map_text, materialise, table
from massflow.operators.joins import join_spread
from massflow.session import remove, written

RADIUS = 3
SHINGLE_WORDS = 3
#: Most fingerprints of one BK-tree, on average over the chunks of a shard.
TREE_MAX = 2048
#: Bound of the sum of squared shard sizes that are searched at once.
PAIR_BUDGET = 16_000_000
#: Shingles whose bits are counted at once.
VOTE_ROWS = 1 << 17


def shingle_hashes(text: bytes, k: int) -> list[int]:
    """XXH64 (seed 42) of each k-word shingle; bytes methods touch ASCII only."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """The fingerprint of each list: a bit is 1 if set in over half of it."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    votes = np.zeros((len(hashes), 64), np.int64)
    flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(hashes)), sizes)
    for at in range(0, len(flat), VOTE_ROWS):
        own = owner[at : at + VOTE_ROWS]
        bits = np.unpackbits(flat[at : at + VOTE_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        votes[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    ones = (2 * votes > sizes[:, None]).astype(np.uint8)
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def make():
        def fn(texts: list[bytes | None], _: pa.RecordBatch) -> list[pa.Array]:
            out: list[np.ndarray] = []
            block: list[list[int]] = []
            held = 0
            for t in texts:
                block.append(shingle_hashes(t or b"", shingle_words))
                held += len(block[-1])
                if held > VOTE_ROWS:
                    out.append(majority(block))
                    block, held = [], 0
            if block:
                out.append(majority(block))
            return [pa.array(np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64))]

        return fn

    return map_text(docs, [c for c in docs.columns if c != "text"], make, [T.StructField("fp", T.LongType(), False)])


def forest_links(fp: np.ndarray, cell: np.ndarray, tree: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of the links inside each cell.

    ``cell`` is sorted; rows with ``tree`` come before the others of their cell.
    One BK-tree a cell is grown level by level for all cells together."""
    n = len(fp)
    child = np.full((n, 65), -1, np.int32)
    new = np.r_[True, cell[1:] != cell[:-1]]
    root = np.flatnonzero(new)[np.cumsum(new) - 1]
    item = np.flatnonzero(tree & ~new)
    node = root[item]
    while len(item):
        d = np.bitwise_count(fp[item] ^ fp[node]).astype(np.int64)
        _, first, back = np.unique(node * 65 + d, return_index=True, return_inverse=True)
        child[node[first], d[first]] = item[first]
        node = item[first][back]
        stay = item != node
        item, node = item[stay], node[stay]
    parent = np.arange(n)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    q = np.flatnonzero(query & ~new & tree[root])
    node = root[q]
    while len(q):
        d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
        hit = d <= radius
        a, b = q[hit], node[hit]
        while len(a):  # the first open link of each query, until none is open
            for _ in range(64):
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent[:] = up
            opened = parent[a] != parent[b]
            a, b = a[opened], b[opened]
            if not len(a):
                break
            pick = np.unique(a, return_index=True)[1]
            for x, y in zip(a[pick].tolist(), b[pick].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        found_q, found_n = [], []
        for e in range(-radius, radius + 1):
            edge = d + e
            ok = (edge > 0) & (edge <= 64)
            c = child[node[ok], edge[ok]]
            own = q[ok]
            good = (c >= 0) & (c < own)  # a subtree holds later rows only
            found_q.append(own[good])
            found_n.append(c[good].astype(np.int64))
        q, node = np.concatenate(found_q), np.concatenate(found_n)
    for _ in range(64):
        up = parent[parent]
        if np.array_equal(up, parent):
            break
        parent[:] = up
    kids = np.flatnonzero(parent != np.arange(n))
    return kids, parent[kids]


def search_shards(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def solve(cols: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            cell, role, fp = cols
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            several = np.repeat(sizes > 1, sizes)
            cell, role, fp = cell[several], role[several], fp[several]
            sizes = sizes[sizes > 1]
            cost = np.cumsum(sizes.astype(np.float64) ** 2)
            at = 0
            while at < len(sizes):
                to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIR_BUDGET, "right")))
                a, b = int(sizes[:at].sum()), int(sizes[:to].sum())
                r = role[a:b]
                kid, root = forest_links(fp[a:b].view(np.uint64), cell[a:b], r < 2, r != 1, radius)
                if len(kid):
                    own = fp[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array(own[kid]), pa.array(own[root])], names=["a", "b"])
                at = to

        for batch in batches:
            cols = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if not len(cols[0]):
                continue
            last = np.searchsorted(cols[0], cols[0][-1])  # the last cell may go on
            if last or (held and held[0][0][0] != cols[0][0]):
                head = tuple(c[:last] for c in cols)
                if held:
                    head = tuple(np.concatenate(x) for x in zip(*held, head, strict=True))
                if len(head[0]):
                    yield from solve(head)
                held = [tuple(c[last:] for c in cols)]
            else:
                held.append(cols)
        if held:
            yield from solve(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def link_forest(nodes: DataFrame, radius: int = RADIUS, tree_max: int = TREE_MAX) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``nodes.fp`` that connect exactly
    what all links at ``radius`` or fewer bits connect (radius 0 to 3)."""
    blocks = [F.struct(F.lit(i).alias("blk"), F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)).alias("val")) for i in range(4)]
    routed = nodes.select("fp", F.explode(F.array(*blocks)).alias("x")).select("fp", "x.blk", ((F.col("x.blk").cast("long") * 65536) + F.col("x.val")).alias("shard"))
    large = routed.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > tree_max)
    marked = routed.join(large, "shard", "left")
    single = marked.filter("n IS NULL").select((F.col("shard") * 16384).alias("shard"), "fp")
    # the other 48 bits of a large shard, as four blocks of 12
    low = F.expr("CASE WHEN blk = 0 THEN 0L ELSE fp & ((1L << (16 * blk)) - 1) END")
    high = F.expr("CASE WHEN blk = 3 THEN 0L ELSE shiftrightunsigned(fp, 16 * blk + 16) << (16 * blk) END")
    rest = low.bitwiseOR(high)
    subs = [F.struct(F.lit(i).cast("long").alias("sub"), F.shiftrightunsigned("rest", 12 * i).bitwiseAND(F.lit(0xFFF)).alias("val")) for i in range(4)]
    split = (
        marked.filter("n IS NOT NULL").withColumn("rest", rest)
        .select("fp", "shard", F.explode(F.array(*subs)).alias("x"))
        .select((F.col("shard") * 16384 + F.col("x.sub") * 4096 + F.col("x.val")).alias("shard"), "fp")
    )
    again = split.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > tree_max)
    dealt = split.join(again, "shard", "left").withColumn("chunks", F.ceil(F.coalesce("n", F.lit(1)) / F.lit(tree_max)).cast("long"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), "chunks"))
    paired = dealt.select("shard", "fp", "own", F.explode(F.expr("sequence(0L, chunks - 1)")).alias("other"))
    cells = paired.select(
        F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
        F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END").alias("role"), "fp",
    )
    cells = cells.unionByName(single.select(F.xxhash64("shard").alias("cell"), F.lit(0).alias("role"), "fp"))
    dealt_out = cells.repartition("cell").sortWithinPartitions("cell", "role", "fp")
    return map_arrow(dealt_out, search_shards(radius), "a long, b long")


def connect(edges: DataFrame) -> DataFrame:
    """``v`` and ``root`` for every vertex of ``edges`` (a, b): equal roots for
    connected vertices.  Each round hooks a vertex to its neighbour of least
    hash, follows two more hooks, and keeps only edges between different trees;
    random hashes keep hooks short, so rounds grow with the log of the size.
    Tables of a round go when the next one has been written."""
    spark = edges.sparkSession
    edges, edges_at = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    roots = roots_at = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("x"))).alias("m"))
        hook = hook.select(F.col("a").alias("v"), F.when(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("x")) <= F.col("m"), F.col("a")).otherwise(F.col("m.x")).alias("up"))
        hook, first_at = written(hook, "hooks")
        for _ in range(2):
            far = hook.select(F.col("v").alias("up"), F.col("up").alias("top"))
            hook = hook.join(far, "up").select("v", F.col("top").alias("up"))
        hook, hook_at = written(hook, "hooks")
        step = hook.select(F.col("v").alias("root"), F.col("up").alias("top"))
        now = hook.select("v", F.col("up").alias("root")) if roots is None else roots.join(step, "root", "left").select("v", F.coalesce("top", "root").alias("root"))
        old = [first_at, hook_at, edges_at, *([roots_at] if roots_at else [])]
        roots, roots_at = written(now, "roots")
        for side in ("a", "b"):
            step = hook.select(F.col("v").alias(side), F.col("up").alias("top"))
            edges = edges.join(step, side).drop(side).withColumnRenamed("top", side)
        edges, edges_at = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        for path in old:
            remove(spark, path)
    if roots is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    return roots


def components(prints: DataFrame, radius: int = RADIUS, tree_max: int = TREE_MAX) -> DataFrame:
    """For every distinct ``fp`` of ``prints`` (doc_id, fp): fp, root."""
    nodes = materialise(prints.select("fp").distinct(), "nodes")
    roots = connect(link_forest(nodes, radius, tree_max))
    return nodes.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS, tree_max: int = TREE_MAX) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = materialise(fingerprints(docs.select("doc_id", "text"), shingle_words), "prints")
    parts = materialise(components(prints, radius, tree_max), "parts")
    each = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).join(parts, "fp"), "each")
    roots = materialise(each.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("kinds")), "roots")
    named = join_spread(each.select("fp", "n", "root"), roots, "root", "kinds", each.count())
    named = materialise(named.select("fp", "n", "component_id"), "named")
    made = join_spread(prints, named, "fp", "n", prints.count())
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, radius: int = RADIUS, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component, the row
    with the least doc_id (nulls last, then by a hash of the text, then by a hash
    of the columns without maps) stays; of rows that are equal in all of these one
    stays.  The columns are those of ``docs``."""
    flat = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    key = free_name(docs, "row_hash")
    rank = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.hex(F.xxhash64("text")), F.lit(":"), F.hex(F.xxhash64(*[F.col(f"`{c}`") for c in flat])))
    prints = materialise(fingerprints(docs.select("doc_id", "text", rank.alias("row"), F.xxhash64("text").alias("th")), shingle_words), "prints")
    parts = components(prints, radius)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "row")).alias("s")
    stay = prints.groupBy("fp").agg(best).join(parts, "fp").groupBy("root").agg(F.min("s").alias("s"))
    stay = materialise(stay.select(F.col("s.row").alias(key)), "stay")
    # one key of the join and of the grouping: texts are dealt out once
    return docs.withColumn(key, rank).join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
