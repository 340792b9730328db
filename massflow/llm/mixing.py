"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are put in a reproducible shuffled order (md5 of doc_id)
and cut into blocks of ``block_rows``.  Time is a row of slots, one block each.
Of the sources that still have blocks, one of integer weight w has the share
w / W of the slots, W being the sum of their weights.  Its block k (from 0) may not
run before its release floor(k W / w) and must run before its deadline
ceil((k + 1) W / w); earliest deadline first among released blocks meets every
deadline and leaves no slot empty, because the shares sum to one.  So after any
slot a source is less than one block from its share.

A source leaves at the slot of its last block.  There a new phase begins: weights
are taken anew over the sources left, and blocks, releases and deadlines count from
that slot.  The bound holds in every phase, however many blocks a source has; of K
streams there are at most K phases.  A phase repeats after W slots, so a fold over
W slots schedules it, and every block finds its slot by arithmetic.  K is the number
of configured sources plus one: all other sources, and a null source, form one
pooled stream.  What is broadcast, and what the fold takes, is bounded by K and W.

No row is dropped, repeated or sampled.  Repeated rows and equal ids stay (ties:
doc_id, then the hash of the source's name; rows equal in both are alike); an empty
table gives no rows; texts are not read, so their length does not matter; extra
columns are kept, whatever their names.  Each stream is ranked in buckets of the hash
range, as many as its rows need, and bucket counts are summed in groups, so no task
holds a hot source whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.common import free_name, table

#: Target weights of the production mix; sources not named share ``OTHER``.
WEIGHTS: dict[str, int] = {"src0": 50, **{f"src{i}": 7 for i in range(1, 20)}}
OTHER = 17
BLOCK_ROWS = 32
#: Mean rows of a bucket in which documents of a stream are ranked.
BUCKET_ROWS = 1_000
#: Buckets whose counts are summed by one task.
GROUP_BUCKETS = 1_000


def stream_of(source: Column, names: list[str]) -> Column:
    """The index of a source in ``names``; len(names) for all others."""
    at = F.array_position(F.array(*map(F.lit, names)), source) if names else F.lit(0)
    return F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(F.lit(len(names))).cast("int")


def plans(spark: SparkSession, blocks: list[int], weights: list[int]) -> DataFrame:
    """``plan_stream`` and ``plan``: of each phase its first slot (base), its period
    W (len), the stream's weight (c), its blocks done before (lo) and after (hi), and
    the slots of its blocks in a period.

    ``blocks`` and ``weights`` have a number for each stream."""
    last = len(weights) - 1
    one = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in blocks]).alias("n"), F.array(*[F.lit(x).cast("long") for x in weights]).alias("w"))
    # released and not done in this period: (deadline, stream); the least goes into slot t
    due = f"""array_min(transform(
        filter(sequence(0, {last}), s -> e.done[s] < c[s] AND (e.done[s] * len) div greatest(c[s], 1L) <= t),
        s -> struct(((e.done[s] + 1) * len + c[s] - 1) div c[s] AS due, s AS s))).s"""
    period = f"""aggregate(sequence(0L, len - 1),
        struct(transform(c, x -> 0L) AS done, cast(array() AS array<int>) AS slots),
        (e, t) -> transform(array({due}), p -> struct(
            transform(e.done, (v, s) -> v + IF(s = p, 1L, 0L)) AS done, concat(e.slots, array(p)) AS slots))[0],
        e -> e.slots)"""
    # the first slot after the last block of the stream that ends first
    end = f"""array_min(transform(filter(sequence(0, {last}), s -> c[s] > 0), s -> ((acc.have[s] - 1) div c[s]) * len
        + filter(transform(slots, (x, i) -> IF(x = s, cast(i AS bigint), -1L)), i -> i >= 0)[int((acc.have[s] - 1) % c[s])] + 1))"""
    took = "transform(c, (x, s) -> (upto div len) * x + size(filter(slice(slots, 1, int(upto % len)), v -> v = s)))"
    phase = f"""transform(array(zip_with(acc.have, w, (h, x) -> IF(h > 0, x, 0L))), c ->
        transform(array(aggregate(c, 0L, (a, x) -> a + x)), len -> IF(len = 0, acc,
            transform(array({period}), slots -> transform(array({end}), upto -> transform(array({took}), took -> struct(
                zip_with(acc.have, took, (h, x) -> h - x) AS have,
                zip_with(acc.done, took, (d, x) -> d + x) AS done,
                acc.base + upto AS base,
                concat(acc.phases, array(struct(acc.base AS base, len AS len, c AS c, acc.done AS lo, zip_with(acc.done, took, (d, x) -> d + x) AS hi, slots AS slots))) AS phases
            ))[0])[0])[0]))[0])[0]"""
    fold = f"""aggregate(sequence(0, {last}),
        struct(n AS have, transform(n, x -> 0L) AS done, 0L AS base,
            cast(array() AS array<struct<base: bigint, len: bigint, c: array<bigint>, lo: array<bigint>, hi: array<bigint>, slots: array<int>>>) AS phases),
        (acc, step) -> {phase}, acc -> acc.phases)"""
    made = one.select(F.expr(fold).alias("phases"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("plan_stream"))
    return made.select(
        "plan_stream",
        F.expr("""transform(filter(phases, x -> x.hi[plan_stream] > x.lo[plan_stream]), x -> struct(
            x.base AS base, x.len AS len, x.c[plan_stream] AS c, x.lo[plan_stream] AS lo, x.hi[plan_stream] AS hi,
            filter(transform(x.slots, (s, t) -> IF(s = plan_stream, t, -1)), t -> t >= 0) AS slots))""").alias("plan"),
    )


def mix(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS, like: DataFrame | None = None) -> DataFrame:
    """``docs`` with a struct column (its name: the last one) of block, slot,
    release, deadline and position; position orders the mixed corpus.

    ``like`` is counted in place of ``docs``: a table of the same doc_id and
    source rows that is cheaper to read."""
    if any(w < 1 for w in (*weights.values(), other)) or block_rows < 1:
        raise ValueError("weights and block_rows must be positive integers")
    names, per = list(weights), [*weights.values(), other]
    tmp = free_name(docs, "mix_row")
    out = free_name(docs, "mix")
    like = docs if like is None else like
    # a row for each stream
    have = {r[0]: r[1] for r in like.groupBy(stream_of(F.col("source"), names)).count().collect()}
    plan = plans(docs.sparkSession, [-(-have.get(s, 0) // block_rows) for s in range(len(per))], per)
    buckets = F.array(*[F.lit(max(1, -(-have.get(s, 0) // bucket_rows))).cast("long") for s in range(len(per))])  # of each stream

    def keyed(df: DataFrame) -> DataFrame:
        h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
        stream = stream_of(F.col("source"), names)
        b = F.shiftright(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") * F.element_at(buckets, stream + 1), 32)
        return df.withColumn(tmp, F.struct(stream.alias("stream"), b.alias("bucket"), h.alias("h")))

    sizes = keyed(like.select("doc_id", "source")).groupBy(F.col(f"{tmp}.stream").alias("stream"), F.col(f"{tmp}.bucket").alias("bucket")).agg(F.count("*").alias("n"))
    sizes = sizes.selectExpr("stream", "bucket", f"bucket div {GROUP_BUCKETS} AS part", "n")
    heads = sizes.groupBy("stream", "part").agg(F.sum("n").alias("n"))
    heads = heads.selectExpr("stream AS of_stream", "part AS of_part", "sum(n) OVER (PARTITION BY stream ORDER BY part) - n AS head")
    inner = sizes.selectExpr("stream AS at_stream", "part", "bucket AS at_bucket", "sum(n) OVER (PARTITION BY stream, part ORDER BY bucket) - n AS inner_n")
    before = inner.join(heads, (F.col("at_stream") == F.col("of_stream")) & (F.col("part") == F.col("of_part")))
    before = before.select("at_stream", "at_bucket", (F.col("head") + F.col("inner_n")).alias("before"))
    rows = keyed(docs)
    rank = F.expr(f"row_number() OVER (PARTITION BY {tmp}.stream, {tmp}.bucket ORDER BY {tmp}.h, doc_id, xxhash64(source))").cast("long") - 1
    rows = rows.withColumn(tmp, F.struct(f"{tmp}.stream", f"{tmp}.bucket", rank.alias("r")))
    rows = rows.join(before, (F.col(f"{tmp}.stream") == before["at_stream"]) & (F.col(f"{tmp}.bucket") == before["at_bucket"]))
    rows = rows.join(F.broadcast(plan), F.col("at_stream") == F.col("plan_stream"))  # a row for each stream
    rank = F.col(f"{tmp}.r") + F.col("before")
    rows = rows.withColumn(tmp, F.struct(rank.alias("rank"), F.floor(rank / block_rows).alias("block")))
    spot = f"""transform(filter(plan, p -> p.lo <= {tmp}.block AND {tmp}.block < p.hi), p -> transform(array({tmp}.block - p.lo), k -> struct(
        p.base + (k div p.c) * p.len + p.slots[int(k % p.c)] AS slot, p.base + (k * p.len) div p.c AS rel, p.base + ((k + 1) * p.len + p.c - 1) div p.c AS due))[0])[0]"""
    s = "plan_stream"
    rows = rows.withColumn(s, F.expr(spot))
    made = F.struct(
        F.col(f"{tmp}.block").alias("block"), F.col(f"{s}.slot").alias("slot"), F.col(f"{s}.rel").alias("release"), F.col(f"{s}.due").alias("deadline"),
        (F.col(f"{s}.slot") * block_rows + F.col(f"{tmp}.rank") % block_rows).alias("position"),
    )
    return rows.select(*docs.columns, made.alias(out))


def mixed_order(docs: DataFrame, weights: dict[str, int], other: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows and columns of ``docs``, sorted by position in the mix."""
    made = mix(docs, weights, other, block_rows)
    position = F.col(f"{made.columns[-1]}.position")
    return made.repartitionByRange(position).sortWithinPartitions(position).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    made = mix(docs, WEIGHTS, OTHER)
    return made.select("doc_id", "source", f"{made.columns[-1]}.*")


def _sql() -> str:
    """The schedule slot by slot: of the sources with blocks left, the released
    block of least deadline by weights; a source's last block starts a phase."""
    names, per = list(WEIGHTS), [*WEIGHTS.values(), OTHER]
    k = len(per)
    rows = ", ".join(f"({i}, '{n}', {w})" for i, (n, w) in enumerate(zip([*names, ""], per, strict=True)))
    share = "greatest(a[s + 1], 1)"
    return f"""
WITH RECURSIVE streams(stream, name, w) AS (VALUES {rows}),
docs AS (
  SELECT d.doc_id, d.source, coalesce(s.stream, {k - 1}) AS stream,
    row_number() OVER (PARTITION BY coalesce(s.stream, {k - 1}) ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id) - 1 AS rnk
  FROM documents d LEFT JOIN streams s ON d.source = s.name AND s.stream < {k - 1}),
n AS (SELECT s.stream, s.w, (count(d.stream) + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} AS n FROM streams s LEFT JOIN docs d ON d.stream = s.stream GROUP BY ALL),
sim(t, start, w, have, done, k, pick, block, release, deadline) AS (
  SELECT -1::BIGINT, 0::BIGINT, list(w::BIGINT ORDER BY stream), list(n::BIGINT ORDER BY stream), list(0::BIGINT ORDER BY stream), list(0::BIGINT ORDER BY stream), -1::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT FROM n
  UNION ALL
  SELECT t + 1, CASE WHEN have[p + 1] = 1 THEN t + 2 ELSE start END, w,
    [have[s + 1] - CASE WHEN s = p THEN 1 ELSE 0 END FOR s IN range({k})],
    [done[s + 1] + CASE WHEN s = p THEN 1 ELSE 0 END FOR s IN range({k})],
    [CASE WHEN have[p + 1] = 1 THEN 0 ELSE k[s + 1] + CASE WHEN s = p THEN 1 ELSE 0 END END FOR s IN range({k})],
    p, done[p + 1], start + (k[p + 1] * total) // a[p + 1], start + ((k[p + 1] + 1) * total + a[p + 1] - 1) // a[p + 1]
  FROM (SELECT *, list_min([(((k[s + 1] + 1) * total + a[s + 1] - 1) // {share}) * 1000 + s FOR s IN range({k})
          IF a[s + 1] > 0 AND (k[s + 1] * total) // {share} <= t + 1 - start]) % 1000 AS p
        FROM (SELECT *, list_sum(a)::BIGINT AS total FROM (SELECT *, [CASE WHEN have[s + 1] > 0 THEN w[s + 1] ELSE 0 END FOR s IN range({k})] AS a FROM sim)) WHERE total > 0))
SELECT d.doc_id, d.source, m.block, m.t AS slot, m.release, m.deadline, m.t * {BLOCK_ROWS} + d.rnk % {BLOCK_ROWS} AS position
FROM docs d JOIN sim m ON m.pick = d.stream AND m.block = d.rnk // {BLOCK_ROWS}
"""


SQL = _sql()
