"""Resampling by index tables.

A draw is a function of (seed, repetition, position) by integer hashing, so it does
not depend on partitions, and any engine with 64-bit integers makes the same table:
``bits_sql`` and ``draws_sql`` write it for other SQL engines."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.operators.windows import dense_index

_MASK, _FACTOR = (1 << 32) - 1, 0x45D9F3B
#: What a hash decides: a restart, where it goes, a block's start, a free index.
RESTART, FRESH, BLOCK, FREE = range(4)


def _mix(x):
    """A bijection of 32-bit numbers, held in 64 bits."""
    for _ in range(2):
        x = (((x >> 16) ^ x) * _FACTOR) & _MASK
    return (x >> 16) ^ x


def bits(seed: int, rep: int, pos: np.ndarray, purpose: int) -> np.ndarray:
    """A 32-bit number for each position."""
    start = _mix((_mix(seed & _MASK) + rep) & _MASK)
    return _mix((_mix((start + np.asarray(pos, np.int64)) & _MASK) + purpose) & _MASK)


def below(n: int, seed: int, rep: int, pos: np.ndarray, purpose: int) -> np.ndarray:
    """Numbers from 0 to n - 1."""
    return (bits(seed, rep, pos, purpose) * n) >> 32


def _check(n: int, block: float) -> None:
    if isinstance(n, bool) or not isinstance(n, (int, np.integer)) or not 0 < n < 1 << 31:
        raise ValueError("a series has a positive number of rows")
    if isinstance(block, bool) or not math.isfinite(block) or block < 1:
        raise ValueError("blocks are finite and at least one row long")


def moving_block(n: int, block: int, seed: int, rep: int = 0) -> np.ndarray:
    """Blocks of consecutive indices from random starts; they never wrap."""
    _check(n, block)
    b, pos = min(int(block), n), np.arange(n)
    return below(n - b + 1, seed, rep, pos // b, BLOCK) + pos % b


def stationary(n: int, block: float, seed: int, rep: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Circular indices with geometric block lengths, and where seams are: the first
    row, restarts and wraps."""
    _check(n, block)
    pos = np.arange(n)
    restart = bits(seed, rep, pos, RESTART) < 2.0**32 / block
    restart[0] = True
    at = np.maximum.accumulate(np.where(restart, pos, 0))
    idx = (below(n, seed, rep, at, FRESH) + pos - at) % n
    return idx, restart | (idx == 0)


def index_table(n: int, seed: int, rep: int, kind: str, block: float) -> tuple[np.ndarray, np.ndarray]:
    """(indices, seams) of one repetition; in an iid draw every row is a seam."""
    if kind == "moving":
        idx = moving_block(n, block, seed, rep)
        return idx, np.r_[True, idx[1:] != idx[:-1] + 1]
    if kind == "stationary":
        return stationary(n, block, seed, rep)
    if kind != "iid":
        raise ValueError(f"unknown kind of draw: {kind}")
    _check(n, 1)
    return below(n, seed, rep, np.arange(n), FREE), np.ones(n, bool)


def draws(spark: SparkSession, n: int | DataFrame, reps: int, seed: int, kind: str = "moving", block: float = 21) -> DataFrame:
    """(rep, pos, idx, seam) for a series of n rows; for a table (keys, n) of series
    the same with its keys.  Tables are made a repetition and series at a time."""
    lengths = spark.range(1).select(F.lit(int(n)).alias("n")) if not isinstance(n, DataFrame) else n
    keys = [c for c in lengths.columns if c != "n"]
    fields = "".join(f"`{k}` {lengths.schema[k].dataType.simpleString()}, " for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                size = int(row[-1])
                idx, seam = index_table(size, seed, int(row[0]), kind, block)
                yield pd.DataFrame(dict(zip(keys, row[1:-1], strict=True)) | {"rep": row[0], "pos": np.arange(size), "idx": idx, "seam": seam})

    every = spark.range(reps).withColumnRenamed("id", "rep").join(F.broadcast(lengths.select(*keys, "n")))  # one row a series
    return every.mapInPandas(run, f"{fields}rep long, pos long, idx long, seam boolean")


def bits_sql(seed: int, rep: str, pos: str, purpose: int) -> str:
    """``bits`` as DuckDB SQL over the columns ``rep`` and ``pos``."""
    def mix(x: str, name: str) -> str:
        for i in range(2):
            x = f"[(xor({name}{i} >> 16, {name}{i}) * {_FACTOR}) & {_MASK} FOR {name}{i} IN [{x}]][1]"
        return f"[xor({name}9 >> 16, {name}9) FOR {name}9 IN [{x}]][1]"

    start = mix(f"(({_mix(seed & _MASK)} + {rep})::BIGINT & {_MASK})", "ba")
    return mix(f"(({mix(f'(({start} + {pos}) & {_MASK})', 'bb')} + {purpose}) & {_MASK})", "bc")


def draws_sql(lengths: str, reps: int, seed: int, kind: str, block: float = 21, keys: Sequence[str] = ()) -> str:
    """``draws`` as a DuckDB subquery; ``lengths`` is a table of keys and n."""
    k = "".join(f"{x}, " for x in keys)
    free = lambda n, pos, purpose: f"(({bits_sql(seed, 'rep', pos, purpose)} * ({n})) >> 32)"
    every = f"(SELECT *, unnest(range(n::BIGINT)) AS pos FROM (SELECT *, unnest(range({reps})) AS rep FROM {lengths}))"
    if kind == "moving":
        least = f"least({int(block)}, n)"
        return f"(SELECT {k}rep, pos, {free(f'n - {least} + 1', f'(pos // {least})', BLOCK)} + pos % {least} AS idx FROM {every})"
    if kind == "iid":
        return f"(SELECT {k}rep, pos, {free('n', 'pos', FREE)} AS idx, true AS seam FROM {every})"
    begun = f"(SELECT *, pos = 0 OR {bits_sql(seed, 'rep', 'pos', RESTART)} < {2.0**32 / block!r}::DOUBLE AS restart FROM {every})"
    placed = f"(SELECT *, max(CASE WHEN restart THEN pos END) OVER (PARTITION BY {k}rep ORDER BY pos) AS head FROM {begun})"
    drawn = f"(SELECT *, ({free('n', 'head', FRESH)} + pos - head) % n AS idx FROM {placed})"
    return f"(SELECT {k}rep, pos, idx, restart OR idx = 0 AS seam FROM {drawn})"


def resample(df: DataFrame, drawn: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``df`` (keys, idx, ...) in the drawn order: idx becomes the position."""
    return drawn.join(df, [*keys, "idx"]).drop("idx").withColumnRenamed("pos", "idx")


def contaminate(df: DataFrame, share: float, size: float, seed: int, values: Sequence[str] = ("log_return",)) -> DataFrame:
    """Adds size * sd, with a random sign for each column, to ceil(rows * share)
    random rows (one at least) of the columns ``values``; sd is the column's own over
    ``df``, which has one row an idx.  Adds ``hit``; a null stays null.

    Rows are chosen by rank of a hash, counted in hash buckets."""
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)
    if not number(share) or not 0 < share <= 1 or not number(size) or size <= 0:
        raise ValueError("a share lies in (0, 1], a size is positive")
    text = lambda *more: F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("idx").cast("string"), *more).cast("binary"))
    rows = dense_index(df.withColumns({"_all": F.lit(0), "_h": text()}), ["_all"], ["_h", "idx"], F.conv(F.substring("_h", 1, 4), 16, 10).cast("long"), "_rank")
    whole = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(float(share)))).alias("_hits"), *[F.stddev_pop(v).alias(f"_sd{i}") for i, v in enumerate(values)])
    made = rows.join(F.broadcast(whole)).withColumn("hit", F.col("_rank") < F.col("_hits"))  # one row
    sign = lambda v: F.when(F.substring(text(F.lit(v)), 1, 1) >= "8", 1.0).otherwise(-1.0)
    moved = {v: F.when(F.col("hit"), F.col(v) + sign(v) * F.lit(float(size)) * F.col(f"_sd{i}")).otherwise(F.col(v)) for i, v in enumerate(values)}
    return made.withColumns(moved).select(*df.columns, "hit")


#: Losses up to this many numbers are sent to the tasks as one matrix;
#: larger ones are joined to the draws.
LOCAL_NUMBERS = 2_000_000


def _local_intervals(losses: DataFrame, base: str, blocks: Sequence[int], reps: int, seeds: Sequence[int]) -> DataFrame | None:
    """As ``paired_intervals``, from a matrix of bounded size: the same draws.
    None if some method lacks a step."""
    pdf = losses.select("t", "method", "loss_name", "value").toPandas().pivot_table(index="t", columns=["method", "loss_name"], values="value", dropna=False).sort_index()
    names = [c for c in pdf.columns if c[0] != base]
    if pdf.isna().any().any() or not names:
        return None
    x = np.stack([(pdf[base, loss] - pdf[m, loss]).to_numpy() for m, loss in names], 1)
    n, blocks, seeds = len(x), list(blocks), list(seeds)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            which, rep = b["id"].to_numpy() % len(blocks), b["id"].to_numpy() // len(blocks)
            means = [x[stationary(n, blocks[i], seeds[i], int(r))[0]].mean(0) for i, r in zip(which, rep, strict=True)]
            if means:
                yield pd.DataFrame({"which": np.repeat(which, len(names)), "series": np.tile(np.arange(len(names)), len(rep)), "m": np.concatenate(means)})

    spark = losses.sparkSession
    made = spark.range(reps * len(blocks)).mapInPandas(run, "which long, series long, m double")
    spread = made.groupBy("which", "series").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    pick = lambda at, v, kind: F.element_at(F.array(*[F.lit(y).cast(kind) for y in v]), F.col(at).cast("int") + 1)
    return spread.select(
        pick("series", [m for m, _ in names], "string").alias("method"), pick("series", [k for _, k in names], "string").alias("loss_name"),
        pick("series", [float(v) for v in x.mean(0)], "double").alias("mean_delta"), F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), pick("which", blocks, "int").alias("block"),
    )


def _joined_interval(losses: DataFrame, base: str, block: int, reps: int, seed: int) -> DataFrame:
    other = losses.select(F.col("t"), F.col("loss_name"), F.col("value").alias("other"), F.col("method"))
    mine = losses.filter(F.col("method") == base).select("t", "loss_name", F.col("value").alias("mine"))
    delta = other.filter(F.col("method") != base).join(mine, ["t", "loss_name"]).withColumn("delta", F.col("mine") - F.col("other"))
    steps = losses.select("t").distinct()
    steps = dense_index(steps.withColumn("_k", F.lit(0)), ["_k"], ["t"], F.floor(F.col("t") / 4096)).drop("_k")
    n = steps.count()
    drawn = draws(losses.sparkSession, n, reps, seed, "stationary", block).groupBy("rep", "idx").agg(F.count("*").alias("w"))
    means = delta.join(steps, "t").join(drawn, "idx").groupBy("method", "loss_name", "rep").agg((F.sum(F.col("delta") * F.col("w")) / F.sum("w")).alias("m"))
    spread = means.groupBy("method", "loss_name").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return delta.groupBy("method", "loss_name").agg(F.avg("delta").alias("mean_delta")).join(spread, ["method", "loss_name"]).withColumn("block", F.lit(block))


def paired_intervals(losses: DataFrame, base: str, blocks: Sequence[int], reps: int, seeds: Sequence[int]) -> DataFrame:
    """For each other method, loss and block length: mean difference to ``base`` and its
    bootstrap interval; a draw is shared by all methods and losses."""
    if 0 < losses.count() <= LOCAL_NUMBERS and (made := _local_intervals(losses, base, blocks, reps, seeds)) is not None:
        return made
    return reduce(DataFrame.unionByName, [_joined_interval(losses, base, b, reps, s) for b, s in zip(blocks, seeds, strict=True)])


def paired_interval(losses: DataFrame, base: str, block: int, reps: int, seed: int) -> DataFrame:
    """``paired_intervals`` of one block length."""
    return paired_intervals(losses, base, [block], reps, [seed]).drop("block")
