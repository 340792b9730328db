"""Trailing windows of a fixed number of rows.

A symbol's rows are cut in blocks of ``block`` consecutive idx values, and each
block gets the last rows of the one before it, so a symbol of any length is
spread over tasks and windows still see whole histories (halo partitioning).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 8192


def dense_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str = "idx") -> DataFrame:
    """Zero-based row number within ``keys`` by ``order``, without sorting a key's
    rows in one task: ``bucket`` must not decrease along ``order``."""
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket")) - F.col("_n")).drop("_n")
    local = rows.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)))
    return local.join(before, [*keys, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_row") - 1).cast("long")).drop("_bucket", "_before", "_row")


def halo(df: DataFrame, back: int, ahead: int = 0, block: int = BLOCK, idx: str = "idx") -> DataFrame:
    """Rows with ``_block``, copied to the blocks whose frames reach them, and
    ``_own`` true in the block a row belongs to."""
    lo = F.greatest(F.floor((F.col(idx) - ahead) / block), F.lit(0))
    hi = F.floor((F.col(idx) + back) / block)
    rows = df.withColumn("_block", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    return rows.withColumn("_own", F.floor(F.col(idx) / block) == F.col("_block"))


def windows(returns: DataFrame, length: int, stride: int = 1, keys: Sequence[str] = ("symbol",), value: str = "log_return", block: int = BLOCK) -> DataFrame:
    """Gap-aware trailing windows: ``length`` finite values at consecutive idx.

    Endpoints are length-1, length-1+stride, ... before windows with a gap go
    (``collect_list`` drops nulls, so a short list is a gap)."""
    if length < 1 or stride < 1:
        raise ValueError("length and stride must be positive")
    w = Window.partitionBy(*keys, "_block").orderBy("idx")
    frame = w.rangeBetween(-(length - 1), 0)
    v = F.when(~F.isnan(value), F.col(value))
    cols = [c for c in ("session_date", "available_at", "price_end") if c in returns.columns]
    start = [F.first("price_start").over(frame).alias("price_start")] if "price_start" in returns.columns else []
    made = halo(returns, length - 1, block=block).select(
        *keys, "idx", "_own", *cols, *start, F.collect_list(v).over(frame).alias("sample"),
    )
    made = made.filter(F.col("_own") & (F.size("sample") == length) & (F.pmod(F.col("idx") - (length - 1), F.lit(stride)) == 0))
    return made.select(*keys, F.col("idx").alias("endpoint"), (F.col("idx") - (length - 1)).alias("start_idx"), *cols, *(["price_start"] if start else []), "sample")


def rolling(df: DataFrame, length: int, stride: int = 1, keys: Sequence[str] = ("symbol",), value: str = "log_return") -> DataFrame:
    """Plain windows (keys, endpoint, sample); null or NaN input is an error."""
    v = F.col(value)
    return windows(df.withColumn(value, F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit("values must be finite")).cast("double")).otherwise(v)), length, stride, keys, value).select(*keys, "endpoint", "sample")


def joint_panel(returns: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """One row a session with ``x`` = values in the order of ``symbols``; every
    symbol must have exactly the same sessions and price intervals."""
    if len(set(symbols)) != len(symbols) or not symbols:
        raise ValueError("symbols must be unique and not empty")
    r = returns.filter(F.col("symbol").isin(*symbols))
    by = r.groupBy("idx").agg(
        F.count("*").alias("n"), F.count_distinct("symbol").alias("k"), F.min("session_date").alias("session_date"), F.max("session_date").alias("d2"), F.min("price_start").alias("price_start"), F.max("price_start").alias("s2"),
        F.min("price_end").alias("price_end"), F.max("price_end").alias("e2"), F.max("available_at").alias("available_at"), F.map_from_entries(F.collect_list(F.struct("symbol", "log_return"))).alias("m"),
    )
    same = (F.col("n") == len(symbols)) & (F.col("k") == len(symbols)) & (F.col("session_date") == F.col("d2")) & (F.col("price_start") == F.col("s2")) & (F.col("price_end") == F.col("e2"))
    ok = F.when(same, F.col("session_date")).otherwise(F.raise_error(F.lit("symbols do not share their sessions and price intervals")).cast("date"))
    x = F.array(*[F.element_at("m", s) for s in symbols])
    return by.select("idx", ok.alias("session_date"), "available_at", "price_start", "price_end", F.when(~F.exists(x, lambda v: v.isNull() | F.isnan(v)), x).alias("x"))


def joint_windows(panel: DataFrame, length: int, stride: int = 1, keys: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """Windows of a joint panel: void if any component is missing or the chain of
    price intervals breaks inside; available when the last of all atoms is."""
    rows = panel.withColumn("_next", F.col("idx") + 1)
    prior = rows.select(*keys, F.col("_next").alias("idx"), F.col("price_end").alias("_prior"))
    rows = rows.drop("_next").join(prior, [*keys, "idx"], "left").withColumn("_broken", (~F.col("price_start").eqNullSafe(F.col("_prior"))).cast("int"))
    w = Window.partitionBy(*keys, "_block").orderBy("idx")
    frame = w.rangeBetween(-(length - 1), 0)
    inner = F.sum("_broken").over(w.rangeBetween(-(length - 2), 0)) if length > 1 else F.lit(0)
    made = halo(rows, length - 1, block=block).select(
        *keys, "idx", "_own", "session_date", "price_end", F.max("available_at").over(frame).alias("available_at"), F.first("price_start").over(frame).alias("price_start"),
        F.collect_list("x").over(frame).alias("sample"), inner.alias("_breaks"),
    )
    made = made.filter(F.col("_own") & (F.size("sample") == length) & (F.col("_breaks") == 0) & (F.pmod(F.col("idx") - (length - 1), F.lit(stride)) == 0))
    return made.select(*keys, F.col("idx").alias("endpoint"), (F.col("idx") - (length - 1)).alias("start_idx"), "session_date", "available_at", "price_start", "price_end", "sample")


def return_windows(vectors: DataFrame, length: int, stride: int = 1, keys: Sequence[str] = (), value: str = "x", block: int = BLOCK) -> DataFrame:
    """(keys, endpoint, sample) of ``length`` rows at consecutive idx; a null row is
    a gap.  Rows are vectors of a stream without dates."""
    if length < 1 or stride < 1:
        raise ValueError("length and stride must be positive")
    frame = Window.partitionBy(*keys, "_block").orderBy("idx").rangeBetween(-(length - 1), 0)
    made = halo(vectors.select(*keys, "idx", value), length - 1, block=block).select(*keys, "idx", "_own", F.collect_list(value).over(frame).alias("sample"))
    made = made.filter(F.col("_own") & (F.size("sample") == length) & (F.pmod(F.col("idx") - (length - 1), F.lit(stride)) == 0))
    return made.select(*keys, F.col("idx").alias("endpoint"), "sample")


def truth_windows(df: DataFrame, length: int, keys: Sequence[str] = ("symbol",), truth: str = "truth") -> DataFrame:
    """Endpoint truth and whether the window holds no switch."""
    frame = Window.partitionBy(*keys, "_block").orderBy("idx").rangeBetween(-(length - 1), 0)
    made = halo(df, length - 1).select(*keys, "idx", "_own", truth, F.count("*").over(frame).alias("n"), F.min(truth).over(frame).alias("lo"), F.max(truth).over(frame).alias("hi"))
    return made.filter(F.col("_own") & (F.col("n") == length)).select(*keys, F.col("idx").alias("endpoint"), truth, (F.col("lo") == F.col("hi")).alias("pure"))


def pure_state(df: DataFrame, length: int, low: float, high: float, keys: Sequence[str] = ("symbol",), value: str = "rho") -> DataFrame:
    """0 if all values of a window are ``low``, 1 if ``high``, else -1."""
    frame = Window.partitionBy(*keys, "_block").orderBy("idx").rangeBetween(-(length - 1), 0)
    made = halo(df, length - 1).select(*keys, "idx", "_own", F.count("*").over(frame).alias("n"), F.min(value).over(frame).alias("lo"), F.max(value).over(frame).alias("hi"))
    state = F.when((F.col("lo") == low) & (F.col("hi") == low), 0).when((F.col("lo") == high) & (F.col("hi") == high), 1).otherwise(-1)
    return made.filter(F.col("_own") & (F.col("n") == length)).select(*keys, F.col("idx").alias("endpoint"), state.alias("state"))


def running(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], order: str = "idx", block: int = BLOCK) -> DataFrame:
    """Adds running sums along ``order`` (numbers): within blocks by a window, and
    before them by the sums of earlier blocks, so a key is spread over tasks."""
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    rows = rows.withColumns({f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    blocks = rows.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in sums])
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", *[F.coalesce(F.sum(f"_b_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in sums])
    own = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_v_{n}": F.sum(f"_v_{n}").over(own) for n in sums})
    made = rows.join(blocks, [*keys, "_block"]).withColumns({n: F.col(f"_v_{n}") + F.col(f"_b_{n}") for n in sums})
    return made.drop("_block", *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def before(df: DataFrame, keys: Sequence[str], columns: dict[str, str], order: str = "idx", steps: int = 1, block: int = BLOCK) -> DataFrame:
    """Adds columns of the row exactly ``steps`` earlier in ``order`` (null if
    there is none)."""
    w = Window.partitionBy(*keys, "_block").orderBy(order).rangeBetween(-steps, -steps)
    made = halo(df, steps, block=block, idx=order).withColumns({new: F.first(old).over(w) for new, old in columns.items()})
    return made.filter("_own").drop("_own", "_block")


def non_overlapping(wins: DataFrame, length: int, keys: Sequence[str] = ("symbol",), stride: int = 1) -> DataFrame:
    """Greedy choice along endpoints: a window is taken if its endpoint is more
    than ``length`` past the last one taken.

    In an unbroken stretch the choice is every (length + 1)-th endpoint from the
    first taken, so only stretches are folded in order, not windows."""
    ends = before(wins.select(*keys, "endpoint"), keys, {"_prior": "endpoint"}, "endpoint", stride)
    ends = running(ends, keys, {"_run": F.col("_prior").isNull().cast("long")}, "endpoint")
    spans = ends.groupBy(*keys, "_run").agg(F.min("endpoint").alias("lo"), F.max("endpoint").alias("hi"))
    step = -(-(length + 1) // stride) * stride
    kinds = T.StructType([*[spans.schema[k] for k in keys], T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType())])

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for lo, hi in sorted(zip(g["lo"].tolist(), g["hi"].tolist(), strict=True)):
            first = lo if last is None or lo > last + length else lo + -(-(last + length + 1 - lo) // stride) * stride
            if first <= hi:
                last = first + (hi - first) // step * step
                out.append((first, last))
        head = {k: g[k].iloc[0] for k in keys}
        return pd.DataFrame([{**head, "_from": a, "_to": b} for a, b in out], columns=kinds.fieldNames())

    picked = spans.groupBy(*keys).applyInPandas(choose, kinds)
    picked = picked.select(*keys, F.explode(F.sequence("_from", "_to", F.lit(step).cast("long"))).alias("endpoint"))
    return wins.join(picked, [*keys, "endpoint"])


def seam_windows(df: DataFrame, length: int, keys: Sequence[str] = ("symbol",), seam: str = "seam") -> DataFrame:
    """Endpoints, and whether a seam lies anywhere but in the first row."""
    w = Window.partitionBy(*keys, "_block").orderBy("idx")
    crossed = F.sum(F.col(seam).cast("int")).over(w.rangeBetween(-(length - 2), 0)) if length > 1 else F.lit(0)
    made = halo(df, length - 1).select(*keys, "idx", "_own", F.count("*").over(w.rangeBetween(-(length - 1), 0)).alias("n"), crossed.alias("c"))
    return made.filter(F.col("_own") & (F.col("n") == length)).select(*keys, F.col("idx").alias("endpoint"), (F.col("c") > 0).alias("crosses"))


def future(returns: DataFrame, horizon: int, keys: Sequence[str] = ("symbol",), value: str = "log_return", block: int = BLOCK) -> DataFrame:
    """Outcomes of the ``horizon`` rows strictly after each row: total return,
    yearly volatility, drawdown and yearly downside; null if incomplete."""
    from massflow.functions.distributions import downside, drawdown, sd, total

    w = Window.partitionBy(*keys, "_block").orderBy("idx").rangeBetween(1, horizon)
    v = F.when(~F.isnan(value), F.col(value))
    made = halo(returns, 0, horizon, block).select(*keys, "idx", "_own", F.collect_list(v).over(w).alias("a")).filter("_own")
    full = F.when(F.size("a") == horizon, F.col("a"))
    year = F.sqrt(F.lit(252.0))
    return made.select(*keys, "idx", total(full).alias("future_return"), (sd(full) * year).alias("future_volatility"), drawdown(full).alias("future_drawdown"), (downside(full) * year).alias("future_downside"))
