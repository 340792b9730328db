"""Prices to validated, gap-preserving, availability-stamped log returns.

Tables carry ``symbol``; a session's return joins two consecutive sessions of the
calendar, and is null if either price is missing: gaps are never bridged.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massflow.operators.windows import before

LAG_MINUTES = 1


def session_date(c: Column) -> Column:
    """The UTC date of a date, timestamp or text; null input is an error."""
    day = F.to_date(c)
    return F.when(day.isNotNull(), day).otherwise(F.raise_error(F.lit("a session date is missing or cannot be read")))


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def bad_prices(prices: DataFrame, price: str = "price") -> DataFrame:
    """Rows whose price is null, not a number, infinite or not positive."""
    p = F.col(price).try_cast("double")
    return prices.filter(p.isNull() | F.isnan(p) | (p <= 0) | (p == float("inf")))


def duplicate_sessions(prices: DataFrame) -> DataFrame:
    """(symbol, session_date, n, conflicting) of sessions named more than once."""
    by = prices.groupBy("symbol", "session_date").agg(F.count("*").alias("n"), F.min("price").alias("lo"), F.max("price").alias("hi"))
    return by.filter("n > 1").select("symbol", "session_date", "n", (F.col("lo") != F.col("hi")).alias("conflicting"))


def off_calendar(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows on dates that are no session."""
    return prices.join(calendar.select("session_date"), "session_date", "left_anti")


def validate(prices: DataFrame, calendar: DataFrame) -> None:
    """Raise with the first offending rows, if any; all rules are one plan."""
    require_columns(prices, ["symbol", "session_date", "price"])
    rules = {"prices that are not positive and finite": bad_prices(prices), "duplicate sessions": duplicate_sessions(prices), "dates that are no session": off_calendar(prices, calendar)}
    every = reduce(DataFrame.unionByName, [bad.select(F.lit(what).alias("what"), F.col("symbol").cast("string").alias("symbol"), F.col("session_date").cast("string").alias("day")) for what, bad in rules.items()])
    if found := every.limit(5).collect():
        raise ValueError(f"{found[0]['what']}: {[(r['symbol'], r['day'], r['what']) for r in found]}")


def fingerprint(df: DataFrame, keys: Sequence[str], columns: Sequence[Column]) -> DataFrame:
    """(keys, n, fingerprint): 26 hex digits that depend on the rows' columns, as text,
    and on how often each row occurs, but not on their order or partitions.  Two
    halves of every row's MD5 are added up."""
    line = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]).cast("binary"))
    part = lambda at: F.sum(F.conv(F.substring(line, at, 13), 16, 10).cast("decimal(38,0)"))
    made = df.groupBy(*keys).agg(F.count("*").alias("n"), part(1).alias("a"), part(14).alias("b"))
    half = lambda c: F.lpad(F.lower(F.hex((F.col(c) % F.lit(1 << 52).cast("decimal(38,0)")).cast("long"))), 13, "0")
    return made.select(*keys, "n", F.concat(half("a"), half("b")).alias("fingerprint"))


def _spine(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows of ``on_calendar`` with ``first_no``, the symbol's first session."""
    known = calendar.select("session_date", "session_no")
    span = prices.join(known, "session_date").groupBy("symbol").agg(F.min("session_no").alias("first_no"), F.max("session_no").alias("last_no"))
    spine = span.select("symbol", "first_no", F.explode(F.sequence("first_no", "last_no")).alias("session_no")).join(calendar, "session_no")
    spine = spine.select("symbol", "session_date", "close_utc", "session_no", "first_no")
    return spine.join(prices.select("symbol", "session_date", "price"), ["symbol", "session_date"], "left")


def on_calendar(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every session between a symbol's first and last date; absent prices null.

    ``calendar`` has session_date, close_utc and session_no (a dense number), so
    a session's neighbour is known without ordering the symbol's whole history."""
    return _spine(prices, calendar).drop("first_no")


def log_returns(prices: DataFrame, calendar: DataFrame) -> DataFrame:
    """symbol, idx, session_date, log_return, available_at, price_start, price_end.

    The first session of a symbol has no return; idx counts from 0.  The
    earlier price comes from the row of the session number before, in blocks of
    sessions, so one symbol's history is never sorted in one task and the prices
    are not read again for it."""
    full = before(_spine(prices, calendar), ["symbol"], {"price_start": "session_date", "before": "price"}, "session_no")
    return full.filter("session_no > first_no").select(
        "symbol", (F.col("session_no") - F.col("first_no") - 1).cast("long").alias("idx"), "session_date",
        (F.ln("price") - F.ln("before")).alias("log_return"),
        (F.col("close_utc") + F.expr(f"INTERVAL {LAG_MINUTES} MINUTE")).alias("available_at"),
        "price_start", F.col("session_date").alias("price_end"),
    )


def quality_summary(prices: DataFrame, calendar: DataFrame, name: str = "calendar") -> DataFrame:
    """One row a symbol: sessions observed, expected, missing, invalid returns."""
    full = on_calendar(prices, calendar).groupBy("symbol").agg(F.count("price").alias("observed_sessions"), F.count("*").alias("expected_sessions"))
    bad = log_returns(prices, calendar).groupBy("symbol").agg(F.count_if(F.col("log_return").isNull()).alias("invalid_returns"))
    return full.join(bad, "symbol", "left").select(
        "symbol", F.lit(name).alias("calendar"), "observed_sessions", "expected_sessions", (F.col("expected_sessions") - F.col("observed_sessions")).alias("missing_sessions"),
        F.coalesce("invalid_returns", F.lit(0)).alias("invalid_returns"), F.lit(LAG_MINUTES).alias("availability_lag_minutes"), F.lit(False).alias("point_in_time"),
    )


def crop(df: DataFrame, start, end, date: str = "session_date") -> DataFrame:
    return df.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def common_history(returns: DataFrame, cutoff=None) -> DataFrame:
    """Rows in the period that all symbols share, up to ``cutoff``."""
    by = returns.groupBy("symbol").agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi"))
    last = F.min("hi") if cutoff is None else F.least(F.min("hi"), F.lit(cutoff).cast("date"))
    span = by.agg(F.max("lo").alias("common_start"), last.alias("common_end"))  # one row
    return returns.join(F.broadcast(span), F.col("session_date").between(F.col("common_start"), F.col("common_end")))
