"""Chronological splits with purging, and as-of filters."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def iso_date(text: str) -> dt.date:
    if not isinstance(text, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError("dates are written YYYY-MM-DD")
    return dt.date.fromisoformat(text)


def split(wins: DataFrame, train_end: str, validation_end: str, test_end: str, strict: bool = True) -> DataFrame:
    """Adds ``split``: train, validation, test or null.

    Strict: a validation window's prices must start after the last training
    date, a test window's after the last date, of any window, up to validation_end."""
    a, b, c = map(iso_date, (train_end, validation_end, test_end))
    if not a < b < c:
        raise ValueError("boundaries must increase")
    d = F.col("session_date")
    edge = wins.agg(F.max(F.when(d <= a, d)).alias("_train_last"), F.max(F.when(d <= b, d)).alias("_validation_last"))
    rows = wins.join(F.broadcast(edge))  # one row
    after = lambda last: F.coalesce(F.col("price_start") > F.col(last), F.lit(True)) if strict else F.lit(True)
    kind = F.when(d <= a, "train").when((d > a) & (d <= b) & after("_train_last"), "validation").when((d > b) & (d <= c) & after("_validation_last"), "test")
    return rows.withColumn("split", kind).drop("_train_last", "_validation_last")


def fold(year: int, validation_years: int) -> tuple[str, str, str]:
    """Boundaries of the fold that tests on a year."""
    return f"{year - validation_years - 1}-12-31", f"{year - 1}-12-31", f"{year}-12-31"


def every(df: DataFrame, stride: int, order: str = "endpoint", keys: tuple[str, ...] = ()) -> DataFrame:
    """Each stride-th row by row order after masking, within ``keys``.

    Rows are numbered by buckets of the order column, not in one task."""
    from massflow.operators.windows import dense_index

    rows = df if keys else df.withColumn("_all", F.lit(0))
    made = dense_index(rows, keys or ("_all",), [order], F.floor(F.col(order) / 4096), "_no")
    return made.filter(F.col("_no") % stride == 0).drop("_no", "_all")


def as_of(wins: DataFrame, train_end: str, when: str) -> tuple[DataFrame, DataFrame]:
    """Windows that may be scored as of a moment, and one row of counts."""
    stamp = F.lit(when).cast("timestamp")
    seen = F.col("price_start") <= F.lit(iso_date(train_end))
    late = F.col("available_at") > stamp
    counts = wins.agg(F.count("*").alias("windows"), F.count_if(seen).alias("overlap_training"), F.count_if(~seen & late).alias("not_available"), F.count_if(~seen & ~late).alias("scored"))
    return wins.filter(~seen & ~late), counts


def risk_origins(rows: DataFrame, start: str, end: str, calibration_end: str, when: str, warm: int) -> tuple[DataFrame, DataFrame]:
    """Forecast origins in [start, end], and counts of the first reason against
    each of the others: overlap, not available, not warmed up."""
    asked = F.col("session_date").between(F.lit(iso_date(start)), F.lit(iso_date(end)))
    reason = (
        F.when(F.col("price_start") <= F.lit(iso_date(calibration_end)), "overlap")
        .when(F.col("available_at") > F.lit(when).cast("timestamp"), "not_available").when(F.col("idx") < warm, "not_warm").otherwise("scored")
    )
    marked = rows.filter(asked).withColumn("reason", reason)
    return marked.filter("reason = 'scored'").drop("reason"), marked.groupBy("reason").agg(F.count("*").alias("n"))


def moment(text: str) -> dt.datetime:
    """An ISO moment with its time zone, in UTC."""
    if not isinstance(text, str):
        raise ValueError("a moment is written as ISO text")
    at = dt.datetime.fromisoformat(text)
    if at.tzinfo is None:
        raise ValueError("a moment must name its time zone")
    return at.astimezone(dt.UTC)


def check_contiguous(rows: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Rows that break a rule, with ``fault``, the first one broken (empty if all is
    well): ``gap`` (no row at the idx before), ``chain`` (prices do not start where
    those before ended), ``session`` (not the calendar's next session), ``order``
    (available no later than the row before) or ``early`` (available before its
    session's close; without a calendar, before the day)."""
    from massflow.operators.windows import before

    made = before(rows, ["symbol"], {"_end": "price_end", "_at": "available_at"})
    made = made.join(rows.groupBy("symbol").agg(F.min("idx").alias("_first")), "symbol")
    close, next_session = F.col("price_end").cast("timestamp"), F.lit(True)
    if calendar is not None:
        days = calendar.select(F.col("session_date").alias("_day"), F.col("close_utc").alias("_close"), F.col("session_no").alias("_no"))
        starts = calendar.select(F.col("session_date").alias("_from"), F.col("session_no").alias("_from_no"))
        made = made.join(F.broadcast(days), made["price_end"] == F.col("_day"), "left").join(F.broadcast(starts), made["price_start"] == F.col("_from"), "left")  # a calendar's days
        close, next_session = F.col("_close"), F.coalesce(F.col("_no") == F.col("_from_no") + 1, F.lit(False))
    later = F.col("idx") > F.col("_first")
    fault = (
        F.when(later & F.col("_end").isNull(), "gap").when(later & (F.col("_end") != F.col("price_start")), "chain").when(~next_session, "session")
        .when(later & (F.col("_at") >= F.col("available_at")), "order").when(F.col("available_at") < close, "early")
    )
    return made.withColumn("fault", fault).filter("fault IS NOT NULL").select(*rows.columns, "fault")


def check_prefix(origins: DataFrame, keys: list[str], scored: str = "scored") -> DataFrame:
    """Keys whose scored origins are not the first ones in idx order (empty if all
    is well)."""
    ends = origins.groupBy(*keys).agg(F.max(F.when(F.col(scored), F.col("idx"))).alias("last"), F.min(F.when(~F.col(scored), F.col("idx"))).alias("open"))
    return ends.filter("last > open")
