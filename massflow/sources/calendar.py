"""Session calendars as tables of session_no, session_date and close_utc."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# New York closures that no rule gives.
SINGLE_CLOSURES = (
    "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)


def _easter(y: int) -> dt.date:
    a, b, c = y % 19, y // 100, y % 100
    d, e, f = b // 4, b % 4, (b + 8) // 25
    h = (19 * a + b - d - (b - f + 1) // 3 + 15) % 30
    k = (32 + 2 * e + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    month, day = divmod(h + k - 7 * m + 114, 31)
    return dt.date(y, month, day + 1)


def _nth(y: int, month: int, weekday: int, n: int) -> dt.date:
    if n > 0:
        first = dt.date(y, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(y, month + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


@lru_cache(maxsize=256)
def new_york_year(y: int) -> tuple[frozenset[dt.date], frozenset[dt.date]]:
    """Closed weekdays and early closes (13:00) of a year, by rule."""
    def observed(d: dt.date) -> dt.date:
        return d - dt.timedelta(1) if d.weekday() == 5 else d + dt.timedelta(1) if d.weekday() == 6 else d

    closed = {_nth(y, 2, 0, 3), _easter(y) - dt.timedelta(2), _nth(y, 5, 0, -1), observed(dt.date(y, 7, 4)), _nth(y, 9, 0, 1), _nth(y, 11, 3, 4), observed(dt.date(y, 12, 25))}
    new_year = dt.date(y, 1, 1)
    if new_year.weekday() != 5:  # a Saturday's is not observed in the old year
        closed.add(observed(new_year))
    if y >= 1998:
        closed.add(_nth(y, 1, 0, 3))
    if y >= 2022:
        closed.add(observed(dt.date(y, 6, 19)))
    closed |= {d for d in map(dt.date.fromisoformat, SINGLE_CLOSURES) if d.year == y}
    early = {_nth(y, 11, 3, 4) + dt.timedelta(1)}
    for d in (dt.date(y, 7, 3), dt.date(y, 12, 24)):
        if d.weekday() < 4 or d.month == 12 and d.weekday() < 4:
            early.add(d)
    if y < 2013 and dt.date(y, 7, 3).weekday() == 4:
        early.discard(dt.date(y, 7, 3))
    return frozenset(closed), frozenset(early - closed)


def new_york(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Sessions and scheduled closes of New York, by rule, in UTC."""
    zone, rows, d = ZoneInfo("America/New_York"), [], dt.date.fromisoformat(start)
    while d <= dt.date.fromisoformat(end):
        closed, early = new_york_year(d.year)
        if d.weekday() < 5 and d not in closed:
            at = dt.datetime.combine(d, dt.time(13 if d in early else 16), zone).astimezone(dt.UTC)
            rows.append((len(rows), d, at.replace(tzinfo=None).isoformat(" ")))
        d += dt.timedelta(1)
    made = spark.createDataFrame(rows, "session_no long, session_date date, close_text string")
    return made.select("session_no", "session_date", F.to_timestamp("close_text").alias("close_utc"))


def regular(spark: SparkSession, start: str, end: str, days: int = 1, close_hour: int = 21) -> DataFrame:
    """A session every ``days`` days."""
    lo, hi = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    made = spark.range((hi - lo).days // days + 1).select(F.col("id").alias("session_no"), F.date_add(F.lit(lo), (F.col("id") * days).cast("int")).alias("session_date"))
    return made.withColumn("close_utc", F.col("session_date").cast("timestamp") + F.expr(f"INTERVAL {close_hour} HOUR"))
