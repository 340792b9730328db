"""Price snapshots named by a configuration, as validated returns and panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.operators import ingest, windows
from massflow.session import cut
from massflow.sources import calendar, files

YEARS = ("1990-01-01", "2030-12-31")
CALENDARS = {
    "new_york": lambda spark: calendar.new_york(spark, *YEARS),
    "daily": lambda spark: calendar.regular(spark, *YEARS),
    "weekly": lambda spark: calendar.regular(spark, *YEARS, days=7),  # Mondays
}


@lru_cache(maxsize=8)
def sessions_of(spark: SparkSession, name: str) -> DataFrame:
    """A calendar, made once a session."""
    return cut(CALENDARS[name](spark))


def check_snapshots(spark: SparkSession, assets: Sequence[Mapping[str, str]]) -> dict[str, str]:
    """Hashes by symbol, if the bytes of all files are those of the configuration and
    of their sidecars."""
    found = files.sidecars(spark, [a["dataset"] for a in assets])
    for a in assets:
        digest, side = found[a["dataset"]]
        if side.get("symbol") != a["symbol"] or side.get("sha256", side.get("dataset_sha256")) != digest or digest != a["sha256"]:
            raise ValueError(f"{a['dataset']} is not the snapshot of the configuration")
    return {a["symbol"]: a["sha256"] for a in assets}


def prices(spark: SparkSession, assets: Sequence[Mapping[str, str]], price_column: str) -> DataFrame:
    """(symbol, session_date, price) of the assets' files, after ``check_snapshots``."""
    check_snapshots(spark, assets)
    parts = [files.price_csv(spark, a["dataset"], a["symbol"], price_column=price_column) for a in assets]
    return reduce(DataFrame.unionByName, parts)


def _checked(spark: SparkSession, assets: Sequence[Mapping[str, str]], price_column: str, sessions: str, cutoff: str | None) -> DataFrame:
    """Prices up to ``cutoff``, written once and validated."""
    rows = prices(spark, assets, price_column)
    if cutoff is not None:
        rows = rows.filter(F.col("session_date") <= F.lit(cutoff).cast("date"))
    rows = cut(rows)
    ingest.validate(rows, sessions_of(spark, sessions))
    return rows


def returns(spark: SparkSession, assets: Sequence[Mapping[str, str]], price_column: str, sessions: str, cutoff: str | None = None) -> DataFrame:
    """Log returns of all assets; nothing after ``cutoff`` is read any further."""
    return ingest.log_returns(_checked(spark, assets, price_column, sessions, cutoff), sessions_of(spark, sessions))


def panel(spark: SparkSession, assets: Sequence[Mapping[str, str]], price_column: str, sessions: str, cutoff: str | None = None) -> DataFrame:
    """The joint panel of the assets over their common sessions, written once."""
    days, rows = sessions_of(spark, sessions), _checked(spark, assets, price_column, sessions, cutoff)
    numbers = F.broadcast(days.select("session_date", "session_no"))  # a calendar's days
    by = rows.join(numbers, "session_date").groupBy("symbol").agg(F.min("session_no").alias("lo"), F.max("session_no").alias("hi"))
    span = by.agg((F.max("lo") + 1).alias("lo"), F.min("hi").alias("hi")).first()  # a symbol's first session has no return
    if span["lo"] is None or span["lo"] > span["hi"]:
        raise ValueError("the assets share no history")
    shared = ingest.log_returns(rows, days).join(numbers, "session_date").filter(F.col("session_no").between(span["lo"], span["hi"]))
    return cut(windows.joint_panel(shared.withColumn("idx", F.col("session_no") - span["lo"]).drop("session_no"), [a["symbol"] for a in assets]))


def identity(spark: SparkSession, assets: Sequence[Mapping[str, str]], provider: str, price_column: str) -> dict[str, Any]:
    """What was read: hashes by symbol, provider and column."""
    return {"provider": provider, "price_column": price_column, "assets": check_snapshots(spark, assets)}
