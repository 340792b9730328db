"""Adapters that view the supplied tables as price panels and samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massflow.operators import ingest, windows
from massflow.operators.geometry import distances
from massflow.session import cut
from massflow.sources import calendar

LENGTH = 21
#: Windows of this symbol, at these endpoints, are the fixed centers.
CENTER_SYMBOL, CENTER_ENDPOINTS = "N", (20, 180, 340)
WEEKS = ("1990-01-01", "2005-12-31")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three symbols, one price a week."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("session_date"), "l_extendedprice")
    return rows.groupBy("symbol", "session_date").agg(F.avg("l_extendedprice").alias("price"))


def weekly_calendar(spark: SparkSession) -> DataFrame:
    return calendar.regular(spark, *WEEKS, days=7)


def weekly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.log_returns(weekly_prices(spark, sf_dir), weekly_calendar(spark))


def weekly_windows(spark: SparkSession, sf_dir: str, length: int = LENGTH, stride: int = 1) -> DataFrame:
    return windows.windows(weekly_returns(spark, sf_dir), length, stride)


def weekly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joint panel of the three symbols over their common weeks."""
    r = ingest.common_history(weekly_returns(spark, sf_dir))
    r = r.withColumn("idx", (F.date_diff("session_date", "common_start") / 7).cast("long")).drop("common_start", "common_end")
    return windows.joint_panel(r, ["N", "A", "R"])


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol, a mean order price a day; days without orders are gaps."""
    rows = table(spark, sf_dir, "orders").select(F.lit("orders").alias("symbol"), F.to_date("o_orderdate").alias("session_date"), "o_totalprice")
    return rows.groupBy("symbol", "session_date").agg(F.avg("o_totalprice").alias("price"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, idx, log_return) of consecutive events of a type."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.ln("value").alias("x"))
    rows = windows.dense_index(rows, ["symbol"], ["ts", "event_id"], F.unix_date(F.to_date("ts")))
    w = Window.partitionBy("symbol", "_block").orderBy("idx")
    made = windows.halo(rows, 1).withColumn("log_return", F.col("x") - F.lag("x").over(w)).filter("_own AND idx > 0")
    return made.select("symbol", (F.col("idx") - 1).alias("idx"), "log_return")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, truth, sample) of ready vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"), F.col("embedding").cast("array<double>").alias("sample"))


def centers(wins: DataFrame) -> np.ndarray:
    """The fixed centers: at most three windows come to the driver."""
    rows = wins.filter((F.col("symbol") == CENTER_SYMBOL) & F.col("endpoint").isin(*CENTER_ENDPOINTS)).select("endpoint", "sample").collect()
    return np.sort(np.array([r["sample"] for r in sorted(rows, key=lambda r: r["endpoint"])]), axis=1)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly windows with their W2 distances to the fixed centers.  The windows are
    written once: a mean price differs in its last bits with the order in which parts of
    a week are added up, so windows computed again are not the centers' or each other's."""
    wins = cut(weekly_windows(spark, sf_dir))
    return distances(wins, centers(wins), 2)
