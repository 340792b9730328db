"""Every query with an SQL twin against DuckDB, and the others for a result."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from massflow.operators import evaluate
from massflow.plans import queries as Q

SF = "/root/testdata/sf0.01"
TABLES = ("lineitem", "orders", "events", "customer", "embeddings", "labels")


def table(df):
    cols = sorted(df.columns)

    def text(x):
        if x is None or str(x) in ("nan", "NaT", "<NA>"):
            return "~"
        if isinstance(x, dt.date) and not isinstance(x, dt.datetime):
            return str(x)
        if isinstance(x, dt.datetime):
            return str(x)[:19].replace(" 00:00:00", "")
        return str(x) if isinstance(x, (str, bool)) or str(x) in ("True", "False") else f"{float(x) + 0.0:.9g}"

    return cols, sorted(tuple(map(text, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert table(Q.QUERIES[name](spark, SF).toPandas()) == table(con.execute(Q.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_has_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["w2_assign", "windows_gap_aware", "risk_metrics"])
def test_smallest_tables(spark, name):
    Q.QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_novelty_of_prices_that_differ_when_computed_again(spark, monkeypatch):
    """As the mean of a week does in its last bits, by the order of its parts."""
    again = F.udf(lambda x: x * (1 + random.random() * 1e-13), "double").asNondeterministic()
    prices = Q.P.weekly_prices
    monkeypatch.setattr(Q.P, "weekly_prices", lambda *a: prices(*a).withColumn("price", again("price")))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    for name in ("novelty_percentile", "novelty_quantile"):
        assert table(Q.QUERIES[name](spark, SF).toPandas()) == table(con.execute(Q.SQL[name]).df())


def test_percentiles_of_values_that_differ_when_computed_again(spark):
    again = F.udf(lambda x: x + random.random() / 2, "double").asNondeterministic()
    scored = spark.range(1000).select("id", again(F.col("id").cast("double")).alias("nearest"))
    calibration = spark.range(100).select(F.col("id").cast("double").alias("nearest"))
    got = evaluate.percentiles(scored, calibration, 0.95).select("id", "percentile", "ood").collect()
    assert {r["id"]: (r["percentile"], r["ood"]) for r in got} == {i: (min(i + 1, 100) / 100, i >= 94) for i in range(1000)} and len(got) == 1000


def test_entry_points_without_the_llm_package(tmp_path):
    """The driver removes that package; the rest must import."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/massflow", tmp_path / "massflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'w2_assign' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, check=True)
