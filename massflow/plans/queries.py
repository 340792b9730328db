"""The library's queries over the supplied tables, each with its SQL twin.

A query is registered with ``@query(name, sql)``; computed doubles are rounded,
and -0.0 becomes 0.0, on both sides."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from massflow.functions import distributions as D
from massflow.operators import evaluate, geometry, hmm, ingest, lloyd, medoids, mixture, resample, risk, splits, windows
from massflow.plans import panels as P
from massflow.session import cut
from massflow.sources import calendar, synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
L = P.LENGTH
TRAIN, VALID, TEST = "1997-12-31", "1999-12-31", "2001-12-31"
BANDWIDTH = 0.1


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def r(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0::DOUBLE)"


# SQL of the panels
RET = f"""px AS (SELECT l_returnflag AS symbol, date_trunc('week', l_shipdate)::DATE AS session_date, avg(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
span AS (SELECT symbol, min(session_date) AS lo, max(session_date) AS hi FROM px GROUP BY symbol),
cal AS (SELECT d::DATE AS session_date FROM generate_series(TIMESTAMP '{P.WEEKS[0]}', TIMESTAMP '{P.WEEKS[1]}', INTERVAL 7 DAY) t(d)),
spine AS (SELECT span.symbol, cal.session_date, px.price FROM span JOIN cal ON cal.session_date BETWEEN lo AND hi LEFT JOIN px ON px.symbol = span.symbol AND px.session_date = cal.session_date),
raw AS (SELECT *, row_number() OVER w - 2 AS idx, lag(price) OVER w AS before, lag(session_date) OVER w AS price_start FROM spine WINDOW w AS (PARTITION BY symbol ORDER BY session_date)),
ret AS (SELECT symbol, idx, session_date, ln(price) - ln(before) AS log_return, session_date::TIMESTAMP + INTERVAL 21 HOUR + INTERVAL 1 MINUTE AS available_at, price_start, session_date AS price_end FROM raw WHERE idx >= 0)"""


def win(length: int = L, stride: int = 1, source: str = "ret") -> str:
    return f"""win AS (SELECT symbol, endpoint, endpoint - {length - 1} AS start_idx, session_date, available_at, price_start, price_end, sample, list_sort(sample) AS q FROM (
  SELECT symbol, idx AS endpoint, session_date, available_at, price_end, first(price_start) OVER w AS price_start, list(log_return) OVER w AS sample, count(log_return) OVER w AS c
  FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW)) WHERE c = {length} AND (endpoint - {length - 1}) % {stride} = 0)"""


TICK = """ev AS (SELECT event_type AS symbol, row_number() OVER w - 2 AS idx, x - lag(x) OVER w AS log_return FROM (SELECT *, CASE WHEN value > 0 THEN ln(value) END AS x FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
tick AS (SELECT *, NULL::DATE AS session_date, NULL::TIMESTAMP AS available_at, NULL::DATE AS price_start, NULL::DATE AS price_end FROM ev WHERE idx >= 0)"""
CENTERS = f"""centers AS (SELECT endpoint AS e, q AS c, row_number() OVER (ORDER BY endpoint) - 1 AS k FROM win WHERE symbol = '{P.CENTER_SYMBOL}' AND endpoint IN {P.CENTER_ENDPOINTS})"""
LABELS = CENTERS + f""",
dist AS (SELECT symbol, endpoint, session_date, available_at, price_start, sample, q, list(list_distance(q, c) / sqrt({L}.0::DOUBLE) ORDER BY k) AS d FROM win, centers GROUP BY ALL),
lab AS (SELECT *, list_position(d, list_min(d)) - 1 AS label, list_min(d) AS nearest FROM dist)"""
BASE = f"WITH {RET}, {win()}, {LABELS} "
SAMPLES = "e AS (SELECT vec_id AS id, label AS truth, [x::DOUBLE FOR x IN embedding] AS s, list_sort([x::DOUBLE FOR x IN embedding]) AS q FROM embeddings)"
MEAN, SD = "list_avg({0})", "(CASE WHEN list_min({0}) = list_max({0}) THEN 0 ELSE sqrt(list_avg([(zz - list_avg({0})) * (zz - list_avg({0})) FOR zz IN {0}])) END)"


# --- ingest ---------------------------------------------------------------
@query("w2_assign", BASE + "SELECT symbol, label::INTEGER AS label, count(*) AS n, " + r("sum(nearest)", 4) + " AS distance FROM lab GROUP BY ALL")
def w2_assign(spark, d):
    return P.labelled(spark, d).groupBy("symbol", "label").agg(F.count("*").alias("n"), rnd(F.sum("nearest"), 4).alias("distance"))


@query("ingest_bad_prices", "SELECT c_custkey AS id, c_acctbal AS price FROM customer WHERE c_acctbal IS NULL OR isnan(c_acctbal) OR c_acctbal <= 0")
def ingest_bad_prices(spark, d):
    return ingest.bad_prices(P.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("price")))


@query("ingest_fingerprint", f"""SELECT c_nationkey, count(*) AS n, {" || ".join(f"lpad(to_hex((sum(('0x' || substr(md5(c_custkey || '|' || coalesce((c_acctbal * 100)::BIGINT::VARCHAR, '~')), {at}, 13))::HUGEINT) % {1 << 52})::BIGINT), 13, '0')" for at in (1, 14))} AS fingerprint
  FROM customer GROUP BY c_nationkey""".replace("to_hex(", "lower(to_hex(").replace("::BIGINT), 13", "::BIGINT)), 13"))
def ingest_fingerprint(spark, d):
    return ingest.fingerprint(P.table(spark, d, "customer"), ["c_nationkey"], [F.col("c_custkey"), F.round(F.col("c_acctbal") * 100).cast("long")])


@query("ingest_duplicate_sessions", "SELECT l_returnflag AS symbol, l_shipdate::DATE AS session_date, count(*) AS n, min(l_extendedprice) <> max(l_extendedprice) AS conflicting FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def ingest_duplicate_sessions(spark, d):
    rows = P.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.to_date("l_shipdate").alias("session_date"), F.col("l_extendedprice").alias("price"))
    return ingest.duplicate_sessions(rows)


@query("ingest_off_calendar", "SELECT o_orderdate::DATE AS session_date, 'orders' AS symbol, " + r("ln(avg(o_totalprice))") + " AS log_price FROM orders WHERE dayofweek(o_orderdate) <> 1 GROUP BY 1")
def ingest_off_calendar(spark, d):
    return ingest.off_calendar(P.daily_prices(spark, d), P.weekly_calendar(spark)).select("session_date", "symbol", rnd(F.ln("price")).alias("log_price"))


@query("ingest_calendar_reindex", f"WITH {RET} SELECT symbol, session_date, {r('ln(price)')} AS log_price FROM spine")
def ingest_calendar_reindex(spark, d):
    return ingest.on_calendar(P.weekly_prices(spark, d), P.weekly_calendar(spark)).select("symbol", "session_date", rnd(F.ln("price")).alias("log_price"))


@query("ingest_log_returns", f"WITH {RET} SELECT symbol, idx, session_date, {r('log_return')} AS log_return, available_at, price_start, price_end FROM ret")
def ingest_log_returns(spark, d):
    return P.weekly_returns(spark, d).withColumn("log_return", rnd("log_return"))


DAILY = f"""days AS (SELECT o_orderdate::DATE AS session_date, avg(o_totalprice) AS price FROM orders GROUP BY 1),
full_ AS (SELECT t.d::DATE AS session_date, price FROM generate_series((SELECT min(session_date) FROM days)::TIMESTAMP, (SELECT max(session_date) FROM days)::TIMESTAMP, INTERVAL 1 DAY) t(d) LEFT JOIN days ON days.session_date = t.d::DATE),
dret AS (SELECT 'orders' AS symbol, row_number() OVER w - 2 AS idx, session_date, price, ln(price) - lag(ln(price)) OVER w AS log_return, lag(session_date) OVER w AS price_start, session_date AS price_end, session_date::TIMESTAMP + INTERVAL 21 HOUR + INTERVAL 1 MINUTE AS available_at FROM full_ WINDOW w AS (ORDER BY session_date))"""


def daily_calendar(spark):
    return calendar.regular(spark, *P.WEEKS)


@query("ingest_quality_summary", f"""WITH {DAILY} SELECT 'orders' AS symbol, 'daily' AS calendar, count(price) AS observed_sessions, count(*) AS expected_sessions, count(*) - count(price) AS missing_sessions,
  count(*) FILTER (WHERE idx >= 0 AND log_return IS NULL) AS invalid_returns, 1 AS availability_lag_minutes, false AS point_in_time FROM dret""")
def ingest_quality_summary(spark, d):
    return ingest.quality_summary(P.daily_prices(spark, d), daily_calendar(spark), "daily")


@query("ingest_common_history", f"""WITH {RET}, c AS (SELECT max(lo) AS common_start, least(min(hi), DATE '2000-06-30') AS common_end FROM (SELECT symbol, min(session_date) AS lo, max(session_date) AS hi FROM ret GROUP BY symbol))
  SELECT symbol, idx, session_date, common_start, common_end FROM ret, c WHERE session_date BETWEEN common_start AND common_end""")
def ingest_common_history(spark, d):
    return ingest.common_history(P.weekly_returns(spark, d), "2000-06-30").select("symbol", "idx", "session_date", "common_start", "common_end")


@query("ingest_crop", f"WITH {RET} SELECT symbol, idx, session_date FROM ret WHERE session_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def ingest_crop(spark, d):
    return ingest.crop(P.weekly_returns(spark, d), "1996-01-01", "1996-12-31").select("symbol", "idx", "session_date")


def _nth_sql(month: int, weekday: int, n: int) -> str:
    """The n-th (last: -1) weekday (0: Monday) of a month of year y, as DuckDB SQL."""
    if n > 0:
        first = f"make_date(y, {month}, 1)"
        return f"({first} + ((({weekday} - (isodow({first}) - 1)) % 7 + 7) % 7 + {7 * (n - 1)})::INTEGER)"
    last = f"(make_date(y, {month + 1}, 1) - 1)"
    return f"({last} - (((isodow({last}) - 1 - {weekday}) % 7 + 7) % 7)::INTEGER)"


def _observed_sql(d: str) -> str:
    return f"({d} + (CASE isodow({d}) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END))"


_CLOSED = [
    (_nth_sql(1, 0, 3), "y >= 1998"), (_nth_sql(2, 0, 3), "true"), (_nth_sql(5, 0, -1), "true"), (_observed_sql("make_date(y, 6, 19)"), "y >= 2022"), (_observed_sql("make_date(y, 7, 4)"), "true"),
    (_nth_sql(9, 0, 1), "true"), (_nth_sql(11, 3, 4), "true"), (_observed_sql("make_date(y, 12, 25)"), "true"), (_observed_sql("make_date(y, 1, 1)"), "isodow(make_date(y, 1, 1)) <> 6"), ("easter - 2", "true"),
]
#: Good Friday by the Gregorian computus, one quantity a step.
_EASTER = """e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM range(1993, 2027) t(y)),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS k FROM e2),
e4 AS (SELECT *, (a + 11 * h + 22 * k) // 451 AS m FROM e3),
years AS (SELECT y::INTEGER AS y, make_date(y::INTEGER, ((h + k - 7 * m + 114) // 31)::INTEGER, ((h + k - 7 * m + 114) % 31 + 1)::INTEGER) AS easter FROM e4)"""
_CALENDAR = f"""WITH {_EASTER}, closed AS ({" UNION ".join(f"SELECT {d} AS d FROM years WHERE {ok}" for d, ok in _CLOSED)} UNION SELECT unnest([{", ".join(f"DATE '{x}'" for x in calendar.SINGLE_CLOSURES)}])),
days AS (SELECT t.d::DATE AS d, year(t.d)::INTEGER AS y FROM generate_series(TIMESTAMP '1993-01-01', TIMESTAMP '2026-12-31', INTERVAL 1 DAY) t(d)),
open AS (SELECT d, y, d = {_nth_sql(11, 3, 4)} + 1 OR (month(d) = 12 AND day(d) = 24 AND isodow(d) < 5) OR (month(d) = 7 AND day(d) = 3 AND isodow(d) < 5) AS early,
  CASE WHEN y >= 2007 THEN d >= {_nth_sql(3, 6, 2)} AND d < {_nth_sql(11, 6, 1)} ELSE d >= {_nth_sql(4, 6, 1)} AND d < {_nth_sql(10, 6, -1)} END AS summer
  FROM days WHERE isodow(d) < 6 AND d NOT IN (SELECT d FROM closed))
SELECT row_number() OVER (ORDER BY d) - 1 AS session_no, d AS session_date, d::TIMESTAMP + to_hours((CASE WHEN early THEN 13 ELSE 16 END + CASE WHEN summer THEN 4 ELSE 5 END)::INTEGER) AS close_utc FROM open"""


@query("session_calendar", _CALENDAR)
def session_calendar(spark, d):
    return calendar.new_york(spark, "1993-01-01", "2026-12-31")


# --- windows --------------------------------------------------------------
WIN_OUT = f"symbol, endpoint, start_idx, session_date, available_at, price_start, price_end, {r('list_sum(sample)')} AS total, {r('sample[1]')} AS first_atom, {r('list_max(sample)')} AS top"


def win_out(w):
    return w.select("symbol", "endpoint", "start_idx", "session_date", "available_at", "price_start", "price_end", rnd(D.total(F.col("sample"))).alias("total"), rnd(F.col("sample")[0]).alias("first_atom"), rnd(F.array_max("sample")).alias("top"))


@query("windows_weekly", f"WITH {RET}, {win(L, 4)} SELECT {WIN_OUT} FROM win")
def windows_weekly(spark, d):
    return win_out(P.weekly_windows(spark, d, L, 4))


@query("windows_gap_aware", f"WITH {DAILY}, {win(5, 2, '(SELECT * FROM dret WHERE idx >= 0)')} SELECT {WIN_OUT} FROM win")
def windows_gap_aware(spark, d):
    return win_out(windows.windows(ingest.log_returns(P.daily_prices(spark, d), daily_calendar(spark)), 5, 2))


@query("windows_ticks", f"WITH {TICK}, {win(63, 1, 'tick')} SELECT symbol, count(*) AS n, {r('sum(list_max(sample))', 4)} AS tops, {r('sum(list_sum(sample))', 3)} AS totals FROM win GROUP BY symbol")
def windows_ticks(spark, d):
    w = windows.windows(P.ticks(spark, d), 63)
    return w.groupBy("symbol").agg(F.count("*").alias("n"), rnd(F.sum(F.array_max("sample")), 4).alias("tops"), rnd(F.sum(D.total(F.col("sample"))), 3).alias("totals"))


VALUES_SQL = "vals AS (SELECT event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx, value FROM events)"


def event_values(spark, d):
    """(symbol, idx, value): finite values of events by type."""
    rows = P.table(spark, d, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", "value")
    return windows.dense_index(rows, ["symbol"], ["ts", "event_id"], F.unix_date(F.to_date("ts"))).select("symbol", "idx", "value")


@query("windows_rolling", f"WITH {VALUES_SQL} SELECT symbol, endpoint, {r('list_sum(s)')} AS total, {r('s[1]')} AS first_atom FROM (SELECT symbol, idx AS endpoint, list(value) OVER w AS s FROM vals WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE len(s) = 10 AND (endpoint - 9) % 5 = 0")
def windows_rolling(spark, d):
    w = windows.rolling(event_values(spark, d), 10, 5, value="value")
    return w.select("symbol", "endpoint", rnd(D.total(F.col("sample"))).alias("total"), rnd(F.col("sample")[0]).alias("first_atom"))


@query("windows_segments", f"WITH {VALUES_SQL} SELECT symbol, part, endpoint, {r('list_sum([x[1] FOR x IN s])')} AS total, {r('list_max([x[2] FOR x IN s])')} AS top FROM (SELECT symbol, idx // 100 AS part, idx AS endpoint, list([value, value * value]) OVER w AS s FROM vals WINDOW w AS (PARTITION BY symbol, idx // 100 ORDER BY idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) WHERE len(s) = 8 AND (endpoint - 7) % 3 = 0")
def windows_segments(spark, d):
    """Windows of vectors that stay inside their segment of 100 rows."""
    rows = event_values(spark, d).select("symbol", F.floor(F.col("idx") / 100).alias("part"), "idx", F.array("value", F.col("value") * F.col("value")).alias("x"))
    w = windows.return_windows(rows, 8, 3, ["symbol", "part"])
    return w.select("symbol", "part", "endpoint", rnd(D.total(F.transform("sample", lambda x: x[0]))).alias("total"), rnd(F.array_max(F.transform("sample", lambda x: x[1]))).alias("top"))


JOINT = """com AS (SELECT max(lo) AS a, min(hi) AS b FROM (SELECT symbol, min(session_date) AS lo, max(session_date) AS hi FROM ret GROUP BY symbol)),
panel AS (SELECT datediff('day', a, session_date) // 7 AS idx, session_date, max(available_at) AS available_at, min(price_start) AS price_start, max(log_return) FILTER (WHERE symbol = 'N') AS n, max(log_return) FILTER (WHERE symbol = 'A') AS a_, max(log_return) FILTER (WHERE symbol = 'R') AS r_
  FROM ret, com WHERE session_date BETWEEN a AND b GROUP BY 1, 2),"""
JWIN = JOINT + f"""
jw AS (SELECT * FROM (SELECT idx AS endpoint, session_date, max(available_at) OVER w AS available_at, first(price_start) OVER w AS price_start, list([n, a_, r_]) OVER w AS sample, count(n + a_ + r_) OVER w AS c
  FROM panel WINDOW w AS (ORDER BY idx ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW)) WHERE c = {L})"""


@query("windows_joint", f"WITH {RET}, {JWIN} SELECT endpoint, session_date, available_at, price_start, {r('list_sum([x[1] FOR x IN sample])')} AS n_total, {r('list_sum([x[3] FOR x IN sample])')} AS r_total FROM jw")
def windows_joint(spark, d):
    w = windows.joint_windows(P.weekly_panel(spark, d), L)
    col = lambda i: rnd(D.total(F.transform("sample", lambda x: x[i])))
    return w.select("endpoint", "session_date", "available_at", "price_start", col(0).alias("n_total"), col(2).alias("r_total"))


TRUTH = f"t AS (SELECT *, (year(session_date) - 1994) % 2 AS truth FROM ret)"


@query("windows_truth", f"WITH {RET}, {TRUTH} SELECT symbol, endpoint, truth, pure FROM (SELECT symbol, idx AS endpoint, truth, min(truth) OVER w = max(truth) OVER w AS pure, count(*) OVER w AS c FROM t WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW)) WHERE c = {L}")
def windows_truth(spark, d):
    t = P.weekly_returns(spark, d).withColumn("truth", ((F.year("session_date") - 1994) % 2).cast("long"))
    return windows.truth_windows(t, L)


@query("windows_pure_state", f"""WITH {RET}, t AS (SELECT *, CASE WHEN year(session_date) % 2 = 0 THEN 0.2::DOUBLE ELSE 0.8::DOUBLE END AS rho FROM ret)
  SELECT symbol, endpoint, (CASE WHEN lo = hi AND lo < 0.5 THEN 0 WHEN lo = hi THEN 1 ELSE -1 END)::INTEGER AS state FROM (SELECT symbol, idx AS endpoint, min(rho) OVER w AS lo, max(rho) OVER w AS hi, count(*) OVER w AS c FROM t WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW)) WHERE c = {L}""")
def windows_pure_state(spark, d):
    t = P.weekly_returns(spark, d).withColumn("rho", F.when(F.year("session_date") % 2 == 0, 0.2).otherwise(0.8))
    return windows.pure_state(t, L, 0.2, 0.8)


@query("windows_non_overlapping", f"""WITH RECURSIVE {DAILY}, {win(3, 1, '(SELECT * FROM dret WHERE idx >= 0)')}, pick(endpoint) AS (
  SELECT min(endpoint) FROM win UNION ALL SELECT (SELECT min(endpoint) FROM win WHERE win.endpoint - pick.endpoint > 3) FROM pick WHERE pick.endpoint IS NOT NULL)
  SELECT 'orders' AS symbol, endpoint FROM pick WHERE endpoint IS NOT NULL""")
def windows_non_overlapping(spark, d):
    w = windows.windows(ingest.log_returns(P.daily_prices(spark, d), daily_calendar(spark)), 3)
    return windows.non_overlapping(w, 3).select("symbol", "endpoint")


@query("windows_seam", f"""WITH {RET}, t AS (SELECT *, idx % 17 = 0 AS seam FROM ret)
  SELECT symbol, endpoint, crosses FROM (SELECT symbol, idx AS endpoint, count(*) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS c, (sum(seam::INT) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) > 0 AS crosses FROM t) WHERE c = 9""")
def windows_seam(spark, d):
    return windows.seam_windows(P.weekly_returns(spark, d).withColumn("seam", F.col("idx") % 17 == 0), 9)


def drawdown_sql(x: str) -> str:
    cum = f"[list_sum({x}[1:i]) FOR i IN range(1, len({x}) + 1)]"
    return f"(CASE WHEN {x} IS NOT NULL THEN 1 - exp(-greatest(0, list_max([greatest(0, list_max({cum}[1:i])) - {cum}[i] FOR i IN range(1, len({x}) + 1)]))) END)"


@query("future_outcomes", f"""WITH {RET}, f AS (SELECT symbol, idx, CASE WHEN count(log_return) OVER w = 4 THEN list(log_return) OVER w END AS a FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))
  SELECT symbol, idx, {r('list_sum(a)')} AS future_return, {r(f"{SD.format('a')} * sqrt(252)")} AS future_volatility, {r(drawdown_sql('a'))} AS future_drawdown, {r('sqrt(list_avg([least(x, 0) * least(x, 0) FOR x IN a])) * sqrt(252)')} AS future_downside FROM f""")
def future_outcomes(spark, d):
    f = windows.future(P.weekly_returns(spark, d), 4)
    return f.select("symbol", "idx", *[rnd(c).alias(c) for c in f.columns[2:]])


# --- splits ---------------------------------------------------------------
def split_sql(strict: bool) -> str:
    v, t = (" AND price_start > tl", " AND price_start > vl") if strict else ("", "")
    return f"""WITH {RET}, {win()}, edge AS (SELECT max(session_date) FILTER (WHERE session_date <= DATE '{TRAIN}') AS tl, max(session_date) FILTER (WHERE session_date <= DATE '{VALID}') AS vl FROM win)
  SELECT symbol, endpoint, CASE WHEN session_date <= DATE '{TRAIN}' THEN 'train' WHEN session_date <= DATE '{VALID}'{v} THEN 'validation' WHEN session_date > DATE '{VALID}' AND session_date <= DATE '{TEST}'{t} THEN 'test' END AS split FROM win, edge"""


@query("split_strict", split_sql(True))
def split_strict(spark, d):
    return splits.split(P.weekly_windows(spark, d), TRAIN, VALID, TEST).select("symbol", "endpoint", "split")


@query("split_operational", split_sql(False))
def split_operational(spark, d):
    return splits.split(P.weekly_windows(spark, d), TRAIN, VALID, TEST, strict=False).select("symbol", "endpoint", "split")


@query("split_fit_stride", f"WITH {RET}, {win()} SELECT symbol, endpoint FROM (SELECT symbol, endpoint, row_number() OVER (PARTITION BY symbol ORDER BY endpoint) - 1 AS n FROM win WHERE session_date <= DATE '{TRAIN}') WHERE n % 5 = 0")
def split_fit_stride(spark, d):
    return splits.every(P.weekly_windows(spark, d).filter(F.col("session_date") <= F.lit(TRAIN).cast("date")), 5, keys=("symbol",)).select("symbol", "endpoint")


@query("split_folds", " UNION ALL ".join(f"SELECT {y}::BIGINT AS year, {v}::BIGINT AS validation_years, make_date({y} - {v} - 1, 12, 31) AS train_end, make_date({y} - 1, 12, 31) AS validation_end, make_date({y}, 12, 31) AS test_end" for y in range(1998, 2002) for v in (1, 2)))
def split_folds(spark, d):
    rows = [(y, v, *splits.fold(y, v)) for y in range(1998, 2002) for v in (1, 2)]
    made = spark.createDataFrame(rows, "year long, validation_years long, a string, b string, c string")
    return made.select("year", "validation_years", F.to_date("a").alias("train_end"), F.to_date("b").alias("validation_end"), F.to_date("c").alias("test_end"))


ASOF = "2000-06-30 00:00:00"


@query("score_as_of", f"WITH {RET}, {win()} SELECT symbol, endpoint FROM win WHERE NOT price_start <= DATE '{TRAIN}' AND NOT available_at > TIMESTAMP '{ASOF}'")
def score_as_of(spark, d):
    return splits.as_of(P.weekly_windows(spark, d), TRAIN, ASOF)[0].select("symbol", "endpoint")


@query("score_as_of_counts", f"""WITH {RET}, {win()} SELECT count(*) AS windows, count(*) FILTER (WHERE price_start <= DATE '{TRAIN}') AS overlap_training,
  count(*) FILTER (WHERE price_start > DATE '{TRAIN}' AND available_at > TIMESTAMP '{ASOF}') AS not_available, count(*) FILTER (WHERE price_start > DATE '{TRAIN}' AND available_at <= TIMESTAMP '{ASOF}') AS scored FROM win""")
def score_as_of_counts(spark, d):
    return splits.as_of(P.weekly_windows(spark, d), TRAIN, ASOF)[1]


@query("risk_origin_counts", f"""WITH {RET} SELECT CASE WHEN price_start <= DATE '{TRAIN}' THEN 'overlap' WHEN available_at > TIMESTAMP '{ASOF}' THEN 'not_available' WHEN idx < 160 THEN 'not_warm' ELSE 'scored' END AS reason, count(*) AS n
  FROM ret WHERE session_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' GROUP BY 1""")
def risk_origin_counts(spark, d):
    return splits.risk_origins(P.weekly_returns(spark, d), "1997-01-01", "2000-12-31", TRAIN, ASOF, 160)[1]


# --- distances ------------------------------------------------------------
def sample_pairs(spark, d):
    """Each vector with the one of the next id."""
    a = P.samples(spark, d)
    b = a.select((F.col("id") - 1).alias("id"), F.col("sample").alias("other"))
    return a.join(b, "id")


PAIRS = f"WITH {SAMPLES}, p AS (SELECT a.id, a.s AS s, b.s AS t, a.q AS x, b.q AS y FROM e a JOIN e b ON b.id = a.id + 1)"


@query("wasserstein_pairs", PAIRS + f" SELECT id, {r('list_avg([abs(x[i] - y[i]) FOR i IN range(1, len(x) + 1)])')} AS w1, {r('list_distance(x, y) / sqrt(len(x))')} AS w2 FROM p")
def wasserstein_pairs(spark, d):
    return sample_pairs(spark, d).select("id", rnd(D.wasserstein(F.col("sample"), F.col("other"), 1)).alias("w1"), rnd(D.wasserstein(F.col("sample"), F.col("other"), 2)).alias("w2"))


@query("w2_decomposition", PAIRS + f""", m AS (SELECT id, {MEAN.format('x')} AS mx, {MEAN.format('y')} AS my, {SD.format('x')} AS sx, {SD.format('y')} AS sy, x, y FROM p),
  c AS (SELECT *, greatest(-1, least(1, list_avg([(x[i] - mx) * (y[i] - my) FOR i IN range(1, len(x) + 1)]) / (sx * sy))) AS rho FROM m)
  SELECT id, {r('(mx - my) ** 2')} AS location, {r('(sx - sy) ** 2')} AS scale, {r('greatest(0, 2 * sx * sy * (1 - rho))')} AS shape, {r('(mx - my) ** 2 + (sx - sy) ** 2 + greatest(0, 2 * sx * sy * (1 - rho))')} AS total FROM c""")
def w2_decomposition(spark, d):
    made = sample_pairs(spark, d).select("id", D.w2_parts(F.col("sample"), F.col("other")).alias("p"))
    return made.select("id", *[rnd(f"p.{c}").alias(c) for c in ("location", "scale", "shape", "total")])


@query("component_fractions", PAIRS + f""", m AS (SELECT {MEAN.format('x')} AS mx, {MEAN.format('y')} AS my, {SD.format('x')} AS sx, {SD.format('y')} AS sy, x, y FROM p),
  c AS (SELECT (mx - my) ** 2 AS lo, (sx - sy) ** 2 AS sc, 2 * (sx * sy - list_avg([(x[i] - mx) * (y[i] - my) FOR i IN range(1, len(x) + 1)])) AS sh FROM m)
  SELECT {r('sum(lo) / sum(lo + sc + sh)')} AS location, {r('sum(sc) / sum(lo + sc + sh)')} AS scale, {r('sum(sh) / sum(lo + sc + sh)')} AS shape FROM c""")
def component_fractions(spark, d):
    parts = sample_pairs(spark, d).select(D.w2_parts(F.col("sample"), F.col("other")).alias("p")).select("p.*")
    got = evaluate.component_fractions(parts)
    return got.select(*[rnd(c).alias(c) for c in got.columns])


@query("distance_matrix", f"WITH {SAMPLES}, c AS (SELECT id AS k, q AS y FROM e WHERE id < 4) SELECT id, k, {r('list_avg([abs(q[i] - y[i]) FOR i IN range(1, len(q) + 1)])')} AS w1, {r('list_distance(q, y) / sqrt(len(q))')} AS w2 FROM e, c")
def distance_matrix(spark, d):
    e = P.samples(spark, d).select("id", "sample")
    c = np.array([x["sample"] for x in e.filter("id < 4").orderBy("id").collect()])  # four centers
    made = geometry.distances(geometry.distances(e, c, 1).select("id", "sample", F.col("distance").alias("d1")), c, 2)
    made = made.select("id", F.posexplode(F.arrays_zip("d1", F.col("distance").alias("d2"))).alias("k", "x"))
    return made.select("id", F.col("k").cast("long").alias("k"), rnd("x.d1").alias("w1"), rnd("x.d2").alias("w2"))


def barycenter_sql(how: str) -> str:
    return f"WITH {SAMPLES}, a AS (SELECT truth, i, q[i] AS x FROM (SELECT truth, q, unnest(range(1, len(q) + 1)) AS i FROM e)) SELECT truth, (i - 1)::INTEGER AS pos, {r(how + '(x)')} AS x FROM a GROUP BY truth, i"


def barycenter(spark, d, p):
    made = geometry.barycenters(P.samples(spark, d), p, "truth").select("truth", F.posexplode("center").alias("pos", "x"))
    return made.select("truth", "pos", rnd("x").alias("x"))


@query("barycenter_w2", barycenter_sql("avg"))
def barycenter_w2(spark, d):
    return barycenter(spark, d, 2)


@query("barycenter_w1", barycenter_sql("median"))
def barycenter_w1(spark, d):
    return barycenter(spark, d, 1)


@query("standardize", f"WITH {RET}, {win()}, z AS (SELECT symbol, endpoint, [CASE WHEN list_min(sample) = list_max(sample) THEN 0 ELSE (v - {MEAN.format('sample')}) / {SD.format('sample')} END FOR v IN sample] AS z FROM win) SELECT symbol, endpoint, {r('z[1]')} AS first_z, {r(f'z[{L}]')} AS last_z, {r('list_max(z)')} AS top_z FROM z")
def standardize(spark, d):
    z = P.weekly_windows(spark, d).select("symbol", "endpoint", D.standardize(F.col("sample")).alias("z"))
    return z.select("symbol", "endpoint", rnd(F.element_at("z", 1)).alias("first_z"), rnd(F.element_at("z", -1)).alias("last_z"), rnd(F.array_max("z")).alias("top_z"))


@query("constant_rows", f"""WITH {SAMPLES}, x AS (SELECT id, CASE WHEN id % 7 = 0 THEN [s[1] FOR v IN s] ELSE s END AS s FROM e)
  SELECT id, list_min(s) = list_max(s) AS is_constant, {r(SD.format('s'))} AS sd, {r('CASE WHEN list_min(s) = list_max(s) THEN 0 ELSE list_max([(v - list_avg(s)) / ' + SD.format('s') + ' FOR v IN s]) END')} AS top_z FROM x""")
def constant_rows(spark, d):
    """Every seventh vector is one number repeated."""
    x = F.col("sample")
    e = P.samples(spark, d).select("id", F.when(F.col("id") % 7 == 0, F.transform(x, lambda _: x[0])).otherwise(x).alias("x"))
    return e.select("id", D.is_constant(F.col("x")).alias("is_constant"), rnd(D.sd(F.col("x"))).alias("sd"), rnd(F.array_max(D.standardize(F.col("x")))).alias("top_z"))


@query("asset_scales", f"WITH {RET} SELECT symbol, {r('stddev_pop(log_return)')} AS scale FROM ret WHERE session_date <= DATE '{TRAIN}' GROUP BY symbol")
def asset_scales(spark, d):
    return geometry.asset_scales(P.weekly_returns(spark, d).filter(F.col("session_date") <= F.lit(TRAIN).cast("date"))).select("symbol", rnd("scale").alias("scale"))


DIRECTIONS = geometry.unit_directions(4, 3, 7)
_DIR_SQL = ", ".join("({}, [{}])".format(i, ", ".join(f"{x!r}::DOUBLE" for x in map(float, v))) for i, v in enumerate(DIRECTIONS))


@query("sliced_w2", f"""WITH {RET}, {JWIN}, dirs(k, u) AS (VALUES {_DIR_SQL}),
  pr AS (SELECT endpoint, k, list_sort([(x[1] * u[1] + x[2] * u[2] + x[3] * u[3]) / 0.05::DOUBLE FOR x IN sample]) AS z FROM jw, dirs),
  c AS (SELECT endpoint AS e, k, z AS y FROM pr WHERE endpoint IN {P.CENTER_ENDPOINTS})
  SELECT endpoint, e AS center, {r(f'sqrt(sum(list_distance(z, y) ** 2) / {4 * L}.0::DOUBLE)')} AS distance FROM pr JOIN c USING (k) GROUP BY endpoint, e""")
def sliced_w2(spark, d):
    w = windows.joint_windows(P.weekly_panel(spark, d), L).select("endpoint", "sample")
    c = w.filter(F.col("endpoint").isin(*P.CENTER_ENDPOINTS)).orderBy("endpoint").collect()  # three centers
    made = geometry.sliced_w2(w, np.array([x["sample"] for x in c]), DIRECTIONS, np.full(3, 0.05))
    ends = F.array(*[F.lit(x["endpoint"]) for x in c])
    made = made.select("endpoint", F.posexplode("distance").alias("k", "x"))
    return made.select("endpoint", F.element_at(ends, F.col("k") + 1).cast("long").alias("center"), rnd("x").alias("distance"))


@query("exact_moment_laws", f"""WITH a AS (SELECT list(v ORDER BY v) AS x FROM (SELECT v, unnest(range(50 + 3 * c)) FROM (VALUES (0, 1), (1, -5), (2, 10), (3, -10), (4, 5), (5, -1)) t(v, c))),
  b AS (SELECT list(v ORDER BY v) AS y FROM (SELECT v, unnest(range(50 - 3 * c)) FROM (VALUES (0, 1), (1, -5), (2, 10), (3, -10), (4, 5), (5, -1)) t(v, c)))
  SELECT len(x)::INTEGER AS n, {r('list_avg(x)')} AS mean, {r('sqrt(list_avg([(x[i] - y[i]) ** 2 FOR i IN range(1, 301)]))')} AS w2 FROM a, b""")
def exact_moment_laws(spark, d):
    a, b = synthetic.exact_moment_laws()
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    return df.select(F.size("a").alias("n"), rnd(D.mean(F.col("a"))).alias("mean"), rnd(D.wasserstein(F.col("a"), F.col("b"))).alias("w2"))


# --- features -------------------------------------------------------------
_Q = lambda p: f"(q[floor({p} * (len(q) - 1))::INT + 1] + ({p}::DOUBLE * (len(q) - 1) - floor({p} * (len(q) - 1))) * (q[least(floor({p} * (len(q) - 1))::INT + 2, len(q))] - q[floor({p} * (len(q) - 1))::INT + 1]))"


@query("window_features", f"""WITH {RET}, {win(L, 2)}, m AS (SELECT symbol, endpoint, sample, q, {MEAN.format('sample')} AS m, {SD.format('sample')} AS s FROM win)
  SELECT symbol, endpoint, {r('m')} AS mean, {r('s')} AS sd, {r('list_avg([((v - m) / s) ** 3 FOR v IN sample])')} AS skewness, {r('list_avg([((v - m) / s) ** 4 FOR v IN sample]) - 3')} AS kurtosis,
  {', '.join(f"{r(_Q(p))} AS q{i}" for i, p in enumerate(D.QUANTILES))}, {r('sqrt(list_avg([least(v, 0) ** 2 FOR v IN sample]))')} AS downside, {r(drawdown_sql('sample'))} AS drawdown FROM m""")
def window_features(spark, d):
    names = ["mean", "sd", "skewness", "kurtosis", *[f"q{i}" for i in range(9)], "downside", "drawdown"]
    f = P.weekly_windows(spark, d, L, 2).select("symbol", "endpoint", D.features(F.col("sample")).alias("f"))
    return f.select("symbol", "endpoint", *[rnd(F.col("f")[i]).alias(n) for i, n in enumerate(names)])


def _cov(i, j):
    return f"(list_avg([x[{i}] * x[{j}] FOR x IN sample]) - list_avg([x[{i}] FOR x IN sample]) * list_avg([x[{j}] FOR x IN sample]))"


@query("panel_features", f"""WITH {RET}, {JWIN} SELECT endpoint, {', '.join(f"{r(_cov(i, j), 8)} AS c{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)},
  {', '.join(f"{r(f'greatest(-1, least(1, {_cov(i, j)} / sqrt({_cov(i, i)} * {_cov(j, j)})))')} AS r{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i < j)} FROM jw""")
def panel_features(spark, d):
    w = windows.joint_windows(P.weekly_panel(spark, d), L).select("endpoint", "sample")
    one = geometry.T.StructField("f", geometry.ARRAY)

    def fn(x):
        z = x.reshape(len(x), L, 3)
        return [geometry.list_column(np.hstack([geometry.panel_features(z, "covariance"), geometry.panel_features(z, "correlation")]))]

    names = ["c11", "c12", "c13", "c22", "c23", "c33", "r12", "r13", "r23"]
    f = geometry.with_arrays(w, "sample", [one], fn, ["endpoint"], inner=2)
    return f.select("endpoint", *[rnd(F.col("f")[i], 8 if n[0] == "c" else 6).alias(n) for i, n in enumerate(names)])


# --- evaluation -----------------------------------------------------------
@query("assign_weekly", BASE + f"SELECT symbol, endpoint, label::INTEGER AS label, {r('nearest')} AS nearest, {r('list_sort(d)[2]')} AS second, {r('CASE WHEN list_sort(d)[2] = 0 THEN 0 ELSE (list_sort(d)[2] - nearest) / list_sort(d)[2] END')} AS margin FROM lab")
def assign_weekly(spark, d):
    got = P.labelled(spark, d).select("symbol", "endpoint", "label", D.novelty(F.col("distance")).alias("v"))
    return got.select("symbol", "endpoint", "label", rnd("v.nearest").alias("nearest"), rnd("v.second").alias("second"), rnd("v.margin").alias("margin"))


@query("novelty_percentile", BASE + f", cal2 AS (SELECT nearest AS c FROM lab WHERE session_date <= DATE '{TRAIN}') SELECT symbol, endpoint, {r('(SELECT count(*) FROM cal2 WHERE c <= nearest) / (SELECT count(*) FROM cal2)')} AS percentile, (SELECT count(*) FROM cal2 WHERE c <= nearest) / (SELECT count(*) FROM cal2) >= 0.95 AS ood FROM lab")
def novelty_percentile(spark, d):
    got = P.labelled(spark, d).select("symbol", "endpoint", "session_date", "nearest")
    made = evaluate.percentiles(got, F.col("session_date") <= F.lit(TRAIN).cast("date"), 0.95)
    return made.select("symbol", "endpoint", rnd("percentile").alias("percentile"), "ood")


@query("novelty_quantile", BASE + f"SELECT symbol, endpoint, nearest > (SELECT quantile_cont(nearest, 0.99) FROM lab WHERE session_date <= DATE '{TRAIN}') AS novel FROM lab")
def novelty_quantile(spark, d):
    got = P.labelled(spark, d).select("symbol", "endpoint", "session_date", "nearest")
    return evaluate.over_quantile(got, got.filter(F.col("session_date") <= F.lit(TRAIN).cast("date"))).select("symbol", "endpoint", "novel")


STEPS = BASE + """, near AS (SELECT symbol, endpoint, label, lag(endpoint) OVER w AS pe, lag(label) OVER w AS pl FROM lab WINDOW w AS (PARTITION BY symbol ORDER BY endpoint)),
isl AS (SELECT *, sum(CASE WHEN pe IS NULL OR pe <> endpoint - 1 OR pl <> label THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY endpoint) AS run FROM near),
rn AS (SELECT symbol, run, any_value(label) AS label, count(*) AS length FROM isl GROUP BY symbol, run)"""


@query("temporal_summary", STEPS + f""" SELECT symbol, count(*) FILTER (WHERE pe = endpoint - 1) AS pairs, count(*) FILTER (WHERE pe = endpoint - 1 AND pl <> label) AS switches,
  {r('any_value((SELECT avg(length) FROM rn WHERE rn.symbol = near.symbol))')} AS mean_dwell, {r('any_value((SELECT median(length) FROM rn WHERE rn.symbol = near.symbol))')} AS median_dwell,
  {r('count(*) FILTER (WHERE pe = endpoint - 1 AND pl <> label) / count(*) FILTER (WHERE pe = endpoint - 1)')} AS switch_frequency FROM near GROUP BY symbol""")
def temporal_summary(spark, d):
    got = evaluate.temporal_summary(P.labelled(spark, d), ["symbol"], "endpoint")
    return got.select("symbol", "pairs", "switches", rnd("mean_dwell").alias("mean_dwell"), rnd("median_dwell").alias("median_dwell"), rnd("switch_frequency").alias("switch_frequency"))


@query("transition_matrix", STEPS + f" SELECT symbol, pl::INTEGER AS source, label::INTEGER AS target, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY symbol, pl)')} AS share FROM near WHERE pe = endpoint - 1 GROUP BY symbol, pl, label")
def transition_matrix(spark, d):
    return evaluate.transitions(P.labelled(spark, d), ["symbol"], "endpoint").withColumn("share", rnd("share"))


@query("dwell_runs", STEPS + " SELECT symbol, label::INTEGER AS label, length FROM rn")
def dwell_runs(spark, d):
    return evaluate.runs(P.labelled(spark, d), ["symbol"], "endpoint").select("symbol", "label", "length")


AGREE_V = """, n AS (SELECT a, b, count(*) AS n FROM ab GROUP BY a, b), i AS (SELECT a, sum(n) AS m FROM n GROUP BY a), j AS (SELECT b, sum(n) AS m FROM n GROUP BY b),
v AS (SELECT (SELECT sum(n) FROM n)::DOUBLE AS n, (SELECT sum(n * (n - 1) / 2) FROM n) AS ij, (SELECT sum(m * (m - 1) / 2) FROM i) AS si, (SELECT sum(m * (m - 1) / 2) FROM j) AS sj,
  (SELECT -sum(n / t * ln(n / t)) FROM n, (SELECT sum(n)::DOUBLE AS t FROM n)) AS hab, (SELECT -sum(m / t * ln(m / t)) FROM i, (SELECT sum(n)::DOUBLE AS t FROM n)) AS ha, (SELECT -sum(m / t * ln(m / t)) FROM j, (SELECT sum(n)::DOUBLE AS t FROM n)) AS hb)"""
_ARI = r("(ij - si * sj / (n * (n - 1) / 2)) / ((si + sj) / 2 - si * sj / (n * (n - 1) / 2))")
AGREE = AGREE_V + f" SELECT n::BIGINT AS n, {_ARI} AS ari, " + r("(ha + hb - hab) / ((ha + hb) / 2)") + " AS nmi FROM v"


@query("agreement_labels", "WITH ab AS (SELECT quality AS a, toxic AS b FROM labels)" + AGREE)
def agreement_labels(spark, d):
    return evaluate.agreement(P.table(spark, d, "labels"), "quality", "toxic").select("n", rnd("ari").alias("ari"), rnd("nmi").alias("nmi"))


@query("agreement_states", BASE + ", ab AS (SELECT year(session_date) % 2 AS a, label AS b FROM lab)" + AGREE)
def agreement_states(spark, d):
    got = P.labelled(spark, d).select((F.year("session_date") % 2).alias("a"), F.col("label").alias("b"))
    return evaluate.agreement(got, "a", "b").select("n", rnd("ari").alias("ari"), rnd("nmi").alias("nmi"))


@query("balanced_accuracy", f"SELECT {r('avg(x)')} AS balanced_accuracy, {r('min(x)')} AS least_recall FROM (SELECT avg((quality = toxic)::INT) AS x FROM labels GROUP BY quality)")
def balanced_accuracy(spark, d):
    return evaluate.balanced_accuracy(P.table(spark, d, "labels"), "quality", "toxic").select(rnd("balanced_accuracy").alias("balanced_accuracy"), rnd("least_recall").alias("least_recall"))


@query("label_mapping", """WITH n AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), p(x, y) AS (VALUES (0, 1), (1, 0)),
  g AS (SELECT x, y, coalesce(sum(n) FILTER (WHERE (b = 0 AND a = x) OR (b = 1 AND a = y)), 0) AS hits FROM p, n GROUP BY x, y), best AS (SELECT x, y FROM g ORDER BY hits DESC, x LIMIT 1)
  SELECT 0 AS predicted, x::INTEGER AS truth FROM best UNION ALL SELECT 1, y::INTEGER FROM best""")
def label_mapping(spark, d):
    order = evaluate.label_mapping(P.table(spark, d, "labels"), "quality", "toxic", 2)
    return spark.createDataFrame(list(enumerate(order)), "predicted int, truth int")


OTHER_ENDPOINTS = (340, 100, 25)
_OTHER = f"""oc AS (SELECT endpoint AS e, q AS c, list_position({list(OTHER_ENDPOINTS)}, endpoint) - 1 AS k FROM win WHERE symbol = '{P.CENTER_SYMBOL}' AND endpoint IN {OTHER_ENDPOINTS}),
pd AS (SELECT a.k AS i, b.k AS j, list_distance(a.c, b.c) / sqrt({L}.0::DOUBLE) AS d FROM oc a, centers b),
pm AS (SELECT a.j AS x, b.j AS y, c.j AS z, a.d + b.d + c.d AS total FROM pd a, pd b, pd c WHERE a.i = 0 AND b.i = 1 AND c.i = 2 AND a.j <> b.j AND b.j <> c.j AND a.j <> c.j), best AS (SELECT * FROM pm ORDER BY total, x, y LIMIT 1)"""


def other_centers(wins) -> np.ndarray:
    rows = {x["endpoint"]: x["sample"] for x in wins.filter((F.col("symbol") == P.CENTER_SYMBOL) & F.col("endpoint").isin(*OTHER_ENDPOINTS)).select("endpoint", "sample").collect()}  # three
    return np.sort(np.array([rows[e] for e in OTHER_ENDPOINTS]), axis=1)


@query("center_alignment", BASE + f", {_OTHER} SELECT unnest([0, 1, 2]) AS current, unnest([x, y, z])::INTEGER AS reference, {r('total')} AS total FROM best")
def center_alignment(spark, d):
    wins = P.weekly_windows(spark, d)
    old, new = P.centers(wins), other_centers(wins)
    order = evaluate.align_centers(old, new)
    total = float(sum(np.sqrt(((new[i] - old[j]) ** 2).mean()) for i, j in enumerate(order)))
    return spark.createDataFrame([(i, int(j), total) for i, j in enumerate(order)], "current int, reference int, total double").withColumn("total", rnd("total"))


@query("refit_comparison", BASE + f""", {_OTHER}, nd AS (SELECT symbol, endpoint, list(list_distance(q, c) ORDER BY k) AS d FROM win, oc GROUP BY ALL), ab AS (SELECT lab.label AS a, list_position(nd.d, list_min(nd.d)) - 1 AS b FROM lab JOIN nd USING (symbol, endpoint))
  {AGREE_V} SELECT n::BIGINT AS common, (SELECT count(DISTINCT a) FROM ab) AS previous_occupied, (SELECT count(DISTINCT b) FROM ab) AS current_occupied, {r('(SELECT total / 3 FROM best)')} AS displacement, {_ARI} AS ari FROM v""")
def refit_comparison(spark, d):
    wins = with_id(P.weekly_windows(spark, d))
    old, new = P.centers(wins), other_centers(wins)
    labels = [geometry.distances(wins, c, 2, keep=["id"]).select("id", "label") for c in (old, new)]
    got = evaluate.refit_comparison(*labels, old, new, "id")
    row = [(got["common"], got["previous_occupied"], got["current_occupied"], got["displacement"], got["ari"])]
    made = spark.createDataFrame(row, "common long, previous_occupied long, current_occupied long, displacement double, ari double")
    return made.withColumns({"displacement": rnd("displacement"), "ari": rnd("ari")})


@query("occupancy", BASE + "SELECT k::INTEGER AS label, count(label) AS n FROM range(5) t(k) LEFT JOIN lab ON label = k GROUP BY k")
def occupancy(spark, d):
    return evaluate.occupancy(P.labelled(spark, d), 5)


@query("silhouette", f"""WITH {SAMPLES}, s AS (SELECT * FROM e ORDER BY md5(id::VARCHAR) LIMIT 160), p AS (SELECT a.id, a.truth, b.truth AS other, avg(list_distance(a.s, b.s)) AS d FROM s a JOIN s b ON a.id <> b.id GROUP BY ALL),
  w AS (SELECT id, truth, max(d) FILTER (WHERE truth = other) AS own, min(d) FILTER (WHERE truth <> other) AS near FROM p GROUP BY ALL) SELECT id, truth AS label, {r('CASE WHEN own IS NULL THEN 0 ELSE (near - own) / greatest(own, near) END')} AS silhouette FROM w""")
def silhouette(spark, d):
    sample = P.samples(spark, d).orderBy(F.md5(F.col("id").cast("string").cast("binary"))).limit(160)  # the measure is of a bounded sample
    got = evaluate.silhouette_rows(sample.select("id", F.col("truth").alias("label"), "sample"))
    return got.select("id", "label", rnd("silhouette").alias("silhouette"))


def _kernel(p, q, h=BANDWIDTH):
    return f"list_avg([list_avg([exp(-0.5::DOUBLE * ((u - v) / {h}::DOUBLE) ** 2) FOR v IN {q}]) FOR u IN {p}])"


@query("mmd_pairs", PAIRS + f" SELECT id, {r('greatest(0, ' + _kernel('s', 's') + ' + ' + _kernel('t', 't') + ' - 2 * ' + _kernel('s', 't') + ')')} AS mmd2 FROM p")
def mmd_pairs(spark, d):
    return evaluate.with_mmd(sample_pairs(spark, d).select("id", "sample", "other"), "sample", "other", BANDWIDTH).select("id", rnd("mmd2").alias("mmd2"))


@query("mmd_adjacent", BASE.replace("WITH ", "WITH RECURSIVE ", 1) + f""", pick(symbol, endpoint) AS (SELECT symbol, min(endpoint) FROM lab GROUP BY symbol
  UNION ALL SELECT p.symbol, (SELECT min(l.endpoint) FROM lab l WHERE l.symbol = p.symbol AND l.endpoint - p.endpoint > {L}) FROM pick p WHERE p.endpoint IS NOT NULL),
  sel AS (SELECT symbol, label, sample AS s, lead(sample) OVER w AS t, lead(label) OVER w AS l2 FROM lab JOIN pick USING (symbol, endpoint) WINDOW w AS (PARTITION BY symbol ORDER BY endpoint))
  SELECT symbol, label = l2 AS same_label, count(*) AS pairs, {r("avg(greatest(0, " + _kernel("s", "s", 0.02) + " + " + _kernel("t", "t", 0.02) + " - 2 * " + _kernel("s", "t", 0.02) + "))")} AS mean_mmd2 FROM sel WHERE t IS NOT NULL GROUP BY ALL""")
def mmd_adjacent(spark, d):
    got = P.labelled(spark, d)
    return evaluate.adjacent_mmd(windows.non_overlapping(got, L), 0.02, ["symbol"]).withColumn("mean_mmd2", rnd("mean_mmd2"))


@query("within_between", BASE + f"""SELECT (SELECT {r('avg(nearest)')} FROM lab) AS within, {r(f'avg(list_distance(a.c, b.c) / sqrt({L}.0::DOUBLE))')} AS between_centers FROM centers a JOIN centers b ON a.k < b.k""")
def within_between(spark, d):
    wins = P.weekly_windows(spark, d)
    c = P.centers(wins)
    between = float(np.mean([np.sqrt(((c[i] - c[j]) ** 2).mean()) for i in range(len(c)) for j in range(i)])) if len(c) > 1 else None
    return geometry.distances(wins, c, 2).agg(rnd(F.avg("nearest")).alias("within")).withColumn("between_centers", rnd(F.lit(between)))


@query("state_profile", BASE + f", pf AS (SELECT label, {SD.format('sample')} AS s, {MEAN.format('sample')} AS m FROM lab) SELECT label::INTEGER AS label, count(*) AS n, {r('avg(s)')} AS sd, {r('avg(m)')} AS mean FROM pf GROUP BY label")
def state_profile(spark, d):
    got = P.labelled(spark, d).select("label", D.sd(F.col("sample")).alias("sd"), D.mean(F.col("sample")).alias("mean"))
    got = evaluate.state_profile(got, ["sd", "mean"])
    return got.select("label", "n", rnd("sd").alias("sd"), rnd("mean").alias("mean"))


@query("detection_delay", BASE + "SELECT symbol, min(endpoint) FILTER (WHERE endpoint >= 100 AND endpoint < 300 AND label = 1) - 100 AS delay, min(endpoint) FILTER (WHERE endpoint >= 100 AND endpoint < 300 AND label = 1) IS NULL AS censored FROM lab GROUP BY symbol")
def detection_delay(spark, d):
    return evaluate.detection_delay(P.labelled(spark, d), 100, 1, 300, ["symbol"])


@query("episode_delay", BASE + """, l2 AS (SELECT symbol, endpoint, label FROM lab WHERE endpoint >= 50 AND endpoint < 350), g AS (SELECT *, endpoint - row_number() OVER (PARTITION BY symbol, label ORDER BY endpoint) AS g FROM l2),
  h AS (SELECT symbol, min(endpoint) AS f FROM g WHERE label = 2 GROUP BY symbol, g HAVING count(*) >= 5)
  SELECT symbol, min(f) - 50 AS delay, min(f) - 50 + 4 AS confirmation_delay, min(f) IS NULL AS censored FROM (SELECT DISTINCT symbol FROM lab) LEFT JOIN h USING (symbol) GROUP BY symbol""")
def episode_delay(spark, d):
    return evaluate.episode_delay(P.labelled(spark, d), 2, 50, 350, keys=["symbol"])


@query("replicate_summary", f"SELECT event_type, count(value) AS n, {r('avg(value)')} AS mean, min(value) AS least, max(value) AS most, {r('stddev_samp(value) / sqrt(count(value))')} AS standard_error FROM events GROUP BY event_type")
def replicate_summary(spark, d):
    got = evaluate.replicate_summary(P.table(spark, d, "events"), ["event_type"], "value")
    return got.select("event_type", "n", rnd("mean").alias("mean"), "least", "most", rnd("standard_error").alias("standard_error"))


# --- estimators -----------------------------------------------------------
_UNIT = lambda seed: f"((('0x' || substr(md5('{seed}:' || id), 1, 13))::BIGINT + 0.5) / {2.0**52!r}::DOUBLE)"


def _lloyd_sql(e: str, k: int, steps: int, p: int = 2, seed: int | None = None) -> list[str]:
    """Lloyd on the table ``e`` (id, q), unrolled: from the rows of id below k, or by
    k-means++ draws of a seed; the last table is a{steps} (id, q, k, d)."""
    cost = "list_distance(q, c) ** 2 / len(q)" if p == 2 else "list_avg([abs(q[i] - c[i]) FOR i IN range(1, len(q) + 1)])"
    if seed is None:
        parts = [f"c0 AS (SELECT id AS k, q AS c FROM {e} WHERE id < {k})"]
    else:
        parts = [f"s0 AS (SELECT 0 AS k, arg_min(q, {{'u': {_UNIT(seed)}, 'id': id}}) AS c FROM {e})"]
        for i in range(1, k):
            far = f"SELECT id, any_value(q) AS q, min({cost}) AS d FROM {e}, s{i - 1} GROUP BY id"
            parts.append(f"s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT {i}, arg_min(q, {{'u': -ln({_UNIT(seed * 1000 + i)}) / d, 'id': id}}) FROM ({far}) WHERE d > 0)")
        parts.append(f"c0 AS (SELECT * FROM s{k - 1})")
    for t in range(steps + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT id, q, k, d FROM (SELECT id, q, k, {cost} AS d, row_number() OVER (PARTITION BY id ORDER BY {cost}, k) AS n FROM {e}, c{t}) WHERE n = 1)")
        if t < steps:
            parts.append(f"c{t + 1} AS (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, {'avg' if p == 2 else 'median'}(q[i]) AS x FROM (SELECT k, q, unnest(range(1, len(q) + 1)) AS i FROM a{t}) GROUP BY k, i) GROUP BY k)")
    return parts


@query("lloyd_explicit", f"WITH {', '.join([SAMPLES, *_lloyd_sql('e', 4, 3)])} SELECT k AS label, count(*) AS n, {r('sum(d)')} AS inertia FROM a3 GROUP BY k")
def lloyd_explicit(spark, d):
    e = P.samples(spark, d)
    q = lloyd.coordinates(e, "id").cache()
    start = np.array([x["q"] for x in q.filter("id < 4").orderBy("id").collect()])
    got = lloyd.fit(q, 4, 2, init=start, max_iter=3)
    q.unpersist()
    made = got.transform(e.select("id", "sample")).groupBy("label").agg(F.count("*").alias("n"), rnd(F.sum(F.col("nearest") * F.col("nearest"))).alias("inertia"))
    return made.select(F.col("label").cast("long").alias("label"), "n", "inertia")


#: An id of a window: its endpoint and three hex digits of its symbol's MD5.
_WINDOW_ID = "endpoint * 4096 + ('0x' || substr(md5(symbol), 1, 3))::BIGINT"


def with_id(wins: DataFrame) -> DataFrame:
    code = F.conv(F.substring(F.md5(F.col("symbol").cast("binary")), 1, 3), 16, 10).cast("long")
    return wins.withColumn("id", F.col("endpoint") * 4096 + code)


@query("lloyd_kmeans_pp", f"""WITH {TICK}, {win(63, 1, 'tick')}, e AS (SELECT {_WINDOW_ID} AS id, symbol, q FROM win), {', '.join(_lloyd_sql('e', 3, 4, seed=3))}
  SELECT symbol, k::INTEGER AS label, count(*) AS n, {r('sum(sqrt(d))', 3)} AS distance FROM a4 JOIN (SELECT id, symbol FROM e) USING (id) GROUP BY symbol, k""")
def lloyd_kmeans_pp(spark, d):
    w = with_id(windows.windows(P.ticks(spark, d), 63))
    q = lloyd.coordinates(w, "id").cache()
    got = lloyd.fit(q, 3, 2, n_init=1, max_iter=4, seed=3)
    q.unpersist()
    return got.transform(w.select("symbol", "endpoint", "sample")).groupBy("symbol", "label").agg(F.count("*").alias("n"), rnd(F.sum("nearest"), 3).alias("distance"))


@query("lloyd_w1", f"WITH {', '.join([SAMPLES, *_lloyd_sql('e', 3, 4, 1)])} SELECT id, truth, k::INTEGER AS label, {r('d')} AS nearest FROM a4 JOIN (SELECT id, truth FROM e) USING (id)")
def lloyd_w1(spark, d):
    e = P.samples(spark, d)
    q = lloyd.coordinates(e, "id").cache()
    start = np.array([x["q"] for x in q.filter("id < 3").orderBy("id").collect()])
    got = lloyd.fit(q, 3, 1, init=start, max_iter=4)
    q.unpersist()
    return got.transform(e.select("id", "truth", "sample")).select("id", "truth", "label", rnd("nearest").alias("nearest"))


@query("choose_k")
def choose_k(spark, d):
    q = cut(lloyd.coordinates(P.samples(spark, d), "id"))
    best, scores, fits = lloyd.choose_k(q.filter("id % 2 = 0"), q.filter("id % 2 = 1"), [2, 3, 4], n_init=5)
    return spark.createDataFrame([(k, float(v), fits[k].converged, k == best) for k, v in scores.items()], "k int, silhouette double, converged boolean, chosen boolean")


_RICH = f"[m, s, list_avg([((v - m) / s) ** 3 FOR v IN sample]), list_avg([((v - m) / s) ** 4 FOR v IN sample]) - 3, {', '.join(_Q(p) for p in D.QUANTILES)}, sqrt(list_avg([least(v, 0) ** 2 FOR v IN sample])), {drawdown_sql('sample')}]"


def _scaled_sql(source: str) -> str:
    """Standardised features e (id, q) of ``source`` (id, f)."""
    return f"""ft AS (SELECT id, unnest(f) AS x, unnest(range(len(f))) AS i FROM {source}), st AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM ft GROUP BY i),
e AS (SELECT id, list((x - m) / CASE WHEN s > 1e-12::DOUBLE THEN s ELSE 1 END ORDER BY i) AS q FROM ft JOIN st USING (i) GROUP BY id)"""


STEPS_OF_FIT = 12


@query("feature_kmeans", f"""WITH {RET}, {win()}, mm AS (SELECT symbol, endpoint, sample, q, {MEAN.format('sample')} AS m, {SD.format('sample')} AS s FROM win),
  fs AS (SELECT {_WINDOW_ID} AS id, symbol, endpoint, {_RICH} AS f FROM mm), {_scaled_sql('fs')}, {', '.join(_lloyd_sql('e', 3, STEPS_OF_FIT, seed=1))}
  SELECT symbol, endpoint, k::INTEGER AS label, {r('sqrt(d)')} AS nearest FROM a{STEPS_OF_FIT} JOIN (SELECT id, symbol, endpoint FROM fs) USING (id)""")
def feature_kmeans(spark, d):
    w = cut(with_id(P.weekly_windows(spark, d)).withColumn("features", D.features(F.col("sample"), "rich")))
    got = lloyd.FeatureKMeans(3, n_init=1, seed=1, max_iter=STEPS_OF_FIT).fit(w, "id").predict(w, "id")
    return w.select("id", "symbol", "endpoint").join(got, "id").select("symbol", "endpoint", "label", rnd(F.array_min("distance")).alias("nearest"))


@query("feature_gmm")
def feature_gmm(spark, d):
    w = cut(with_id(P.weekly_windows(spark, d)).withColumn("features", D.features(F.col("sample"), "moments")))
    got = mixture.FeatureGmm(3, n_init=2).fit(w, "id").predict(w, "id")
    return w.select("id", "symbol", "endpoint").join(got, "id").select("symbol", "endpoint", "label")


@query("panel_kmeans", f"""WITH {RET}, {JWIN}, fs AS (SELECT endpoint AS id, [{', '.join(_cov(i, j) for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)}] AS f FROM jw),
  {_scaled_sql('fs')}, {', '.join(_lloyd_sql('e', 3, STEPS_OF_FIT, seed=1))} SELECT id AS endpoint, k::INTEGER AS label, {r('sqrt(d)')} AS nearest FROM a{STEPS_OF_FIT}""")
def panel_kmeans(spark, d):
    w = cut(windows.joint_windows(P.weekly_panel(spark, d), L))
    got = lloyd.PanelKMeans("covariance", 3, n_init=1, seed=1, max_iter=STEPS_OF_FIT).fit(w).predict(w)
    return got.select(F.col("id").alias("endpoint"), "label", rnd(F.array_min("distance")).alias("nearest"))


@query("panel_kmeans_marginal", f"""WITH {RET}, {JWIN}, e AS (SELECT endpoint AS id, [v / sqrt({3 * L}.0::DOUBLE) FOR v IN list_concat({', '.join(f'list_sort([x[{i}] FOR x IN sample])' for i in (1, 2, 3))})] AS q FROM jw),
  {', '.join(_lloyd_sql('e', 2, STEPS_OF_FIT, seed=2))} SELECT id AS endpoint, k::INTEGER AS label, {r('sqrt(d)')} AS nearest FROM a{STEPS_OF_FIT}""")
def panel_kmeans_marginal(spark, d):
    w = cut(windows.joint_windows(P.weekly_panel(spark, d), L))
    got = lloyd.PanelKMeans("marginal", 2, n_init=1, seed=2, max_iter=STEPS_OF_FIT).fit(w).predict(w)
    return got.select(F.col("id").alias("endpoint"), "label", rnd(F.array_min("distance")).alias("nearest"))


LENGTHS = "(SELECT symbol, count(*) AS n FROM ret GROUP BY symbol)"


def lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol").agg(F.count("*").alias("n"))


@query("iid_null_dwell", f"""WITH {RET}, {win()}, {CENTERS}, nl AS (SELECT symbol || ':' || rep AS symbol, pos AS idx, log_return, NULL::DATE AS session_date, NULL::TIMESTAMP AS available_at, NULL::DATE AS price_start, NULL::DATE AS price_end
    FROM {resample.draws_sql(LENGTHS, 5, 7, 'iid', keys=['symbol'])} JOIN ret USING (symbol, idx)),
  {win(source='nl').replace('win AS', 'nwin AS', 1)}, ds AS (SELECT symbol, endpoint, list(list_distance(q, c) / sqrt({L}.0::DOUBLE) ORDER BY k) AS d FROM nwin, centers GROUP BY ALL),
  lb AS (SELECT symbol, endpoint, list_position(d, list_min(d)) - 1 AS label FROM ds), nr AS (SELECT *, lag(endpoint) OVER w AS pe, lag(label) OVER w AS pl FROM lb WINDOW w AS (PARTITION BY symbol ORDER BY endpoint)),
  ru AS (SELECT symbol, run, count(*) AS length FROM (SELECT *, sum(CASE WHEN pe IS NULL OR pe <> endpoint - 1 OR pl <> label THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY endpoint) AS run FROM nr) GROUP BY symbol, run),
  dw AS (SELECT symbol, avg(length) AS mean_dwell, count(*) AS runs FROM ru GROUP BY symbol)
  SELECT split_part(symbol, ':', 1) AS symbol, split_part(symbol, ':', 2)::BIGINT AS rep, count(*) FILTER (WHERE pe = endpoint - 1) AS pairs, count(*) FILTER (WHERE pe = endpoint - 1 AND pl <> label) AS switches, {r('any_value(mean_dwell)')} AS mean_dwell, any_value(runs) AS runs FROM nr JOIN dw USING (symbol) GROUP BY ALL""")
def iid_null_dwell(spark, d):
    """Dwell of the fixed centers' labels when the order of returns is random."""
    wins = P.weekly_windows(spark, d)
    base = P.weekly_returns(spark, d).select("symbol", "idx", "log_return")
    null = resample.resample(base, resample.draws(spark, lengths(base), 5, 7, "iid"), ["symbol"])
    made = windows.windows(null, L, keys=("symbol", "rep"))
    labels = geometry.distances(made, P.centers(wins), 2, keep=["symbol", "rep", "endpoint"])
    return evaluate.temporal_summary(labels, ["symbol", "rep"], "endpoint").select("symbol", "rep", "pairs", "switches", rnd("mean_dwell").alias("mean_dwell"), "runs")


@query("sliced_medoids")
def sliced_medoids(spark, d):
    w = cut(windows.joint_windows(P.weekly_panel(spark, d), L).select("endpoint", "sample"))
    model = medoids.fit(w, 3, geometry.unit_directions(16, 3, 5), np.full(3, 0.05), candidates=64, n_init=2)
    return model.transform(w).select("endpoint", "label", rnd("nearest").alias("nearest"))


TWO = hmm.Hmm(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[-1.0], [1.0]]), np.ones((2, 1, 1)), np.zeros(1), np.full(1, 0.5))


@query("hmm_filter", f"""WITH RECURSIVE {RET}, x AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY idx) AS t, idx, log_return / 0.5::DOUBLE AS z FROM ret WHERE log_return IS NOT NULL),
  f(symbol, t, idx, p) AS (SELECT symbol, t, idx, 0.6::DOUBLE * exp(-0.5::DOUBLE * (z + 1) ** 2) / (0.6::DOUBLE * exp(-0.5::DOUBLE * (z + 1) ** 2) + 0.4::DOUBLE * exp(-0.5::DOUBLE * (z - 1) ** 2)) FROM x WHERE t = 1
   UNION ALL SELECT x.symbol, x.t, x.idx, (0.7::DOUBLE * p + 0.2::DOUBLE * (1 - p)) * exp(-0.5::DOUBLE * (z + 1) ** 2) / ((0.7::DOUBLE * p + 0.2::DOUBLE * (1 - p)) * exp(-0.5::DOUBLE * (z + 1) ** 2) + (0.3::DOUBLE * p + 0.8::DOUBLE * (1 - p)) * exp(-0.5::DOUBLE * (z - 1) ** 2))
   FROM f JOIN x ON x.symbol = f.symbol AND x.t = f.t + 1)
  SELECT symbol, idx, {r('p')} AS p0 FROM f""")
def hmm_filter(spark, d):
    got = hmm.causal_filter(P.weekly_returns(spark, d).filter("log_return IS NOT NULL"), TWO, ["symbol"], "log_return")
    return got.select("symbol", "idx", rnd(F.col("posterior")[0]).alias("p0"))


@query("hmm_fit")
def hmm_fit(spark, d):
    """A model for each symbol, fitted inside a task, and its causal states."""
    return hmm.fit_each(P.weekly_returns(spark, d).filter("log_return IS NOT NULL"), "symbol", "log_return", 2, n_init=2, full=False)


@query("panel_hmm_fit")
def panel_hmm_fit(spark, d):
    p = P.weekly_panel(spark, d).filter("x IS NOT NULL").withColumn("k", F.lit("panel"))
    return hmm.fit_each(p, "k", "x", 2, n_init=2).select("idx", "state")


# --- resampling and risk --------------------------------------------------
@query("bootstrap_means", f"""WITH {RET} SELECT symbol, rep, {r('avg(log_return)')} AS mean, count(*) FILTER (WHERE seam) AS seams, max(idx)::BIGINT AS last
  FROM {resample.draws_sql(LENGTHS, 20, 11, 'stationary', 13, ['symbol'])} JOIN ret USING (symbol, idx) GROUP BY symbol, rep""")
def bootstrap_means(spark, d):
    base = P.weekly_returns(spark, d).select("symbol", "idx", "log_return")
    made = resample.draws(spark, lengths(base), 20, 11, "stationary", 13).join(base, ["symbol", "idx"])
    return made.groupBy("symbol", "rep").agg(rnd(F.avg("log_return")).alias("mean"), F.count_if("seam").alias("seams"), F.max("idx").alias("last"))


@query("moving_block_means", f"""WITH {RET} SELECT symbol, rep, {r('avg(log_return)')} AS mean, count(*) AS n, sum(idx * (pos % 7))::BIGINT AS mark FROM {resample.draws_sql(LENGTHS, 10, 4, 'moving', 21, ['symbol'])} JOIN ret USING (symbol, idx) GROUP BY symbol, rep""")
def moving_block_means(spark, d):
    base = P.weekly_returns(spark, d).select("symbol", "idx", "log_return")
    made = resample.draws(spark, lengths(base), 10, 4, "moving", 21).join(base, ["symbol", "idx"])
    return made.groupBy("symbol", "rep").agg(rnd(F.avg("log_return")).alias("mean"), F.count("*").alias("n"), F.sum(F.col("idx") * (F.col("pos") % 7)).alias("mark"))


_RAMP = " ".join(f"WHEN t < {b} THEN least(1, greatest(0, (t - {(a + b) // 2 - synthetic.RAMP_LENGTH // 2} + 1) / {synthetic.RAMP_LENGTH + 1}.0::DOUBLE))" for a, b in synthetic.RAMP_SPANS)


@query("control_streams", f"""WITH s AS (SELECT 'rare' AS kind, t AS idx, CASE WHEN {' OR '.join(f't >= {a} AND t < {a + synthetic.RARE_LENGTH}' for a in synthetic.RARE_STARTS)} THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS rho FROM range(3000) x(t)
  UNION ALL SELECT 'gradual', t, 0.2::DOUBLE + 0.6::DOUBLE * CASE {_RAMP} END FROM range(3000) x(t)),
  w AS (SELECT kind, idx, rho, min(rho) OVER v AS lo, max(rho) OVER v AS hi FROM s WINDOW v AS (PARTITION BY kind ORDER BY idx ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))
  SELECT kind, idx, {r('rho')} AS rho, (CASE WHEN idx < 62 THEN NULL WHEN round(hi, 9) = 0.2 THEN 0 WHEN round(lo, 9) = 0.8 THEN 1 ELSE -1 END)::INTEGER AS state FROM w""")
def control_streams(spark, d):
    """Correlations of the controls, and the pure states of their windows."""
    rows = []
    for kind in ("rare", "gradual"):
        rho = synthetic.control_rho(kind)
        state = [None] * 62 + synthetic.pure_truth(rho, 63).tolist()
        rows += [(kind, t, float(v), s) for t, (v, s) in enumerate(zip(rho, state, strict=True))]
    return spark.createDataFrame(rows, "kind string, idx long, rho double, state int").withColumn("rho", rnd("rho"))


_REACH = f"(SELECT symbol, max(endpoint) + 1 AS n FROM lab GROUP BY symbol)"


@query("conditional_outcomes", BASE + f""", f AS (SELECT symbol, idx, CASE WHEN count(log_return) OVER w = 4 THEN sum(log_return) OVER w END AS x FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)),
  kn AS (SELECT symbol, idx, label, x FROM lab JOIN f ON lab.symbol = f.symbol AND lab.endpoint = f.idx WHERE x IS NOT NULL),
  rp AS (SELECT symbol, rep, label, avg(x) AS m FROM {resample.draws_sql(_REACH, 100, 3, 'moving', L + 4, ['symbol'])} JOIN kn USING (symbol, idx) GROUP BY ALL),
  sp AS (SELECT symbol, label, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM rp GROUP BY ALL)
  SELECT symbol, label::INTEGER AS label, {r('avg(x)')} AS mean, count(*) AS n, {r('any_value(lo)')} AS lo, {r('any_value(hi)')} AS hi FROM kn LEFT JOIN sp USING (symbol, label) GROUP BY symbol, label""".replace("SELECT symbol, idx, label, x FROM lab JOIN f", "SELECT lab.symbol, idx, label, x FROM lab JOIN f"))
def conditional_outcomes(spark, d):
    lab = P.labelled(spark, d).select("symbol", F.col("endpoint").alias("idx"), "label")
    out = windows.future(P.weekly_returns(spark, d), 4).select("symbol", "idx", "future_return")
    reach = lab.groupBy("symbol").agg((F.max("idx") + 1).alias("n"))
    made = evaluate.conditional_outcomes(lab.join(out, ["symbol", "idx"]), "future_return", resample.draws(spark, reach, 100, 3, "moving", L + 4), ["symbol"])
    return made.select("symbol", "label", "n", *[rnd(c).alias(c) for c in ("mean", "lo", "hi")])


_MD5 = lambda *more: "md5(" + " || ':' || ".join(["'9'", "idx", *more]) + ")"
_MOVED = {c: f"CASE WHEN hit THEN {c} + CASE WHEN substr({_MD5(repr(c))}, 1, 1) >= '8' THEN 1 ELSE -1 END * 5.0::DOUBLE * sd_{c} ELSE {c} END" for c in ("n", "a", "r")}


@query("contamination", f"""WITH {RET}, {JOINT} px AS (SELECT idx, n, a_ AS a, r_ AS r FROM panel), sds AS (SELECT stddev_pop(n) AS sd_n, stddev_pop(a) AS sd_a, stddev_pop(r) AS sd_r, greatest(1, ceil(count(*) * 0.05::DOUBLE)) AS hits FROM px),
  hx AS (SELECT px.*, sds.*, row_number() OVER (ORDER BY {_MD5()}, idx) <= hits AS hit FROM px, sds) SELECT idx, hit, {', '.join(f'{r(v)} AS {c}' for c, v in _MOVED.items())} FROM hx""".replace("px AS (SELECT l_returnflag", "prices AS (SELECT l_returnflag").replace("FROM px GROUP BY symbol", "FROM prices GROUP BY symbol").replace("LEFT JOIN px ON px.symbol = span.symbol AND px.session_date", "LEFT JOIN prices px ON px.symbol = span.symbol AND px.session_date"))
def contamination(spark, d):
    """The panel of all symbols, each column with its own scale and signs."""
    wide = P.weekly_panel(spark, d).select("idx", *[F.col("x")[i].alias(c) for i, c in enumerate("nar")])
    made = resample.contaminate(wide, 0.05, 5.0, 9, ["n", "a", "r"])
    return made.select("idx", "hit", *[rnd(c).alias(c) for c in "nar"])


BASKET = f"bk AS (SELECT idx, session_date, max(available_at) AS available_at, CASE WHEN count(x) = 3 THEN avg(exp(x) - 1) ** 2 END AS q FROM (SELECT idx, session_date, available_at, unnest([n, a_, r_]) AS x FROM panel) GROUP BY idx, session_date)"


def basket_rows(spark, d):
    p = P.weekly_panel(spark, d)
    q = F.pow(D.mean(F.transform("x", lambda v: F.expm1(v))), 2)
    return p.select(F.lit("basket").alias("series"), "idx", "session_date", "available_at", q.alias("q"))


@query("risk_basket", f"WITH {RET}, {JOINT} {BASKET} SELECT idx, session_date, {r('q', 8)} AS q FROM bk")
def risk_basket(spark, d):
    return basket_rows(spark, d).select("idx", "session_date", rnd("q", 8).alias("q"))


RISK = dict(window=10, horizon=3, min_history=12, prior=5.0, decay=0.9)
RISK_SQL = f"""v0 AS (SELECT *, CASE WHEN count(q) OVER w = 10 THEN avg(q) OVER w END AS m FROM bk WINDOW w AS (ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
cut AS (SELECT quantile_cont(m, 1 / 3::DOUBLE) AS b1, quantile_cont(m, 2 / 3::DOUBLE) AS b2 FROM v0 WHERE idx <= 150),
vs AS (SELECT idx, session_date, available_at, q, CASE WHEN m IS NULL THEN -1 ELSE (m >= b1)::INT + (m >= b2)::INT END AS vol_state FROM v0, cut),
tg AS (SELECT *, CASE WHEN count(q) OVER w = 3 THEN avg(q) OVER w END AS target, CASE WHEN count(q) OVER w = 3 THEN max(idx) OVER w END AS target_end FROM vs WINDOW w AS (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"""


def risk_rows(spark, d):
    return risk.targets(risk.volatility_states(basket_rows(spark, d), 10, 150), 3)


@query("risk_states_targets", f"WITH {RET}, {JOINT} {BASKET}, {RISK_SQL} SELECT idx, vol_state::INTEGER AS vol_state, {r('target', 8)} AS target, target_end FROM tg")
def risk_states_targets(spark, d):
    return risk_rows(spark, d).select("idx", "vol_state", rnd("target", 8).alias("target"), "target_end")


FORECAST_SQL = RISK_SQL + f""", al AS (SELECT *, avg(q) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e, avg(q) OVER (ORDER BY idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ro FROM tg),
ew(idx, w) AS (SELECT idx, e FROM al WHERE idx = 11 UNION ALL SELECT al.idx, 0.9::DOUBLE * w + 0.1::DOUBLE * q FROM ew JOIN al ON al.idx = ew.idx + 1),
mt AS (SELECT a.idx, count(b.target) AS n, coalesce(sum(b.target), 0) AS s FROM al a LEFT JOIN al b ON b.idx <= a.idx - 3 AND b.idx >= 9 AND b.vol_state = a.vol_state GROUP BY a.idx),
fc AS (SELECT al.idx, session_date, target, e AS expanding, ro AS rolling, w AS ewma, n AS matured, (s + 5 * e) / (n + 5) AS regime FROM al JOIN ew USING (idx) JOIN mt USING (idx))"""


def forecast_rows(spark, d):
    return risk.forecasts(risk_rows(spark, d), ["vol_state"], 3, **RISK)


@query("risk_forecasts", f"WITH RECURSIVE {RET}, {JOINT} {BASKET}, {FORECAST_SQL} SELECT idx, {r('expanding', 8)} AS expanding, {r('rolling', 8)} AS rolling, {r('ewma', 8)} AS ewma, matured, {r('regime', 8)} AS regime FROM fc")
def risk_forecasts(spark, d):
    got = forecast_rows(spark, d).filter("expanding IS NOT NULL")
    return got.select("idx", rnd("expanding", 8).alias("expanding"), rnd("rolling", 8).alias("rolling"), rnd("ewma", 8).alias("ewma"), F.col("vol_state_matured").alias("matured"), rnd("vol_state_mean", 8).alias("regime"))


METHODS = ("expanding", "rolling", "ewma", "regime")


def risk_losses(spark, d):
    return risk.losses(forecast_rows(spark, d).withColumnRenamed("vol_state_mean", "regime"), METHODS)


def _loss_sql(by: str) -> str:
    rows = " UNION ALL ".join(f"SELECT session_date, '{m}' AS method, greatest({m}, 1e-12::DOUBLE) AS f, {m} < 1e-12::DOUBLE AS fl, target FROM fc WHERE target IS NOT NULL AND {m} IS NOT NULL" for m in METHODS)
    return f"WITH RECURSIVE {RET}, {JOINT} {BASKET}, {FORECAST_SQL} SELECT method, {by} count(*) AS n, {r('avg(ln(f) + target / f)')} AS qlike, {r('avg((target - f) ** 2)', 10)} AS mse, count(*) FILTER (WHERE fl) AS floored FROM ({rows}) GROUP BY ALL"


@query("risk_metrics", _loss_sql(""))
def risk_metrics(spark, d):
    return risk.metrics(risk_losses(spark, d)).withColumns({"qlike": rnd("qlike"), "mse": rnd("mse", 10)})


@query("risk_metrics_by_year", _loss_sql("year(session_date)::INTEGER AS year,"))
def risk_metrics_by_year(spark, d):
    return risk.metrics(risk_losses(spark, d), by_year=True).withColumns({"qlike": rnd("qlike"), "mse": rnd("mse", 10)})


def _intervals_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT idx AS t, '{m}' AS method, greatest({m}, 1e-12::DOUBLE) AS f, target FROM fc WHERE target IS NOT NULL AND {m} IS NOT NULL" for m in METHODS)
    drawn = resample.draws_sql("(SELECT count(DISTINCT t) AS n FROM lo)", 200, 5, "stationary", 13)
    return f"""WITH RECURSIVE {RET}, {JOINT} {BASKET}, {FORECAST_SQL}, lo AS (SELECT t, method, 'qlike' AS loss_name, ln(f) + target / f AS v FROM ({rows}) UNION ALL SELECT t, method, 'mse', (target - f) ** 2 FROM ({rows})),
  de AS (SELECT o.t, o.method, loss_name, b.v - o.v AS delta FROM lo o JOIN lo b USING (t, loss_name) WHERE b.method = 'regime' AND o.method <> 'regime'),
  tt AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT t FROM lo)),
  rp AS (SELECT method, loss_name, rep, avg(delta) AS m FROM {drawn} JOIN tt USING (idx) JOIN de USING (t) GROUP BY ALL)
  SELECT method, loss_name, {r('any_value(mean_delta)', 8)} AS mean_delta, {r('quantile_cont(m, 0.025)', 8)} AS lo, {r('quantile_cont(m, 0.975)', 8)} AS hi
  FROM rp JOIN (SELECT method, loss_name, avg(delta) AS mean_delta FROM de GROUP BY ALL) USING (method, loss_name) GROUP BY method, loss_name"""


@query("risk_intervals", _intervals_sql())
def risk_intervals(spark, d):
    long = risk_losses(spark, d)
    stacked = long.select(F.col("idx").alias("t"), "method", F.explode(F.create_map(F.lit("qlike"), "qlike", F.lit("mse"), "mse")).alias("loss_name", "value"))
    return resample.paired_interval(stacked, "regime", 13, 200, 5).select("method", "loss_name", *[rnd(c, 8).alias(c) for c in ("mean_delta", "lo", "hi")])


_BROKEN = """bad AS (SELECT symbol, idx, CASE WHEN idx % 50 = 7 THEN price_start - 1 ELSE price_start END AS price_start, CASE WHEN idx % 50 = 31 THEN price_end + 1 ELSE price_end END AS price_end,
  CASE WHEN idx % 50 = 13 THEN available_at - INTERVAL 21 DAY WHEN idx % 50 = 19 THEN available_at - INTERVAL 90 MINUTE ELSE available_at END AS available_at FROM ret WHERE idx % 50 <> 23)"""


@query("contiguity_guard", f"""WITH {RET}, {_BROKEN}, no AS (SELECT session_date AS d, row_number() OVER (ORDER BY session_date) AS no FROM cal),
  lg AS (SELECT *, lag(idx) OVER w AS pi, lag(price_end) OVER w AS pe, lag(available_at) OVER w AS pa, row_number() OVER w AS k FROM bad WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
  jn AS (SELECT lg.*, a.no AS na, b.no AS nb FROM lg LEFT JOIN no a ON a.d = price_end LEFT JOIN no b ON b.d = price_start)
  SELECT symbol, idx, fault FROM (SELECT symbol, idx, CASE WHEN k > 1 AND pi <> idx - 1 THEN 'gap' WHEN k > 1 AND pe <> price_start THEN 'chain' WHEN na IS NULL OR nb IS NULL OR na <> nb + 1 THEN 'session'
    WHEN k > 1 AND pa >= available_at THEN 'order' WHEN available_at < price_end::TIMESTAMP + INTERVAL 21 HOUR THEN 'early' END AS fault FROM jn) WHERE fault IS NOT NULL""")
def contiguity_guard(spark, d):
    """Weekly returns with rows that break each rule: a lost row, prices that do not
    chain, a session that is none, and availability too soon."""
    at, on = F.col("available_at"), lambda n: F.col("idx") % 50 == n
    rows = P.weekly_returns(spark, d).filter(~on(23)).select(
        "symbol", "idx", F.when(on(7), F.date_sub("price_start", 1)).otherwise(F.col("price_start")).alias("price_start"), F.when(on(31), F.date_add("price_end", 1)).otherwise(F.col("price_end")).alias("price_end"),
        F.when(on(13), at - F.expr("INTERVAL 21 DAY")).when(on(19), at - F.expr("INTERVAL 90 MINUTE")).otherwise(at).alias("available_at"),
    )
    return splits.check_contiguous(rows, P.weekly_calendar(spark)).select("symbol", "idx", "fault")


@query("scored_prefix", f"""WITH RECURSIVE {RET}, {JOINT} {BASKET}, {FORECAST_SQL}, og AS (SELECT (idx // 60)::BIGINT AS part, idx, target IS NOT NULL AS scored FROM fc WHERE expanding IS NOT NULL)
  SELECT part, max(idx) FILTER (WHERE scored) AS last, min(idx) FILTER (WHERE NOT scored) AS open FROM og GROUP BY part HAVING max(idx) FILTER (WHERE scored) > min(idx) FILTER (WHERE NOT scored)""")
def scored_prefix(spark, d):
    """Stretches of 60 origins whose scored ones do not come first."""
    got = forecast_rows(spark, d).filter("expanding IS NOT NULL").select(F.floor(F.col("idx") / 60).alias("part"), "idx", F.col("target").isNotNull().alias("scored"))
    return splits.check_prefix(got, ["part"])


@query("w2_assign_ticks", f"""WITH {TICK}, {win(63, 1, 'tick')}, c AS (SELECT row_number() OVER (ORDER BY endpoint) - 1 AS k, q AS c FROM win WHERE symbol = 'click' AND endpoint IN (100, 200, 300)),
  dd AS (SELECT symbol, endpoint, list(list_distance(q, c) / sqrt(63.0::DOUBLE) ORDER BY k) AS d FROM win, c GROUP BY ALL) SELECT symbol, (list_position(d, list_min(d)) - 1)::INTEGER AS label, count(*) AS n, {r('sum(list_min(d))', 3)} AS distance FROM dd GROUP BY 1, 2""")
def w2_assign_ticks(spark, d):
    t = P.ticks(spark, d)
    own = windows.windows(t.filter("symbol = 'click' AND idx <= 300"), 63).filter("endpoint IN (100, 200, 300)").select("endpoint", "sample").collect()
    c = np.array([x["sample"] for x in sorted(own, key=lambda x: x["endpoint"])])  # three centers
    w = windows.windows(t, 63).select("symbol", "sample")
    return geometry.distances(w, c, 2, keep=["symbol"]).groupBy("symbol", "label").agg(F.count("*").alias("n"), rnd(F.sum("nearest"), 3).alias("distance"))
