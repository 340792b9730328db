"""Causal forecasts of second moments, losses and intervals.

A forecast at t uses rows up to t; a target enters a mean when it has matured."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massflow.operators.windows import BLOCK, halo
from massflow.session import cut

FLOOR = 1e-12


def basket(returns: DataFrame) -> DataFrame:
    """(idx, session_date, q): squared mean simple return of the assets."""
    by = returns.groupBy("idx").agg(F.min("session_date").alias("session_date"), F.max("available_at").alias("available_at"), F.avg(F.expm1("log_return")).alias("m"))
    return by.select("idx", "session_date", "available_at", (F.col("m") * F.col("m")).alias("q"))


def volatility_states(rows: DataFrame, window: int, training_end: int) -> DataFrame:
    """Adds ``vol_state``: tercile, by training rows, of the trailing mean of q
    (a value at a boundary goes up); -1 before a full window."""
    w = Window.partitionBy("series", "_block").orderBy("idx").rangeBetween(-(window - 1), 0)
    made = halo(rows, window - 1).withColumn("_m", F.when(F.count("q").over(w) == window, F.avg("q").over(w))).filter("_own").drop("_own", "_block")
    made = cut(made)  # numbers only; read for the bounds and for the states
    bounds = made.filter(F.col("idx") <= training_end).groupBy("series").agg(F.percentile("_m", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("_b"))
    state = F.when(F.col("_m").isNull(), -1).otherwise((F.col("_m") >= F.col("_b")[0]).cast("int") + (F.col("_m") >= F.col("_b")[1]).cast("int"))
    return made.join(F.broadcast(bounds), "series").withColumn("vol_state", state).drop("_m", "_b")  # a row a series


def targets(rows: DataFrame, horizon: int, as_of: str | None = None) -> DataFrame:
    """Adds ``target``, the mean of the next ``horizon`` q, null until matured
    and available; with its last row's idx and availability."""
    w = Window.partitionBy("series", "_block").orderBy("idx").rangeBetween(1, horizon)
    full = F.count("q").over(w) == horizon
    at = F.max("available_at").over(w)
    ok = full if as_of is None else full & (at <= F.lit(as_of).cast("timestamp"))
    made = halo(rows, 0, horizon).withColumns({"target": F.when(ok, F.avg("q").over(w)), "target_end": F.when(ok, F.max("idx").over(w)), "target_available_at": F.when(ok, at)})
    return made.filter("_own").drop("_own", "_block")


def _fold(e: float, x: np.ndarray, decay: float) -> np.ndarray:
    """e = decay e + (1 - decay) x, after each x."""
    out = np.empty(len(x))
    for i, v in enumerate(((1 - decay) * x).tolist()):
        e = decay * e + v
        out[i] = e
    return out


class _Block:
    """One block of a series, with the halo before it: numbers placed by idx."""

    def __init__(self, table: pa.Table, states: Sequence[str], window: int, horizon: int):
        idx = table.column("idx").to_numpy()
        self.order = np.argsort(idx, kind="stable")
        idx = idx[self.order]
        lo = int(idx[0])
        self.at, self.own, self.idx = idx - lo, table.column("_own").to_numpy(zero_copy_only=False)[self.order], idx
        q = np.full(int(idx[-1]) - lo + 1, np.nan)
        q[self.at] = table.column("q").to_numpy(zero_copy_only=False)[self.order].astype(float)
        self.q = q[self.at][self.own]
        self.rolling, ripe = (self._mean(q, n)[self.at][self.own] for n in (window, horizon))
        origin = idx[self.own] - horizon >= max(window - 1, 0)
        self.states, self.hits = {}, {}
        for name in states:
            s = np.full(len(q), -1)
            s[self.at] = np.nan_to_num(table.column(name).to_numpy(zero_copy_only=False)[self.order].astype(float), nan=-1).astype(int)
            back = self.at[self.own] - horizon
            was = np.where(back >= 0, s[np.maximum(back, 0)], -1)
            self.states[name] = s[self.at][self.own]
            self.hits[name] = np.where(origin & np.isfinite(ripe), was, -1)
        self.ripe = np.nan_to_num(ripe)

    @staticmethod
    def _mean(q: np.ndarray, n: int) -> np.ndarray:
        """Trailing means of n numbers, NaN where one lacks."""
        out = np.full(len(q), np.nan)
        if len(q) >= n:
            out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(q, n).mean(1)
        return out

    def columns(self, k: int) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
        """Matured targets, and ones for them, of each state column and state."""
        return {(name, j): (np.where(hit == j, self.ripe, 0.0), hit == j) for name, hit in self.hits.items() for j in range(k)}


def forecasts(rows: DataFrame, states: Sequence[str], k: int, window: int, horizon: int, min_history: int, prior: float, decay: float, block: int = BLOCK) -> DataFrame:
    """Adds expanding, rolling, ewma and, for each state column, the mean of its
    matured targets shrunk to the expanding mean, and how many matured; all null
    before min_history.

    rows: series, idx (dense from 0), q, state columns (-1: none yet).  The mean
    of the last ``horizon`` q is the target that matures now, of the origin
    ``horizon`` rows ago; it enters the running sum of that origin's state, and
    the current state's sum is taken.  The ewma starts from the mean of the first
    ``min_history`` q.  A null q is no observation: it enters no mean and has no ewma.

    Two passes over blocks of a series: the first sums each block (and folds the ewma
    from nothing), a carry of one row a block goes along the series, and the second
    continues each block from its carry."""
    whole = lambda v, lo: isinstance(v, int) and not isinstance(v, bool) and v >= lo
    if not (whole(k, 1) and whole(window, 1) and whole(horizon, 1) and whole(min_history, window)) or not prior > 0 or not 0 < decay < 1:
        raise ValueError("forecast parameters are not valid")
    rows = cut(rows)  # read by both passes
    states, back = list(states), max(window - 1, horizon)
    kinds = rows.schema
    cells = [(s, j) for s in states for j in range(k)]
    summary = T.StructType([kinds["series"], T.StructField("_block", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("q_sum", "q_n", "fold")], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("head", "y", "n")]])

    def add_up(table: pa.Table) -> pa.Table:
        b = _Block(table, states, window, horizon)
        seen = b.q[np.isfinite(b.q)]
        cols = b.columns(k)
        fold = _fold(0.0, seen, decay)
        out = {"q_sum": [float(seen.sum())], "q_n": [float(len(seen))], "fold": [float(fold[-1]) if len(fold) else 0.0], "head": [seen[:min_history].tolist()]}
        out |= {"y": [[float(cols[c][0].sum()) for c in cells]], "n": [[float(cols[c][1].sum()) for c in cells]]}
        return pa.table({"series": table.column("series")[:1].combine_chunks(), "_block": table.column("_block")[:1].combine_chunks(), **{c: pa.array(v, pa.float64() if c in ("q_sum", "q_n", "fold") else pa.list_(pa.float64())) for c, v in out.items()}})

    carry_kind = T.StructType([kinds["series"], T.StructField("_block", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("_q", "_rows", "_e")], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_y", "_n")]])

    def carry(table: pa.Table) -> pa.Table:
        """What each block begins with; _e is null until the ewma has begun."""
        table = table.sort_by("_block")
        out: dict[str, list] = {c: [] for c in ("_q", "_rows", "_e", "_y", "_n")}
        q, n, e, y, m = 0.0, 0.0, None, np.zeros(len(cells)), np.zeros(len(cells))
        for r in table.to_pylist():
            for c, v in (("_q", q), ("_rows", n), ("_e", e), ("_y", y.tolist()), ("_n", m.tolist())):
                out[c].append(v)
            size = int(r["q_n"])
            if e is not None:
                e = e * decay**size + r["fold"]
            elif n + size >= min_history:
                j = int(min_history - n)  # the block's rows that complete the first mean
                head = np.array(r["head"][:j])
                rest = r["fold"] - decay ** (size - j) * (_fold(0.0, head, decay)[-1] if j else 0.0)
                e = (q + head.sum()) / min_history * decay ** (size - j) + (rest if size > j else 0.0)
            q, n, y, m = q + r["q_sum"], n + size, y + np.array(r["y"]), m + np.array(r["n"])
        return pa.table({"series": table.column("series"), "_block": table.column("_block"), **{c: pa.array(v, pa.list_(pa.float64()) if c in ("_y", "_n") else pa.float64()) for c, v in out.items()}})

    added = ["expanding", "rolling", "ewma", *[x for s in states for x in (f"{s}_matured", f"{s}_mean")]]
    made_kind = T.StructType([*kinds.fields, *[T.StructField(c, T.LongType() if c.endswith("_matured") else T.DoubleType()) for c in added]])

    def forecast(table: pa.Table) -> pa.Table:
        b = _Block(table, states, window, horizon)
        first = {c: table.column(c)[0].as_py() for c in ("_q", "_rows", "_e", "_y", "_n")}
        warm, seen = b.idx[b.own] >= min_history - 1, np.isfinite(b.q)
        q, n = first["_q"] + np.nan_to_num(b.q).cumsum(), first["_rows"] + seen.cumsum()
        mean = np.divide(q, n, out=np.full(len(q), np.nan), where=n > 0)
        out = {"expanding": mean, "rolling": b.rolling}
        e, x = first["_e"], b.q[seen]
        ewma = np.full(len(x), np.nan)
        if e is not None:
            ewma = _fold(e, x, decay)
        elif (j := int(min_history - first["_rows"])) <= len(x):
            ewma[j - 1] = (first["_q"] + x[:j].sum()) / min_history
            ewma[j:] = _fold(ewma[j - 1], x[j:], decay)
        out["ewma"] = np.full(len(q), np.nan)
        out["ewma"][seen] = ewma
        cols = b.columns(k)
        for s in states:
            y, m = np.zeros(len(q)), np.zeros(len(q))
            for j in range(k):
                i, now = cells.index((s, j)), b.states[s] == j
                y[now] = (first["_y"][i] + cols[s, j][0].cumsum())[now]
                m[now] = (first["_n"][i] + cols[s, j][1].cumsum())[now]
            out[f"{s}_matured"], out[f"{s}_mean"] = m, (y + prior * mean) / (m + prior)
        kept = table.take(pa.array(b.order[b.own]))
        arrays = [kept.column(c) for c in kinds.names]
        for c in added:
            gone = ~warm if c != "ewma" else np.zeros(len(q), bool)
            v = np.where(gone, np.nan, out[c])
            arrays.append(pa.array(np.nan_to_num(v).astype(np.int64) if c.endswith("_matured") else v, mask=~np.isfinite(v)))
        return pa.table(arrays, names=made_kind.fieldNames())

    blocked = halo(rows, back, block=block)
    narrow = halo(rows.select("series", "idx", "q", *states), back, block=block)
    sums = narrow.groupBy("series", "_block").applyInArrow(add_up, summary)
    starts = cut(sums.groupBy("series").applyInArrow(carry, carry_kind))  # a row a block
    joined = blocked.join(starts, ["series", "_block"])
    return joined.groupBy("series", "_block").applyInArrow(forecast, made_kind)


def losses(rows: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Long (series, idx, method, forecast, floor_applied, qlike, mse), where a
    target exists; forecasts are floored, targets never."""
    long = rows.filter("target IS NOT NULL").select("series", "idx", "session_date", "target", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("raw")) for m in methods])).alias("x"))
    f = F.greatest(F.col("raw"), F.lit(FLOOR))
    long = long.select("series", "idx", "session_date", "target", "x.*").filter("raw IS NOT NULL")
    return long.select("series", "idx", "session_date", "method", f.alias("forecast"), (F.col("raw") < FLOOR).alias("floor_applied"), (F.ln(f) + F.col("target") / f).alias("qlike"), F.pow(F.col("target") - f, 2).alias("mse"))


def metrics(scored: DataFrame, by_year: bool = False) -> DataFrame:
    keys = ["method", *([F.year("session_date").alias("year")] if by_year else [])]
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("qlike").alias("qlike"), F.avg("mse").alias("mse"), F.count_if("floor_applied").alias("floored"))
