"""Causal operators as arbitrary stateful streams.

``stream_sessions`` turns ticks in any order into sessions by event time and a
watermark.  The others keep a fixed-size state for each series; rows of a micro-batch
are taken in idx order.  Rows must reach a series in order of idx between batches: a
row whose idx was passed already is late, and is dropped and not mixed into history."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from massflow.operators.hmm import Hmm


def _rows(state: GroupState, empty: tuple, parts: Iterator[pd.DataFrame], last: int) -> tuple[tuple, pd.DataFrame]:
    own = state.get if state.exists else empty
    g = pd.concat(list(parts)).sort_values("idx")
    return own, g[g["idx"] > own[last]]


def stream_sessions(ticks: DataFrame, session: str = "1 day", lateness: str = "2 hours") -> DataFrame:
    """(symbol, session_start, price, n, available_at) from ticks (symbol, ts, price):
    the last price of each session of event time, whatever the order of arrival.

    A session is given out once, when the watermark (the latest event time less
    ``lateness``) has passed its end; a tick that comes after that is dropped.  So a
    price is known ``lateness`` after its session's end, which ``available_at`` says."""
    made = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", session)).agg(F.max_by("price", F.struct("ts", "price")).alias("price"), F.count("*").alias("n"))
    return made.select("symbol", F.col("window.start").alias("session_start"), "price", "n", (F.col("window.end") + F.expr(f"INTERVAL {lateness}")).alias("available_at"))


def stream_windows(rows: DataFrame, length: int) -> DataFrame:
    """(symbol, endpoint, sample) as soon as ``length`` finite consecutive values
    are there; a gap (null, or a skipped idx) empties the ring."""
    def step(key, parts, state):
        (ring, last), g = _rows(state, ([], -1), parts, 1)
        ring, out = list(ring), []
        for i, x in zip(g["idx"].tolist(), g["log_return"].tolist(), strict=True):
            if x is None or not np.isfinite(x):
                ring = []
            else:
                ring = (ring if i == last + 1 or not ring else []) + [float(x)]
                ring = ring[-length:]
                if len(ring) == length:
                    out.append((key[0], i, list(ring)))
            last = i
        state.update((ring, int(last)))
        yield pd.DataFrame(out, columns=["symbol", "endpoint", "sample"])

    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, endpoint long, sample array<double>", "ring array<double>, last long", "append", GroupStateTimeout.NoTimeout)


def stream_filter(rows: DataFrame, model: Hmm) -> DataFrame:
    """(symbol, idx, state, p): causal posteriors, continued between batches."""
    def step(key, parts, state):
        (post, last), g = _rows(state, ([], -1), parts, 1)
        g = g[np.isfinite(g["log_return"])]
        if len(g):
            out = model.filter(g["log_return"].to_numpy().reshape(-1, 1), np.array(post) if post else None)
            state.update((out[-1].tolist(), int(g["idx"].iloc[-1])))
            yield pd.DataFrame({"symbol": key[0], "idx": g["idx"], "state": out.argmax(1).astype("int32"), "p": list(out)})
        else:
            state.update((list(post), int(last)))
            yield pd.DataFrame(columns=["symbol", "idx", "state", "p"])

    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, idx long, state int, p array<double>", "post array<double>, last long", "append", GroupStateTimeout.NoTimeout)


def stream_ewma(rows: DataFrame, decay: float, min_history: int) -> DataFrame:
    """(symbol, idx, ewma) of q, seeded with the mean of the first rows."""
    def step(key, parts, state):
        (n, total, e, last), g = _rows(state, (0, 0.0, 0.0, -1), parts, 3)
        out = []
        for i, q in zip(g["idx"].tolist(), g["q"].tolist(), strict=True):
            n += 1
            if n <= min_history:
                total += q
                e = total / n
            else:
                e = decay * e + (1 - decay) * q
            if n >= min_history:
                out.append((key[0], i, e))
            last = i
        state.update((int(n), float(total), float(e), int(last)))
        yield pd.DataFrame(out, columns=["symbol", "idx", "ewma"])

    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, idx long, ewma double", "n long, total double, e double, last long", "append", GroupStateTimeout.NoTimeout)


def stream_matured(rows: DataFrame, k: int, window: int, horizon: int, prior: float, min_history: int) -> DataFrame:
    """(symbol, idx, matured, forecast): running means of matured targets by the
    state at their origin; the queue holds the last ``horizon`` origins."""
    def step(key, parts, state):
        empty = ([0.0] * k, [0] * k, [], [], 0, 0.0, -1)
        (sums, counts, queue, qs, n, total, last), g = _rows(state, empty, parts, 6)
        sums, counts, queue, qs, out = list(sums), list(counts), list(queue), list(qs), []
        for i, q, s in zip(g["idx"].tolist(), g["q"].tolist(), g["state"].tolist(), strict=True):
            n, total = n + 1, total + q
            qs = [*qs, float(q)][-horizon:]
            queue.append(int(s))
            if len(queue) > horizon:
                was = queue.pop(0)
                if was >= 0 and n - 1 - horizon >= window - 1:
                    sums[was] += sum(qs) / horizon
                    counts[was] += 1
            if n >= min_history:
                m, y = (counts[s], sums[s]) if s >= 0 else (0, 0.0)
                out.append((key[0], i, int(m), (y + prior * total / n) / (m + prior)))
            last = i
        state.update((sums, counts, queue, qs, int(n), float(total), int(last)))
        yield pd.DataFrame(out, columns=["symbol", "idx", "matured", "forecast"])

    kept = "sums array<double>, counts array<long>, queue array<int>, qs array<double>, n long, total double, last long"
    return rows.groupBy("symbol").applyInPandasWithState(step, "symbol string, idx long, matured long, forecast double", kept, "append", GroupStateTimeout.NoTimeout)
