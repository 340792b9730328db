"""Risk studies: causal forecasts, their losses and paired intervals."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.functions import distributions as D
from massflow.operators import resample, risk, splits, windows
from massflow.plans import config, frozen, inputs
from massflow.session import cut

#: A risk job: snapshots, the period of origins, and the forecast's parameters.
RISK_JOB = config.SCORE | {"horizon": config.integer(1), "min_history": config.integer(1), "prior": config.number(0, 1e9), "decay": config.number(0, 1), "blocks": config.integers(1), "reps": config.integer(2), "seed": config.integer(0)}


def intervals(scored: DataFrame, base: str, blocks: list[int], reps: int, seed: int) -> DataFrame:
    """Paired intervals of losses against ``base``, for each block length."""
    long = scored.select(F.col("idx").alias("t"), "method", F.explode(F.create_map(F.lit("qlike"), "qlike", F.lit("mse"), "mse")).alias("loss_name", "value"))
    return resample.paired_intervals(long, base, blocks, reps, [seed + b for b in blocks])


def risk_study(rows: DataFrame, states: list[str], k: int, cfg: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """Losses of every method and origin, and paired intervals by block length."""
    c = config.validate(cfg, config.RISK)
    made = risk.targets(risk.volatility_states(rows, c["window"], c["training_end"]), c["horizon"])
    made = risk.forecasts(made, [*states, "vol_state"], k, c["window"], c["horizon"], c["min_history"], c["prior"], c["decay"])
    methods = ["expanding", "rolling", "ewma", *[f"{s}_mean" for s in [*states, "vol_state"]]]
    scored = cut(risk.losses(made.filter(F.col("idx") > c["training_end"]), methods))
    return scored, intervals(scored, f"{states[0] if states else 'vol_state'}_mean", c["blocks"], c["reps"], c["seed"])


def risk_panel(panel: DataFrame, contract: Mapping[str, Any], model: Any, c: Mapping[str, Any], calendar: DataFrame | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """Forecasts of a complete panel from a frozen model's states: origins with
    targets and losses, and a summary with metrics and intervals."""
    first, last, ready = splits.iso_date(c["start"]), splits.iso_date(c["end"]), splits.moment(c["as_of"])
    length, k = contract["length"], len(model.medoids)
    if first > last or c["min_history"] < length:
        raise ValueError("the period or the history is not valid")
    rows = cut(panel.select(F.lit("basket").alias("symbol"), "idx", "session_date", "price_start", "price_end", "available_at", "x"))
    if not rows.filter("x IS NULL").isEmpty():
        raise ValueError("risk needs complete returns")
    if faults := splits.check_contiguous(rows.drop("x"), calendar).limit(3).collect():
        raise ValueError(f"risk needs consecutive sessions: {[(str(r['session_date']), r['fault']) for r in faults]}")
    states = model.transform(windows.joint_windows(panel, length).select("endpoint", "sample")).select(F.col("endpoint").alias("idx"), F.col("label").alias("joint"))
    q = F.pow(D.mean(F.transform("x", lambda v: F.expm1(v))), 2)
    series = rows.select(F.lit("basket").alias("series"), "idx", "session_date", "price_start", "available_at", q.alias("q")).join(states, "idx", "left").withColumn("joint", F.coalesce("joint", F.lit(-1)))
    training_end = rows.filter(F.col("session_date") <= F.lit(contract["train_end"]).cast("date")).agg(F.max("idx").alias("i")).first()["i"]
    if training_end is None:
        raise ValueError("there is no training history")
    at = ready.replace(tzinfo=None).isoformat(" ")
    made = risk.targets(risk.volatility_states(series, length, training_end), c["horizon"], at)
    made = risk.forecasts(made, ["joint", "vol_state"], max(k, 3), length, c["horizon"], c["min_history"], c["prior"], c["decay"])
    kept, counts = splits.risk_origins(made, c["start"], c["end"], contract["calibration_end"], at, c["min_history"] - 1)
    origins = cut(kept.withColumn("scored", F.col("target").isNotNull()))
    n = origins.agg(F.count("*").alias("n"), F.count_if("scored").alias("scored")).first()
    if n["scored"] <= max(c["blocks"]):
        raise ValueError("there are too few scored origins for the blocks")
    if not splits.check_prefix(origins, ["series"]).isEmpty():
        raise ValueError("scored origins are not the first ones")
    methods = ["expanding", "rolling", "ewma", "joint_mean", "vol_state_mean"]
    scored = cut(risk.losses(origins, methods))
    summary = {
        "origins": n["n"], "scored": n["scored"], "pending": n["n"] - n["scored"], "reasons": {r["reason"]: r["n"] for r in counts.collect()}, "horizon": c["horizon"], "point_in_time": False,
        "metrics": [r.asDict() for r in risk.metrics(scored).orderBy("method").collect()], "by_year": [r.asDict() for r in risk.metrics(scored, by_year=True).orderBy("year", "method").collect()],
        "intervals": [r.asDict() for r in intervals(scored, "joint_mean", c["blocks"], c["reps"], c["seed"]).collect()],
    }
    return origins, summary


def risk_run(spark: SparkSession, bundle: str | Path, cfg: Mapping[str, Any]) -> tuple[DataFrame, dict[str, Any]]:
    """``risk_panel`` of the snapshots that a configuration names."""
    contract, model = frozen.load(bundle)
    c = config.validate(cfg, RISK_JOB)
    if (c["provider"], c["price_column"]) != (contract["provider"], contract["price_column"]) or [a["symbol"] for a in c["assets"]] != contract["symbols"]:
        raise ValueError("the snapshots differ from the contract")
    # the period bounds origins, not the rows in which their targets mature
    panel = inputs.panel(spark, c["assets"], c["price_column"], contract["calendar"])
    return risk_panel(panel, contract, model, c, inputs.sessions_of(spark, contract["calendar"]))
