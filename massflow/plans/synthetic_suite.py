"""Recovery of known laws and behaviour on stationary nulls, for all methods.

One task a (suite, length, repetition): it generates its stream, fits every method
and returns rows of numbers; summaries over repetitions are DataFrame aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.functions import local
from massflow.operators import evaluate
from massflow.plans import config
from massflow.sources import synthetic

METHODS = ("w2", "w1", "shape_w2", "volatility", "mean_vol", "moments", "rich", "gmm")
SUITES = ("variance", "normal_t5", "signed_exponential", "equal_four_moments")
SEGMENT, SUBSAMPLE = 756, 5
SCHEMA = {"repeats": config.integer(1), "lengths": config.integers(2), "seed": config.integer(0), "n_init": config.integer(1)}
ROW = "suite string, length int, rep int, method string, part string, measure string, value double"


def scores(truth: np.ndarray, label: np.ndarray) -> dict[str, float | None]:
    """Agreement of mapped labels with the truth; with one true state only the
    balanced accuracy says anything."""
    states = np.unique(truth)
    if not len(truth):
        return {"ari": None, "nmi": None, "balanced_accuracy": None, "windows": 0}
    recall = float(np.mean([(label[truth == s] == s).mean() for s in states]))
    two = len(states) > 1
    return {"ari": local.ari(truth, label) if two else None, "nmi": local.nmi(truth, label) if two else None, "balanced_accuracy": recall, "windows": len(truth)}


def delays(ends: np.ndarray, truth: np.ndarray, mapped: np.ndarray, test_start: int) -> list[int | None]:
    """Rows from each switch inside the test segments to the first right label; None
    if none comes before the next switch.  The switch at the test's start has a gap."""
    out = []
    for switch in range(test_start + SEGMENT, 4 * SEGMENT, SEGMENT):
        right = ends[(ends >= switch) & (ends < switch + SEGMENT) & (mapped == truth)]
        out.append(int(right[0] - switch) if len(right) else None)
    return out


def recover(suite: str, length: int, n_init: int, seed: int) -> Iterator[tuple[str, str, str, float | None]]:
    """Fit on the first two segments, map labels there, and judge the other two."""
    x, state = synthetic.recovery_stream(suite, seed, length=SEGMENT)
    wins, ends = local.windows(x, length, max(1, length // 5))
    starts, truth = ends - length + 1, state[ends]
    flips = np.cumsum(np.r_[0, np.diff(state) != 0])
    pure, train, test = flips[starts] == flips[ends], ends < 2 * SEGMENT, starts >= 2 * SEGMENT
    for name in METHODS:
        model = local.Method(name, 2, seed, n_init).fit(wins[train][::SUBSAMPLE])
        place = local.mapping(truth[train], model.predict(wins[train]), 2)
        mapped = place[model.predict(wins[test])]
        for part, rows in (("pure", pure[test]), ("mixed", ~pure[test])):
            for k, v in scores(truth[test][rows], mapped[rows]).items():
                yield name, part, k, v
        found = delays(ends[test], truth[test], mapped, 2 * SEGMENT)
        yield name, "delay", "events", len(found)
        for v in found:
            yield name, "delay", "censored" if v is None else "delay", 1 if v is None else v


def null(length: int, n_init: int, seed: int) -> Iterator[tuple[str, str, str, float | None]]:
    """Two states forced on one normal law; novelty is calibrated on a segment that
    no fit has seen."""
    x = 0.01 * np.random.default_rng(seed).standard_normal(4 * SEGMENT)
    stride = max(1, length // 5)
    wins, ends = local.windows(x, length, stride)
    starts = ends - length + 1
    train, held, test = ends < 2 * SEGMENT, (starts >= 2 * SEGMENT) & (ends < 3 * SEGMENT), starts >= 3 * SEGMENT
    for name in METHODS:
        one, two = (local.Method(name, 2, seed + s, n_init).fit(wins[train][::SUBSAMPLE]) for s in (0, 10_000))
        label, time = one.predict(wins[test]), local.dwell(one.predict(wins[test]))
        limit = np.quantile(one.nearest(wins[held]), 0.99)
        apart = None if len(one.centers) < 2 else float(np.sqrt(((one.centers[0] - one.centers[1]) ** 2).mean()))
        found = {
            "seed_ari": local.ari(label, two.predict(wins[test])), "switch_frequency": time["switch_frequency"], "mean_dwell_windows": time["mean_dwell"], "mean_dwell_rows": time["mean_dwell"] * stride,
            "novelty_rate": float((one.nearest(wins[test]) > limit).mean()), "centers_w2": apart, "validation_windows": int(held.sum()),
        }
        for k, v in found.items():
            yield name, "null", k, v


def repetitions(spark: SparkSession, cfg: Mapping[str, Any]) -> DataFrame:
    """Long rows (suite, length, rep, method, part, measure, value) of all runs."""
    c = config.validate(cfg, SCHEMA)
    if max(c["lengths"]) > SEGMENT:
        raise ValueError("a window is longer than a segment")
    runs = [(s, n, i) for s in (*SUITES, "stationary") for n in c["lengths"] for i in range(c["repeats"])]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        suite, length, rep = g.iloc[0].tolist()
        seed = c["seed"] + 100_000 * rep + length + (1_000 * SUITES.index(suite) if suite in SUITES else 50_000)
        rows = null(length, c["n_init"], seed) if suite == "stationary" else recover(suite, length, c["n_init"], seed)
        return pd.DataFrame([(suite, length, rep, *r) for r in rows], columns=["suite", "length", "rep", "method", "part", "measure", "value"])

    df = spark.createDataFrame(runs, "suite string, length int, rep int")
    return df.groupBy("suite", "length", "rep").applyInPandas(run, ROW)


def exact(cfg: Mapping[str, Any]) -> dict[str, Any]:
    """Shuffled blocks of two laws with equal first four moments: half to fit."""
    c = config.validate(cfg, SCHEMA)
    blocks, truth = synthetic.exact_moment_blocks(c["seed"])
    powers = np.array([[(b**k).mean() for k in range(1, 5)] for b in blocks])
    out: dict[str, Any] = {"block_length": blocks.shape[1], "max_first_four_moment_gap": float(np.abs(powers - powers[0]).max()), "w2_between_laws": float(np.sqrt(((np.sort(blocks[0]) - np.sort(blocks[1])) ** 2).mean())), "methods": {}}
    half = len(blocks) // 2
    for name in ("w2", "w1", "volatility", "moments"):
        model = local.Method(name, 2, c["seed"], c["n_init"]).fit(blocks[:half])
        mapped = local.mapping(truth[:half], model.predict(blocks[:half]), 2)[model.predict(blocks[half:])]
        out["methods"][name] = {"test_ari": local.ari(truth[half:], mapped), "test_balanced_accuracy": scores(truth[half:], mapped)["balanced_accuracy"], "effective_clusters": len(model.centers)}
    return out


def run(spark: SparkSession, cfg: Mapping[str, Any]) -> dict[str, Any]:
    """The suite as plain data: summaries over repetitions by suite, length, method."""
    long = repetitions(spark, cfg).cache()
    keys = ["suite", "length", "method", "part", "measure"]
    found = evaluate.replicate_summary(long, keys, "value").collect()
    counted = long.filter("part = 'delay'").groupBy("suite", "length", "method").agg(F.sum(F.when(F.col("measure") == "events", F.col("value"))).alias("events"), F.count_if(F.col("measure") == "censored").alias("censored")).collect()
    long.unpersist()
    out: dict[str, Any] = {"recovery": {}, "stationary": {}, "exact_moments": exact(cfg), "config": dict(cfg)}
    for r in found:
        spot = out["stationary"] if r["suite"] == "stationary" else out["recovery"].setdefault(r["suite"], {})
        method = spot.setdefault(str(r["length"]), {}).setdefault(r["method"], {})
        if r["part"] != "delay" or r["measure"] == "delay":
            method.setdefault(r["part"], {})[r["measure"]] = {k: r[k] for k in ("n", "mean", "least", "most", "standard_error")}
    for r in counted:
        spot = out["recovery"][r["suite"]][str(r["length"])][r["method"]].setdefault("delay", {})
        spot |= {"events": int(r["events"]), "censored": r["censored"], "detected": int(r["events"]) - r["censored"], "failure_rate": r["censored"] / r["events"] if r["events"] else None}
    return out
