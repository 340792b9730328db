"""Studies of a joint panel: development on training and validation windows,
assessment of the sealed result on later windows, sensitivity and baselines."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.operators import evaluate, geometry, hmm, lloyd, medoids, resample, splits, windows
from massflow.plans import artifacts, config, inputs, reports
from massflow.session import cut
from massflow.sources import files

JOINT_MODELS, BASELINES = ("scaled_joint", "raw_joint"), ("marginal", "covariance", "correlation")
MODELS = (*JOINT_MODELS, *BASELINES, "hmm")
CALIBRATION = 0.99


def validated(cfg: Mapping[str, Any]) -> dict[str, Any]:
    c = config.validate(cfg, config.JOINT)
    config.ordered(c, "train_end", "validation_end", "assessment_end")
    if c["candidates"] < max(c["ks"]):
        raise ValueError("there are fewer candidates than clusters")
    return c


def split_windows(panel: DataFrame, c: Mapping[str, Any]) -> DataFrame:
    return splits.split(windows.joint_windows(panel, c["length"]), c["train_end"], c["validation_end"], c["assessment_end"])


def training_scales(panel: DataFrame, train_end: str) -> np.ndarray:
    """Population deviation of each asset over complete training rows."""
    rows = panel.filter((F.col("session_date") <= F.lit(train_end).cast("date")) & F.col("x").isNotNull()).select(F.posexplode("x").alias("asset", "v"))
    scales = np.array([r["s"] for r in rows.groupBy("asset").agg(F.stddev_pop("v").alias("s")).orderBy("asset").collect()])
    if not len(scales) or not (scales > 0).all():
        raise ValueError("an asset does not vary in training")
    return scales


def sliced_silhouette(labelled: DataFrame, directions: np.ndarray, scales: np.ndarray) -> float | None:
    """Silhouette under the sliced distance of a bounded sample (endpoint, label, sample)."""
    z = geometry.with_arrays(labelled.select("endpoint", "label", "sample"), "sample", [geometry.T.StructField("z", geometry.ARRAY)], lambda x: [geometry.list_column(geometry.project(x, directions, scales))], ["endpoint", "label"], inner=2)
    return evaluate.silhouette(z.select(F.col("endpoint").alias("id"), "label", F.col("z").alias("sample")))


def fit_models(panel: DataFrame, wins: DataFrame, c: Mapping[str, Any]) -> tuple[dict[str, Any], dict[str, Any]]:
    """All models at the K of best validation silhouette (smaller on ties)."""
    train = cut(splits.every(wins.filter("split = 'train'").select("endpoint", "sample"), c["fit_stride"]))
    dims = len(c["assets"])
    scales, directions = training_scales(panel, c["train_end"]), geometry.unit_directions(c["projections"], dims, c["seed"])
    sample = wins.filter("split = 'validation'").select("endpoint", "sample").orderBy(F.xxhash64(F.lit(c["seed"]), "endpoint"), "endpoint").limit(c["selection_sample"])
    anchors = cut(sample)
    tried, selection = {}, []
    for k in sorted(c["ks"]):
        tried[k] = medoids.fit(train, k, directions, scales, c["candidates"], c["n_init"], c["seed"])
        labelled = tried[k].transform(anchors)
        selection.append({"k": k, "silhouette": sliced_silhouette(labelled, directions, scales), "occupied": labelled.select("label").distinct().count()})
    usable = [r for r in selection if r["silhouette"] is not None]
    if not usable:
        raise ValueError("no K gives two clusters on validation windows")
    k = max(usable, key=lambda r: (r["silhouette"], -r["k"]))["k"]
    models: dict[str, Any] = {"scaled_joint": tried[k], "raw_joint": medoids.fit(train, k, directions, np.ones(dims), c["candidates"], c["n_init"], c["seed"])}
    for kind in BASELINES:
        models[kind] = lloyd.PanelKMeans(kind, k, scales, c["baseline_n_init"], c["seed"]).fit(train)
    rows = panel.filter((F.col("session_date") <= F.lit(c["train_end"]).cast("date")) & F.col("x").isNotNull()).orderBy("idx").select("x").collect()  # one training series
    models["hmm"] = hmm.fit(panel.sparkSession, np.array([r["x"] for r in rows]), k, c["hmm_n_init"], c["seed"], max_iter=c["hmm_max_iter"])
    note = {"k": k, "selection": selection, "scales": scales, "training_windows": train.count(), "hmm_loglik": models["hmm"].loglik, "hmm_converged": models["hmm"].converged}
    return models, note


def save_models(models: Mapping[str, Any], folder: Path) -> None:
    folder.mkdir()
    for name, model in models.items():
        files.save_model(folder / f"{name}.json", "medoids" if name in JOINT_MODELS else "hmm" if name == "hmm" else "panel_kmeans", model)


def load_models(folder: Path) -> dict[str, Any]:
    return {name: files.load_model(folder / f"{name}.json") for name in MODELS}


def calibrate(models: Mapping[str, Any], wins: DataFrame, quantile: float = CALIBRATION) -> dict[str, float]:
    """Quantile of the nearest distance of validation windows, for joint models."""
    held = wins.filter("split = 'validation'").select("endpoint", "sample")
    return {name: models[name].transform(held).agg(F.percentile("nearest", F.lit(quantile)).alias("t")).first()["t"] for name in JOINT_MODELS}


def assignments(models: Mapping[str, Any], panel: DataFrame, wins: DataFrame) -> DataFrame:
    """Windows with a label column for each model, and nearest distances of the joint
    ones.  The hidden Markov model filters the whole panel causally."""
    out = wins.select("endpoint", "session_date", "price_start", "price_end", "available_at")
    for name, model in models.items():
        if name == "hmm":
            states = hmm.causal_filter(panel.filter("x IS NOT NULL").withColumn("k", F.lit("panel")), model, ["k"], "x")
            found = states.select(F.col("idx").alias("endpoint"), F.col("state").alias(name))
        elif name in JOINT_MODELS:
            found = model.transform(wins.select("endpoint", "sample")).select("endpoint", F.col("label").alias(name), F.col("nearest").alias(f"{name}_nearest"))
        else:
            found = model.predict(wins).select(F.col("id").alias("endpoint"), F.col("label").alias(name))
        out = out.join(found, "endpoint")
    return out


def _spread(x: np.ndarray, length: int, dims: int) -> list:
    z = x.reshape(len(x), length, dims)
    return [geometry.pa.array(z.std(1).mean(1)), geometry.pa.array(geometry.panel_features(z, "correlation").mean(1))]


def summaries(table: DataFrame, wins: DataFrame, models: Mapping[str, Any], c: Mapping[str, Any], k: int, calibration: Mapping[str, float]) -> dict[str, Any]:
    """Occupancy, agreement with the scaled joint model, dwell, contemporaneous
    volatility and correlation by state, and novelty, of every model."""
    length, dims = c["length"], len(c["assets"])
    double = geometry.T.DoubleType()
    spread = geometry.with_arrays(wins.select("endpoint", "sample"), "sample", [geometry.T.StructField("vol", double), geometry.T.StructField("corr", double)], lambda x: _spread(x, length, dims), ["endpoint"], inner=2)
    both, out = cut(table.join(spread, "endpoint")), {}
    if both.isEmpty():
        raise ValueError("there are no windows to judge")
    for name in models:
        labels = both.select("endpoint", F.col(name).alias("label"))
        row = evaluate.partition_diagnostics(labels, k, both.select("endpoint", F.col("scaled_joint").alias("label")))
        by = {r["label"]: r for r in both.groupBy(F.col(name).alias("label")).agg(F.count("*").alias("n"), F.avg("vol").alias("vol"), F.avg("corr").alias("corr")).collect()}
        row["contemporaneous"] = [{"state": j, "n": by[j]["n"] if j in by else 0, "mean_asset_volatility": by[j]["vol"] if j in by else None, "mean_pair_correlation": by[j]["corr"] if j in by else None} for j in range(k)]
        if name in JOINT_MODELS:
            row |= {"novelty_threshold": calibration[name], "novelty_fraction": both.agg(F.avg((F.col(f"{name}_nearest") > calibration[name]).cast("double")).alias("v")).first()["v"]}
        out[name] = row
    return out


def sensitivity(wins: DataFrame, model: medoids.Medoids, c: Mapping[str, Any]) -> dict[str, Any]:
    """Validation labels after refits with other directions, and on block-resampled
    training windows, at fixed K and scales."""
    train = cut(splits.every(wins.filter("split = 'train'").select("endpoint", "sample"), c["fit_stride"]))
    held = cut(wins.filter("split = 'validation'").select("endpoint", "sample"))
    reference, k = cut(model.transform(held).select("endpoint", "label")), len(model.medoids)
    out: dict[str, Any] = {"projections": [], "window_block_bootstrap": []}
    for count in c["projection_counts"]:
        for seed in c["projection_seeds"]:
            again = medoids.fit(train, k, geometry.unit_directions(count, len(c["assets"]), seed), model.scales, c["candidates"], c["n_init"], c["seed"])
            out["projections"].append({"projections": count, "seed": seed} | evaluate.partition_diagnostics(again.transform(held), k, reference))
    numbered = windows.dense_index(train.withColumn("k", F.lit(0)), ["k"], ["endpoint"], F.floor(F.col("endpoint") / windows.BLOCK)).drop("k", "endpoint")
    n = numbered.count()
    for rep in range(c["bootstrap_repeats"]):
        drawn = resample.draws(train.sparkSession, n, 1, c["seed"] + 100 + rep, "moving", c["bootstrap_block_windows"])
        rows = cut(resample.resample(numbered, drawn).select(F.col("idx").alias("endpoint"), "sample"))
        again = medoids.fit(rows, k, model.directions, model.scales, c["candidates"], c["n_init"], c["seed"])
        out["window_block_bootstrap"].append({"repeat": rep} | evaluate.partition_diagnostics(again.transform(held), k, reference))
    return out


def _write(folder: Path, c: Mapping[str, Any], manifest: Mapping[str, Any], metrics: Mapping[str, Any], table: DataFrame) -> None:
    files.write_json(folder / "config.json", c)
    files.write_json(folder / "manifest.json", manifest)
    files.write_json(folder / "metrics.json", metrics)
    table.coalesce(1).write.parquet(str(folder / "assignments.parquet"))  # a row a window of one panel
    reports.study("Joint study", metrics["models"], folder / "report.html")


def _manifest(stage: str, c: Mapping[str, Any], read: Any, **more: Any) -> dict[str, Any]:
    return {"stage": stage, "exposure": c["exposure"], "symbol_order": [a["symbol"] for a in c["assets"]], "data_identity": artifacts.identity(read), "data": read, "sources": artifacts.sources(), "dependencies": artifacts.provenance(), **more}


def develop(spark: SparkSession, cfg: Mapping[str, Any], root: str | Path) -> Path:
    """Fit, calibrate and judge on rows up to ``validation_end``; later rows are
    dropped as they are read.  The sealed directory is named by what went in."""
    c = validated(cfg)
    read = inputs.identity(spark, c["assets"], c["provider"], c["price_column"])
    target = Path(root) / f"joint-{artifacts.artifact_id({'config': c, 'data': read, 'sources': artifacts.sources(), 'dependencies': artifacts.provenance()})}" / "development"
    if target.exists():
        artifacts.verify(target)
        return target
    panel = inputs.panel(spark, c["assets"], c["price_column"], c["calendar"], c["validation_end"])
    wins = cut(split_windows(panel, c))
    with artifacts.publish(target) as tmp:
        models, note = fit_models(panel, wins, c)
        save_models(models, tmp / "models")
        models = load_models(tmp / "models")  # what was saved is what is judged
        calibration = calibrate(models, wins)
        held = wins.filter("split = 'validation'")
        table = cut(assignments(models, panel, held))
        metrics = {"stage": "development", "fit": note, "calibration": calibration, "models": summaries(table, held, models, c, note["k"], calibration), "sensitivity": sensitivity(wins, models["scaled_joint"], c)}
        _write(tmp, c, _manifest("development", c, read), metrics, table)
    return target


def parent(path: str | Path, cfg: Mapping[str, Any] | None = None) -> tuple[dict, dict, dict, str]:
    """Config, manifest and metrics of a sealed development, and its digest; sources
    and dependencies must be the ones that made it, and so the config if given."""
    path = Path(path)
    digest = artifacts.verify(path)
    c, manifest, metrics = (json.loads((path / f"{n}.json").read_text()) for n in ("config", "manifest", "metrics"))
    if manifest["stage"] != "development" or (cfg is not None and c != dict(cfg)):
        raise ValueError("this is not the development of that protocol")
    if manifest["sources"] != artifacts.sources() or manifest["dependencies"] != artifacts.provenance():
        raise ValueError("sources or dependencies differ from those of the development")
    return c, manifest, metrics, digest


def assess(spark: SparkSession, cfg: Mapping[str, Any], development: str | Path) -> Path:
    """Score later windows with the development's models; nothing is fitted."""
    c = validated(cfg)
    dev = Path(development)
    _, manifest, known, digest = parent(dev, c)
    read = inputs.identity(spark, c["assets"], c["provider"], c["price_column"])
    if artifacts.identity(read) != manifest["data_identity"]:
        raise ValueError("the snapshots differ from those of the development")
    target = dev.parent / "assessment"
    if target.exists():
        artifacts.verify(target)
        if json.loads((target / "manifest.json").read_text())["development"] != digest:
            raise ValueError("the assessment at hand is of another development")
        return target
    panel = inputs.panel(spark, c["assets"], c["price_column"], c["calendar"], c["assessment_end"])
    held = cut(split_windows(panel, c).filter("split = 'test'"))
    models = load_models(dev / "models")
    table = cut(assignments(models, panel, held))
    metrics = {"stage": "assessment", "fit": known["fit"], "calibration": known["calibration"], "models": summaries(table, held, models, c, known["fit"]["k"], known["calibration"]), "sensitivity": None}
    with artifacts.publish(target) as tmp:
        _write(tmp, c, _manifest("assessment", c, read, development=digest), metrics, table)
    return target
