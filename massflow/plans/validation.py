"""Robustness of a joint study's model on its validation windows, and synthetic
controls.  K and directions stay as the development chose them."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.operators import evaluate, geometry, lloyd, medoids, resample, windows
from massflow.plans import artifacts, config, inputs, joint, reports
from massflow.session import cut
from massflow.sources import files, synthetic

CONTROLS = ("gaussian_null", "student_null", "rare", "gradual")
CONTROL = {"length": 63, "stride": 5, "train": 1500, "held": 2250, "projections": 64, "direction_seed": 42, "null_candidates": 128, "n_init": 5, "null_k": 3, "k": 2}


def validated(cfg: Mapping[str, Any], market: Mapping[str, Any]) -> dict[str, Any]:
    c = config.validate(cfg, config.VALIDATION)
    if c["chronological_ends"][-1] > market["train_end"]:
        raise ValueError("a chronological refit cannot see rows after training")
    return c


def training_vectors(panel: DataFrame, train_end: str) -> DataFrame:
    """(idx, x): complete training rows, renumbered from 0."""
    rows = panel.filter((F.col("session_date") <= F.lit(train_end).cast("date")) & F.col("x").isNotNull()).select(F.lit(0).alias("k"), F.col("idx").alias("at"), "x")
    return cut(windows.dense_index(rows, ["k"], ["at"], F.floor(F.col("at") / windows.BLOCK)).select("idx", "x"))


def scales_of(vectors: DataFrame) -> np.ndarray:
    rows = vectors.select(F.posexplode("x").alias("asset", "v")).groupBy("asset").agg(F.stddev_pop("v").alias("s")).orderBy("asset").collect()
    return np.array([r["s"] for r in rows])


def fit_vectors(vectors: DataFrame, m: Mapping[str, Any], reference: medoids.Medoids, seed: int | None = None, candidates: int | None = None, scales: np.ndarray | None = None) -> tuple[medoids.Medoids, int]:
    """A refit on the windows of vectors, with scales of its own unless given."""
    wins = cut(windows.return_windows(vectors, m["length"], m["fit_stride"]))
    model = medoids.fit(wins, len(reference.medoids), reference.directions, scales_of(vectors) if scales is None else scales, candidates or m["candidates"], m["n_init"], m["seed"] if seed is None else seed)
    return model, wins.count()


def market(vectors: DataFrame, dates: DataFrame, anchors: DataFrame, reference: medoids.Medoids, m: Mapping[str, Any], c: Mapping[str, Any]) -> list[dict[str, Any]]:
    """Refits on resampled returns, shorter histories, other candidates and seeds, and
    contaminated returns; each judged by labels of the same anchors.  ``dates`` has the
    idx and session_date of the vectors."""
    spark, k, n = vectors.sparkSession, len(reference.medoids), vectors.count()
    base, out = cut(reference.transform(anchors).select("endpoint", "label")), []

    def record(kind: str, model: medoids.Medoids, wins: int, **more: Any) -> None:
        scored = model.transform(anchors)
        near = scored.agg(F.avg(F.col("nearest") * F.col("nearest")).alias("v")).first()["v"]
        out.append({"kind": kind, **more, **evaluate.partition_diagnostics(scored.select("endpoint", "label"), k, base), "training_windows": wins, "scales": model.scales, "runs": model.runs, "mean_squared_nearest": near})

    for block in c["block_lengths"]:
        for rep in range(c["bootstrap_repeats"]):
            drawn = cut(resample.draws(spark, n, 1, c["seed"] + 1_000 * rep + block, "stationary", block))
            model, wins = fit_vectors(cut(resample.resample(vectors, drawn).select("idx", "x")), m, reference)
            seams = windows.seam_windows(drawn.select(F.lit(0).alias("symbol"), F.col("pos").alias("idx"), "seam"), m["length"])
            crossing = seams.filter(F.pmod(F.col("endpoint") - (m["length"] - 1), F.lit(m["fit_stride"])) == 0).agg(F.count_if("crosses").alias("n")).first()["n"]
            record("return_bootstrap", model, wins, mean_block=block, repeat=rep, seams=drawn.filter("pos > 0").agg(F.count_if("seam").alias("n")).first()["n"], windows_crossing_seams=crossing)
    for end in c["chronological_ends"]:
        seen = cut(vectors.join(dates.filter(F.col("session_date") <= F.lit(end).cast("date")).select("idx"), "idx"))
        model, wins = fit_vectors(seen, m, reference)
        record("chronological", model, wins, train_end=end, training_returns=seen.count(), is_reference=end == m["train_end"])
    for budget in c["candidate_sizes"]:
        for seed in c["optimizer_seeds"]:
            model, wins = fit_vectors(vectors, m, reference, seed, budget, reference.scales)
            record("candidate_budget", model, wins, candidates=budget, seed=seed, is_reference=budget == m["candidates"] and seed == m["seed"])
    names = [f"x{i}" for i in range(len(reference.scales))]
    wide = vectors.select("idx", *[F.col("x")[i].alias(v) for i, v in enumerate(names)])
    for share in c["outlier_fractions"]:
        dirty = cut(resample.contaminate(wide, share, c["outlier_magnitude"], c["seed"], names))
        model, wins = fit_vectors(dirty.select("idx", F.array(*names).alias("x")), m, reference)
        record("training_outliers", model, wins, fraction=share, magnitude=c["outlier_magnitude"], contaminated_returns=dirty.agg(F.count_if("hit").alias("n")).first()["n"])
    return out


def recovery(train: tuple[np.ndarray, np.ndarray], test: tuple[np.ndarray, np.ndarray]) -> dict[str, Any]:
    """Recall of pure states in the test, by a mapping from training alone; each pair
    is (truth, label), truth -1 for mixed windows."""
    from massflow.functions import local

    for truth, _ in (train, test):
        if set(truth[truth >= 0]) != {0, 1}:
            raise ValueError("both pure states must appear")
    place = local.mapping(train[0][train[0] >= 0], train[1][train[0] >= 0], 2)
    truth, mapped = test[0], place[test[1]]
    recall = [float((mapped[truth == s] == s).mean()) for s in (0, 1)]
    pure = truth >= 0
    return {"mapping": place.tolist(), "recall": recall, "balanced_accuracy": float(np.mean(recall)), "pure_ari": float(local.ari(truth[pure], test[1][pure])), "pure_counts": np.bincount(truth[pure], minlength=2).tolist(), "mixed_windows": int((~pure).sum())}


def controls(spark: SparkSession, c: Mapping[str, Any]) -> list[dict[str, Any]]:
    """Joint and covariance clusterings of streams of known dependence."""
    p, out = CONTROL, []
    directions = geometry.unit_directions(p["projections"], 5, p["direction_seed"])
    for kind in CONTROLS:
        null = kind.endswith("null")
        for seed in c["synthetic_seeds"]:
            values, rho = synthetic.control_stream(kind, seed)
            stream = cut(synthetic.as_series(spark, values, kind).select("idx", "x"))
            spans = {"train": (0, p["train"]), "held": (p["train"], p["held"]), "test": (p["held"], len(values))}
            wins = {n: cut(windows.return_windows(stream.filter(F.col("idx").between(a, b - 1)), p["length"]).filter(F.col("endpoint") - (p["length"] - 1) >= a)) for n, (a, b) in spans.items()}
            fitted = cut(wins["train"].filter(F.pmod(F.col("endpoint") - (p["length"] - 1), F.lit(p["stride"])) == 0))
            scales, k = values[: p["train"]].std(0), p["null_k"] if null else p["k"]
            truth = {n: synthetic.pure_truth(rho[a:b], p["length"]) for n, (a, b) in spans.items()}
            for budget in [p["null_candidates"]] if null else c["candidate_sizes"]:
                for method in ("joint", "covariance"):
                    if method == "joint":
                        model = medoids.fit(fitted, k, directions, scales, budget, p["n_init"], seed)
                        scored = {n: cut(model.transform(w)) for n, w in wins.items()}
                    else:
                        model = lloyd.PanelKMeans("covariance", k, scales, p["n_init"], seed).fit(fitted)
                        scored = {n: cut(model.predict(w).withColumnRenamed("id", "endpoint").withColumn("nearest", F.array_min("distance"))) for n, w in wins.items()}
                    test = scored["test"].select("endpoint", "label")
                    row: dict[str, Any] = {"control": kind, "seed": seed, "candidates": budget, "method": method, "forced_k": k, "training_windows": fitted.count(), "test": evaluate.partition_diagnostics(test, k)}
                    if null:
                        limit = scored["held"].agg(F.percentile("nearest", F.lit(0.99)).alias("t")).first()["t"]
                        row |= {"novelty_threshold": limit, "novelty_fraction": scored["test"].agg(F.avg((F.col("nearest") > limit).cast("double")).alias("v")).first()["v"]}
                    else:
                        labels = {n: np.array([r["label"] for r in scored[n].select("endpoint", "label").orderBy("endpoint").collect()]) for n in ("train", "test")}  # 3,000 rows at most
                        row["recovery"] = recovery((truth["train"], labels["train"]), (truth["test"], labels["test"]))
                        if kind == "rare":
                            place = F.array(*[F.lit(v) for v in row["recovery"]["mapping"]])
                            start = synthetic.RARE_STARTS[-1]
                            mapped = test.withColumn("label", F.element_at(place, F.col("label") + 1))
                            row["delay"] = evaluate.episode_delay(mapped, 1, start, start + synthetic.RARE_LENGTH).first().asDict()
                    out.append(row)
    return out


def _reference(spark: SparkSession, m: Mapping[str, Any], development: str | Path) -> tuple[medoids.Medoids, DataFrame, DataFrame, str]:
    """The development's model, its panel, its validation windows and its digest."""
    _, manifest, _, digest = joint.parent(development, m)
    if manifest["data_identity"] != artifacts.identity(inputs.identity(spark, m["assets"], m["provider"], m["price_column"])):
        raise ValueError("the snapshots differ from those of the development")
    panel = inputs.panel(spark, m["assets"], m["price_column"], m["calendar"], m["validation_end"])
    anchors = cut(joint.split_windows(panel, m).filter("split = 'validation'").select("endpoint", "sample"))
    return files.load_model(Path(development) / "models" / "scaled_joint.json"), panel, anchors, digest


def refit_once(spark: SparkSession, market_cfg: Mapping[str, Any], development: str | Path, train_end: str, seed: int, candidates: int) -> dict[str, Any]:
    """One refit on returns up to a date, judged on the development's validation windows."""
    m = joint.validated(market_cfg)
    if train_end > m["train_end"]:
        raise ValueError("a refit cannot see rows after training")
    reference, panel, anchors, digest = _reference(spark, m, development)
    vectors = training_vectors(panel, train_end)
    model, wins = fit_vectors(vectors, m, reference, seed, candidates)
    k = len(reference.medoids)
    row = evaluate.partition_diagnostics(model.transform(anchors).select("endpoint", "label"), k, reference.transform(anchors).select("endpoint", "label"))
    return {"train_end": train_end, "seed": seed, "candidates": candidates, "parent": digest, "training_returns": vectors.count(), "training_windows": wins, "scales": model.scales.tolist(), **row}


def run(spark: SparkSession, cfg: Mapping[str, Any], market_cfg: Mapping[str, Any], development: str | Path, root: str | Path) -> Path:
    """All checks of a sealed development, as a sealed directory with a page."""
    m = joint.validated(market_cfg)
    c = validated(cfg, m)
    reference, panel, anchors, digest = _reference(spark, m, development)
    if min(c["candidate_sizes"]) < len(reference.medoids):
        raise ValueError("there are fewer candidates than clusters")
    own = {"config": c, "market": m, "parent": digest, "sources": artifacts.sources()}
    target = Path(root) / f"joint-validation-{artifacts.artifact_id(own)}"
    if target.exists():
        artifacts.verify(target)
        return target
    if anchors.limit(2).count() < 2:
        raise ValueError("there are too few validation windows")
    vectors = training_vectors(panel, m["train_end"])
    complete = panel.filter((F.col("session_date") <= F.lit(m["train_end"]).cast("date")) & F.col("x").isNotNull()).select(F.lit(0).alias("k"), F.col("idx").alias("at"), "session_date")
    dates = windows.dense_index(complete, ["k"], ["at"], F.floor(F.col("at") / windows.BLOCK)).select("idx", "session_date")
    found = {"market": market(vectors, dates, anchors, reference, m, c), "synthetic": controls(spark, c)}
    with artifacts.publish(target) as tmp:
        files.write_json(tmp / "config.json", {"validation": c, "market": m})
        files.write_json(tmp / "manifest.json", own | {"dependencies": artifacts.provenance(), "reference_k": len(reference.medoids)})
        files.write_json(tmp / "metrics.json", found)
        rows = [{k: r.get(k) for k in ("kind", "mean_block", "repeat", "train_end", "candidates", "seed", "fraction", "ari", "occupied")} for r in found["market"]]
        reports.page("Robustness of a joint study", "Validation windows only; no interval and no forecast.", {"Refits": reports.table(rows)}, found, tmp / "report.html")
    return target
