"""Frozen bundles: a model of a sealed development with its contract, and scoring of
later windows by the contract alone."""

from __future__ import annotations

import json
import shutil
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.operators import splits, windows
from massflow.operators.medoids import Medoids
from massflow.plans import artifacts, config, inputs, joint
from massflow.session import cut
from massflow.sources import files

#: Modules whose numbers a frozen model depends on.
NUMERICAL = ("operators/geometry.py", "operators/medoids.py", "operators/windows.py", "operators/splits.py", "operators/ingest.py")


def numerical_sources() -> dict[str, str]:
    every = artifacts.sources()
    return {n: every[n] for n in NUMERICAL}


def check(contract: Mapping[str, Any]) -> dict[str, Any]:
    """The contract, if it is whole and this code and machine may serve it."""
    c = config.validate(contract, config.CONTRACT)
    config.ordered(c, "train_end", "calibration_end")
    if c["numerical_sources"] != numerical_sources():
        raise ValueError("the code of the numbers has changed since the model was frozen")
    if c["dependencies"] != artifacts.provenance():
        raise ValueError("dependencies have changed since the model was frozen")
    return c


def load(bundle: str | Path) -> tuple[dict[str, Any], Medoids]:
    bundle = Path(bundle)
    artifacts.verify(bundle)
    c = check(json.loads((bundle / "contract.json").read_text()))
    model = files.load_model(bundle / "model.json")
    if not isinstance(model, Medoids) or model.medoids.shape[1:] != (c["length"], len(c["symbols"])):
        raise ValueError("the model does not have the contract's shape")
    return c, model


def freeze(development: str | Path, root: str | Path, model: str = "scaled_joint") -> Path:
    """Publish a bundle; the sealed parent must be the same before and after."""
    dev = Path(development)
    c, manifest, metrics, digest = joint.parent(dev)
    if model not in joint.JOINT_MODELS:
        raise ValueError(f"only {' and '.join(joint.JOINT_MODELS)} can be frozen")
    names = [a["symbol"] for a in c["assets"]]
    if names != manifest["symbol_order"]:
        raise ValueError("the order of assets differs within the development")
    contract = check({
        "version": 1, "symbols": names, "length": c["length"], "provider": c["provider"], "price_column": c["price_column"], "return_basis": "adjusted_close", "calendar": c["calendar"], "train_end": c["train_end"],
        "calibration_end": c["validation_end"], "novelty_threshold": metrics["calibration"][model], "model": model, "parent": digest, "numerical_sources": numerical_sources(), "dependencies": manifest["dependencies"],
    })
    own = artifacts.sha256(dev / "models" / f"{model}.json")
    name = f"bundle-{artifacts.identity({'contract': contract, 'model': own})[:24]}"
    target = Path(root) / name
    with artifacts.locked(Path(root) / ".locks" / name):
        if not target.exists():
            with artifacts.publish(target) as tmp:
                shutil.copyfile(dev / "models" / f"{model}.json", tmp / "model.json")
                files.write_json(tmp / "contract.json", contract)
                if artifacts.verify(dev) != digest or artifacts.sha256(tmp / "model.json") != own:
                    raise ValueError("the development changed while the bundle was written")
        elif artifacts.verify(dev) != digest:
            raise ValueError("the development has changed")
        load(target)
    return target


def score(panel: DataFrame, symbols: list[str], contract: Mapping[str, Any], model: Medoids, start: str, end: str, as_of: str) -> tuple[DataFrame, dict[str, Any]]:
    """Labels, nearest distances and novelty of complete windows that end in [start,
    end], begin after training and were available; ``calibration_reuse`` marks those
    that end in the calibration period.  Nothing is fitted."""
    c = check(contract)
    if symbols != c["symbols"]:
        raise ValueError("assets or their order differ from the contract")
    first, last, ready = splits.iso_date(start), splits.iso_date(end), splits.moment(as_of)
    if first > last:
        raise ValueError("scoring starts after its end")
    asked = cut(windows.joint_windows(panel, c["length"]).filter(F.col("session_date").between(F.lit(first), F.lit(last))))
    kept, counts = splits.as_of(asked, c["train_end"], ready.replace(tzinfo=None).isoformat(" "))
    n = counts.first().asDict()
    if not n["scored"]:
        raise ValueError("no complete window is available after training")
    made = model.transform(kept).select("endpoint", "session_date", "price_start", "price_end", "available_at", F.col("label").alias("state"), F.col("nearest").alias("nearest_distance"))
    made = cut(made.withColumns({"novelty": F.col("nearest_distance") > c["novelty_threshold"], "calibration_reuse": F.col("session_date") <= F.lit(splits.iso_date(c["calibration_end"]))}))
    k = len(model.medoids)
    total = made.agg(*[F.count_if(F.col("state") == j).alias(f"n{j}") for j in range(k)], F.avg(F.col("novelty").cast("double")).alias("novel"), F.max("calibration_reuse").alias("reuse"), F.min("session_date").alias("lo"), F.max("session_date").alias("hi")).first()
    summary = {
        "windows": n["scored"], "counts": [total[f"n{j}"] for j in range(k)], "novelty_fraction": total["novel"], "excluded_training_overlap": n["overlap_training"], "excluded_unavailable": n["not_available"],
        "novelty_reading": "retrospective, in the calibration period" if total["reuse"] else "after calibration", "point_in_time": False, "period": [str(total["lo"]), str(total["hi"])],
    }
    return made, summary


def score_snapshots(spark: SparkSession, bundle: str | Path, cfg: Mapping[str, Any]) -> tuple[DataFrame, dict[str, Any]]:
    """``score`` of the snapshots that a configuration names."""
    c, model = load(bundle)
    s = config.validate(cfg, config.SCORE)
    if (s["provider"], s["price_column"]) != (c["provider"], c["price_column"]):
        raise ValueError("provider or price column differ from the contract")
    names = [a["symbol"] for a in s["assets"]]
    if names != c["symbols"]:
        raise ValueError("assets or their order differ from the contract")
    panel = inputs.panel(spark, s["assets"], s["price_column"], c["calendar"], s["end"])
    return score(panel, names, c, model, s["start"], s["end"], s["as_of"])

