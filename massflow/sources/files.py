"""Price files, tables, models and reports on disk."""

from __future__ import annotations

import hashlib
import html
import json
import math
import os
import re
from pathlib import Path
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_sha256(spark: SparkSession, path: str) -> str:
    """The hash of a file's raw bytes, read through Spark."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]


def price_csv(spark: SparkSession, path: str, symbol: str, date_column: str = "Date", price_column: str = "Adj Close") -> DataFrame:
    """(symbol, session_date, price) of a CSV file; other columns are ignored."""
    raw = spark.read.option("header", True).option("mode", "FAILFAST").csv(path)
    missing = [c for c in (date_column, price_column) if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(F.lit(symbol).alias("symbol"), F.to_date(F.col(f"`{date_column}`")).alias("session_date"), F.col(f"`{price_column}`").try_cast("double").alias("price"))


def sidecars(spark: SparkSession, paths: list[str]) -> dict[str, tuple[str, dict]]:
    """The hash of each file's raw bytes and what its JSON sidecar says."""
    every = spark.read.format("binaryFile").load([x for p in paths for x in (p, f"{p}.json")])
    side = F.col("path").endswith(".json")
    rows = every.select("path", F.sha2("content", 256).alias("hash"), F.when(side, F.col("content").cast("string")).alias("text")).collect()  # few, named files
    by_name = {unquote(re.sub("^[a-z0-9]+:/*", "/", r["path"])): r for r in rows}
    at = lambda p: by_name[re.sub("^[a-z0-9]+:/*", "/", p) if ":" in p else os.path.abspath(p)]
    return {p: (at(p)["hash"], json.loads(at(f"{p}.json")["text"])) for p in paths}


def check_sidecar(spark: SparkSession, path: str, symbol: str) -> str:
    """The file's hash, if its JSON sidecar agrees on symbol and hash."""
    own, side = sidecars(spark, [path])[path]
    if side.get("symbol") != symbol or side.get("sha256", side.get("dataset_sha256")) != own:
        raise ValueError(f"{path} does not match its sidecar")
    return own


def json_safe(value):
    """Plain Python, NaN and infinities as null."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, np.ndarray):
        return json_safe(value.tolist())
    if isinstance(value, np.generic):
        return json_safe(value.item())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value


def write_json(path: str | Path, value) -> None:
    """Sorted keys; the file appears whole or not at all."""
    path = Path(path)
    tmp = path.with_name(f".{path.name}.{os.getpid()}")
    with tmp.open("w") as f:
        f.write(json.dumps(json_safe(value), sort_keys=True, indent=1, allow_nan=False))
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


_FEATURE = {"k", "n_init", "seed", "max_iter", "scaled", "mean", "scale", "converged", "prototypes"}
KINDS = {
    "lloyd": {"centers", "objective", "history", "n_iter", "converged", "p"}, "medoids": {"medoids", "ids", "directions", "scales", "objective", "runs"}, "hmm": {"start", "trans", "means", "covs", "shift", "scale", "loglik", "converged", "terminal"},
    "feature_kmeans": _FEATURE | {"centers"}, "panel_kmeans": _FEATURE | {"centers", "kind", "scales", "shape"}, "feature_gmm": _FEATURE | {"tol", "weights", "means", "covs"},
}
_ARRAYS = ("centers", "medoids", "directions", "scales", "start", "trans", "means", "covs", "shift", "scale", "terminal", "mean", "prototypes", "weights")


def save_model(path: str | Path, kind: str, model) -> None:
    """A model's fields as JSON; numbers keep all their digits."""
    fields = {k: getattr(model, k) for k in KINDS[kind]}
    write_json(path, {"kind": kind, "fields": fields})


def _check(kind: str, f: dict) -> None:
    """Shapes and ranges that a model of a kind must have."""
    rows = lambda x, width: x.ndim == 2 and len(x) and x.shape[1] == width
    if kind == "lloyd":
        c = f["centers"]
        ok = c.ndim == 2 and (np.diff(c, axis=1) >= 0).all() and f["p"] in (1, 2) and math.isclose(f["history"][-1], f["objective"], rel_tol=1e-9)
    elif kind == "medoids":
        ok = f["medoids"].ndim == 3 and len(f["ids"]) == len(f["medoids"]) and (f["scales"] > 0).all() and len(f["scales"]) == f["medoids"].shape[2] == f["directions"].shape[1] and np.abs((f["directions"] ** 2).sum(1) - 1).max() <= 1e-12
    elif kind == "hmm":
        ok = np.allclose(f["trans"].sum(1), 1) and np.isclose(f["start"].sum(), 1) and (f["scale"] > 0).all()
    else:
        width = len(f["mean"])
        ok = f["scale"].shape == f["mean"].shape and (f["scale"] > 0).all()
        if kind == "feature_gmm":
            ok = ok and rows(f["means"], width) and f["covs"].shape == (len(f["means"]), width, width) and np.isclose(f["weights"].sum(), 1) and len(f["weights"]) == len(f["means"])
        else:
            ok = ok and rows(f["centers"], width)
        if kind == "panel_kmeans":
            length, dims = f["shape"]
            ok = ok and f["scales"].shape == (dims,) and (f["scales"] > 0).all() and width == {"marginal": length * dims, "covariance": dims * (dims + 1) // 2, "correlation": dims * (dims - 1) // 2}[f["kind"]]
    if not ok:
        raise ValueError(f"the parts of this {kind} do not fit together")


def load_model(path: str | Path):
    """Reads and checks a model: exact fields, finite arrays, shapes."""
    from massflow.operators import hmm, lloyd, medoids, mixture

    makers = {"lloyd": lloyd.Fit, "medoids": medoids.Medoids, "hmm": hmm.Hmm, "feature_kmeans": lloyd.FeatureKMeans, "panel_kmeans": lloyd.PanelKMeans, "feature_gmm": mixture.FeatureGmm}
    data = json.loads(Path(path).read_text())
    if not isinstance(data, dict) or set(data) != {"kind", "fields"} or data["kind"] not in KINDS or set(data["fields"]) != KINDS[data["kind"]]:
        raise ValueError("not a model file of a known kind")
    f = dict(data["fields"])
    f |= {k: np.array(f[k], float) for k in _ARRAYS if f.get(k) is not None}
    if any(not np.isfinite(f[k]).all() for k in _ARRAYS if f.get(k) is not None):
        raise ValueError("a model's numbers must be finite")
    _check(data["kind"], f)
    maker = makers[data["kind"]]
    if data["kind"] in ("lloyd", "medoids", "hmm"):
        return maker(**f)
    model = maker.__new__(maker)
    model.__dict__.update(f)
    return model


def bars_svg(values: dict[str, float], width: int = 480) -> str:
    top = max([abs(v) for v in values.values()] + [1e-300])
    rows = [
        f'<text x="0" y="{18 * i + 13}" font-size="12">{html.escape(str(k))}</text><rect x="140" y="{18 * i + 3}" width="{max(0, abs(v) / top * (width - 240)):.1f}" height="12" fill="#557"/><text x="{width - 90}" y="{18 * i + 13}" font-size="12">{v:.6g}</text>'
        for i, (k, v) in enumerate(values.items())
    ]
    return f'<svg width="{width}" height="{18 * len(values) + 6}">{"".join(rows)}</svg>'


def report(title: str, tables: dict[str, DataFrame], path: str | Path, rows: int = 200) -> None:
    """An HTML page of small aggregate tables, with a bar chart of each first
    number column; texts are escaped, nothing is fitted."""
    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        pdf = df.limit(rows).toPandas()
        cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in pdf.itertuples(index=False))
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in pdf)}</tr>{cells}</table>")
        numbers = pdf.select_dtypes("number").columns
        if len(numbers) and len(pdf):
            parts.append(bars_svg({str(i if not len(pdf.columns) else pdf.iloc[i, 0]): float(pdf[numbers[-1]].iloc[i]) for i in range(len(pdf)) if pdf[numbers[-1]].notna().iloc[i]}))
    Path(path).write_text(f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>{''.join(parts)}")
