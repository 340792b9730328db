"""K-medoids of multivariate windows under sliced W2.

Candidates are a bounded hash sample; their M x M costs and the search are on the
driver; all restarts' medoids are scored on the full data in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massflow.operators.geometry import blas_cost, matrix, power_cost, project, sliced_w2


@dataclass
class Medoids:
    medoids: np.ndarray
    ids: list[int]
    directions: np.ndarray
    scales: np.ndarray
    objective: float
    runs: list[dict] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        return sliced_w2(df, self.medoids, self.directions, self.scales)


def search(cost: np.ndarray, start: list[int], max_iter: int = 100) -> list[int]:
    """Alternate assignment and within-cluster medoids; only strict gains."""
    chosen = list(start)
    for _ in range(max_iter):
        label = cost[:, chosen].argmin(1)
        new = list(chosen)
        for j in range(len(chosen)):
            own = np.flatnonzero(label == j)
            if len(own):
                within = cost[np.ix_(own, own)].sum(0)
                now = cost[own, chosen[j]].sum()
                if within.min() < now:
                    new[j] = int(own[within.argmin()])
        if new == chosen:
            break
        chosen = new
    return chosen


def objectives(df: DataFrame, sets: list[np.ndarray], directions: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Summed squared distance to the nearest medoid, for each set."""
    flat = [project(s.reshape(len(s), -1), directions, scales) for s in sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(flat))
        for b in batches:
            x = matrix(b.column(0), 2)
            if len(x):
                z = project(x, directions, scales)
                out += [power_cost(z, c, 2).min(1).sum() for c in flat]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(out)], names=["run", "cost"])

    made = df.select("sample").mapInArrow(run, "run long, cost double").groupBy("run").agg(F.sum("cost").alias("cost"))
    return np.array([r["cost"] for r in sorted(made.collect(), key=lambda r: r["run"])])


def fit(df: DataFrame, k: int, directions: np.ndarray, scales: np.ndarray, candidates: int = 128, n_init: int = 3, seed: int = 0, id_col: str = "endpoint") -> Medoids:
    """The best of ``n_init`` restarts; those with fewer than k distinct
    candidates are skipped and logged in ``runs``."""
    scales = np.asarray(scales, float)
    runs, sets, ids = [], [], []
    own = df.select(F.col(id_col).cast("long").alias("id"), "sample")
    samples: dict[int, list] = {}

    def draw(r: int) -> None:
        samples[r] = own.orderBy(F.xxhash64(F.lit(seed + r), "id"), "id").limit(candidates).collect()

    threads = [InheritableThread(target=draw, args=(r,)) for r in range(n_init)]  # short jobs, side by side
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if len(samples) < n_init:
        raise RuntimeError("candidates could not be drawn")
    for r in range(n_init):
        rows = sorted(samples[r], key=lambda x: x["id"])
        found = np.array([x["sample"] for x in rows], float)
        z = project(found.reshape(len(found), -1), directions, scales) if len(found) else np.zeros((0, 1))
        distinct = np.sort(np.unique(z, axis=0, return_index=True)[1]) if len(z) else np.zeros(0, int)
        if len(distinct) < k:
            runs.append({"run": r, "skipped": True})
            continue
        start = np.random.default_rng(seed + r).choice(distinct, k, replace=False).tolist()
        cost = blas_cost(z, z)
        np.fill_diagonal(cost, 0)
        chosen = search(cost, start)
        runs.append({"run": r, "skipped": False})
        sets.append(found[chosen])
        ids.append([rows[i]["id"] for i in chosen])
    if not sets:
        raise ValueError("no restart has k distinct candidates")
    cost = objectives(df, sets, directions, scales)
    for run, value in zip([x for x in runs if not x["skipped"]], cost, strict=True):
        run["objective"] = float(value)
    best = int(cost.argmin())
    return Medoids(sets[best], ids[best], directions, scales, float(cost[best]), runs)
