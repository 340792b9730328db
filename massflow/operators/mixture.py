"""Gaussian mixtures on feature arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from massflow.operators import lloyd
from massflow.operators.geometry import ARRAY, T, list_column, matrix, power_cost, with_arrays
from massflow.operators.lloyd import FeatureKMeans


def log_parts(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Logarithm of weight times density, rows x components."""
    out = np.empty((len(x), len(means)))
    for j, (m, c) in enumerate(zip(means, covs, strict=True)):
        low = np.linalg.cholesky(c)
        y = np.linalg.solve(low, (x - m).T)
        out[:, j] = np.log(weights[j]) - 0.5 * ((y * y).sum(0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
    return out


def shares(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of components, and the log density of each row."""
    top = parts.max(1, keepdims=True)
    total = top + np.log(np.exp(parts - top).sum(1, keepdims=True))
    return np.exp(parts - total), total[:, 0]


def _sums(q: DataFrame, k: int, weigh) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Over all rows of ``q``: weights, weighted sums and products of each component,
    and the log likelihood; ``weigh`` maps a matrix to (weights, log densities).  A
    task sends k rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, flat, ll = np.zeros(k), None, 0.0
        for b in batches:
            x = matrix(b.column(0))
            if len(x):
                w, density = weigh(x)
                n += w.sum(0)
                ll += float(density.sum())
                own = np.hstack([w.T @ x, np.einsum("nk,ni,nj->kij", w, x, x, optimize=True).reshape(k, -1)])
                flat = own if flat is None else flat + own
        if flat is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(n), list_column(flat), pa.array([ll] + [0.0] * (k - 1))], names=["j", "n", "s", "ll"])

    rows = sorted(q.select("q").mapInArrow(run, "j long, n double, s array<double>, ll double").collect(), key=lambda r: (r["j"], r["n"], r["ll"]))
    each = [[r for r in rows if r["j"] == j] for j in range(k)]
    n = np.array([sum(r["n"] for r in e) for e in each])
    flat = np.stack([np.sum([r["s"] for r in e], 0) for e in each])
    dims = int((np.sqrt(1 + 4 * flat.shape[1]) - 1) / 2)
    return n, flat[:, :dims], flat[:, dims:].reshape(k, dims, dims), sum(r["ll"] for r in rows)


class FeatureGmm(FeatureKMeans):
    """Standardised features and a Gaussian mixture with whole covariances: the
    likeliest of ``n_init`` runs, each from a k-means fit of its own seed.  Runs end
    when the mean log density gains under ``tol``."""

    RIDGE = 1e-6

    def __init__(self, k: int, n_init: int = 20, seed: int = 0, max_iter: int = 100, tol: float = 1e-3):
        super().__init__(k, n_init, seed, max_iter)
        self.tol = tol

    def _run(self, q: DataFrame, k: int, seed: int) -> tuple[float, bool, tuple[np.ndarray, ...]]:
        centers = lloyd.fit(q, k, 2, seed=seed).centers

        def hard(x: np.ndarray):
            return np.eye(k)[power_cost(x, centers, 2).argmin(1)], np.zeros(len(x))

        weigh, last, done = hard, -np.inf, False
        for _ in range(self.max_iter + 1):
            n, s, ss, ll = _sums(q, k, weigh)
            total = n.sum()
            if weigh is not hard:
                done = ll / total - last < self.tol
                last = ll / total
                if done:
                    break
            n = n + 10 * np.finfo(float).eps
            means = s / n[:, None]
            covs = ss / n[:, None, None] - means[:, :, None] * means[:, None, :] + self.RIDGE * np.eye(s.shape[1])
            now = (n / n.sum(), means, covs)
            weigh = lambda x, now=now: shares(log_parts(x, *now))
        return last, done, now

    def fit(self, df: DataFrame, id_col: str, features: str = "features", sample: str = "sample") -> FeatureGmm:
        k = self._standards(df, id_col, features)
        q = self._scaled(df, id_col, features).cache()
        runs = [self._run(q, k, self.seed + i) for i in range(self.n_init if k > 1 else 1)]
        _, self.converged, (self.weights, self.means, self.covs) = max(runs, key=lambda r: r[0])
        labels = self.predict(df, id_col, features).select("id", "label")
        if labels.select("label").distinct().count() != k:
            raise ValueError("a component is empty")
        self._prototypes(df, labels, id_col, sample)
        q.unpersist()
        return self

    def predict(self, df: DataFrame, id_col: str, features: str = "features") -> DataFrame:
        """(id, label, distance): distance is 1 - probability of each component."""
        now = (self.weights, self.means, self.covs)

        def fn(x: np.ndarray):
            p = shares(log_parts(x, *now))[0]
            return [pa.array(p.argmax(1).astype(np.int32)), list_column(1 - p)]

        return with_arrays(self._scaled(df, id_col, features), "q", [T.StructField("label", T.IntegerType()), T.StructField("distance", ARRAY)], fn, ["id"])

