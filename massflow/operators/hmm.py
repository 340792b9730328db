"""Gaussian hidden Markov models: fits in parallel by seed, causal filtering.

Filtering is never smoothed: the posterior at a row depends on rows up to it,
and continues from a given posterior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

FLOOR = 1e-12


@dataclass
class Hmm:
    """Parameters on the standardised scale x -> (x - shift) / scale."""

    start: np.ndarray
    trans: np.ndarray
    means: np.ndarray  # k x D
    covs: np.ndarray  # k x D x D
    shift: np.ndarray
    scale: np.ndarray
    loglik: float = float("nan")
    converged: bool = True
    terminal: np.ndarray | None = None

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (np.atleast_2d(x) - self.shift) / self.scale
        out = np.empty((len(z), len(self.means)))
        for j, (m, c) in enumerate(zip(self.means, self.covs, strict=True)):
            low = np.linalg.cholesky(c)
            y = np.linalg.solve(low, (z - m).T)
            out[:, j] = -0.5 * ((y * y).sum(0) + z.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(low)).sum()
        return out

    def filter(self, x: np.ndarray, initial: np.ndarray | None = None) -> np.ndarray:
        """Posteriors n x k; ``initial`` is the posterior before the first row."""
        if not np.isfinite(x).all():
            raise ValueError("observations must be finite")
        dens = self.log_density(x)
        out = np.empty_like(dens)
        prior = np.log(np.maximum(self.start if initial is None else initial @ self.trans, FLOOR))
        for t in range(len(dens)):
            a = prior + dens[t]
            a = np.exp(a - a.max())
            out[t] = a / a.sum()
            prior = np.log(np.maximum(out[t] @ self.trans, FLOOR))
        return out

    def prototypes(self, length: int) -> np.ndarray:
        """Quantile samples of each state, in data units (one dimension)."""
        z = np.array([NormalDist().inv_cdf((i + 0.5) / length) for i in range(length)])
        return self.shift[0] + self.scale[0] * (self.means[:, :1] + np.sqrt(self.covs[:, 0, :1]) * z)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def baum_welch(x: np.ndarray, k: int, seed: int, max_iter: int = 200, tol: float = 1e-4, full: bool = True, least: float = 1e-8) -> Hmm:
    """Expectation maximisation from one seeded start; x is n x D."""
    n, dims = x.shape
    if n < k * k + 2 * k - 1 + (full and k * dims * (dims + 3) // 2 - 2 * k):
        raise ValueError("fewer rows than free parameters")
    shift, scale = x.mean(0), x.std(0)
    if (scale <= 0).any() or (x == x[0]).all(0).any():
        raise ValueError("a column is constant")
    z = (x - shift) / scale
    rng = np.random.default_rng(seed)
    means = z[rng.choice(n, k, replace=False)].copy()
    covs = np.tile(np.cov(z.T, ddof=0).reshape(dims, dims) + 1e-3 * np.eye(dims), (k, 1, 1))
    start, trans = np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1) if k > 1 else 1 - 0.1)
    trans /= trans.sum(1, keepdims=True)
    last, done, ll = -np.inf, False, -np.inf
    for _ in range(max_iter):
        m = Hmm(start, trans, means, covs, np.zeros(dims), np.ones(dims))
        dens = m.log_density(z)
        la, lt = np.empty((n, k)), np.log(np.maximum(trans, FLOOR))
        la[0] = np.log(np.maximum(start, FLOOR)) + dens[0]
        for t in range(1, n):
            la[t] = dens[t] + _lse(la[t - 1][:, None] + lt, 0)
        lb = np.zeros((n, k))
        for t in range(n - 2, -1, -1):
            lb[t] = _lse(lt + dens[t + 1] + lb[t + 1], 1)
        ll = float(_lse(la[-1], 0))
        post = np.exp(la + lb - ll)
        pair = np.exp(_lse((la[:-1, :, None] + lt + (dens[1:] + lb[1:])[:, None, :] - ll).transpose(1, 2, 0), 2))
        if ll - last < tol:
            done = ll - last > -1e-6
            break
        last = ll
        start = np.maximum(post[0], FLOOR)
        start /= start.sum()
        trans = np.maximum(pair, FLOOR)
        trans /= trans.sum(1, keepdims=True)
        weight = np.maximum(post.sum(0), FLOOR)
        means = (post.T @ z) / weight[:, None]
        for j in range(k):
            d = z - means[j]
            c = (post[:, j, None] * d).T @ d / weight[j]
            if not full:
                c = np.diag(np.diag(c))
            value, vector = np.linalg.eigh(c)
            covs[j] = (vector * np.maximum(value, max(least, 1e-8 * value.max()))) @ vector.T
    order = np.argsort([np.trace(c) for c in covs], kind="stable")
    return Hmm(start[order], trans[np.ix_(order, order)], means[order], covs[order], shift, scale, ll, done, post[-1][order])


def _best(x: np.ndarray, k: int, n_init: int, seed: int, full: bool, how: dict) -> Hmm:
    """The best log likelihood of the converged restarts, else of all."""
    runs = [baum_welch(x, k, seed + i, full=full, least=1e-6 if full else 1e-8, **how) for i in range(n_init)]
    return max([m for m in runs if m.converged] or runs, key=lambda m: m.loglik)


def fit(spark: SparkSession, x: np.ndarray, k: int, n_init: int = 5, seed: int = 0, full: bool = True, **how) -> Hmm:
    """The best of ``n_init`` restarts, which run as tasks.  ``x`` is one bounded
    training series; for series that stay on executors see ``fit_each``."""
    x = np.asarray(x, float).reshape(len(x), -1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["seed"]:
                m = _best(x, k, 1, int(s), full, how)
                yield pd.DataFrame({"seed": [s], "ll": [m.loglik], "converged": [m.converged]})

    seeds = spark.createDataFrame([(seed + i,) for i in range(n_init)], "seed long").repartition(n_init)
    got = seeds.mapInPandas(run, "seed long, ll double, converged boolean").collect()
    good = [r for r in got if r["converged"]] or got
    best = max(sorted(good, key=lambda r: r["seed"]), key=lambda r: r["ll"])
    return _best(x, k, 1, int(best["seed"]), full, how)


def fit_each(df: DataFrame, key: str, value: str, k: int, n_init: int = 5, seed: int = 0, full: bool = True, **how) -> DataFrame:
    """(key, idx, state, posterior): a model for each series, fitted to all of it and
    filtered causally, inside one task a series (its numbers are one array)."""
    kind = df.schema[key].dataType.simpleString()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        x = np.array(g[value].tolist(), float).reshape(len(g), -1)
        post = _best(x, k, n_init, seed, full, how).filter(x)
        return g[[key, "idx"]].assign(state=post.argmax(1).astype("int32"), posterior=list(post))

    return df.select(key, "idx", value).groupBy(key).applyInPandas(run, f"`{key}` {kind}, idx long, state int, posterior array<double>")


def causal_filter(df: DataFrame, model: Hmm, keys: list[str], value: str, initial: np.ndarray | None = None) -> DataFrame:
    """(keys, idx, state, posterior): series are filtered in parallel; within a
    series the recursion is sequential, held as one array of numbers."""
    key_fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        x = np.array(g[value].tolist(), float).reshape(len(g), -1)
        post = model.filter(x, initial)
        return g[[*keys, "idx"]].assign(state=post.argmax(1).astype("int32"), posterior=list(post))

    return df.select(*keys, "idx", value).groupBy(*keys).applyInPandas(run, f"{key_fields}, idx long, state int, posterior array<double>")
