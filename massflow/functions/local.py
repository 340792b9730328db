"""The estimators on matrices that one task holds, for studies that fan out one
task a repetition.  The distributed forms are in ``operators``."""

from __future__ import annotations

import numpy as np

from massflow.functions.distributions import QUANTILES
from massflow.operators.geometry import power_cost
from massflow.operators.mixture import log_parts, shares


def windows(x: np.ndarray, length: int, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(windows, endpoints) of a series, or of rows of vectors (windows x length x D)."""
    view = np.lib.stride_tricks.sliding_window_view(x, length, axis=0)[::stride]
    return (view if x.ndim == 1 else view.transpose(0, 2, 1)), np.arange(length - 1, len(x), stride)


def standardize(x: np.ndarray) -> np.ndarray:
    flat = (x == x[:, :1]).all(1)
    sd = np.where(flat, 1.0, x.std(1))
    return np.where(flat[:, None], 0.0, (x - x.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1)[:, None])


def features(x: np.ndarray, kind: str) -> np.ndarray:
    """As ``distributions.features``, a row a window."""
    z, mean, sd = standardize(x), x.mean(1), x.std(1) * (x != x[:, :1]).any(1)
    if kind == "volatility":
        return sd[:, None]
    if kind == "mean_vol":
        return np.stack([mean, sd], 1)
    four = np.stack([mean, sd, (z**3).mean(1), np.where(sd > 0, (z**4).mean(1) - 3, 0)], 1)
    if kind in ("moments", "gmm"):
        return four
    if kind != "rich":
        raise ValueError(f"unknown feature kind: {kind}")
    path = np.hstack([np.zeros((len(x), 1)), x.cumsum(1)])
    fall = (np.maximum.accumulate(path, axis=1) - path).max(1)
    return np.hstack([four, np.quantile(x, QUANTILES, axis=1).T, np.sqrt((np.minimum(x, 0) ** 2).mean(1))[:, None], (1 - np.exp(-fall))[:, None]])


def distinct(x: np.ndarray, limit: int, near: float = 1e-12) -> int:
    """How many rows differ by more than rounding, up to ``limit``."""
    found: list[np.ndarray] = []
    left = x
    while len(left) and len(found) < limit:
        found.append(left[0])
        left = left[(np.abs(left - left[0]) > near + near * np.abs(left[0])).any(1)]
    return len(found)


def kmeans(x: np.ndarray, k: int, seed: int, n_init: int = 5, p: int = 2, max_iter: int = 100) -> np.ndarray:
    """Centers (means, or medians for p = 1) of the restart of least cost, from
    k-means++ draws; an empty cluster takes the farthest row."""
    best = None
    for run in range(n_init):
        rng = np.random.default_rng([seed, run])
        centers = x[[rng.integers(len(x))]]
        while len(centers) < k:
            cost = power_cost(x, centers, p).min(1)
            if cost.sum() <= 0:
                raise ValueError("there are fewer distinct samples than clusters")
            centers = np.vstack([centers, x[rng.choice(len(x), p=cost / cost.sum())]])
        label = None
        for _ in range(max_iter):
            cost = power_cost(x, centers, p)
            now = cost.argmin(1)
            if label is not None and (now == label).all():
                break
            label = now
            for j in range(k):
                own = label == j
                centers[j] = x[cost.min(1).argmax()] if not own.any() else x[own].mean(0) if p == 2 else np.median(x[own], 0)
        total = power_cost(x, centers, p).min(1).sum()
        if best is None or total < best[0]:
            best = (total, centers)
    return best[1]


def mixture(x: np.ndarray, k: int, seed: int, n_init: int = 5, max_iter: int = 100, tol: float = 1e-3, ridge: float = 1e-6) -> tuple[np.ndarray, ...]:
    """(weights, means, covariances) of the likeliest run, each from a k-means fit."""
    best = None
    for run in range(n_init if k > 1 else 1):
        w = np.eye(k)[power_cost(x, kmeans(x, k, seed + run, 1), 2).argmin(1)]
        last = -np.inf
        for _ in range(max_iter):
            n = w.sum(0) + 10 * np.finfo(float).eps
            means = (w.T @ x) / n[:, None]
            covs = np.stack([((x - m).T * w[:, j]) @ (x - m) / n[j] for j, m in enumerate(means)]) + ridge * np.eye(x.shape[1])
            now = (n / n.sum(), means, covs)
            w, density = shares(log_parts(x, *now))
            gain, last = density.mean() - last, density.mean()
            if gain < tol:
                break
        if best is None or last > best[0]:
            best = (last, now)
    return best[1]


class Method:
    """One of the study's methods on windows: w1, w2, shape_w2, or k-means or a
    mixture on features.  ``centers`` are sorted samples in the method's geometry."""

    def __init__(self, kind: str, k: int, seed: int, n_init: int):
        self.kind, self.k, self.seed, self.n_init = kind, k, seed, n_init
        self.p = 1 if kind == "w1" else 2

    def _view(self, x: np.ndarray) -> np.ndarray:
        return np.sort(standardize(x) if self.kind == "shape_w2" else x, axis=1)

    def fit(self, x: np.ndarray) -> Method:
        if self.kind in ("w1", "w2", "shape_w2"):
            self.centers = kmeans(self._view(x), self.k, self.seed, self.n_init, self.p)
            return self
        f = features(x, self.kind)
        self.mean, sd = f.mean(0), f.std(0)
        self.scale = np.where(sd > 1e-12, sd, 1.0)
        z, k = (f - self.mean) / self.scale, distinct(f, self.k)
        self.model = mixture(z, k, self.seed, self.n_init) if self.kind == "gmm" else kmeans(z, k, self.seed, self.n_init)
        label, q = self._raw(z), np.sort(x, axis=1)
        self.used = np.unique(label)
        self.centers = np.stack([q[label == j].mean(0) for j in self.used])
        return self

    def _raw(self, z: np.ndarray) -> np.ndarray:
        return (shares(log_parts(z, *self.model))[0].argmax(1)) if self.kind == "gmm" else power_cost(z, self.model, 2).argmin(1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.kind in ("w1", "w2", "shape_w2"):
            return power_cost(self._view(x), self.centers, self.p).argmin(1)
        label = self._raw((features(x, self.kind) - self.mean) / self.scale)
        return np.searchsorted(self.used, label).clip(max=len(self.used) - 1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Transport distance to the nearest center, whatever assigns labels."""
        d = power_cost(self._view(x), self.centers, self.p).min(1)
        return d if self.p == 1 else np.sqrt(d)


def contingency(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ka, ia = np.unique(a, return_inverse=True)
    kb, ib = np.unique(b, return_inverse=True)
    out = np.zeros((len(ka), len(kb)))
    np.add.at(out, (ia, ib), 1)
    return out


def ari(a: np.ndarray, b: np.ndarray) -> float:
    """Adjusted Rand index; 1 for trivially equal partitions."""
    n = contingency(a, b)
    pairs = lambda v: float((v * (v - 1) / 2).sum())
    ij, i, j, total = pairs(n), pairs(n.sum(1)), pairs(n.sum(0)), n.sum()
    expected = i * j / (total * (total - 1) / 2) if total > 1 else 0.0
    return 1.0 if (i + j) / 2 == expected else (ij - expected) / ((i + j) / 2 - expected)


def nmi(a: np.ndarray, b: np.ndarray) -> float:
    """Mutual information over the mean of the entropies."""
    n = contingency(a, b)
    p = n / n.sum()
    h = lambda v: float(-(v[v > 0] * np.log(v[v > 0])).sum())
    ha, hb = h(p.sum(1)), h(p.sum(0))
    return 1.0 if ha + hb == 0 else (ha + hb - h(p)) / ((ha + hb) / 2)


def mapping(truth: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """The truth state of each label with most agreement."""
    from massflow.operators.evaluate import assignment

    n = np.zeros((k, k))
    np.add.at(n, (label, truth), 1)
    return np.array(assignment(-n))


def dwell(label: np.ndarray) -> dict[str, float | None]:
    """Switch frequency and mean dwell of labels of consecutive windows."""
    flips = int((label[1:] != label[:-1]).sum())
    return {"switch_frequency": flips / (len(label) - 1) if len(label) > 1 else None, "mean_dwell": len(label) / (flips + 1)}
