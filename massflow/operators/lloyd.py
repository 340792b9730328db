"""Lloyd clustering of windows under W1 or W2, and of feature arrays.

A window's sorted atoms are its coordinates, so W2 clustering is Euclidean on
them (inertia divided by L) and W1 uses coordinate medians.  Each iteration is
one pass over the stored coordinates, in which tasks send k partial sums (W2), or a
few passes that send counts for the medians (W1); centers live on the driver.
Random choices compare hashes of (seed, id), so they depend on rows alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massflow.operators.geometry import ARRAY, T, barycenters, distances, list_column, matrix, medians, panel_features, power_cost, with_arrays


@dataclass
class Fit:
    """A fitted clustering; ``objective`` sums W1 or squared W2."""

    centers: np.ndarray
    objective: float
    history: list[float]
    n_iter: int
    converged: bool
    p: int

    def transform(self, df: DataFrame, column: str = "sample") -> DataFrame:
        return distances(df, self.centers, self.p, column)


def coordinates(df: DataFrame, id_col: str, column: str = "sample", ordered: bool = True) -> DataFrame:
    """(id, q): stored coordinates, sorted for distributions; ids break ties."""
    q = F.array_sort(column) if ordered else F.col(column)
    return df.select(F.col(id_col).cast("long").alias("id"), q.alias("q"))


def _unit(seed: int):
    """A number in (0, 1) of each row: 52 bits of the MD5 of seed and id."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def _pass(q: DataFrame, centers: np.ndarray, old: np.ndarray | None, p: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums and counts by label, total cost, and labels that differ from those
    under ``old``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, cost, moved = np.zeros_like(centers), np.zeros(len(centers), np.int64), 0.0, 0
        for b in batches:
            x = matrix(b.column(0))
            if not len(x):
                continue
            d = power_cost(x, centers, p)
            label = d.argmin(1)
            cost += float(d.min(1).sum())
            if old is not None:
                moved += int((power_cost(x, old, p).argmin(1) != label).sum())
            for j in range(len(centers)):
                own = label == j
                counts[j] += own.sum()
                if p == 2:
                    sums[j] += x[own].sum(0)
        k = len(centers)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(counts), list_column(sums), pa.array([cost] + [0.0] * (k - 1)), pa.array([moved] + [0] * (k - 1))], names=["label", "n", "s", "cost", "moved"])

    made = q.select("q").mapInArrow(run, "label long, n long, s array<double>, cost double, moved long")
    # k rows of L sums from each task are added up here
    sums, counts, cost, moved = np.zeros_like(centers), np.zeros(len(centers), np.int64), 0.0, 0
    for r in sorted(made.collect(), key=lambda r: (r["label"], r["n"], r["cost"])):
        sums[r["label"]] += r["s"]
        counts[r["label"]] += r["n"]
        cost += r["cost"]
        moved += r["moved"]
    return sums, counts, cost, moved


def _nearest_cost(q: DataFrame, centers: np.ndarray, p: int) -> DataFrame:
    cost = F.col("nearest") * F.col("nearest") if p == 2 else F.col("nearest")
    return distances(q, centers, p, "q", ordered=False).select("id", "q", cost.alias("cost"))


def _spread(q: DataFrame, k: int, seed: int, p: int) -> np.ndarray:
    """k-means++: the next center is drawn in proportion to the cost."""
    u = _unit(seed)
    first = q.agg(F.min_by("q", F.struct(u, "id")).alias("q")).first()["q"]
    centers = [first]
    for i in range(1, k):
        far = _nearest_cost(q, np.array(centers), p).filter("cost > 0")
        row = far.agg(F.min_by("q", F.struct(-F.ln(_unit(seed * 1000 + i)) / F.col("cost"), "id")).alias("q")).first()
        if row["q"] is None:
            raise ValueError("there are fewer distinct samples than clusters")
        centers.append(row["q"])
    return np.array(centers)


def _distinct_random(q: DataFrame, k: int, seed: int) -> np.ndarray:
    rows = q.groupBy("q").agg(F.min("id").alias("id")).orderBy(_unit(seed), "id").limit(k).collect()
    if len(rows) < k:
        raise ValueError("there are fewer distinct samples than clusters")
    return np.array([r["q"] for r in rows])


def _reseed(q: DataFrame, centers: np.ndarray, counts: np.ndarray, p: int) -> np.ndarray:
    """Empty clusters, in order, take the row farthest from the others."""
    out = centers.copy()
    used = [c for c, n in zip(centers, counts, strict=True) if n]
    for j in np.flatnonzero(counts == 0):
        row = _nearest_cost(q, np.array(used), p).agg(F.max_by("q", F.struct("cost", -F.col("id"))).alias("q")).first()
        out[j] = row["q"]
        used.append(out[j])
    return out


def fit(
    q: DataFrame, k: int, p: int = 2, init: str | np.ndarray = "k-means++", n_init: int = 1, max_iter: int = 300, tol: float = 0.0, seed: int = 0, prefer_converged: bool = False,
) -> Fit:
    """Lloyd iterations over ``coordinates``; the restart of least objective wins
    (of the converged ones, if ``prefer_converged`` and there are any).

    Stops when all clusters are occupied and labels stay, alternate between two
    states, or centers move by at most ``tol``."""
    if k < 1 or p not in (1, 2):
        raise ValueError("k must be positive, p 1 or 2")
    explicit = not isinstance(init, str)
    if explicit:
        init = np.sort(np.asarray(init, float), axis=1)
        if len(np.unique(init, axis=0)) != k:
            raise ValueError("explicit centers must be k distinct samples")
    found: list[Fit] = []
    for run in range(1 if explicit else n_init):
        centers = init.copy() if explicit else (_spread(q, k, seed + run, p) if init == "k-means++" else _distinct_random(q, k, seed + run))
        old, older, history, done, steps = None, None, [], False, 0
        sums, counts, cost, _ = _pass(q, centers, None, p)
        history.append(cost)
        for steps in range(1, max_iter + 1):  # noqa: B007
            if p == 2:
                new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
            else:
                labelled = distances(q, centers, p, "q", ordered=False).select("label", "q")
                middle = medians(labelled.select(F.col("label").alias("g"), "q"), k)
                new = np.where(np.isnan(middle), centers, middle)
            if (counts == 0).any():
                new = _reseed(q, new, counts, p)
            older, old, centers = old, centers, new
            sums, counts, cost, moved = _pass(q, centers, old, p)
            history.append(cost)
            shift = float(np.abs(centers - old).max())
            cycle = older is not None and np.array_equal(older, centers)
            if (counts > 0).all() and (moved == 0 or cycle or shift <= tol):
                done = True
                break
        found.append(Fit(centers, cost, history, steps, done, p))
    good = [f for f in found if f.converged] if prefer_converged else []
    return min(good or found, key=lambda f: f.objective)


def choose_k(q: DataFrame, validation: DataFrame, ks: list[int], p: int = 2, sample: int = 800, n_init: int = 20, **how) -> tuple[int, dict[int, float], dict[int, Fit]]:
    """The K of highest validation silhouette (smaller on ties), the silhouettes and
    the fits, which say whether they converged; the silhouette takes at most
    ``sample`` rows, by hash."""
    from massflow.operators.evaluate import silhouette

    rows = validation.orderBy(_unit(0), "id").limit(sample)
    scores, fits = {}, {}
    for k in sorted(ks):
        fits[k] = fit(q, k, p, n_init=n_init, **how)
        labelled = distances(rows, fits[k].centers, p, "q", ordered=False).select("id", "label", F.col("q").alias("sample"))
        value = silhouette(labelled)
        if value is not None:
            scores[k] = value
    if not scores:
        raise ValueError("no K gives two clusters")
    return max(sorted(scores), key=lambda k: scores[k]), scores, fits


#: Numbers of two rows closer than this, in itself and in proportion, are equal.
NEAR = 1e-12


def distinct_rows(df: DataFrame, id_col: str, column: str, limit: int) -> int:
    """How many rows differ by more than rounding, up to ``limit``: each pass finds
    the row of least id that is near none of those found."""
    far, found = df.select(F.col(id_col).alias("id"), F.col(column).alias("q")), 0
    while found < limit:
        row = far.agg(F.min_by("q", "id").alias("q")).first()
        if row["q"] is None:
            break
        found += 1
        mine = F.array(*[F.lit(float(v)) for v in row["q"]])
        far = far.filter(F.exists(F.zip_with("q", mine, lambda a, b: F.abs(a - b) > NEAR + NEAR * F.abs(b)), lambda x: x))
    return found


class FeatureKMeans:
    """Standardised features, k-means on them, and the mean sorted atoms of each
    label as prototypes; k is reduced to the number of distinct rows.  Features of
    ``scaled`` = False are taken as they are."""

    def __init__(self, k: int, n_init: int = 20, seed: int = 0, max_iter: int = 300, scaled: bool = True):
        self.k, self.n_init, self.seed, self.max_iter, self.scaled = k, n_init, seed, max_iter, scaled

    def _standards(self, df: DataFrame, id_col: str, features: str) -> int:
        """Sets mean and scale; returns the clusters to make."""
        if len(df.select(id_col).limit(self.k).collect()) < self.k:
            raise ValueError("there are fewer rows than clusters")
        atoms = df.select(F.posexplode(features).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("pos").collect()
        self.mean = np.array([r["m"] if self.scaled else 0.0 for r in atoms])
        self.scale = np.array([r["s"] if self.scaled and r["s"] > NEAR else 1.0 for r in atoms])
        return distinct_rows(df, id_col, features, self.k)

    def _prototypes(self, df: DataFrame, labels: DataFrame, id_col: str, sample: str) -> None:
        own = df.select(F.col(id_col).cast("long").alias("id"), sample).join(labels, "id")
        self.prototypes = np.array([r["center"] for r in barycenters(own, 2, "label", sample).orderBy("label").collect()])

    def fit(self, df: DataFrame, id_col: str, features: str = "features", sample: str = "sample") -> FeatureKMeans:
        k = self._standards(df, id_col, features)
        q = self._scaled(df, id_col, features).cache()
        got = fit(q, k, 2, n_init=self.n_init, max_iter=self.max_iter, seed=self.seed)
        labels = distances(q, got.centers, 2, "q", ordered=False).select("id", "label")
        if labels.select("label").distinct().count() != k:
            raise ValueError("a cluster is empty")
        self.centers, self.converged = got.centers, got.converged
        self._prototypes(df, labels, id_col, sample)
        q.unpersist()
        return self

    def _scaled(self, df: DataFrame, id_col: str, features: str) -> DataFrame:
        m, s = (F.array(*[F.lit(float(v)) for v in a]) for a in (self.mean, self.scale))
        z = F.zip_with(F.zip_with(features, m, lambda x, y: x - y), s, lambda x, y: x / y)
        return df.select(F.col(id_col).cast("long").alias("id"), z.alias("q"))

    def predict(self, df: DataFrame, id_col: str, features: str = "features") -> DataFrame:
        return distances(self._scaled(df, id_col, features), np.array(self.centers), 2, "q", ordered=False).select("id", "label", "distance")


class PanelKMeans(FeatureKMeans):
    """k-means on marginal, covariance or correlation features of joint windows, after
    frozen asset scales; marginal features are not standardised."""

    def __init__(self, kind: str, k: int, scales: np.ndarray | None = None, n_init: int = 20, seed: int = 0, max_iter: int = 300):
        if kind not in ("marginal", "covariance", "correlation"):
            raise ValueError(f"unknown feature kind: {kind}")
        super().__init__(k, n_init, seed, max_iter, kind != "marginal")
        self.kind, self.scales = kind, scales

    def _features(self, wins: DataFrame, id_col: str) -> DataFrame:
        scales, shape, kind = np.asarray(self.scales, float), tuple(self.shape), self.kind

        def fn(x: np.ndarray):
            if x.shape[1] != shape[0] * shape[1]:
                raise ValueError("the panel does not have the model's shape")
            return [list_column(panel_features(x.reshape(len(x), *shape) / scales, kind))]

        return with_arrays(wins.select(id_col, "sample"), "sample", [T.StructField("features", ARRAY)], fn, [id_col], inner=2)

    def fit(self, wins: DataFrame, id_col: str = "endpoint") -> PanelKMeans:
        row = wins.select(F.size("sample").alias("length"), F.size(F.col("sample")[0]).alias("dims")).first()
        if row is None:
            raise ValueError("there are no windows")
        self.shape = [row["length"], row["dims"]]
        self.scales = np.ones(row["dims"]) if self.scales is None else np.asarray(self.scales, float)
        if self.scales.shape != (row["dims"],) or not np.isfinite(self.scales).all() or (self.scales <= 0).any():
            raise ValueError("asset scales must be positive")
        f = self._features(wins, id_col).withColumn("sample", F.col("features")).cache()
        super().fit(f, id_col)
        f.unpersist()
        return self

    def predict(self, wins: DataFrame, id_col: str = "endpoint") -> DataFrame:
        return super().predict(self._features(wins, id_col), id_col)
