"""Agreement, novelty, dwell, separation and outcome measures of labels."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from massflow.operators.geometry import matrix
from massflow.operators.joins import join_spread
from massflow.operators.windows import BLOCK, before, dense_index, running
from massflow.session import cut


#: Numbers of the largest temporary array of a kernel.
KERNEL_NUMBERS = 1 << 21


def _kernel_means(x: np.ndarray, y: np.ndarray, bandwidth: float) -> np.ndarray:
    """Mean Gaussian kernel of all pairs of atoms, row by row."""
    out, step = np.empty(len(x)), max(1, KERNEL_NUMBERS // max(1, x.shape[1] * y.shape[1]))
    for i in range(0, len(x), step):
        d = x[i : i + step, :, None] - y[i : i + step, None, :]
        np.multiply(d, d, out=d)
        d *= -0.5 / bandwidth**2
        out[i : i + step] = np.exp(d, out=d).mean((1, 2))
    return out


def with_mmd(df: DataFrame, a: str, b: str, bandwidth: float, name: str = "mmd2") -> DataFrame:
    """Adds the biased squared Gaussian MMD of two array columns of a row."""
    if not bandwidth > 0:
        raise ValueError("bandwidth must be positive")
    names = list(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(names.index(a)), batch.column(names.index(b))
            shape = np.stack([c.value_lengths().to_numpy(zero_copy_only=False) for c in (x, y)], 1)
            out = np.empty(len(shape))
            for size in np.unique(shape, axis=0):  # rows of equal lengths together
                rows = np.flatnonzero((shape == size).all(1))
                p, q = matrix(x.take(pa.array(rows))), matrix(y.take(pa.array(rows)))
                out[rows] = np.maximum(0, _kernel_means(p, p, bandwidth) + _kernel_means(q, q, bandwidth) - 2 * _kernel_means(p, q, bandwidth))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def mmd(x: DataFrame, y: DataFrame, bandwidth: float, key: str, column: str = "sample") -> DataFrame:
    """(key, mmd2): biased squared Gaussian MMD of the samples of equal key.

    Pairs of atoms are formed within a row's two arrays, L x L numbers at a time."""
    both = x.select(key, F.col(column).alias("a")).join(y.select(key, F.col(column).alias("b")), key)
    return with_mmd(both, "a", "b", bandwidth).select(key, "mmd2")


def adjacent_mmd(picked: DataFrame, bandwidth: float, keys: list[str]) -> DataFrame:
    """Mean MMD of consecutive separated windows, within and between labels.  Windows
    are numbered by blocks of endpoints, so a long series is spread."""
    numbered = dense_index(picked.select(*keys, "endpoint", "sample", "label"), keys, ["endpoint"], F.floor(F.col("endpoint") / BLOCK), "_no")
    made = before(numbered, keys, {"_b": "sample", "_l": "label"}, "_no").filter("_b IS NOT NULL")
    made = with_mmd(made.select(*keys, (F.col("label") == F.col("_l")).alias("same_label"), F.col("sample").alias("_a"), "_b"), "_a", "_b", bandwidth, "_m")
    return made.groupBy(*keys, "same_label").agg(F.count("*").alias("pairs"), F.avg("_m").alias("mean_mmd2"))


def percentiles(scored: DataFrame, calibration: DataFrame | Column, threshold: float, value: str = "nearest") -> DataFrame:
    """Adds ``percentile``, the share of calibration values at most the row's,
    and ``ood``.  Distinct values are ranked in value ranges, from one written table
    of counts; a value that many rows share is dealt to several tasks.  Rows find their
    rank by value, so they are written first: values computed again may differ in their
    last bits and would find none.  A calibration that is part of ``scored`` is given as
    a condition on its rows, for the same reason."""
    scored = cut(scored)
    if isinstance(calibration, Column):
        calibration = scored.filter(calibration)
    both = scored.select(value, F.lit(0).alias("_cal"), F.lit(1).alias("_row")).unionByName(calibration.select(value, F.lit(1).alias("_cal"), F.lit(0).alias("_row")))
    by_value = cut(both.groupBy(value).agg(F.sum("_cal").alias("_n"), F.sum("_row").alias("_rows")))
    sums = by_value.agg(F.sum(F.when(F.col(value).isNotNull(), F.col("_n"))).alias("cal"), F.sum("_rows").alias("rows"), F.count("*").alias("k")).first()
    edges = by_value.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.005) if sums["k"] else []
    part = F.size(F.filter(F.array(*[F.lit(float(e)) for e in sorted(set(edges))]), lambda e: e < F.col(value))) if edges else F.lit(0)
    by_value = by_value.withColumn("_part", part)
    sizes = by_value.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    earlier = sizes.withColumn("_before", F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).drop("_sum")  # 64 rows
    ranks = by_value.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_part").orderBy(value))).join(F.broadcast(earlier), "_part")
    total = float(sums["cal"]) if sums["cal"] else None
    ranks = cut(ranks.select(value, "_rows", ((F.col("_upto") + F.col("_before")) / F.lit(total)).alias("percentile")))
    return join_spread(scored, ranks, value, "_rows", sums["rows"] or 0).withColumn("ood", F.col("percentile") >= threshold)


def over_quantile(scored: DataFrame, calibration: DataFrame, q: float = 0.99, value: str = "nearest") -> DataFrame:
    """Adds ``novel``: strictly over the calibration quantile (exact, linear)."""
    cut = calibration.agg(F.percentile(value, F.lit(q)).alias("_cut"))
    return scored.join(F.broadcast(cut)).withColumn("novel", F.col(value) > F.col("_cut")).drop("_cut")


def runs(labels: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """(keys, run, label, length, first): runs end at label changes and gaps."""
    near = before(labels.select(*keys, position, "label"), keys, {"_l": "label"}, position)
    new = (~F.col("_l").eqNullSafe(F.col("label"))).cast("long")
    made = running(near, keys, {"run": new}, position)
    return made.groupBy(*keys, "run").agg(F.min("label").alias("label"), F.count("*").alias("length"), F.min(position).alias("first"))


def temporal_summary(labels: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """Per key: adjacent pairs, switch frequency over them, mean and median dwell."""
    near = before(labels.select(*keys, position, "label"), keys, {"_l": "label"}, position)
    pairs = near.groupBy(*keys).agg(F.count("_l").alias("pairs"), F.count_if(F.col("_l") != F.col("label")).alias("switches"))
    dwell = runs(labels, keys, position).groupBy(*keys).agg(F.avg("length").alias("mean_dwell"), F.median("length").alias("median_dwell"), F.count("*").alias("runs"))
    return pairs.join(dwell, keys).withColumn("switch_frequency", F.try_divide("switches", "pairs"))


def transitions(labels: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """(keys, source, target, n, share) over adjacent positions."""
    near = before(labels.select(*keys, position, "label"), keys, {"source": "label"}, position).filter("source IS NOT NULL")
    counts = near.groupBy(*keys, "source", F.col("label").alias("target")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "source")))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, ari (1 for trivially equal partitions), nmi (arithmetic mean;
    null if ``a`` has one state)."""
    def pairs(c):
        return c * (c - 1) / 2

    n = contingency(df, a, b)
    cell = n.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.ln("n")).alias("hij"))
    side = lambda c, s: n.groupBy(c).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(s), F.sum(F.col("m") * F.ln("m")).alias(f"h{s}"), F.count("*").alias(f"k{s}"))
    row = cell.join(F.broadcast(side("a", "i"))).join(F.broadcast(side("b", "j")))  # one row each
    expected = F.try_divide(F.col("i") * F.col("j"), pairs(F.col("n")))
    top = (F.col("i") + F.col("j")) / 2
    ari = F.when(top == expected, F.lit(1.0)).otherwise(F.try_divide(F.col("ij") - expected, top - expected))
    log_n = F.ln("n")
    ha, hb, hab = log_n - F.col("hi") / F.col("n"), log_n - F.col("hj") / F.col("n"), log_n - F.col("hij") / F.col("n")
    nmi = F.when(F.col("ki") > 1, F.coalesce(F.try_divide(ha + hb - hab, (ha + hb) / 2), F.lit(0.0)))
    return row.select(F.col("n").cast("long").alias("n"), ari.alias("ari"), nmi.alias("nmi"))


def balanced_accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    recall = df.groupBy(truth).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"))
    return recall.agg(F.avg("recall").alias("balanced_accuracy"), F.min("recall").alias("least_recall"))


def occupancy(labels: DataFrame, k: int, label: str = "label") -> DataFrame:
    """(label, n) of all k states, zeros included."""
    states = labels.sparkSession.range(k).select(F.col("id").cast("int").alias(label))
    return states.join(labels.groupBy(label).agg(F.count("*").alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


#: Rows of the largest sample that a silhouette takes.
SILHOUETTE_ROWS = 1_000


def _silhouettes(df: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """ids, labels and silhouettes of a bounded sample (id, label, sample); a lone
    row has 0, and all have NaN where there is one cluster."""
    rows = df.select("id", "label", "sample").limit(SILHOUETTE_ROWS + 1).collect()
    if len(rows) > SILHOUETTE_ROWS:
        raise ValueError(f"a silhouette takes a sample of at most {SILHOUETTE_ROWS} rows")
    rows.sort(key=lambda r: r["id"])
    x, label = np.array([r["sample"] for r in rows], float), np.array([r["label"] for r in rows])
    kinds, place = np.unique(label, return_inverse=True)
    if len(kinds) < 2:
        return [r["id"] for r in rows], label, np.full(len(rows), np.nan)
    x = x - x.mean(0)
    square = (x * x).sum(1)
    d = np.sqrt(np.maximum(square[:, None] + square - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    member = np.eye(len(kinds))[place]
    size = member.sum(0)
    mean = d @ member / np.maximum(size - member, 1)
    at = np.arange(len(x)), place
    own = mean[at]
    mean[at] = np.inf
    near = mean.min(1)
    return [r["id"] for r in rows], label, np.where(size[place] == 1, 0, (near - own) / np.maximum(np.maximum(own, near), 1e-300))


def silhouette(df: DataFrame) -> float | None:
    """Mean Euclidean silhouette of a bounded sample (id, label, sample); None
    unless there are two clusters at least and fewer than rows."""
    _, label, value = _silhouettes(df)
    kinds = len(np.unique(label))
    return float(value.mean()) if 2 <= kinds < len(value) else None


def silhouette_rows(df: DataFrame) -> DataFrame:
    """(id, label, silhouette) of a bounded sample; null where there is one cluster."""
    ids, label, value = _silhouettes(df)
    kinds = T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("label", df.schema["label"].dataType), T.StructField("silhouette", T.DoubleType())])
    return df.sparkSession.createDataFrame([(i, v.item(), None if np.isnan(s) else float(s)) for i, v, s in zip(ids, label, value, strict=True)], kinds)


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row at least total cost; by permutations up to 7 rows, else
    by shortest augmenting paths."""
    cost = np.asarray(cost, float)
    n = len(cost)
    if n <= 7:
        return list(min(permutations(range(n)), key=lambda p: (sum(cost[i, j] for i, j in enumerate(p)), p)))
    u, v, match, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[least[free].argmin()]
            step = least[j1]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def label_mapping(df: DataFrame, truth: str, predicted: str, k: int) -> list[int]:
    """The truth state of each predicted label with most agreement."""
    table = np.zeros((k, k))
    for r in contingency(df, truth, predicted).collect():  # at most k x k rows
        table[r["b"], r["a"]] = r["n"]
    return assignment(-table)


def align_centers(reference: np.ndarray, current: np.ndarray, p: int = 2) -> list[int]:
    """The reference place of each current center at least total distance."""
    from massflow.operators.geometry import power_cost

    d = power_cost(np.sort(current, 1), np.sort(reference, 1), p)
    return assignment(np.sqrt(d) if p == 2 else d)


def component_fractions(parts: DataFrame) -> DataFrame:
    """Ratios of sums of location, scale and shape; zeros if the total is 0."""
    sums = parts.agg(*[F.sum(c).alias(c) for c in ("location", "scale", "shape", "total")])
    return sums.select(*[F.coalesce(F.try_divide(c, "total"), F.lit(0.0)).alias(c) for c in ("location", "scale", "shape")])


def conditional_outcomes(labelled: DataFrame, outcome: str, drawn: DataFrame, keys: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Mean outcome of each state (of each series of ``keys``, and of each kind ``by``)
    and a bootstrap interval; ``labelled`` has keys, by, idx, label, outcome; a draw is
    shared by all states and kinds."""
    known, each = labelled.filter(F.col(outcome).isNotNull()), [*keys, *by, "label"]
    point = known.groupBy(*each).agg(F.avg(outcome).alias("mean"), F.count("*").alias("n"))
    weights = drawn.groupBy(*keys, "rep", "idx").agg(F.count("*").alias("w"))
    reps = known.join(weights, [*keys, "idx"]).groupBy("rep", *each).agg((F.sum(F.col(outcome) * F.col("w")) / F.sum("w")).alias("m"))
    spread = reps.groupBy(*each).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return point.join(spread, each, "left")


def state_profile(labelled: DataFrame, features: list[str]) -> DataFrame:
    return labelled.groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in features])


def detection_delay(labels: DataFrame, switch: int, state: int, end: int, keys: Sequence[str] = ()) -> DataFrame:
    """Endpoints from an internal switch to the first correct one; censored if none."""
    first = F.min(F.when((F.col("endpoint") >= switch) & (F.col("endpoint") < end) & (F.col("label") == state), F.col("endpoint")))
    return labels.groupBy(*keys).agg((first - switch).alias("delay")).withColumn("censored", F.col("delay").isNull())


def episode_delay(labels: DataFrame, state: int, start: int, end: int, needed: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """First ``needed`` labels of a state on consecutive endpoints in [start, end)."""
    inside = labels.filter((F.col("endpoint") >= start) & (F.col("endpoint") < end)).withColumn("_k", F.lit(0))
    long = runs(inside, [*keys, "_k"], "endpoint").filter((F.col("label") == state) & (F.col("length") >= needed))
    made = long.groupBy(*keys).agg((F.min("first") - start).alias("delay"))
    if keys:
        made = labels.select(*keys).distinct().join(made, list(keys), "left")
    return made.select(*keys, "delay", (F.col("delay") + needed - 1).alias("confirmation_delay"), F.col("delay").isNull().alias("censored"))


def replicate_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, least, most and standard error (null for one) over replicates;
    nulls and NaN are skipped."""
    v = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.when(F.count(v) > 1, F.stddev_samp(v) / F.sqrt(F.count(v))).alias("standard_error"))


def refit_comparison(old: DataFrame, new: DataFrame, old_centers: np.ndarray, new_centers: np.ndarray, key: str = "endpoint") -> dict:
    """Agreement of two fits on common windows (labels of each by ``key``), how many
    states each uses there, and, for equal K, the mapping of the new centers and their
    mean displacement."""
    both = old.select(key, F.col("label").alias("old")).join(new.select(key, F.col("label").alias("new")), key)
    row = agreement(both, "old", "new").first()
    used = both.agg(F.count_distinct("old").alias("old"), F.count_distinct("new").alias("new")).first()
    out = {
        "common": row["n"], "ari": row["ari"], "previous_k": len(old_centers), "current_k": len(new_centers), "k_changed": len(old_centers) != len(new_centers),
        "previous_occupied": used["old"], "current_occupied": used["new"], "both_single_state": used["old"] == used["new"] == 1, "mapping": None, "displacement": None,
    }
    if not out["k_changed"]:
        order = align_centers(old_centers, new_centers)
        far = [np.sqrt(((np.sort(new_centers[i]) - np.sort(old_centers[j])) ** 2).mean()) for i, j in enumerate(order)]
        out |= {"mapping": order, "displacement": float(np.mean(far))}
    return out


def partition_diagnostics(labels: DataFrame, k: int, reference: DataFrame | None = None, key: str = "endpoint") -> dict:
    """Counts, occupied states and temporal summary of one series of labels (by
    ``key``), and agreement with ``reference`` on the same anchors."""
    n = {r["label"]: r["n"] for r in occupancy(labels, k).collect()}
    if any(v not in range(k) for v in n):
        raise ValueError("labels must lie below k")
    counts = [n[j] for j in range(k)]
    if not sum(counts):
        raise ValueError("there are no labels")
    time = temporal_summary(labels.withColumn("_k", F.lit(0)), ["_k"], key).drop("_k").first().asDict()
    occupied = sum(c > 0 for c in counts)
    out = {"n": sum(counts), "counts": counts, "occupancy": [c / sum(counts) for c in counts], "occupied": occupied, "single_state": occupied == 1, "temporal": time}
    if reference is not None:
        both = reference.select(key, F.col("label").alias("a")).join(labels.select(key, F.col("label").alias("b")), key)
        other = {r["a"]: r["count"] for r in both.groupBy("a").count().collect()}
        if sum(other.values()) != out["n"] or reference.count() != out["n"]:
            raise ValueError("the reference must have the same anchors")
        out |= {"ari": agreement(both, "a", "b").first()["ari"], "reference_counts": [other.get(j, 0) for j in range(k)], "both_single_state": len(other) == 1 and occupied == 1}
    return out
