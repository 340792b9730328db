"""Distances of windows to a few centers, barycenters and sliced distances.

Centers are k arrays of L numbers, held in the closure; a batch of windows is
one numpy matrix, and no n x k x L temporary is built."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPORARY_BYTES = 32 << 20


def matrix(column: pa.Array, inner: int = 1) -> np.ndarray:
    """A list column (``inner`` list levels) as a 2-d array; lengths must agree."""
    if column.null_count:
        raise ValueError("a sample is null")
    n = len(column)
    for _ in range(inner):
        column = column.flatten()
    flat = column.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if not np.isfinite(flat).all():
        raise ValueError("samples must be finite")
    if n and len(flat) % n:
        raise ValueError("samples differ in length")
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def list_column(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def power_cost(q: np.ndarray, centers: np.ndarray, p: int) -> np.ndarray:
    """Mean p-th power differences, n x k, of sorted rows."""
    out = np.empty((len(q), len(centers)))
    step = max(1, TEMPORARY_BYTES // (8 * max(1, q.shape[1])))
    for i in range(0, len(q), step):
        for j, c in enumerate(centers):
            d = q[i : i + step] - c
            out[i : i + step, j] = np.abs(d).mean(1) if p == 1 else np.einsum("ij,ij->i", d, d) / q.shape[1]
    return out


def blas_cost(q: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared W2 by expansion; fastest, loses digits of tiny distances."""
    out = q @ (centers.T * (-2.0 / q.shape[1]))
    out += (np.einsum("ij,ij->i", q, q) / q.shape[1])[:, None]
    out += np.einsum("ij,ij->i", centers, centers) / q.shape[1]
    return np.maximum(out, 0, out=out)


def with_arrays(df: DataFrame, column: str, fields: list[T.StructField], fn, keep: Sequence[str] | None = None, inner: int = 1) -> DataFrame:
    """``keep`` columns (all by default) and what ``fn`` makes of the matrix."""
    names = list(df.columns if keep is None else keep)
    src = df.select(*names, F.col(column).alias("_sample"))
    schema = T.StructType([src.schema[k] for k in names] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + fn(matrix(b.column(len(names)), inner)), names=schema.fieldNames())

    return src.mapInArrow(run, schema)


ARRAY = T.ArrayType(T.DoubleType())


def distances(df: DataFrame, centers: np.ndarray, p: int = 2, column: str = "sample", keep: Sequence[str] | None = None, ordered: bool = True) -> DataFrame:
    """Adds ``distance`` (array of k true distances), ``label`` (first nearest)
    and ``nearest``; samples and centers may be unsorted;
    ``ordered`` = False takes coordinates as they are (features)."""
    c = np.asarray(centers, float)
    c = np.sort(c, axis=1) if ordered else c

    def fn(x: np.ndarray) -> list[pa.Array]:
        if x.shape[1] != c.shape[1]:
            raise ValueError("samples and centers differ in length")
        d = power_cost(np.sort(x, axis=1) if ordered else x, c, p)
        d = np.sqrt(d) if p == 2 else d
        return [list_column(d), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))]

    return with_arrays(df, column, [T.StructField("distance", ARRAY), T.StructField("label", T.IntegerType()), T.StructField("nearest", T.DoubleType())], fn, keep)


def barycenters(df: DataFrame, p: int = 2, by: str = "label", column: str = "sample") -> DataFrame:
    """(by, center): coordinate means or medians of the sorted members, for a few
    groups.  Means are grouped by (group, place), so a large group is spread; medians
    take counts from tasks (``medians``)."""
    atoms = F.array_sort(column)
    if p == 2:
        made = df.select(by, F.posexplode(atoms).alias("pos", "x")).groupBy(by, "pos").agg(F.avg("x").alias("x"))
        return made.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("center"))
    groups = [r[0] for r in df.select(by).distinct().orderBy(by).collect()]  # a few
    kind = df.schema[by].dataType
    if not groups:
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(by, kind), T.StructField("center", ARRAY)]))
    number = F.coalesce(*[F.when(F.col(by).eqNullSafe(F.lit(g)), F.lit(i)) for i, g in enumerate(groups)]).cast("int")
    found = medians(df.select(number.alias("g"), atoms.alias("q")), len(groups))
    rows = [(g, v.tolist()) for g, v in zip(groups, found, strict=True)]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(by, kind), T.StructField("center", ARRAY)]))


#: Numbers that come to the driver at most when medians are settled.
SETTLE_NUMBERS = 1_000_000


def _ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    b = np.ascontiguousarray(x + 0.0).view(np.int64)
    return (b ^ ((b >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.uint64) ^ np.uint64(1 << 63)


def medians(members: DataFrame, k: int, settle: int = SETTLE_NUMBERS) -> np.ndarray:
    """Exact coordinate medians (k x L; midpoint for even counts; NaN for an empty
    group) of ``members`` (g from 0 to k - 1, q).

    A radix search over the bits of the doubles: every pass counts, for each group and
    place, the next eight bits of the numbers that share the bits found so far, until
    what is left of all groups and places is at most ``settle`` numbers, which come to
    the driver.  A task sends 256 counts a group and place, whatever the group's size."""
    sizes = {r["g"]: (r["n"], r["width"]) for r in members.groupBy("g").agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).collect()}
    if not sizes:
        return np.zeros((k, 0))
    width = next(iter(sizes.values()))[1]
    n = np.array([sizes.get(g, (0, 0))[0] for g in range(k)], np.int64)
    cells = k * width
    rank = np.repeat(np.maximum(n - 1, 0) // 2, width)
    left = np.repeat(n, width)
    prefix, known = np.zeros(cells, np.uint64), 0

    def scan(last: bool):
        seen, at = prefix.copy(), known

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, above = np.zeros(cells * 256, np.int64), np.full(cells, np.inf)
            cell_out: list[np.ndarray] = []
            value_out: list[np.ndarray] = []
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column(1))
                cell = (b.column(0).to_numpy().astype(np.int64)[:, None] * width + np.arange(width)).ravel()
                x, bits_ = x.ravel(), _ordered_bits(x).ravel()
                top = bits_ >> np.uint64(64 - at) if at else np.zeros(len(bits_), np.uint64)
                same = top == seen[cell]
                if not last:
                    digit = (bits_[same] >> np.uint64(56 - at)) & np.uint64(255)
                    counts += np.bincount(cell[same] * 256 + digit.astype(np.int64), minlength=cells * 256)
                    continue
                over = top > seen[cell]
                np.minimum.at(above, cell[over], x[over])
                if at < 64:
                    cell_out.append(cell[same])
                    value_out.append(x[same])
            if not last:
                hit = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit].astype(float))], names=["at", "v"])
                return
            far = np.flatnonzero(np.isfinite(above))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*cell_out, -1 - far]).astype(np.int64)), pa.array(np.concatenate([*value_out, above[far]]))], names=["at", "v"])

        pdf = members.select("g", "q").mapInArrow(run, "at long, v double").toPandas()
        return pdf["at"].to_numpy(np.int64), pdf["v"].to_numpy(float)

    while left.sum() > settle and known < 64:
        at, v = scan(False)
        counts = np.bincount(at, weights=v, minlength=cells * 256).astype(np.int64).reshape(cells, 256)
        upto = counts.cumsum(1)
        digit = (upto <= rank[:, None]).sum(1).clip(max=255)
        rank = rank - np.where(digit > 0, upto[np.arange(cells), np.maximum(digit - 1, 0)], 0)
        left = counts[np.arange(cells), digit]
        prefix = (prefix << np.uint64(8)) | digit.astype(np.uint64)
        known += 8
    at, v = scan(True)
    above = np.full(cells, np.inf)
    np.minimum.at(above, -1 - at[at < 0], v[at < 0])
    own, value = at[at >= 0], v[at >= 0]
    order = np.lexsort((value, own))
    own, value = own[order], value[order]
    starts = np.searchsorted(own, np.arange(cells))
    out = np.full(cells, np.nan)
    signed = prefix ^ np.uint64(1 << 63)
    back = signed.view(np.int64)
    exact = (back ^ ((back >> 63) & 0x7FFFFFFFFFFFFFFF)).view(np.float64)  # of the whole 64 bits
    for c in range(cells):
        size = int(n[c // width])
        if not size:
            continue
        pick = lambda r, c=c: (exact[c] if known == 64 else value[starts[c] + r]) if r < left[c] else above[c]
        low = pick(rank[c])
        out[c] = low if size % 2 else (low + pick(rank[c] + 1)) / 2
    return out.reshape(k, width)


def asset_scales(returns: DataFrame) -> DataFrame:
    """Population deviation of each asset's unique training rows; must be > 0."""
    made = returns.dropDuplicates(["symbol", "idx"]).groupBy("symbol").agg(F.stddev_pop("log_return").alias("scale"))
    return made.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.raise_error(F.lit("an asset does not vary")).cast("double")))


def unit_directions(count: int, dims: int, seed: int) -> np.ndarray:
    z = np.random.default_rng(seed).standard_normal((count, dims))
    return z / np.linalg.norm(z, axis=1, keepdims=True)


def project(x: np.ndarray, directions: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Rows of R x L sorted projections of windows given as L x D rows."""
    dims = len(scales)
    if np.abs((directions**2).sum(1) - 1).max() > 1e-12:
        raise ValueError("directions must have unit length")
    z = (x.reshape(len(x), -1, dims) / scales) @ directions.T
    z.sort(axis=1)
    if not np.isfinite(z).all():
        raise ValueError("a projection is not finite")
    return z.transpose(0, 2, 1).reshape(len(x), -1)


def sliced_w2(df: DataFrame, centers: np.ndarray, directions: np.ndarray, scales: np.ndarray, column: str = "sample", keep: Sequence[str] | None = None) -> DataFrame:
    """As ``distances``, for windows of L rows of D numbers: the root mean square
    over directions and ranks of the differences of sorted projections."""
    scales = np.asarray(scales, float)
    c = project(np.asarray(centers, float).reshape(len(centers), -1), directions, scales)

    def fn(x: np.ndarray) -> list[pa.Array]:
        d = np.sqrt(power_cost(project(x, directions, scales), c, 2))
        return [list_column(d), pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))]

    return with_arrays(df, column, [T.StructField("distance", ARRAY), T.StructField("label", T.IntegerType()), T.StructField("nearest", T.DoubleType())], fn, keep, inner=2)


def panel_features(sample: np.ndarray, kind: str) -> np.ndarray:
    """Features of windows (n, L, D): marginal, covariance or correlation."""
    n, length, dims = sample.shape
    if kind == "marginal":
        return np.sort(sample, axis=1).transpose(0, 2, 1).reshape(n, -1) / np.sqrt(length * dims)
    mid = sample - sample.mean(1, keepdims=True)
    cov = np.einsum("nli,nlj->nij", mid, mid) / length
    if kind == "covariance":
        return cov[:, *np.triu_indices(dims)]
    if kind != "correlation" or dims < 2:
        raise ValueError("correlation features need two assets or more")
    flat = (sample == sample[:, :1]).all(1)
    sd = np.sqrt(np.einsum("nii->ni", cov))
    sd[flat] = 0
    scale = sd[:, :, None] * sd[:, None, :]
    rho = np.clip(np.divide(cov, scale, out=np.zeros_like(cov), where=scale > 0), -1, 1)
    return rho[:, *np.triu_indices(dims, 1)]
