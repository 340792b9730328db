"""Distances, moments and path statistics of samples held in array columns.

All are built-in expressions.  An intermediate that a lambda uses is bound once
with ``let``: an expression named inside a lambda is evaluated for each element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def is_constant(a: Column) -> Column:
    """Whether all atoms are equal, exactly; sums of squares cannot tell."""
    return F.array_min(a) == F.array_max(a)


def sd(a: Column) -> Column:
    """Population standard deviation, exactly 0 for a constant sample."""
    spread = let(mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))
    return F.when(is_constant(a), F.lit(0.0)).otherwise(spread)


def sorted_cost(x: Column, y: Column, p: int) -> Column:
    """Mean p-th power difference of two sorted samples of one length."""
    diff = F.zip_with(x, y, lambda a, b: F.abs(a - b) if p == 1 else (a - b) * (a - b))
    return total(diff) / F.size(x)


def wasserstein(x: Column, y: Column, p: int = 2) -> Column:
    """Exact one-dimensional W1 or W2 of two samples of one length."""
    if p not in (1, 2):
        raise ValueError("p must be 1 or 2")
    cost = sorted_cost(F.array_sort(x), F.array_sort(y), p)
    return F.sqrt(cost) if p == 2 else cost


def w2_parts(x: Column, y: Column) -> Column:
    """Squared W2 as struct(location, scale, shape, total)."""
    def parts(v: Column) -> Column:
        a, b = v["a"], v["b"]

        def inner(s: Column) -> Column:
            cov = F.aggregate(F.zip_with(a, b, lambda p, q: (p - s["ma"]) * (q - s["mb"])), F.lit(0.0), lambda t, z: t + z) / F.size(a)
            rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, s["sa"] * s["sb"])))
            location = (s["ma"] - s["mb"]) * (s["ma"] - s["mb"])
            scale = (s["sa"] - s["sb"]) * (s["sa"] - s["sb"])
            shape = F.when((s["sa"] == 0) | (s["sb"] == 0), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 2 * s["sa"] * s["sb"] * (1 - rho)))
            return F.struct(location.alias("location"), scale.alias("scale"), shape.alias("shape"), (location + scale + shape).alias("total"))

        return let(F.struct(mean(a).alias("ma"), mean(b).alias("mb"), sd(a).alias("sa"), sd(b).alias("sb")), inner)

    return let(F.struct(F.array_sort(x).alias("a"), F.array_sort(y).alias("b")), parts)


def standardize(a: Column) -> Column:
    """(x - mean) / sd in the given order; zeros for a constant sample."""
    scaled = let(F.struct(mean(a).alias("m"), sd(a).alias("s")), lambda v: F.transform(a, lambda x: (x - v["m"]) / v["s"]))
    return F.when(is_constant(a), F.transform(a, lambda _: F.lit(0.0))).otherwise(scaled)


def moments(a: Column) -> Column:
    """array(mean, sd, skewness, excess kurtosis); the last three 0 if constant."""
    def body(v: Column) -> Column:
        def power(k: int) -> Column:
            return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow((x - v["m"]) / v["s"], k)) / F.size(a)

        return F.array(v["m"], v["s"], power(3), power(4) - 3)

    flat = F.array(F.element_at(a, 1), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    return F.when(is_constant(a), flat).otherwise(let(F.struct(mean(a).alias("m"), sd(a).alias("s")), body))


def quantile(ordered: Column, q: float) -> Column:
    """Linear interpolation between the atoms of a sorted sample."""
    def body(h: Column) -> Column:
        low = F.floor(h).cast("int")
        a = F.get(ordered, low)
        return a + (h - low) * (F.get(ordered, F.least(low + 1, F.size(ordered) - 1)) - a)

    return let((F.size(ordered) - 1) * F.lit(float(q)), body)


def downside(a: Column) -> Column:
    """Root mean square of the negative parts."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.pow(F.least(x, F.lit(0.0)), 2)) / F.size(a))


def drawdown(a: Column) -> Column:
    """Largest fall of cumulated log returns from their peak, as a fraction."""
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"))

    def step(s: Column, x: Column) -> Column:
        cum = s["cum"] + x
        peak = F.greatest(s["peak"], cum)
        return F.struct(cum.alias("cum"), peak.alias("peak"), F.greatest(s["fall"], peak - cum).alias("fall"))

    return F.aggregate(a, start, step, lambda s: 1 - F.exp(-s["fall"]))


def features(a: Column, kind: str = "rich") -> Column:
    """A feature array: volatility 1, mean_vol 2, moments 4, rich 15 numbers."""
    if kind == "volatility":
        return F.array(sd(a))
    if kind == "mean_vol":
        return F.array(mean(a), sd(a))
    if kind == "moments":
        return moments(a)
    if kind != "rich":
        raise ValueError(f"unknown feature kind: {kind}")
    levels = let(F.array_sort(a), lambda q: F.array(*[quantile(q, p) for p in QUANTILES]))
    return F.concat(moments(a), levels, F.array(downside(a), drawdown(a)))


def ewma(a: Column, decay: float, start: Column) -> Column:
    """decay * e + (1 - decay) * x, folded over the array."""
    return F.aggregate(a, start, lambda e, x: decay * e + (1 - decay) * x)


def first_argmin(a: Column) -> Column:
    """Zero-based place of the least element, the first of equals."""
    return (F.array_position(a, F.array_min(a)) - 1).cast("int")


def novelty(distances: Column, calibration: Sequence[float] | None = None, threshold: float = 0.95) -> Column:
    """struct(nearest, second, margin, percentile, ood) of a distance array.

    The calibration is a bounded sorted sample held as a literal; for large
    ones use operators.evaluate.percentiles."""
    ordered = F.array_sort(distances)
    near, second = F.get(ordered, F.lit(0)), F.get(ordered, F.lit(1))
    margin = F.when(second.isNull(), F.lit(None)).when(second == 0, F.lit(0.0)).otherwise((second - near) / second)
    cols = [near.alias("nearest"), second.alias("second"), margin.alias("margin")]
    if calibration is not None:
        cal = F.array(*[F.lit(float(x)) for x in sorted(calibration)])
        share = F.size(F.filter(cal, lambda c: c <= near)) / F.lit(len(calibration))
        cols += [share.alias("percentile"), (share >= threshold).alias("ood")]
    return F.struct(*cols)
