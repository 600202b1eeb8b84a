"""Functions over numeric series (ARRAY<DOUBLE> columns), all built from Spark's own higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: what stands in a lambda is otherwise evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def positions(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def at(arr: Column, position: Column) -> Column:
    """Linear interpolation between the neighbours of a fractional position."""
    last = F.size(arr) - 1
    low = F.least(F.floor(position).cast("int"), last)
    high = F.least(low + 1, last)
    return F.get(arr, low) + (F.get(arr, high) - F.get(arr, low)) * (position - low)


def resample(arr: Column, n: int) -> Column:
    """n values at even positions from the first to the last element."""
    return let(arr, lambda a: F.transform(positions(n), lambda i: at(a, i * (F.size(a) - 1) / F.lit(float(max(1, n - 1))))))


def resample_span(arr: Column, n: int) -> Column:
    """n values at i * (len - 1) / n: the last element is never reached."""
    return let(arr, lambda a: F.transform(positions(n), lambda i: at(a, i * (F.size(a) - 1) / F.lit(float(n)))))


def depth_channel(depths: Column, n: int) -> Column:
    """Negative depths clipped, square root, then resampled."""
    return resample(F.transform(depths, lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))), n)


def measured(size: Column, start: Column, end: Column) -> Column:
    """Indexes whose angle 180 i / (size - 1) lies inside the interval, both ends excluded."""
    angle = lambda i: i * 180.0 / (size - 1)
    return F.filter(F.sequence(F.lit(0), size - 1), lambda i: (angle(i) > start) & (angle(i) < end))


def gradient_channel(depths: Column, start: Column, end: Column, n: int) -> Column:
    """Signed square root of the central difference inside the measured interval, one-sided at its ends, zero outside; resampled."""
    inside = measured(F.size(depths), start, end)
    clipped = F.transform(depths, lambda x: F.greatest(x, F.lit(0.0)))
    parts = F.struct(clipped.alias("d"), F.array_min(inside).alias("low"), F.array_max(inside).alias("high"))

    def channel(p):
        d, low, high = p["d"], p["low"], p["high"]

        def slope(i):
            left, right = F.greatest(i - 1, low), F.least(i + 1, high)
            g = F.when((i < low) | (i > high) | (left >= right), F.lit(0.0)).otherwise((F.get(d, right) - F.get(d, left)) / F.greatest(right - left, F.lit(1)))
            return F.coalesce(F.signum(g) * F.sqrt(F.abs(g)), F.lit(0.0))

        return F.transform(F.sequence(F.lit(0), F.size(d) - 1), slope)

    return resample(let(parts, channel), n)


def stretch(arr: Column, factor) -> Column:
    """Scaled about the centre; zero where the source has nothing."""
    last = F.size(arr) - 1
    factor = _d(factor)

    def value(i):
        p = ((i / last - 0.5) / factor + 0.5) * last
        return F.when((p < 0) | (p > last), F.lit(0.0)).otherwise(at(arr, F.greatest(p, F.lit(0.0))))

    return F.transform(F.sequence(F.lit(0), last), value)


def shift(arr: Column, bins) -> Column:
    """Moved right by whole bins (left if negative), filled with zeros."""
    b = bins if isinstance(bins, Column) else F.lit(int(bins))
    return F.transform(F.sequence(F.lit(0), F.size(arr) - 1), lambda i: F.when((i - b >= 0) & (i - b < F.size(arr)), F.get(arr, i - b)).otherwise(F.lit(0.0)))


def aligned(arr: Column, factor: Column, bins: Column) -> Column:
    """Stretched, then shifted by whole bins; null where the stretch is not above 0 or not finite."""
    good = (factor > 0) & ~F.isnan(factor) & (factor < float("inf"))
    return F.when(good, let(let(F.struct(arr.alias("a"), factor.alias("f")), lambda p: stretch(p["a"], p["f"])), lambda s: shift(s, bins)))


def weighted_l1(arr: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(arr, weights, lambda x, w: F.abs(x) * w), F.lit(0.0), lambda s, x: s + x)


def weighted_jaccard(a: Column, b: Column, weights: Column) -> Column:
    """(|a| + |b| - |a - b|) / (|a| + |b| + |a - b|) in the weighted L1 norm; 0 where the denominator is."""
    both = weighted_l1(a, weights) + weighted_l1(b, weights)
    apart = weighted_l1(F.zip_with(a, b, lambda x, y: x - y), weights)
    return F.when(both + apart > 0, (both - apart) / (both + apart)).otherwise(F.lit(0.0))


def angle_weights(n: int, centre: float = 120.0, width: float = 35.0) -> Column:
    """A Gaussian over the angles 180 i / (n - 1)."""
    return F.transform(positions(n), lambda i: F.exp(F.lit(-0.5) * F.pow((i * (180.0 / (n - 1)) - centre) / width, F.lit(2.0))))


def log_mean_exp(column: Column, tau: float, top: Column) -> Column:
    """Aggregate tau (ln sum exp(s / tau) - ln n); `top` is the group's largest value, so that nothing overflows."""
    return top + F.lit(tau) * (F.log(F.sum(F.exp((column - top) / tau))) - F.log(F.count(column)))


def gaussian_kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    total = sum(raw)
    return [x / total for x in raw]


def smooth(arr: Column, sigma: float) -> Column:
    """Gaussian smoothing with reflected ends (the end value counts twice)."""
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    size = F.size(arr)

    def value(i):
        def reflected(j):
            m = F.pmod(j, 2 * size)
            return F.get(arr, F.when(m < size, m).otherwise(2 * size - 1 - m))

        taps = F.zip_with(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda o: reflected(i + o)), F.array(*map(F.lit, kernel)), lambda x, k: x * k)
        return F.aggregate(taps, F.lit(0.0), lambda s, x: s + x)

    return F.transform(F.sequence(F.lit(0), size - 1), value)


def overlap(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def stride(arr: Column, target: int = 240, digits: int = 4) -> Column:
    """About `target` points at an even stride, rounded half-even."""
    step = F.greatest(F.lit(1), F.floor(F.size(arr) / F.lit(target)).cast("int"))
    return F.transform(F.filter(arr, lambda x, i: i % step == 0), lambda x: F.bround(x, digits))


def peak(arr: Column) -> tuple[Column, Column, Column]:
    """Number of bins, largest value and the angle of the first largest; nulls if nothing is finite."""
    finite = F.filter(arr, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.array_max(finite)
    return F.size(arr), top, (F.array_position(arr, top) - 1) * 180.0 / F.greatest(F.size(arr) - 1, F.lit(1))


def trimmed_rms(arr: Column, trim: int, floor: float) -> Column:
    """Root mean square without `trim` bins at either end; null below floor."""
    body = F.slice(arr, F.lit(trim + 1), F.size(arr) - 2 * trim)
    value = F.sqrt(F.aggregate(body, F.lit(0.0), lambda s, x: s + x * x) / F.size(body))
    return F.when(value >= floor, value)


def mass(arr: Column) -> Column:
    """Sum of the depths, negative ones clipped."""
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
