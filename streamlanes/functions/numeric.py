"""Numeric and array functions, as columns where Spark has what they need and as numpy for kernels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-4


def mean(values: Column) -> Column:
    """Mean of an array; an empty one is an error."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) < 1, F.raise_error(F.lit("mean of nothing"))).otherwise(total / F.size(values))


def variance(values: Column) -> Column:
    """Sample variance of an array; fewer than two values are an error."""
    m = mean(values)
    total = F.aggregate(F.transform(values, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) < 2, F.raise_error(F.lit("variance of fewer than two values"))).otherwise(total / (F.size(values) - 1))


def pairwise_min(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.least(x, y))


def pairwise_max(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def within_limits(a: Column, b: Column, eps: float = EPSILON) -> Column:
    return F.abs(a - b) <= F.lit(eps)


def lossless_cast(value: Column, to: str) -> Column:
    """``value`` as another type; an error where information would be lost. 0 and 1 are false and true."""
    done = value.try_cast(to)
    # As whole numbers: through a double, those above 2^53 would pass. With all digits that fit, and as doubles.
    whole = F.coalesce(done.try_cast("decimal(38,0)") == value.try_cast("decimal(38,0)"), F.lit(True))
    exact = F.coalesce(done.try_cast("decimal(38,18)") == value.try_cast("decimal(38,18)"), F.lit(True))
    again = whole & exact & (done.try_cast("double") == value.try_cast("double"))
    back = F.when(value.isNull(), True).otherwise(F.coalesce(again, F.lit(False)))
    return F.when(back, done).otherwise(F.raise_error(F.lit(f"value does not fit {to}")))


def duration_text(ms: Column) -> Column:
    """HH:mm:ss:SSS of a duration in ms; hours may pass 99."""
    ms = ms.cast("long")
    hours, rest = F.floor(ms / 3_600_000), ms % 3_600_000
    return F.format_string("%02d:%02d:%02d:%03d", hours, F.floor(rest / 60_000), F.floor(rest % 60_000 / 1000), rest % 1000)


#: From so many taps on sliding dot products are taken by FFT.
DIRECT_TAPS = 64


def sliding_dot(x: Sequence[float], taps: Sequence[float]) -> np.ndarray:
    """Dot products of ``taps`` along ``x`` where they lie inside it, not flipped.

    Many taps go by overlap-save: pieces of ``x`` of a few times their length, each with what the next needs of it, are
    multiplied in the frequency domain, so a result costs the logarithm of the taps, not their number.
    """
    x, taps = np.asarray(x, float), np.asarray(taps, float)
    k, n = len(taps), len(x) - len(taps) + 1
    if k < DIRECT_TAPS or n < 1:
        return np.correlate(x, taps, "valid") if n > 0 else np.empty(0)
    size = 1 << (4 * k - 1).bit_length()
    step = size - k + 1
    pieces = -(-n // step)
    centre = x.mean()  # what all values have in common would only cost digits
    padded = np.zeros((pieces - 1) * step + size)
    padded[: len(x)] = x - centre
    windows = np.lib.stride_tricks.sliding_window_view(padded, size)[::step]
    spectrum = np.fft.rfft(taps[::-1], size)
    y = np.fft.irfft(np.fft.rfft(windows, axis=1) * spectrum, size, axis=1)[:, k - 1 :]
    return y.reshape(-1)[:n] + centre * taps.sum()


def correlate(x: Sequence[float], y: Sequence[float], factor: float = 1.0, offset: float = 0.0) -> np.ndarray:
    """factor * d + offset of the sliding dot products d of ``y`` along ``x``."""
    return factor * sliding_dot(x, y) + offset


def _density(at: np.ndarray, centre: float, sd: float) -> np.ndarray:
    return np.exp(-0.5 * ((at - centre) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))


def gauss_kernel(length: int, sd: float) -> np.ndarray:
    """A normal density over 1..length around the middle, summing to 1."""
    k = _density(np.arange(1, length + 1), (length + 1) / 2, sd)
    return k / k.sum()


def log_kernel(length: int, sd: float) -> tuple[np.ndarray, float, float]:
    """Laplacian of a Gaussian times sd^2: taps, the sum of its negative and of its positive ones."""
    k = _density(np.arange(0, length + 2), (length + 1) / 2, sd)
    taps = np.correlate(k / k.sum(), [1.0, -2.0, 1.0], "valid") * sd * sd
    return taps, float(taps[taps < 0].sum()), float(taps[taps > 0].sum())


def total_of(numbers: Sequence[float]) -> float:
    """The sum, as configurations ask for it."""
    return sum(numbers)


def indices(start: int, end: int) -> list[int]:
    """Whole numbers from ``start`` up to but without ``end``."""
    return list(range(start, end))


def same_sets(a: set, b: set) -> bool:
    return set(a) == set(b)


def is_partition(parts: Sequence[set], whole: set) -> bool:
    """Whether ``parts`` are disjoint, not empty and together ``whole``."""
    return all(parts) and sum(map(len, parts)) == len(whole) and set().union(*parts) == whole
