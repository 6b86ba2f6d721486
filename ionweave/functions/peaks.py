"""Expressions on arrays of (mz, intensity) structs. All are built in: nothing leaves the JVM."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mass of a hydrogen atom as the precursor filter takes it (fixed value).
HYDROGEN = 1.00782503207


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it.

    Spark copies an expression to each place that uses it, also when it moves a filter below a
    projection; a chain of steps would so grow beyond bounds, and lambdas would compute it for each element.
    """
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def get_dim(min_mz: float, max_mz: float, bin_size: float) -> tuple[int, float, float]:
    """Number of bins, and the range snapped outwards to multiples of the bin size, in single precision."""
    lo, hi, w = np.float32(min_mz), np.float32(max_mz), np.float32(bin_size)
    start = np.float32(lo - np.float32(np.fmod(lo, w)))
    end = np.float32(np.float32(hi + w) - np.float32(np.fmod(hi, w)))
    return math.ceil(float(np.float32(np.float32(end - start) / w))), float(start), float(end)


def in_range(peaks: Column, low: float | None, high: float | None) -> Column:
    """Peaks with low <= m/z <= high; a bound that is None doesn't hold."""
    if low is not None:
        peaks = F.filter(peaks, lambda p: p["mz"] >= low)
    return peaks if high is None else F.filter(peaks, lambda p: p["mz"] <= high)


def is_valid(peaks: Column, min_peaks: int, min_range: float) -> Column:
    """Whether there are enough peaks over a wide enough range; peaks are in order of m/z."""
    wide = F.try_element_at(peaks, F.lit(-1))["mz"] - F.try_element_at(peaks, F.lit(1))["mz"] >= min_range
    return F.coalesce((F.size(peaks) >= min_peaks) & F.coalesce(wide, F.lit(min_peaks <= 0 and min_range <= 0)), F.lit(False))


def without_precursor(peaks: Column, precursor_mz: Column, charge: Column, tol: float) -> Column:
    """Peaks farther than tol from the precursor at its charge and all below; a null charge counts as 1."""
    z = F.greatest(F.coalesce(charge.cast("int"), F.lit(1)), F.lit(1))
    mass = (precursor_mz.cast("double") - HYDROGEN) * z
    at = F.transform(F.sequence(F.lit(1), z), lambda c: mass / c + HYDROGEN)
    return let(at, lambda every: F.filter(peaks, lambda p: ~F.exists(every, lambda m: F.abs(p["mz"] - m) <= tol)))


def above(peaks: Column, fraction: float) -> Column:
    """Peaks stronger than a fraction of the strongest."""
    most = F.array_max(F.transform(peaks, lambda p: p["intensity"]))
    return let(most, lambda top: F.filter(peaks, lambda p: p["intensity"] > fraction * top))


def _by_intensity(peaks: Column) -> Column:
    """Strongest first; equal intensities in order of m/z."""
    keyed = F.transform(peaks, lambda p: F.struct((-p["intensity"]).alias("o"), p["mz"].alias("mz"), p["intensity"].alias("intensity")))
    return F.array_sort(keyed)


def top_k(peaks: Column, k: int) -> Column:
    """The k strongest peaks, in order of m/z."""
    best = F.transform(F.slice(_by_intensity(peaks), 1, k), lambda p: F.struct(p["mz"].alias("mz"), p["intensity"].alias("intensity")))
    return F.when(F.size(peaks) > k, F.array_sort(best)).otherwise(peaks)


def _mapped(peaks: Column, f) -> Column:
    return F.transform(peaks, lambda p: F.struct(p["mz"].alias("mz"), f(p["intensity"].cast("double")).alias("intensity")))


def scaled(peaks: Column, how: str, max_rank: int | None = None) -> Column:
    """Intensities as they are (off), their roots, log2(1 + x), or ranks (the strongest gets max_rank)."""
    if how == "root":
        return _mapped(peaks, F.sqrt)
    if how == "log":
        return _mapped(peaks, lambda x: F.log2(1 + x))
    if how == "rank":
        top = F.lit(max_rank) if max_rank else F.size(peaks)
        ranked = F.transform(_by_intensity(peaks), lambda p, i: F.struct(p["mz"].alias("mz"), (top - i).cast("double").alias("intensity")))
        return F.array_sort(ranked)
    return peaks


def norm(peaks: Column) -> Column:
    """Length of the vector of intensities."""
    return F.aggregate(peaks, F.lit(0.0), lambda a, p: a + p["intensity"].cast("double") * p["intensity"], F.sqrt)


def unit(peaks: Column) -> Column:
    """Peaks with intensities divided by their norm."""
    return let(norm(peaks), lambda n: _mapped(peaks, lambda x: x / n))


def bin_of(mz: Column, min_mz: float, bin_size: float) -> Column:
    return F.floor((mz - min_mz) / bin_size)
