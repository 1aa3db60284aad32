"""Library complexity: what deeper sequencing would add.

The histogram of fragment multiplicities is aggregated by Spark; it has a few
hundred rows, and all that follows is arithmetic on it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

Histogram = Sequence[tuple[int, int]]


def frequency_of_frequencies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """j -> n_j: how many fragments were seen j times."""
    return df.groupBy(*keys).agg(F.count("*").alias("j")).groupBy("j").agg(F.count("*").alias("n_j"))


def good_toulmin(histogram: DataFrame) -> DataFrame:
    """Distinct and total fragments, and the gain expected of doubling the depth."""
    sign = F.when(F.col("j") % 2 == 1, F.col("n_j")).otherwise(-F.col("n_j"))
    return histogram.agg(F.sum("n_j").alias("distinct"), F.sum(F.col("j") * F.col("n_j")).alias("total"), F.sum(sign).alias("gain"))


def power_series(histogram: Histogram, terms: int) -> list[float]:
    counts = dict(histogram)
    return [(-1) ** j * float(counts.get(j + 1, 0)) for j in range(min(terms, max(counts, default=0)))]


def continued_fraction(series: Sequence[float]) -> np.ndarray:
    """a with series(t) = a0 / (1 + a1 t / (1 + a2 t / ...)), by repeated division of power series."""
    if not len(series):
        return np.zeros(0)
    below = np.array(series, np.float64)
    out = [below[0]]
    # series = a0 / (1 + t * rest): the next level's series is what the division leaves, shifted by one power.
    current = below
    for _ in range(1, len(series)):
        if current[0] == 0:
            break
        inverse = np.zeros(len(current))
        inverse[0] = 1.0
        quotient = np.zeros(len(current))
        for k in range(len(current)):
            quotient[k] = (current[0] * inverse[k] - quotient[:k] @ current[k:0:-1]) / current[0] if k else 1.0
        current = quotient[1:]
        if not len(current) or not np.isfinite(current).all():
            break
        out.append(current[0])
    return np.array(out + [0.0] * (len(series) - len(out)))


def evaluate(fraction: np.ndarray, t: np.ndarray | float, degree: int) -> np.ndarray:
    """The first ``degree`` levels at t, from the innermost out."""
    t = np.asarray(t, np.float64)
    value = np.ones_like(t)
    with np.errstate(divide="ignore", invalid="ignore"):
        for a in fraction[min(degree, len(fraction)) - 1 : 0 : -1]:
            value = 1 + a * t / value
        return fraction[0] / value


def _well_behaved(curve: np.ndarray) -> bool:
    """Finite, non-negative, rising and concave."""
    step = np.diff(curve)
    return bool(np.isfinite(curve).all() and (curve >= 0).all() and (step >= 0).all() and (np.diff(step) <= 0).all())


def select_degree(fraction: np.ndarray, terms: int) -> int | None:
    """The least degree whose extrapolation behaves on a grid up to a hundredfold."""
    grid = 0.05 * np.arange(1, 2001)
    degrees = [terms] if 3 <= terms <= 6 else range(7 + (terms % 2 == 0), terms + 1, 2)
    for degree in degrees:
        if degree <= len(fraction):
            curve = grid * evaluate(fraction, grid, degree)
            if curve[0] >= 0 and _well_behaved(curve):
                return degree
    return None


def _log_binomial(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def interpolate(histogram: Histogram, total: int, distinct: int, target: float) -> float:
    """Expected distinct fragments in a subsample; the running sum of misses is cut to whole numbers."""
    t = int(target)
    if t >= total:
        return float(distinct)
    whole = _log_binomial(total, t)
    missed = 0
    for j, n in sorted(histogram):
        if n and total >= j + t:
            missed = int(missed + math.exp(_log_binomial(total - j, t) - whole) * n)
    return float(distinct - missed)


def first_gap(histogram: Histogram) -> int:
    seen = {j for j, n in histogram if n}
    j = 1
    while j in seen:
        j += 1
    return j


def curve(histogram: Histogram, distinct_for_extrapolation: int, targets: np.ndarray, max_terms: int = 100) -> np.ndarray | None:
    total, distinct = sum(j * n for j, n in histogram), sum(n for _, n in histogram)
    terms = min(max_terms, first_gap(histogram) - 1)
    terms -= terms % 2
    fraction = continued_fraction(power_series(histogram, terms))
    degree = select_degree(fraction, terms) if len(fraction) else None
    if degree is None:
        return None
    near = targets < total
    out = np.empty(len(targets))
    out[near] = [interpolate(histogram, total, distinct, t) for t in targets[near]]
    fold = (targets[~near] - total) / total
    out[~near] = distinct_for_extrapolation + fold * evaluate(fraction, fold, degree)
    return out


def resample(histogram: Histogram, random: np.random.Generator) -> list[tuple[int, int]]:
    """A multinomial draw of as many fragments, by their multiplicities."""
    j, n = zip(*sorted((j, n) for j, n in histogram if n), strict=True)
    drawn = random.multinomial(sum(n), np.array(n) / sum(n))
    return [(a, int(b)) for a, b in zip(j, drawn, strict=True) if b]


def estimate(histogram: Histogram, step: float = 1e6, maximum: float = 1e10, bootstraps: int = 100, level: float = 0.95, max_terms: int = 100, seed: int = 408) -> list[tuple[float, float, float, float]]:
    """Rows (total, expected distinct, lower, upper), medians and quantiles over bootstrap replicates."""
    histogram = [(int(j), int(n)) for j, n in histogram if n]
    distinct = sum(n for _, n in histogram)
    if distinct < 10:
        raise ValueError(f"too few distinct fragments: {distinct}")
    if sum((1 if j % 2 else -1) * n for j, n in histogram) < 0:
        raise ValueError("doubling the depth would lose fragments: the histogram is unreliable")
    targets = np.arange(1, math.ceil(maximum / step)) * step
    if not bootstraps:
        point = curve(histogram, distinct, targets, max_terms)
        return [] if point is None else [(t, e, math.nan, math.nan) for t, e in zip(targets.tolist(), point.tolist(), strict=True)]
    random, kept = np.random.default_rng(seed), []
    for _ in range(100 * bootstraps):
        made = curve(resample(histogram, random), distinct, targets, max_terms)
        if made is not None and _well_behaved(made):
            kept.append(made)
            if len(kept) == bootstraps:
                break
    if not kept:
        return [(t, math.nan, math.nan, math.nan) for t in targets.tolist()]
    table = np.array(kept)
    low, middle, high = np.quantile(table, [(1 - level) / 2, 0.5, (1 + level) / 2], axis=0)
    if len(kept) == 1:
        low = high = np.full(len(targets), np.nan)
    return list(zip(targets.tolist(), middle.tolist(), low.tolist(), high.tolist(), strict=True))
