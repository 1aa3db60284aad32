"""Small numeric routines; what grows with the data is aggregated by Spark first."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F


def logistic_fit(df: DataFrame, x: str = "rpk", y: str = "dup_rate", most: int = 25, tolerance: float = 1e-8) -> tuple[float, float]:
    """Intercept and slope of logit(y) on log10(x) by reweighted least squares.

    Rows need x > 0 and finite y, which is clamped within (0, 1).  Each round is one aggregate of six sums, so the
    rows may be of any number.
    """
    near = 1e-10
    rows = df.filter((F.col(x) > 0) & F.col(y).isNotNull() & ~F.isnan(y)).select(F.log10(x).alias("x"), F.greatest(F.lit(near), F.least(F.lit(1 - near), F.col(y).cast("double"))).alias("y"))
    rows = rows.persist()
    try:
        if rows.count() < 2:
            raise ValueError("the fit needs two rows at least")

        def weighted(mu) -> np.ndarray:
            v = mu * (1 - mu)
            z = F.log(mu / (1 - mu)) + (F.col("y") - mu) / v
            sums = rows.filter(v > 1e-20).agg(*[F.sum(s) for s in (v, v * F.col("x"), v * F.col("x") ** 2, v * z, v * F.col("x") * z)]).first()
            sw, sx, sxx, sz, sxz = map(float, sums)
            return np.linalg.solve(np.array([[sw, sx], [sx, sxx]]), np.array([sz, sxz]))

        def mean(beta: np.ndarray):
            return 1 / (1 + F.exp(-(F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.col("x"))))

        def deviance(beta: np.ndarray) -> float:
            mu = F.greatest(F.lit(near), F.least(F.lit(1 - near), mean(beta)))
            return float(rows.agg(F.sum(2 * (F.col("y") * F.log(F.col("y") / mu) + (1 - F.col("y")) * F.log((1 - F.col("y")) / (1 - mu))))).first()[0])

        beta = weighted((F.col("y") + 0.5) / 2)
        last = deviance(beta)
        for _ in range(most):
            beta = weighted(mean(beta))
            now = deviance(beta)
            if abs(now - last) / (0.1 + abs(now)) < tolerance:
                break
            last = now
        return float(beta[0]), float(beta[1])
    finally:
        rows.unpersist()


def logistic_predict(x: float, intercept: float, slope: float) -> float:
    return 1 / (1 + math.exp(-(intercept + slope * math.log10(x))))


def logistic_curve(log_x, intercept: float, slope: float):
    """The same prediction as a column expression of log10(x)."""
    return 1 / (1 + F.exp(-(F.lit(intercept) + F.lit(slope) * log_x)))


def percentile_p(values: list[float], percent: float) -> float:
    """The p(n+1)/100 percentile, kept within the values."""
    ordered = sorted(values)
    at = percent * (len(ordered) + 1) / 100
    k = int(at)
    if k < 1:
        return ordered[0]
    if k >= len(ordered):
        return ordered[-1]
    return ordered[k - 1] + (at - k) * (ordered[k] - ordered[k - 1])


def density_1d(values: np.ndarray, weights: np.ndarray, points: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian density of weighted values on an even grid, with the normal-reference bandwidth."""
    total = weights.sum()
    mean = (values * weights).sum() / total
    sd = math.sqrt(max(((values - mean) ** 2 * weights).sum() / max(total - 1, 1), 1e-12))
    order = np.argsort(values)
    upto = np.cumsum(weights[order]) / total
    quarters = [float(values[order][min(int(np.searchsorted(upto, q)), len(values) - 1)]) for q in (0.25, 0.75)]
    spread = min(sd, (quarters[1] - quarters[0]) / 1.34) or sd or 1.0
    width = 0.9 * spread * total ** -0.2
    grid = np.linspace(values.min() - 3 * width, values.max() + 3 * width, points)
    bell = np.exp(-0.5 * ((grid[:, None] - values[None]) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return grid, bell @ weights / total


def pretty_breaks(low: float, high: float, n: int = 5) -> list[float]:
    """About n round steps of 1, 2 or 5 times a power of ten that cover low to high."""
    if high <= low:
        return [low]
    raw = (high - low) / n
    power = 10 ** math.floor(math.log10(raw))
    step = min((m * power for m in (1, 2, 5, 10)), key=lambda s: abs(s - raw))
    first, last = math.floor(low / step + 1e-9), math.ceil(high / step - 1e-9)
    return [k * step for k in range(first, last + 1)]
