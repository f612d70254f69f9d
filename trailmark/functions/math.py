"""Closed forms of the transition functions, as column expressions and as numpy functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def ln(p: Column) -> Column:
    """Natural logarithm with ln 0 = -inf (Spark's is null)."""
    return F.when(p > 0, F.log(p)).otherwise(F.lit(float("-inf")))


def gaussian(dx: Column, dy: Column, sigma: float, amplitude: float = 1.0, floor: float = 0.0) -> Column:
    """A two-dimensional Gaussian, not below `floor`."""
    return F.greatest(F.lit(amplitude) * F.exp(-(dx * dx + dy * dy) / (2.0 * sigma * sigma)), F.lit(floor))


def ring(distance: Column, mean: Column, sigma: Column, trough: float) -> Column:
    """A Gaussian ring at distance `mean`; inside it the value does not fall below `trough`."""
    g = F.exp(-((distance - mean) * (distance - mean)) / (2.0 * sigma * sigma))
    return F.when(distance < mean, F.greatest(g, F.lit(trough))).otherwise(g)


def quartic(d: Column, a: float, b: float, c: float) -> Column:
    """The former skeleton function c * exp(a d^2 - b d^4)."""
    return F.lit(c) * F.exp(a * d * d - b * d * d * d * d)


def interpolated(dx: Column, dy: Column, sigma: float, scale: float) -> Column:
    """The Gaussian tabulated at whole pixels, between them bilinear, at |dx| * scale and |dy| * scale."""
    ax, ay = F.abs(dx) * scale, F.abs(dy) * scale
    x0, y0 = F.floor(ax), F.floor(ay)
    fx, fy = ax - x0, ay - y0
    at = lambda i, j: F.exp(-((x0 + i) * (x0 + i) + (y0 + j) * (y0 + j)) / (2.0 * sigma * sigma))
    return (1 - fx) * (1 - fy) * at(0, 0) + fx * (1 - fy) * at(1, 0) + (1 - fx) * fy * at(0, 1) + fx * fy * at(1, 1)


def clamp_into_cell(value: Column, cell: Column, eps: float = 1e-6) -> Column:
    """Strictly inside (cell, cell + 1)."""
    return F.greatest(F.least(value, cell + 1 - eps), cell + eps)


def separation_bound(n: int) -> float:
    """The largest possible smallest distance of n points in a unit square; closed forms up to nine points, then a hexagonal bound."""
    # Known optima for 2 to 9 points.
    known = {2: np.sqrt(2), 3: np.sqrt(6) - np.sqrt(2), 4: 1.0, 5: np.sqrt(2) / 2, 6: np.sqrt(13) / 6, 7: 4 - 2 * np.sqrt(3), 8: (np.sqrt(6) - np.sqrt(2)) / 2, 9: 0.5}
    return float(known[n]) if n in known else float(np.sqrt(2 / (np.sqrt(3) * n)) * (1 + 1 / np.sqrt(n)))


def log_gaussian_table(dx: np.ndarray, dy: np.ndarray, sigma: float) -> np.ndarray:
    return -(dx * dx + dy * dy) / (2.0 * sigma * sigma)
