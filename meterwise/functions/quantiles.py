"""Percentile forecasts as arrays of 99 levels (0.01 .. 0.99), in array expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = [i / 100 for i in range(1, 100)]
TAIL = math.log(5.0)  # the exponential tail is fitted between levels 0.95 and 0.99 (0.05 and 0.01)
LEAST_SPREAD = 1e-6
PRICE_BOUNDS = (-500.0, 4000.0)


def levels() -> Column:
    return F.array(*[F.lit(x) for x in LEVELS])


def _scale(q: Column, outer: int, inner: int) -> Column:
    return F.greatest(F.abs(F.element_at(q, outer) - F.element_at(q, inner)), F.lit(LEAST_SPREAD)) / TAIL


def pit(q: Column, y: Column) -> Column:
    """The forecast's distribution function at y: linear between levels, exponential beyond them."""
    k = F.size(F.filter(q, lambda x: x < y))
    lo, hi = F.element_at(q, F.greatest(k, F.lit(1))), F.element_at(q, F.least(k + 1, F.lit(99)))
    inside = k / 100.0 + 0.01 * F.when(hi > lo, (y - lo) / (hi - lo)).otherwise(0.5)
    above = 1.0 - 0.01 * F.exp(-(y - F.element_at(q, 99)) / _scale(q, 99, 95))
    below = 0.01 * F.exp(-(F.element_at(q, 1) - y) / _scale(q, 5, 1))
    return F.when(q.isNull() | y.isNull(), None).when(k == 99, above).when(k == 0, below).otherwise(inside)


def quantile_at(q: Column, tau: Column) -> Column:
    """The forecast's quantile at any level in (0, 1)."""
    above = F.element_at(q, 99) + _scale(q, 99, 95) * F.ln(0.01 / (1.0 - tau))
    below = F.element_at(q, 1) - _scale(q, 5, 1) * F.ln(0.01 / tau)
    pos = (tau - 0.01) * 100.0
    a = F.least(F.floor(pos).cast("int"), F.lit(97))
    w = pos - a
    inside = (1 - w) * F.element_at(q, a + 1) + w * F.element_at(q, a + 2)
    return F.when(tau > 0.99, above).when(tau < 0.01, below).otherwise(inside)


def recalibrated(q: Column, taus: Column, low: float | None = None, high: float | None = None) -> Column:
    """The levels `taus` of q, in order, within bounds."""
    taus = F.transform(taus, lambda t: F.least(F.greatest(t, F.lit(1e-4)), F.lit(1 - 1e-4)))
    out = F.array_sort(F.transform(taus, lambda t: quantile_at(q, t)))
    return clipped(out, low, high)


def clipped(q: Column, low: float | None, high: float | None) -> Column:
    if low is None and high is None:
        return q
    return F.transform(q, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def pinball(q: Column, y: Column) -> Column:
    """Mean pinball loss over the levels."""
    losses = F.zip_with(q, levels(), lambda x, t: F.greatest(t * (y - x), (t - 1) * (y - x)))
    return F.aggregate(losses, F.lit(0.0), lambda a, x: a + x) / 99.0


def mix(a: Column, b: Column, w: float | Column = 0.5) -> Column:
    """Level by level w * a + (1 - w) * b, within the price bounds."""
    w = F.lit(w) if isinstance(w, float) else w
    return clipped(F.zip_with(a, b, lambda x, y: y + w * (x - y)), *PRICE_BOUNDS)


def shifted(quarter: Column, hour_mixed: Column, hour: Column) -> Column:
    """A quarter's levels moved as its hour's were by mixing, in order, within the price bounds."""
    moves = F.zip_with(hour_mixed, hour, lambda x, y: x - y)
    return clipped(F.array_sort(F.zip_with(quarter, moves, lambda x, d: x + d)), *PRICE_BOUNDS)


def covered(q: Column, y: Column, share: int) -> Column:
    """Whether y lies in the central interval, both ends included."""
    k = (100 - share) // 2
    return (y >= F.element_at(q, k)) & (y <= F.element_at(q, 100 - k))
