"""Numeric functions as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """Null instead of a division by zero."""
    return a / F.nullif(b, F.lit(0.0))


def logit(p: Column, clip: float = 1e-4) -> Column:
    p = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(p / (1 - p))


def excess(stock: Column, bench: Column) -> Column:
    """Arithmetic excess return."""
    return stock - bench


def relative(stock: Column, bench: Column) -> Column:
    """Geometric relative return."""
    return (1 + stock) / F.nullif(1 + bench, F.lit(0.0)) - 1


def annualised(spread: Column, days: Column) -> Column:
    """Yearly rate of a spread earned in ``days``; raises where ``days`` is not positive."""
    ok = F.when(days > 0, F.lit(True)).when(days.isNull(), None).otherwise(F.raise_error(F.lit("days must be positive")).cast("boolean"))
    return F.when(ok, F.pow(1 + spread, F.lit(365.0) / days) - 1)


def gross_spread(price: Column, deal: Column) -> Column:
    """What a deal price pays above the price; raises where the price is not positive."""
    ok = F.when(price > 0, F.lit(True)).when(price.isNull(), None).otherwise(F.raise_error(F.lit("price must be positive")).cast("boolean"))
    return F.when(ok, deal / price - 1)


def linear_quantile(value: str | Column, q: float) -> Column:
    """Exact quantile with linear interpolation, as an aggregate."""
    return F.percentile(value, q)


def growth(now: Column, before: Column, periods: int) -> Column:
    """Compound growth per period where both are positive."""
    return F.when((now > 0) & (before > 0), F.pow(now / F.nullif(before, F.lit(0.0)), F.lit(1.0 / periods)) - 1)


def renormalised(values: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean over the values that are given, weights scaled up to one."""
    top = sum((F.coalesce(v, F.lit(0.0)) * w for v, w in zip(values[1:], weights[1:])), F.coalesce(values[0], F.lit(0.0)) * weights[0])
    bottom = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in zip(values[1:], weights[1:])), F.when(values[0].isNotNull(), weights[0]).otherwise(0.0))
    return top / F.nullif(bottom, F.lit(0.0))


def closeness(value: Column, target: float, scale: float) -> Column:
    """exp(-|value - target| / scale): 1 at the target; a missing value adds nothing."""
    return F.coalesce(F.exp(-F.abs(value - target) / scale), F.lit(0.0))


def softmax_label(scores: dict[str, Column], floor: float, unsure: str = "unknown") -> tuple[Column, Column, Column]:
    """(label, confidence, margin) of additive scores: softmax, the first of equal ones, ``unsure`` below ``floor``."""
    top = F.greatest(*scores.values())
    weights = {name: F.exp(s - top) for name, s in scores.items()}
    total = sum(list(weights.values())[1:], list(weights.values())[0])
    shares = F.array_sort(F.array(*[w / total for w in weights.values()]), lambda a, b: F.when(a > b, -1).when(a < b, 1).otherwise(0))
    best = shares[0]
    label = F.coalesce(*[F.when(s == top, name) for name, s in scores.items()])
    return F.when(best < floor, unsure).otherwise(label), best, best - shares[1]


def vapour_pressure(celsius: Column) -> Column:
    """Saturation vapour pressure in kPa (Tetens)."""
    return 0.6108 * F.exp(17.27 * celsius / (celsius + 237.3))
