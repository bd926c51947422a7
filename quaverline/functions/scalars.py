"""Column functions used throughout. Literals are doubles, so that results don't become decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def decibels(value: Column) -> Column:
    """20 log10, silence at -180."""
    return 20.0 * F.log10(F.greatest(value, num(1e-9)))


def amplitude(db: Column) -> Column:
    return F.pow(num(10.0), db / 20.0)


def clip(value: Column, low: float | Column | None, high: float | Column | None) -> Column:
    """Either bound may be open. A null value becomes a bound; fill nulls before."""
    if low is not None:
        value = F.greatest(value, num(low))
    return value if high is None else F.least(value, num(high))


def finite(value: Column, default: float = 0.0) -> Column:
    """Null, NaN and infinite values become ``default``."""
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), num(default)).otherwise(value)


def json_safe(value: Column) -> Column:
    """NaN and infinite values become null, as JSON has neither."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def smoothstep(x: Column, start: float, end: float) -> Column:
    """0 up to ``start``, 1 from ``end``, smooth between; a step at ``end`` if there is no between."""
    if end <= start:
        return F.when(x >= end, num(1.0)).otherwise(num(0.0))
    t = clip((x - start) / (end - start), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def flags(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))


def total(values: Column, each: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(values, num(0.0), lambda a, v: a + each(v))


def mean(values: Column, each: Callable[[Column], Column] = lambda v: v) -> Column:
    return total(values, each) / F.size(values)


def rms(values: Column) -> Column:
    """Root of the mean square; 0 of nothing."""
    return F.when(F.size(values) > 0, F.sqrt(mean(values, lambda v: v * v))).otherwise(num(0.0))


def peak(values: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(values, F.abs)), num(0.0))


def rounded(df, *keep: str, digits: int = 6):
    """Every double that isn't in ``keep`` rounded, and no negative zeros."""
    return df.select(*(F.col(f"`{n}`") if t != "double" or n in keep else (F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) for n, t in df.dtypes))
