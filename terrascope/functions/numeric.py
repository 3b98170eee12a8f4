"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is null, never 0 or NaN, when the denominator is 0 or null."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sigmoid(value: Column) -> Column:
    """Logistic function with the exponent held in [-80, 80]."""
    return 1.0 / (1.0 + F.exp(clip(-value, -80.0, 80.0)))


def quantize_u16(score: Column, visible: Column) -> Column:
    """Score in [0, 1] to an integer in [0, 65535]; 0 where not visible."""
    return F.when(visible, F.rint(clip(score, 0.0, 1.0) * 65535.0)).otherwise(F.lit(0.0)).cast("int")


def dequantize_u16(score: Column) -> Column:
    return score.cast("double") / 65535.0


def finite(*columns: Column) -> Column:
    """True when no argument is null, NaN or infinite."""
    check = F.lit(True)
    for column in columns:
        check = check & column.isNotNull() & ~F.isnan(column) & (F.abs(column) != float("inf"))
    return check
