"""Numeric helpers shared by features, scoring and loans. All double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(value: float) -> Column:
    """A double literal (a bare 0.5 inside SQL text would be a DECIMAL)."""
    return F.lit(float(value))


def finite(c: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != num("inf")), c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, num(high)), num(low))


def growth(rate: Column, periods: Column) -> Column:
    """(1 + rate) ^ periods"""
    return F.pow(num(1) + rate, periods.cast("double"))


def annuity(amount: Column, rate: Column, periods: Column) -> Column:
    """Level instalment of a French loan; at rate 0 its limit, amount / periods."""
    g = growth(rate, periods)
    flat = F.try_divide(amount, periods.cast("double"))
    return F.when(rate == num(0), flat).otherwise(F.try_divide(amount * (rate * g), g - num(1)))
