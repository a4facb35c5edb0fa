"""Null-safe arithmetic, coercion and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL_TYPE = "decimal(18,6)"
SMAPE_FLOOR = 1e-9


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Divide, giving null on a zero denominator (plain ``/`` raises in ANSI mode)."""
    return F.try_divide(numerator, denominator)


def clip(value: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """Bound a value while keeping null (``greatest``/``least`` would skip it)."""
    out = value
    if lower is not None:
        out = F.when(out < lower, F.lit(float(lower))).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, F.lit(float(upper))).otherwise(out)
    return out


def half_even(value: Column, digits: int) -> Column:
    """Round half to even on the scaled binary value, the rule numeric array libraries use."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), None).otherwise(value)


def to_double(value: Column) -> Column:
    """Numeric coercion; text that is no number becomes null."""
    return value.try_cast("double")


def parse_decimal(text: Column) -> Column:
    """Parse decimal text; null and the empty string give null."""
    return F.nullif(text, F.lit("")).try_cast(DECIMAL_TYPE)


def error(actual: Column, predicted: Column) -> Column:
    return predicted - actual


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(predicted - actual)


def squared_error(actual: Column, predicted: Column) -> Column:
    return (predicted - actual) * (predicted - actual)


def smape_term(actual: Column, predicted: Column) -> Column:
    """One row's symmetric relative error on the 0..2 scale."""
    total = F.abs(actual) + F.abs(predicted)
    floored = F.when(total < SMAPE_FLOOR, F.lit(SMAPE_FLOOR)).otherwise(total)
    return F.lit(2.0) * F.abs(predicted - actual) / floored
