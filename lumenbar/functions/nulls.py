"""Missing-value rules: missing is NULL, never NaN or infinity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_or_null(c: Column) -> Column:
    """NaN and +-inf become NULL."""
    infinity = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (F.abs(c) != infinity), c)


def clean_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(F.col(c)) for c in columns})


def safe_float(c: Column, fallback: float | None = None) -> Column:
    """Text or number to double; anything unparsable or NaN becomes ``fallback``."""
    number = c.cast("string").try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(fallback).cast("double"))


def default_if_falsy(c: Column, default: float) -> Column:
    """NULL and 0 both become the default."""
    return F.when(c.isNull() | (c == 0), F.lit(default)).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    """Bound a column, keeping NULL as NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
