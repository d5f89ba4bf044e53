"""Display columns of the report and overview tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenbar.schemas import LABEL_RANK, LABEL_TEXT


def _lookup(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def display_name(asset_name: Column, symbol: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(asset_name), F.lit("")), symbol)


def outlook_text(signal: Column, prob: Column) -> Column:
    """'<label>  (NN%)'."""
    label = F.coalesce(_lookup(LABEL_TEXT, signal), signal)
    return F.format_string("%s  (%.0f%%)", label, prob * 100)


def label_rank(signal: Column) -> Column:
    return F.coalesce(_lookup(LABEL_RANK, signal), F.lit(5))


def price_text(price: Column, prefix: str = "$", suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.format_number(price, 2), F.lit(suffix))


def percent_text(value: Column, decimals: int = 1) -> Column:
    text = F.format_string(f"%.{decimals}f%%", value * 100)
    return F.when(value.isNotNull(), text).otherwise("n/a")


def number_text(value: Column, decimals: int = 3) -> Column:
    return F.when(value.isNotNull(), F.format_string(f"%.{decimals}f", value)).otherwise("n/a")


def growth_text(value: Column) -> Column:
    """Percent growth with an explicit plus sign; 'N/A' when missing."""
    text = F.format_string("%.2f%%", value)
    return (
        F.when(value.isNull(), "N/A").when(value > 0, F.concat(F.lit("+"), text)).otherwise(text)
    )


def rsi_state(rsi: Column) -> Column:
    return F.when(rsi > 70, "Overbought").when(rsi < 30, "Oversold").otherwise("Neutral")


def macd_state(macd: Column, signal: Column) -> Column:
    return F.when(macd > signal, "Bullish crossover").otherwise("Bearish crossover")


def band_state(price: Column, upper: Column, lower: Column) -> Column:
    return (
        F.when(price > upper, "Above upper band")
        .when(price < lower, "Below lower band")
        .otherwise("Within bands")
    )


def trend_state(price: Column, ema: Column) -> Column:
    return F.when(price > ema, "Bullish").otherwise("Bearish")
