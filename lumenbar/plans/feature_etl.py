"""Raw bars to the feature table (bronze to silver)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumenbar.functions.nulls import clean_numbers
from lumenbar.operators.indicators import all_indicators, warm
from lumenbar.operators.merge import deduplicate
from lumenbar.operators.nav import nav_features
from lumenbar.sources.payloads import normalise_ohlcv
from lumenbar.sources.tables import cast_prices, overwrite


def build_features(
    bars: DataFrame, is_fund: bool = False, min_bars: int | None = None
) -> DataFrame:
    """Indicators (and fund features) of every bar, one bar per symbol and time.

    NaN and infinities are missing. Of bars that repeat a key the highest close stays.
    """
    columns = ["open", "high", "low", "close"]
    numbers = clean_numbers(cast_prices(bars, columns), columns)
    prices = deduplicate(normalise_ohlcv(numbers), ["symbol", "event_time"], "close")
    out = all_indicators(prices)
    if is_fund:
        out = nav_features(out)
    return warm(out, min_bars)


def run_feature_etl(
    bars: DataFrame, path: str, is_fund: bool = False, min_bars: int | None = None
) -> bool:
    """Overwrite the feature table in one write; an empty source writes nothing."""
    return overwrite(build_features(bars, is_fund, min_bars), path, source=bars)
