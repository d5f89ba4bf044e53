"""Fund features computed from a net-asset-value series (close)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenbar.operators.panel import per_series


def _growth(now: Column, base: Column, otherwise: Column) -> Column:
    return F.when(base > 0, F.try_divide(now, base) - 1).otherwise(otherwise)


def nav_features(df: DataFrame, **segmenting) -> DataFrame:
    """Rolling returns, Sortino-like ratio, drawdown from the 30-row peak, 14-row momentum."""

    def compute(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("event_time")
        month, fortnight = w.rowsBetween(-29, 0), w.rowsBetween(-13, 0)
        close, nothing, zero = F.col("close"), F.lit(None).cast("double"), F.lit(0.0)
        shifted = d.withColumns(
            {
                "rolling_return_30d": _growth(close, F.lag("close", 30).over(w), nothing),
                "rolling_return_90d": _growth(close, F.lag("close", 90).over(w), nothing),
                "max_drawdown_30d": _growth(close, F.max("close").over(month), zero),
                "nav_momentum_14d": _growth(close, F.avg("close").over(fortnight), zero),
                "_ret": _growth(close, F.lag("close", 1).over(w), zero),
            }
        )
        spread = shifted.withColumns(
            {
                "_mean": F.avg("_ret").over(month),
                "_downside": F.stddev_samp(F.least("_ret", zero)).over(month),
            }
        )
        ratio = F.when(
            F.col("_downside") > 1e-8, F.try_divide(F.col("_mean"), F.col("_downside"))
        ).otherwise(0.0)
        return spread.withColumn("sortino_30d", ratio).drop("_ret", "_mean", "_downside")

    return per_series(df, compute, lookback=95, **segmenting)
