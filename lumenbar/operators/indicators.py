"""Technical indicators over each series: rolling means, bands, EMA, RSI, ATR, stochastic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumenbar.operators.panel import per_series

BLOCK, OFFSET = "_block", "_offset"
# Rows after which an EMA weight of span 26 is below 2^-60, twice, plus the signal line.
INDICATOR_LOOKBACK = 1400


def block_rows(max_span: int, min_span: int) -> int:
    """Rows per EMA block: a weight one block back is below 2^-60 for every span."""
    slow, fast = (math.log((s - 1) / (s + 1)) for s in (max_span, min_span))
    rows = math.ceil(60 * math.log(2) / -slow)
    if -fast * rows > 600:
        raise ValueError("spans too far apart for one block size")
    return rows


def with_blocks(df: DataFrame, keys: list[str], rows: int, time: str = "event_time") -> DataFrame:
    """Numbers the rows of a series and cuts them into blocks of ``rows``."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1
    return (
        df.withColumn("_pos", position)
        .withColumns({BLOCK: F.floor(F.col("_pos") / rows), OFFSET: F.col("_pos") % rows})
        .drop("_pos")
    )


def series_window(keys: list[str], time: str = "event_time") -> WindowSpec:
    # (block, time) sorts like time alone, so the block windows reuse this sort.
    return Window.partitionBy(*keys).orderBy(BLOCK, time)


def add_emas(
    df: DataFrame,
    keys: list[str],
    spans: dict[str, tuple[str, int]],
    rows: int,
    time: str = "event_time",
) -> DataFrame:
    """Recursive EMAs (seed = first value) as running sums: ``{out: (column, span)}``.

    Within a block the EMA is a running sum of x * decay^-offset, scaled back by
    decay^offset; the preceding block contributes its end value, older ones weigh
    below 2^-60. Powers stay inside the block, so long series cannot overflow.
    Inputs must be non-null; the frame needs ``with_blocks``.
    """
    in_block = (
        Window.partitionBy(*keys, BLOCK)
        .orderBy(time)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = series_window(keys, time).rowsBetween(Window.unboundedPreceding, -1)
    j = F.col(OFFSET)
    local, carry, result = {}, {}, {}
    for out, (column, span) in spans.items():
        alpha, decay = 2.0 / (span + 1), (span - 1.0) / (span + 1)
        seed = (F.col(BLOCK) == 0) & (j == 0)
        weight = F.when(seed, 1.0).otherwise(alpha)
        scaled = F.sum(weight * F.col(column) * F.pow(F.lit(1 / decay), j)).over(in_block)
        local[f"_loc_{out}"] = scaled * F.pow(F.lit(decay), j)
        block_end = F.when(j == rows - 1, F.col(f"_loc_{out}"))
        carry[f"_end_{out}"] = F.last(block_end, ignorenulls=True).over(before)
        result[out] = F.col(f"_loc_{out}") + F.pow(F.lit(decay), j + 1) * F.coalesce(
            F.col(f"_end_{out}"), F.lit(0.0)
        )
    return df.withColumns(local).withColumns(carry).withColumns(result).drop(*local, *carry)


def add_price_bands(df: DataFrame, w: WindowSpec) -> DataFrame:
    """Simple moving averages, price volatility and Bollinger bands."""
    close = F.col("close")

    def mean(n: int) -> Column:
        return F.avg(close).over(w.rowsBetween(1 - n, 0))

    def spread(n: int) -> Column:
        return F.stddev_samp(close).over(w.rowsBetween(1 - n, 0))

    return (
        df.withColumns(
            {
                "sma_50": mean(50),
                "sma_200": mean(200),
                "moving_avg_7d": mean(7),
                "volatility_7d": spread(7),
                "_mid": mean(20),
                "_width": spread(20) * 2,
            }
        )
        .withColumns(
            {
                "bb_upper": F.col("_mid") + F.col("_width"),
                "bb_lower": F.col("_mid") - F.col("_width"),
            }
        )
        .drop("_mid", "_width")
    )


def add_oscillators(df: DataFrame, w: WindowSpec) -> DataFrame:
    """RSI, average true range and the stochastic oscillator."""
    fortnight, three = w.rowsBetween(-13, 0), w.rowsBetween(-2, 0)
    close, high, low = F.col("close"), F.col("high"), F.col("low")
    stepped = df.withColumns(
        {
            "_prev": F.lag("close").over(w),
            "_floor": F.min("low").over(fortnight),
            "_ceiling": F.max("high").over(fortnight),
        }
    )
    step = close - F.col("_prev")
    height = F.col("_ceiling") - F.col("_floor")
    moves = stepped.withColumns(
        {
            "_up": F.when(step > 0, step).otherwise(0.0),
            "_down": F.when(step < 0, -step).otherwise(0.0),
            # greatest() skips the missing previous close of the first bar
            "_range": F.greatest(
                high - low, F.abs(high - F.col("_prev")), F.abs(low - F.col("_prev"))
            ),
            "stoch_k": F.when(
                height != 0, F.try_divide(close - F.col("_floor"), height) * 100
            ).otherwise(50.0),
        }
    )
    means = moves.withColumns(
        {
            "_up": F.avg("_up").over(fortnight),
            "_down": F.avg("_down").over(fortnight),
            "atr_14": F.avg("_range").over(fortnight),
            "stoch_d": F.avg("stoch_k").over(three),
        }
    )
    rs = F.try_divide(F.col("_up"), F.col("_down"))
    flat, no_loss = (F.col("_up") == 0) & (F.col("_down") == 0), F.col("_down") == 0
    return means.withColumn(
        "rsi_14",
        F.when(flat, 50.0).when(no_loss, 100.0).otherwise(100 - 100 / (1 + rs)),
    ).drop("_prev", "_floor", "_ceiling", "_up", "_down", "_range")


def price_bands(df: DataFrame) -> DataFrame:
    return per_series(
        df,
        lambda d, keys: add_price_bands(d, Window.partitionBy(*keys).orderBy("event_time")),
        lookback=200,
    )


def oscillators(df: DataFrame) -> DataFrame:
    return per_series(
        df,
        lambda d, keys: add_oscillators(d, Window.partitionBy(*keys).orderBy("event_time")),
        lookback=32,
    )


def _trend_lines(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    first = {"_fast": ("close", 12), "ema_20": ("close", 20), "_slow": ("close", 26)}
    out = add_emas(df, keys, first, rows).withColumn("macd", F.col("_fast") - F.col("_slow"))
    return add_emas(out, keys, {"macd_signal": ("macd", 9)}, rows).drop("_fast", "_slow")


def trend_lines(df: DataFrame) -> DataFrame:
    """ema_20, macd (12 - 26) and its 9-row signal line."""
    rows = block_rows(26, 9)

    def compute(d: DataFrame, keys: list[str]) -> DataFrame:
        return _trend_lines(with_blocks(d, keys, rows), keys, rows).drop(BLOCK, OFFSET)

    return per_series(df, compute, lookback=INDICATOR_LOOKBACK)


def ema(df: DataFrame, column: str, span: int, out: str) -> DataFrame:
    rows = block_rows(span, span)

    def compute(d: DataFrame, keys: list[str]) -> DataFrame:
        blocked = with_blocks(d, keys, rows)
        return add_emas(blocked, keys, {out: (column, span)}, rows).drop(BLOCK, OFFSET)

    return per_series(df, compute, lookback=2 * rows)


def all_indicators(df: DataFrame, **segmenting) -> DataFrame:
    """The 13 indicators in one shuffle and two sorts per series."""
    rows = block_rows(26, 9)

    def compute(d: DataFrame, keys: list[str]) -> DataFrame:
        out = with_blocks(d, keys, rows)
        w = series_window(keys)
        out = _trend_lines(add_oscillators(add_price_bands(out, w), w), keys, rows)
        return out.drop(BLOCK, OFFSET)

    return per_series(df, compute, lookback=INDICATOR_LOOKBACK, **segmenting)


def warm(df: DataFrame, min_bars: int | None = None, **segmenting) -> DataFrame:
    """Drop rows without sma_50; ``min_bars`` also drops the first rows of every series."""
    kept = df.dropna(subset=["sma_50"])
    if not min_bars or min_bars <= 1:
        return kept

    def compute(d: DataFrame, keys: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("event_time")
        return d.withColumn("_seen", F.lag(F.lit(True), min_bars - 1).over(w))

    numbered = per_series(kept, compute, lookback=min_bars, **segmenting)
    return numbered.where(F.col("_seen").isNotNull()).drop("_seen")


def _apart(a: Column, b: Column) -> Column:
    one_missing = a.isNull() != b.isNull()
    return F.when(one_missing, F.lit(float("inf"))).otherwise(F.coalesce(F.abs(a - b), F.lit(0.0)))


def max_differences(
    actual: DataFrame, expected: DataFrame, columns: list[str], tolerance: float = 1e-5,
    keys: tuple[str, ...] = ("symbol", "event_time"),
) -> DataFrame:
    """Self-check: per column the largest absolute difference and PASS / FAIL.

    A value that only one side has counts as an infinite difference.
    """
    renamed = expected.select(*keys, *[F.col(c).alias(f"_e_{c}") for c in columns])
    worst = actual.join(renamed, list(keys)).agg(
        F.count("*").alias("rows"),
        *[F.max(_apart(F.col(c), F.col(f"_e_{c}"))).alias(c) for c in columns],
    )
    return worst.unpivot(["rows"], columns, "indicator", "max_abs_diff").select(
        "indicator",
        "rows",
        "max_abs_diff",
        F.when(F.col("max_abs_diff") <= tolerance, "PASS").otherwise("FAIL").alias("status"),
    )
