"""Indicators against pandas, EMA on long series, segmented series against plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenbar.operators.indicators import all_indicators, ema, warm
from lumenbar.operators.labels import forward_close
from lumenbar.operators.nav import nav_features
from lumenbar.operators.panel import growth_as_of, per_series, split_series
from lumenbar.schemas import FEATURES, NAV_FEATURES


def sample(rows=120, symbols=2, seed=0):
    rng = np.random.default_rng(seed)
    frames = []
    for s in range(symbols):
        i = np.arange(rows)
        close = 100 + 0.18 * i + 2.5 * np.sin(i / 7 + s) + rng.normal(0, 0.3, rows)
        frames.append(
            pd.DataFrame(
                {
                    "symbol": f"S{s}",
                    "event_time": pd.date_range("2023-01-01", periods=rows, freq="D"),
                    "close": close,
                    "high": close + 1 + 0.2 * np.sin(i),
                    "low": close - 1 - 0.2 * np.cos(i),
                }
            )
        )
    return pd.concat(frames, ignore_index=True)


def expected(p):
    def one(g):
        g = g.sort_values("event_time").copy()
        c, h, low = g.close, g.high, g.low

        def mean(x, n):
            return x.rolling(n, min_periods=1).mean()

        g["sma_50"], g["sma_200"], g["moving_avg_7d"] = mean(c, 50), mean(c, 200), mean(c, 7)
        g["volatility_7d"] = c.rolling(7, min_periods=2).std()
        spread = c.rolling(20, min_periods=2).std()
        g["bb_upper"], g["bb_lower"] = mean(c, 20) + 2 * spread, mean(c, 20) - 2 * spread

        def smooth(x, n):
            return x.ewm(span=n, adjust=False).mean()

        g["ema_20"] = smooth(c, 20)
        g["macd"] = smooth(c, 12) - smooth(c, 26)
        g["macd_signal"] = smooth(g["macd"], 9)
        d = c.diff().fillna(0)
        up, down = mean(d.clip(lower=0), 14), mean((-d).clip(lower=0), 14)
        rsi = 100 - 100 / (1 + up / down.where(down != 0))
        g["rsi_14"] = rsi.where(down != 0, np.where(up == 0, 50.0, 100.0))
        pc = c.shift()
        tr = pd.concat([h - low, (h - pc).abs(), (low - pc).abs()], axis=1).max(axis=1)
        g["atr_14"] = mean(tr, 14)
        lo, hi = low.rolling(14, min_periods=1).min(), h.rolling(14, min_periods=1).max()
        g["stoch_k"] = (100 * (c - lo) / (hi - lo)).where(hi != lo, 50.0)
        g["stoch_d"] = mean(g["stoch_k"], 3)
        return g

    return pd.concat([one(g) for _, g in p.groupby("symbol")])


def close_frames(got, want, columns, tol=1e-8):
    got = got.sort_values(["symbol", "event_time"]).reset_index(drop=True)
    want = want.sort_values(["symbol", "event_time"]).reset_index(drop=True)
    assert len(got) == len(want)
    for c in columns:
        a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        np.testing.assert_allclose(a, b, rtol=tol, atol=tol, err_msg=c)


def _date(c):
    return F.to_date(c)


def test_daily_indicators_match_pandas(spark):
    p = sample(rows=260)
    got = all_indicators(spark.createDataFrame(p).withColumn("event_time", _date("event_time"))).toPandas()
    got["event_time"] = pd.to_datetime(got["event_time"])
    close_frames(got, expected(p), FEATURES)


def test_ema_survives_long_series(spark):
    p = sample(rows=6000, symbols=1)
    got = ema(
        spark.createDataFrame(p).withColumn("event_time", _date("event_time")), "close", 9, "e"
    ).toPandas().sort_values("event_time")
    want = p.close.ewm(span=9, adjust=False).mean()
    np.testing.assert_allclose(got.e.to_numpy(), want.to_numpy(), rtol=1e-12)


@pytest.fixture(scope="module")
def hot_series():
    """One symbol with most of the rows, irregular times, and small ones."""
    rng = np.random.default_rng(3)
    frames = []
    for symbol, n in (("HOT", 9000), ("B", 400), ("C", 3)):
        gaps = rng.exponential(400, n) + (rng.random(n) < 0.01) * 90_000
        t = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(gaps) + 1, unit="s")
        close = 100 + np.cumsum(rng.normal(0, 1, n)) * 0.1
        frames.append(
            pd.DataFrame(
                {"symbol": symbol, "event_time": t.astype("datetime64[us]"), "close": close, "high": close + 1, "low": close - 1}
            )
        )
    return pd.concat(frames, ignore_index=True)


def test_segments_equal_whole_series(spark, hot_series):
    df = spark.createDataFrame(hot_series)
    got = all_indicators(df, rows_per_segment=1500, bucket="hour").toPandas()
    close_frames(got, expected(hot_series), FEATURES)


def test_segments_split_the_hot_symbol(spark, hot_series):
    parts = split_series(spark.createDataFrame(hot_series), 200, 50, rows_per_segment=1000, bucket="hour")
    sizes = parts.groupBy("symbol", "_segment").agg(F.count("*").alias("n")).toPandas()
    assert sizes[sizes.symbol == "HOT"].shape[0] >= 8
    assert sizes.n.max() < 1000 + 250 + 400
    assert parts.where("_owned").count() == len(hot_series)


def test_segmented_labels_and_nav(spark, hot_series):
    df = spark.createDataFrame(hot_series)
    ahead = forward_close(df, 252, rows_per_segment=1000, bucket="hour").toPandas()
    want = hot_series.copy()
    want["future_close"] = want.groupby("symbol").close.shift(-252)
    close_frames(ahead, want, ["future_close"])
    parts = nav_features(df, rows_per_segment=1000, bucket="hour").toPandas()
    whole = nav_features(df, rows_per_segment=10**9).toPandas()
    close_frames(parts, whole, NAV_FEATURES)


def test_segment_must_cover_a_frame(spark, hot_series):
    with pytest.raises(ValueError):
        per_series(spark.createDataFrame(hot_series), lambda d, k: d, lookback=500, rows_per_segment=100)


def test_nav_formulas(spark):
    p = sample(rows=120, symbols=1)
    got = nav_features(spark.createDataFrame(p).withColumn("event_time", _date("event_time"))).toPandas()
    got = got.sort_values("event_time")
    c = p.close
    np.testing.assert_allclose(got.rolling_return_30d.iloc[30:], (c / c.shift(30) - 1).iloc[30:])
    assert got.rolling_return_90d.iloc[:90].isna().all()
    ret = (c / c.shift() - 1).fillna(0)
    down = ret.clip(upper=0).rolling(30, min_periods=2).std()
    want = (ret.rolling(30, min_periods=1).mean() / down).where(down > 1e-8, 0.0)
    np.testing.assert_allclose(got.sortino_30d, want, rtol=1e-9)
    assert (got.max_drawdown_30d <= 0).all()


def test_warm_up(spark):
    p = sample(rows=60)
    df = all_indicators(spark.createDataFrame(p).withColumn("event_time", _date("event_time")))
    assert warm(df).count() == 120
    assert warm(df, 50).count() == 2 * 11


def test_growth_as_of(spark):
    rows = [("A", "2020-03-01", 10.0), ("A", "2022-02-20", 16.0), ("A", "2023-03-02", 20.0), ("B", "2023-01-01", 5.0)]
    df = spark.createDataFrame(rows, "symbol string, event_time string, close double")
    got = {r.symbol: r for r in growth_as_of(df.withColumn("event_time", _date("event_time")), (1, 3)).collect()}
    assert got["A"].growth_1y == pytest.approx(25.0)
    assert got["A"].growth_3y == pytest.approx(100.0)
    assert got["B"].growth_1y is None
