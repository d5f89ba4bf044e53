"""Quantiles, cuts, metrics, backtest and drift against NumPy and plain Python."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenbar.operators import backtest, drift, labels, metrics, quantiles, splits
from lumenbar.schemas import HORIZONS


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    hot = np.full(4000, 7.25)  # a third of all rows
    columns = {
        "a": np.concatenate([rng.normal(0, 1e-3, 8000), hot]),
        "b": np.concatenate([rng.lognormal(3, 4, 8000), -hot]),
        "c": np.round(rng.normal(0, 3, 12000)),
    }
    df = spark.createDataFrame(pd.DataFrame(columns))
    probs = [0, 0.001, 0.005, 0.1, 0.5, 2 / 3, 0.995, 1]
    out = quantiles.exact_quantiles(quantiles.unpivot_values(df, list(columns)), probs)
    for row in out.collect():
        np.testing.assert_allclose(row.q, np.quantile(columns[row.feature], probs), rtol=1e-12)
        assert row.n == 12000


def test_winsorize_and_outliers(spark):
    values = [float(i) for i in range(1000)] + [1e6, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    clipped = quantiles.winsorize(df, ["x", "absent"]).toPandas().x
    present = np.array([v for v in values if v is not None])
    assert clipped.max() == pytest.approx(np.quantile(present, 0.995))
    assert clipped.isna().sum() == 1
    low, high = np.quantile(present, [0.001, 0.999])
    want = ((present < low) | (present > high)).sum() / len(values)
    assert quantiles.outlier_rate(df, ["x"]).first()[0] == pytest.approx(want)
    assert quantiles.outlier_rate(df.limit(0), ["x"]).first()[0] == 0.0


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(5)
    days = pd.date_range("2020-01-01", periods=60, freq="D")
    rows = [(f"S{s:02d}", d) for d in days for s in range(30) if rng.random() < 0.8]
    p = pd.DataFrame(rows, columns=["symbol", "event_date"])
    p["realized_return"] = rng.normal(0, 0.05, len(p))
    p["target"] = (p.realized_return > 0).astype(int)
    # coarse probabilities, so that ties occur
    p["prob"] = np.round(np.clip(rng.normal(0.5, 0.15, len(p)), 0, 1), 2)
    return p


@pytest.fixture(scope="module")
def frame(spark, panel):
    return spark.createDataFrame(panel).withColumn("event_date", F.to_date("event_date"))


@pytest.mark.parametrize("fraction", [0.0, 0.3, 0.8, 1.0])
def test_chronological_cut(spark, panel, frame, fraction):
    n = len(panel)
    k = int(n * fraction)
    want = panel.sort_values(["event_date", "symbol"]).head(k)
    keys = set(zip(want.symbol, want.event_date.dt.date))
    first, rest = labels.chronological_split(frame, fraction, "event_date")
    got = {(r.symbol, r.event_date) for r in first.collect()}
    assert got == keys and rest.count() == n - k
    predicate = labels.first_rows_filter(frame, k, "event_date")
    assert {(r.symbol, r.event_date) for r in frame.where(predicate).collect()} == keys


@pytest.mark.parametrize("k", [0, 1, 777, 1200, 2999, 3000])
def test_cut_of_timestamps(spark, k):
    """Most rows in one minute, several symbols at the same instant."""
    rng = np.random.default_rng(8)
    hot = rng.random(3000) < 0.7
    seconds = np.where(hot, 86_400 + rng.integers(0, 40, 3000), rng.integers(0, 300_000, 3000))
    p = pd.DataFrame({"event_time": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, unit="s")})
    p["symbol"] = [f"S{i:04d}" for i in rng.permutation(3000)]
    df = spark.createDataFrame(p.astype({"event_time": "datetime64[us]"})).cache()
    want = set(p.sort_values(["event_time", "symbol"]).head(k).symbol)
    got = {r.symbol for r in df.where(labels.first_rows_filter(df, k)).collect()}
    assert got == want


def test_most_recent(panel, frame):
    want = panel.sort_values(["event_date", "symbol"]).tail(100)
    got = labels.most_recent(frame, 100, "event_date").collect()
    assert {(r.symbol, r.event_date) for r in got} == set(zip(want.symbol, want.event_date.dt.date))
    assert labels.most_recent(frame, 10**6, "event_date").count() == len(panel)


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_classification_metrics(panel, frame):
    row = metrics.classification_metrics(frame).first()
    y, p = panel.target.to_numpy(), panel.prob.to_numpy()
    hit = (p >= 0.5).astype(int)
    tp = (hit & y).sum()
    assert row.roc_auc == pytest.approx(brute_auc(y, p))
    assert row.accuracy == pytest.approx((hit == y).mean())
    assert row.brier == pytest.approx(((p - y) ** 2).mean())
    assert row.f1 == pytest.approx(2 * tp / (hit.sum() + y.sum()))
    one_class = metrics.classification_metrics(frame.where("target = 1")).first()
    assert one_class.roc_auc is None


def test_class_report(panel, frame):
    df = frame.withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    got = {r["class"]: r for r in metrics.class_report(df).collect()}
    p0 = got["0"]
    called = (panel.prob < 0.5).sum()
    assert p0.precision == pytest.approx(((panel.prob < 0.5) & (panel.target == 0)).sum() / called)
    assert got["macro avg"].f1 == pytest.approx((got["0"].f1 + got["1"].f1) / 2)
    assert got["weighted avg"].support == len(panel)


def loop_backtest(panel, top_n, min_prob, cost):
    out, before = [], set()
    for day, g in panel.sort_values(["event_date"]).groupby("event_date"):
        ranked = g.sort_values(["prob", "symbol"], ascending=[False, True])
        picks = ranked[ranked.prob >= min_prob].head(top_n)
        if picks.empty:
            out.append((day.date(), 0.0, 0.0))
            before = set()
            continue
        now = set(picks.symbol)
        turnover = 1.0 if not before else len(now ^ before) / (2 * top_n)
        before = now
        out.append((day.date(), picks.realized_return.mean() - cost * turnover, turnover))
    return out


@pytest.mark.parametrize("min_prob", [0.55, 0.75, 0.85])
def test_period_returns(panel, frame, min_prob):
    got = backtest.period_returns(frame, [], [0.5, min_prob], top_n=4).where(
        F.col("threshold") == min_prob
    )
    rows = {r.event_date: r for r in got.collect()}
    want = loop_backtest(panel, 4, min_prob, 0.002)
    assert len(rows) == len(want)
    for day, ret, turnover in want:
        assert rows[day].period_return == pytest.approx(ret, abs=1e-12)
        assert rows[day].turnover == pytest.approx(turnover)


def test_backtest_stats(panel, frame):
    row = backtest.backtest(frame, 5, top_n=4).first()
    r = pd.Series([x[1] for x in loop_backtest(panel, 4, 0.55, 0.002)])
    equity = (1 + r).cumprod()
    years = len(r) * 5 / 252
    assert row.cagr_approx == pytest.approx(equity.iloc[-1] ** (1 / years) - 1)
    assert row.sharpe_annualized == pytest.approx(r.mean() / r.std() * math.sqrt(252 / 5))
    assert row.max_drawdown == pytest.approx((equity / equity.cummax() - 1).min())
    var = np.percentile(r, 5)
    assert row.var_95 == pytest.approx(var)
    assert row.cvar_95 == pytest.approx(r[r <= var].mean())
    assert row.hit_rate == pytest.approx((r > 0).mean()) and row.max_drawdown <= 0


def test_buckets(panel, frame):
    got = backtest.confidence_buckets(frame).collect()
    assert len(got) == 6
    assert sum(r.samples for r in got) == (panel.prob < 1).sum()
    closed = backtest.confidence_buckets(frame, close_last=True).collect()
    assert sum(r.samples for r in closed) == len(panel)


def test_sweep_recommends_best_sharpe(frame):
    split = frame.withColumn("split", F.lit(1))
    sweep = backtest.threshold_sweep(split, 5, top_n=4).cache()
    best = sweep.orderBy(F.col("avg_sharpe_annualized").desc_nulls_last()).first().threshold
    assert backtest.recommended_threshold(sweep).first()[0] == best


def test_regimes_skip_days_without_picks(panel, frame):
    got = backtest.regime_performance(frame, min_prob=0.75, top_n=4).collect()
    days = panel[panel.prob >= 0.75].event_date.nunique()
    assert sum(r.samples for r in got) == days


def numpy_psi(base, recent):
    edges = np.unique(np.quantile(base, np.linspace(0, 1, 11)))
    if len(edges) < 3:
        edges = np.array([base.min(), base.mean(), base.max()])
    e, a = (np.histogram(x, bins=edges)[0] for x in (base, recent))
    e, a = (np.clip(x / max(x.sum(), 1), 1e-6, 1) for x in (e, a))
    return ((a - e) * np.log(a / e)).sum()


def numpy_ks(x, y):
    v = np.unique(np.concatenate([x, y]))
    cx, cy = (np.searchsorted(np.sort(s), v, side="right") / len(s) for s in (x, y))
    return np.abs(cx - cy).max()


def test_drift(spark):
    rng = np.random.default_rng(9)
    n = 2000
    day = pd.Timestamp("2021-01-01") + pd.to_timedelta(rng.integers(0, 400, n), unit="D")
    late = day >= day.max() - pd.Timedelta(days=62)
    p = pd.DataFrame(
        {
            "event_date": day,
            "same": rng.normal(0, 1, n),
            "moved": rng.normal(0, 1, n) + 2 * late,
            "coarse": rng.integers(0, 2, n).astype(float),
            "tied": np.where(rng.random(n) < 0.4, 5.0, rng.normal(5, 1, n)),
        }
    )
    names = ["same", "moved", "coarse", "tied"]
    df = spark.createDataFrame(p).withColumn("event_date", F.to_date("event_date"))
    windows = drift.drift_windows(df)
    counts = drift.value_counts(windows, names).cache()
    got = {r.feature: r for r in drift.feature_drift(counts, min_samples=100).collect()}
    base = p[(~late) & (day >= day.max() - pd.Timedelta(days=62 + 252))]
    for f in names:
        assert got[f].psi == pytest.approx(numpy_psi(base[f].to_numpy(), p[late][f].to_numpy())), f
        assert got[f].ks == pytest.approx(numpy_ks(base[f].to_numpy(), p[late][f].to_numpy())), f
        assert 0 <= got[f].ks <= 1 and got[f].psi >= 0
    assert got["moved"].drift_level == "high"
    feats = drift.feature_drift(counts, min_samples=100)
    assert drift.drift_summary(windows, feats, 100).first().status == "ok"
    assert drift.drift_summary(windows, feats, 10**6).first().status == "insufficient_samples"
    empty = drift.drift_windows(df.limit(0))
    none = drift.feature_drift(drift.value_counts(empty, names))
    assert drift.drift_summary(empty, none).first().status == "no_data"


def test_splits(spark, panel, frame):
    out = splits.walk_forward_splits(frame, 20, 10, 7).orderBy("split").collect()
    days = sorted(panel.event_date.dt.date.unique())
    want, i = [], 20
    while i + 10 <= len(days):
        want.append((days[i - 1], days[i], days[i + 9]))
        i += 7
    assert [(r.train_end, r.test_start, r.test_end) for r in out] == want
    table = splits.walk_forward_splits(frame, 20, 10, 7)
    checks = splits.leakage_checks(frame, table, target="target").orderBy("split").collect()
    for r in checks:
        d = panel.event_date.dt.date
        assert r.train_rows == (d <= r.train_end).sum()
        assert r.test_rows == ((d >= r.test_start) & (d <= r.test_end)).sum()
        assert not r.date_violation and r.overlap_rows == 0
    tested = splits.test_rows(frame, table).count()
    assert tested == sum(r.test_rows for r in checks)


def test_labels_are_training_rows(spark):
    p = pd.DataFrame({"symbol": "A", "event_time": pd.date_range("2020-01-01", periods=300), "close": np.arange(1.0, 301.0)})
    df = spark.createDataFrame(p).withColumn("event_time", F.to_date("event_time"))
    rows = labels.validation_rows(df, HORIZONS["1y"], features=[]).orderBy("event_time").collect()
    assert len(rows) == 48
    assert rows[0].future_close == 253.0 and rows[0].realized_return == pytest.approx(252.0)
    assert all(r.target == 1 for r in rows)
