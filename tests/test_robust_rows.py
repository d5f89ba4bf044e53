"""Rows that must not get lost: missing keys, repeated keys, infinities, crowded bins."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenbar.operators import audit, drift, labels, merge, metrics
from lumenbar.operators.panel import split_series
from lumenbar.plans import training, walkforward
from lumenbar.plans.feature_etl import build_features
from lumenbar.schemas import FEATURES

BARS = "symbol string, event_time date, close double"


def panel(spark, kind):
    first = datetime(2024, 1, 1)
    rows = [(s, first + timedelta(days=i), float(i)) for s in ("a", "b") for i in range(5)]
    rows += [(None, first + timedelta(days=2), 9.0), ("a", None, 8.0), (None, None, 7.0)]
    rows += [("b", first + timedelta(days=2), 6.0), ("b", first + timedelta(days=2), 5.0)]
    df = spark.createDataFrame(rows, "symbol string, event_time timestamp, close double")
    return df.withColumn("event_time", F.col("event_time").cast(kind))


@pytest.mark.parametrize("kind", ["date", "timestamp"])
@pytest.mark.parametrize("count", range(16))
def test_cuts_lose_and_repeat_no_row(spark, kind, count):
    df = panel(spark, kind)
    first = labels.first_rows_filter(df, count)
    older, newer = df.where(first), df.where(~first)
    assert (older.count(), newer.count()) == (count, 15 - count)
    # rows without a time are the oldest
    assert older.where("event_time IS NULL").count() == min(count, 2)


@pytest.mark.parametrize("kind", ["date", "timestamp"])
def test_missing_keys_survive_series(spark, kind):
    df = panel(spark, kind)
    options = {} if kind == "date" else {"rows_per_segment": 3}
    out = labels.forward_close(df, 1, **options)
    assert out.count() == 15 and out.where("symbol IS NULL").count() == 2


def test_hot_day_is_cut(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(seconds=i), float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "symbol string, event_time timestamp, close double")
    parts = split_series(df, 5, 0, rows_per_segment=100).where("_owned").groupBy("_segment").count()
    assert parts.count() >= 8 and parts.agg(F.max("count")).first()[0] <= 200
    ahead = labels.forward_close(df, 5, rows_per_segment=100)
    assert ahead.where("future_close = close + 5").count() == 895


def test_upserts_take_one_incoming_row_a_key(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    new = spark.createDataFrame([(2, 5.0), (2, 7.0), (3, 3.0), (3, 4.0)], "k int, v double")
    want = [(1, 1.0), (2, 7.0), (3, 4.0)]
    for merged in (
        merge.replace_rows(old, new, ["k"]),
        merge.update_columns(old, new, ["k"], ["v"], newest_by="v"),
    ):
        assert sorted(map(tuple, merged.collect())) == want
    assert sorted(map(tuple, merge.insert_only(old, new, ["k"]).collect())) == [
        (1, 1.0), (2, 2.0), (3, 4.0)
    ]


def test_infinities_become_missing(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(80)]
    rows = [("a", d, 1.0, 2.0 if i != 60 else float("inf"), 0.5, 1.0 + i / 100, 1.0) for i, d in enumerate(days)]
    rows.append(rows[70])
    shape = "symbol string, event_time date, open double, high double, low double, close double, volume double"
    out = build_features(spark.createDataFrame(rows, shape))
    assert out.count() == out.select("event_time").distinct().count()
    assert out.where(F.col("atr_14") == float("inf")).count() == 0


def test_drift_keeps_thin_features(spark):
    first = date(2024, 1, 1)
    rows = [(first + timedelta(days=i), float(i % 7), None if i < 380 else 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "event_date date, x double, y double")
    windows = drift.drift_windows(df, recent_days=60, baseline_days=200)
    assert windows.groupBy("side").count().count() == 2
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = drift.feature_drift(drift.value_counts(windows, ["x", "y"]), min_samples=30)
    levels = {r.feature: r.drift_level for r in found.collect()}
    assert levels["y"] == "insufficient_samples" and levels["x"] == "low"
    summary = drift.drift_summary(windows, found, 30).first()
    assert summary.features == 1 and summary.status == "ok"
    empty = drift.drift_windows(df.limit(0))
    assert empty.count() == 0 and "recent_end" in empty.columns


def test_auc_of_very_many_and_of_crowded_probabilities(spark):
    huge = spark.createDataFrame([(4_000_000_000, 0.5), (4_000_000_000, 0.5)], "target long, prob double")
    assert metrics.roc_auc(huge).count() == 1
    rows = [(int(i % 3 == 0), 0.5 + i * 1e-9) for i in range(3000)]
    got = metrics.roc_auc(spark.createDataFrame(rows, "target int, prob double")).first()[0]
    ranks = [i + 1 for i in range(3000) if i % 3 == 0]
    want = (sum(ranks) - 1000 * 1001 / 2) / (1000 * 2000)
    assert got == pytest.approx(want)


def learnable(spark):
    rows = spark.range(1200).select(
        F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("symbol"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 4).cast("int")).alias("event_time"),
        *[(F.rand(i) * 10).alias(f) for i, f in enumerate(FEATURES)],
    )
    target = (F.col("rsi_14") > 5).cast("int")
    return rows.withColumns({"target": target, "rolling_return_90d": F.rand(99)})


def test_fund_features_missing_in_the_newest_row(spark):
    """An artifact fills its own features, and leaves the frame's values as they were."""
    rows = learnable(spark)
    own = [*FEATURES, "rolling_return_90d"]
    model = training.fit_model(rows, "logreg", own, 1200, "1y", training.ModelSettings(linear_iterations=5))
    artifact = training.Artifact(own, [training.Component("logreg", model)])
    newest = rows.limit(3).withColumn("rolling_return_90d", F.lit(None).cast("double"))
    out = artifact.score(newest).collect()
    assert len(out) == 3 and all(0 <= r.prob <= 1 and r.rolling_return_90d is None for r in out)


def test_a_failing_candidate_leaves_the_others(spark, monkeypatch):
    rows = learnable(spark).cache()
    real = training.model_pipeline

    def broken(name, *args, **kwargs):
        if name == "rf":
            raise RuntimeError("no forest today")
        return real(name, *args, **kwargs)

    monkeypatch.setattr(training, "model_pipeline", broken)
    small = training.ModelSettings(boost_rounds=1, boost_depth=2, linear_iterations=5)
    settings = training.TrainingSettings(candidates=("rf", "logreg"), models=small)
    ranking, fitted, failed = training.rank_candidates(rows, 1200, rows, FEATURES, "1y", settings)
    assert [r["model_name"] for r in ranking] == ["logreg"] and list(fitted) == ["logreg"]
    assert failed[0]["model_name"] == "rf" and "no forest" in failed[0]["reason"]
    assert fitted["logreg"].calibration == "too_few_rows"

    labelled = rows.withColumnRenamed("event_time", "event_date").withColumn("realized_return", F.lit(0.1))
    plan = walkforward.ValidationSettings(
        candidates=("rf", "logreg"), models=small, min_train_days=100, test_days=50, step_days=100
    )
    out = walkforward._evaluate_labelled(labelled, "1y", 252, plan)
    assert out.status == "ok" and out.selected_model_type == "logreg"
    assert {f["model_type"] for f in out.failures} == {"rf"}
    split = out.splits.orderBy("split").first()
    assert split.train_end < split.test_start <= split.test_end and split.overlap_rows == 0
    assert out.threshold_splits.count() > 0
    monkeypatch.setattr(training, "model_pipeline", lambda *a, **k: 1 / 0)
    assert walkforward._evaluate_labelled(labelled, "1y", 252, plan).status == "all_candidate_models_failed"


def test_partition_merge_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "gold")
    shape = "symbol string, trade_date date, v double"
    first = [("a", date(2024, 1, d), float(d)) for d in (1, 2, 3)]
    assert merge.merge_partitions(path, spark.createDataFrame(first, shape), ["symbol", "trade_date"], "trade_date") == 3
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "gold").rglob("*.parquet") if "01-02" not in str(p)}
    new = [("a", date(2024, 1, 2), 20.0), ("a", date(2024, 1, 2), 30.0), ("b", date(2024, 1, 2), 5.0)]
    for _ in range(2):
        merge.merge_partitions(path, spark.createDataFrame(new, shape), ["symbol", "trade_date"], "trade_date")
    got = sorted((r.symbol, r.trade_date.day, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1, 1.0), ("a", 2, 30.0), ("a", 3, 3.0), ("b", 2, 5.0)]
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "gold").rglob("*.parquet") if "01-02" not in str(p)}
    assert after == before
    with pytest.raises(ValueError):
        merge.merge_partitions(path, spark.createDataFrame(new, shape), ["symbol"], "trade_date")


def test_audited_run_reconciles_and_profiles(spark, tmp_path):
    events, reconciled, profiles = [], [], []
    source = spark.range(10).withColumnRenamed("id", "k")
    rows = audit.audited_run(
        source.where("k < 9"), str(tmp_path / "t"), events.append, "job", "src", "dst", source, ["k"],
        reconciled.append, profiles.append, "2024-01-31",
    )
    assert rows == 9 and [e.first().status for e in events] == ["RUNNING", "SUCCESS"]
    assert reconciled[0].first().reconciliation_status == "FAIL"
    assert profiles[0].first().total_rows == 9
    long = "x" * 5000
    with pytest.raises(Exception):
        audit.audited_run(
            source.select(F.raise_error(F.lit(long)).alias("k")), str(tmp_path / "u"), events.append,
            "job", "src", "dst", source, ["k"], reconciled.append, profiles.append, "2024-01-31",
        )
    assert long in events[-1].first().error_message and len(reconciled) == 1
