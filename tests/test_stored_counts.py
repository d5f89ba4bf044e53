"""Counts kept between runs: bucket digests, daily histograms, the watermark ledger."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbar.operators import digests, histograms, merge
from lumenbar.operators.drift import drift_windows, psi, value_counts
from lumenbar.operators.metrics import roc_auc
from lumenbar.operators.quantiles import exact_quantiles, unpivot_values


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_digest_log_reads_only_differing_buckets(spark):
    kind = "k long, a string, b string, v double"
    old = [(i, f"a{i}", None if i % 7 == 0 else "x", i / 3) for i in range(3000)]
    new = list(old)
    new[5] = (5, "x", "a5", 5 / 3)  # columns swapped
    new[14] = (14, None, "a14", 14 / 3)  # value and NULL swapped
    new[9] = (9, "a9", "x", None)
    new = new[:-1] + [(9001, "n", "n", 1.0)]
    before, after = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
    log = digests.change_log_by_digest(before, after, ["k"])
    assert rows_of(log) == rows_of(merge.change_log(before, after, ["k"]))
    assert sorted(r.k for r in log.collect()) == [5, 9, 14, 2999, 9001]
    left, right = (digests.bucket_digests(d, ["k"]) for d in (before, after))
    found = digests.differing_buckets(left, right)
    assert found.count() <= 5
    assert digests.rows_of_buckets(before, found, ["k"]).count() < 50


def test_digests_of_equal_and_odd_tables(spark):
    kind = "k string, v long"
    rows = [("a", 1), ("a", 1), (None, 2), ("", None), ("b", 3)]
    df = spark.createDataFrame(rows, kind)
    same = digests.bucket_digests(df.repartition(3), ["k"])
    assert digests.differing_buckets(digests.bucket_digests(df, ["k"]), same).count() == 0
    # pairs of equal rows cancel in an exclusive or alone
    more = spark.createDataFrame(rows[2:] + [("a", 5), ("a", 5)], kind)
    assert digests.differing_buckets(digests.bucket_digests(more, ["k"]), same).count() == 1
    empty = spark.createDataFrame([], kind)
    got = digests.reconcile_by_digest(df.select("k").distinct(), empty.select("k"), ["k"]).first()
    assert tuple(got) == (4, 0, 0, 4)
    assert tuple(digests.reconcile_by_digest(empty, empty, ["k"]).first()) == (0, 0, 0, 0)


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        x = float(rng.normal(100, 15)) if i % 11 else None
        y = float(rng.integers(0, 2)) if i % 13 else float("nan")
        rows.append((date.fromordinal(date(2023, 1, 1).toordinal() + i // 10), x, y))
    return spark.createDataFrame(rows, "event_date date, x double, y double").cache()


def test_daily_histograms_replace_their_days(spark, series, tmp_path):
    path = str(tmp_path / "days")
    cut = F.lit("2023-06-10").cast("date")
    histograms.write_days(series.where(F.col("event_date") <= cut).withColumn("x", F.lit(1.0)), ["x", "y"], path)
    histograms.write_days(series.where(F.col("event_date") < cut), ["x", "y"], path)
    for _ in range(2):
        assert histograms.write_days(series.where(F.col("event_date") >= cut), ["x", "y"], path) == 9
    want = histograms.daily_histogram(series, ["x", "y"])
    columns = ["day", "feature", "_bin", "n"]
    assert rows_of(histograms.read_days(spark, path).select(columns)) == rows_of(want.select(columns))
    some = histograms.read_days(spark, path, date(2023, 3, 5), date(2023, 4, 2))
    assert {r.month for r in some.select("month").distinct().collect()} == {"2023-03", "2023-04"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert histograms.write_days(series.limit(0), ["x", "y"], path) == 0


def test_quantiles_and_psi_from_days(spark, series, tmp_path):
    path = str(tmp_path / "days")
    histograms.write_days(series, ["x", "y"], path)
    days = histograms.read_days(spark, path)
    probs = [0.0, 0.005, 0.3, 0.5, 1.0]
    want = exact_quantiles(unpivot_values(series, ["x", "y"]), probs)
    assert rows_of(histograms.histogram_quantiles(days, series, ["x", "y"], probs)) == rows_of(want)
    windows = drift_windows(series)
    got = {r.feature: r.psi for r in histograms.histogram_psi(days, windows, ["x", "y"]).collect()}
    exact = {r.feature: r.psi for r in psi(value_counts(windows, ["x", "y"])).collect()}
    assert got.keys() == exact.keys() == {"x", "y"}
    assert all(abs(got[f] - exact[f]) < 1e-12 for f in exact)
    assert histograms.histogram_psi(days, drift_windows(series.limit(0)), ["x"]).count() == 0


def test_undated_rows_are_a_day_of_their_own(spark, tmp_path):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (date(2024, 1, 1), 3.0)], "event_date date, x double")
    path = str(tmp_path / "days")
    for _ in range(2):
        assert histograms.write_days(df, ["x"], path) == 2
    assert histograms.read_days(spark, path).agg(F.sum("n")).first()[0] == 3


def test_ledger_equals_history(spark):
    kind = "symbol string, event_time date"
    first = spark.createDataFrame([("a", date(2024, 1, 5)), ("b", date(2024, 1, 2)), (None, None)], kind)
    late = spark.createDataFrame([("a", date(2024, 1, 3)), ("c", date(2024, 1, 1))], kind)
    ledger = merge.advance_watermarks(merge.watermarks(first), late)
    assert rows_of(ledger) == rows_of(merge.watermarks(first.unionByName(late)))
    assert rows_of(merge.advance_watermarks(ledger, late.limit(0))) == rows_of(ledger)


def test_auc_of_probabilities_in_one_bin(spark):
    rng = np.random.default_rng(1)
    p = 0.5 + rng.integers(0, 200, 2000) * 1e-8
    y = (rng.random(2000) < 0.3 + (p - 0.5) * 2e5).astype(int)
    rows = [(int(a), float(b)) for a, b in zip(y, p)]
    got = roc_auc(spark.createDataFrame(rows, "target int, prob double")).first().roc_auc
    high, low = p[y == 1][:, None], p[y == 0][None, :]
    assert abs(got - ((high > low).mean() + (high == low).mean() / 2)) < 1e-12
