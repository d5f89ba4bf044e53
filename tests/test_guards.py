"""Freshness, promotion gate, report files, audit log, quality."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenbar.operators import audit, guards, quality
from lumenbar.schemas import REPORT_ARTIFACTS
from lumenbar.sources import reports

AS_OF = "2024-01-10 00:00:00"


def test_freshness(spark):
    def check(hours, n=200, **limits):
        df = spark.range(n).select(
            (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours))).alias("event_time")
        )
        return guards.freshness(df, AS_OF, **limits).first()

    assert check(1).status == "ok"
    assert check(24 * 30, max_age_hours=48).reason == "stale"
    assert check(1, n=5).reason == "too_few_rows"
    with pytest.raises(ValueError, match="stale"):
        guards.assert_fresh(
            spark.range(200).select(F.lit("2020-01-01").cast("timestamp").alias("event_time")), "t", AS_OF
        )
    assert check(1, n=0, min_rows=0).reason == "no_timestamp"


@pytest.mark.parametrize(
    "given, want", [(None, ["1y"]), ("1Y, 5y", ["1y", "5y"]), (" ,", ["1y"]), (["5Y", ""], ["5y"])]
)
def test_parse_horizons(given, want):
    assert guards.parse_horizons(given) == want


def gate(spark, required="1y", **changes):
    row = dict(
        source_table="t", horizon="1y", status="ok", avg_roc_auc=0.6, avg_f1=0.5, drift_status="ok",
        drift_high_features=2.0, generated_at=datetime(2024, 1, 8),
    )
    row.update(changes)
    schema = (
        "source_table string, horizon string, status string, avg_roc_auc double, avg_f1 double, "
        "drift_status string, drift_high_features double, generated_at timestamp"
    )
    tables = spark.createDataFrame([("t",)], "source_table string")
    return guards.promotion_gate(spark.createDataFrame([tuple(row.values())], schema), tables, AS_OF, required)


@pytest.mark.parametrize(
    "changes, reason",
    [
        ({}, None),
        ({"avg_roc_auc": 0.45}, "low_roc_auc"),
        ({"avg_roc_auc": None}, "low_roc_auc"),
        ({"avg_f1": 0.2}, "low_f1"),
        ({"status": "no_data"}, "status_not_ok"),
        ({"drift_status": None}, "drift_not_ok"),
        ({"drift_high_features": 15.0}, "high_drift"),
        ({"drift_high_features": None}, None),
        ({"horizon": "5y"}, "missing_horizon"),
        ({"generated_at": datetime(2023, 12, 1)}, "stale_report"),
        ({"source_table": "other"}, "missing_report"),
    ],
)
def test_promotion_gate(spark, changes, reason):
    out = gate(spark, **changes)
    assert out.first().reason == reason
    if reason:
        with pytest.raises(ValueError, match=reason):
            guards.assert_promotable(out)
    else:
        guards.assert_promotable(out)


def test_report_completeness(spark):
    tables = spark.createDataFrame([("a",), ("b",)], "source_table string")
    now, old = datetime(2024, 1, 9), datetime(2023, 1, 1)
    rows = [("a", x, now, True) for x in REPORT_ARTIFACTS]
    rows += [("b", x, old if "drift" in x else now, False) for x in REPORT_ARTIFACTS[:-1] + ["walk_forward_drift.csv"]]
    schema = "source_table string, artifact string, generated_at timestamp, has_horizons boolean"
    found = spark.createDataFrame(rows, schema).where("NOT (source_table = 'b' AND artifact LIKE '%regimes%')")
    out = guards.completeness_summary(guards.report_completeness(tables, found, "2024-01-05 00:00:00")).first()
    assert (out.missing, out.stale, out.invalid, out.status) == (1, 1, 1, "failed")
    good = guards.report_completeness(tables.where("source_table = 'a'"), found, "2024-01-05 00:00:00")
    guards.assert_complete(good)


def test_gate_failures_newest_wins(spark):
    schema = "source_table string, horizon string, status string, reason string, updated_at timestamp"
    rows = [
        ("t", "1y", "fallback", "schema_gate_failed_missing_columns=x", datetime(2024, 1, 1)),
        ("t", "1y", "ok", None, datetime(2024, 1, 2)),
        ("t", "5y", "fallback", "freshness_gate_failed_stale", datetime(2024, 1, 1)),
        ("u", None, "fallback", "insufficient_rows_1_lt_2", datetime(2024, 1, 1)),
    ]
    got = guards.gate_failures(spark.createDataFrame(rows, schema)).collect()
    assert [(r.source_table, r.gate_type, r.gate_detail) for r in got] == [("t", "freshness", "stale")]


REGIMES = "regime string, samples double, hit_rate double, avg_return double, avg_benchmark_return double"


def test_regime_rollup(spark):
    rows = [("bull", 100.0, 0.7, 0.1, 0.2), ("bull", 300.0, 0.5, None, 0.2), ("bear", 0.0, 0.4, 0.1, 0.1), ("odd", 5.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, REGIMES)
    api = reports.regime_rollup(df, []).first()
    assert api.bull_samples == 400 and api.bull_hit_rate == pytest.approx(0.55)
    assert api.bull_avg_return == pytest.approx(0.1) and api.bear_hit_rate is None
    assert api.sideways_samples is None
    text = reports.regime_rollup(df, [], missing_as_zero=True).first()
    assert text.bull_avg_return == pytest.approx(0.025) and text.bear_hit_rate == pytest.approx(0.4)


def test_report_files(spark, tmp_path):
    (tmp_path / "silver_a_walk_forward_summary.json").write_text(
        '{"source_table": "silver.a", "horizons": [{"horizon": "1y", "status": "ok", '
        '"selected_model_type": "rf", "recommended_min_prob": 0.6, "summary": {"splits_ran": 3, '
        '"avg_roc_auc": 0.61234, "avg_f1": 0.5}, "drift_status": "ok", "drift_summary": '
        '{"high_drift_features": 2, "medium_drift_features": 1}, "regime_rows": '
        '[{"regime": "bull", "samples": 100, "hit_rate": 0.7}, {"regime": "bull", "samples": 300, "hit_rate": 0.5}]}]}'
    )
    (tmp_path / "silver_b_walk_forward_summary.json").write_text('{"horizons": []}')
    (tmp_path / "silver_c_walk_forward_summary.json").write_text("{broken")
    names = spark.createDataFrame([(x, f"silver.{x}") for x in "abcd"], "asset_class string, source_table string")
    found = reports.read_reports(spark, str(tmp_path))
    got = {r.asset_class: r for r in reports.validation_summary(found, names).collect()}
    assert [got[x].status for x in "abcd"] == ["ok", "no_horizons", "report_parse_failed", "missing_report"]
    assert got["a"].bull_hit_rate == pytest.approx(0.55) and got["a"].splits_ran == 3
    assert reports.validation_summary(found, names, "a").count() == 1
    lines = [r.line for r in reports.validation_lines(reports.validation_summary(found, names)).collect()]
    assert lines[0] == (
        "- a [1y]: model=rf, threshold=60%, ROC-AUC=0.612, F1=0.500, splits=3, "
        "drift=ok (high=2, medium=1), hit-rate bull/bear/sideways=55.0%/n/a/n/a"
    )
    assert lines[3] == "- d [n/a]: status=missing_report"
    empty = reports.read_reports(spark, str(tmp_path / "nothing"))
    assert {r.status for r in reports.report_rows(empty, names).collect()} == {"missing_report"}


def test_audited_write(spark, tmp_path):
    log = []
    target = str(tmp_path / "t")
    n = audit.audited_write(
        spark.range(50), target, log.append, "job", "src", "tgt", rows_source=60
    )
    assert n == 50
    more = audit.audited_write(
        spark.range(7), target, lambda e: None, "job", "src", "tgt", mode="append"
    )
    assert more == 7
    events = log[0].unionByName(log[1])
    state = audit.current_state(events).collect()
    assert [(s.status, s.rows_target, s.row_count_match) for s in state] == [("SUCCESS", 50, False)]
    assert audit.lineage(events).first().loss_percent == pytest.approx(100 * 10 / 60)

    broken = spark.range(5).select(F.raise_error(F.lit("bad disk")).alias("x"))
    with pytest.raises(Exception, match="bad disk"):
        audit.audited_write(broken, target, log.append, "job", "src", "tgt")
    assert log[-1].first().status == "FAILED" and "bad disk" in log[-1].first().error_message


@pytest.mark.parametrize("n, status, match", [(1000, "PASS", True), (994, "WARN", True), (960, "WARN", False), (900, "FAIL", False)])
def test_reconcile(spark, n, status, match):
    out = audit.reconcile_counts(spark.range(1000), spark.range(n), "s", "t", "2024-01-01")
    row = out.first()
    assert (row.reconciliation_status, row.row_count_match) == (status, match)
    if status == "FAIL":
        with pytest.raises(ValueError, match="10.0%"):
            audit.assert_reconciled(out)
    else:
        audit.assert_reconciled(out)
    empty = audit.reconcile_counts(spark.range(0), spark.range(n), "s", "t", "2024-01-01").first()
    assert empty.row_count_variance_percent == 0


def test_run_status(spark):
    runs = spark.createDataFrame([(7, 3, 2, 1)], "period_days int, total_runs int, successful_runs int, failed_runs int")
    none = spark.createDataFrame([], "gate_type string")
    one = spark.createDataFrame([("schema",)], "gate_type string")
    clean = runs.withColumn("failed_runs", F.lit(0))
    got = [audit.report_status(r, g).first().report_status for r, g in ((runs, none), (clean, one), (clean, none))]
    assert got == ["FAIL", "WARN", "PASS"]


def test_quality_gate(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0), (2, "b", 3.0), (3, "c", None)], "k int, t string, v double")
    p = quality.quality_profile(df, "t1", ["k"], "2024-01-01", "v", ["k"])
    row = p.first()
    assert (row.total_rows, row.unique_rows, row.duplicate_rows, row.null_rows) == (4, 3, 1, 2)
    assert row.data_completeness_percent == pytest.approx(83.33) and row.mean_value == 2.0
    assert row.column_quality["t"].null_count == 1 and row.column_quality["k"].unique_count == 3
    assert {i.issue: i["count"] for i in row.issue_details} == {"null_values": 2, "duplicate_rows": 1}
    good = quality.quality_profile(spark.range(10), "t2", ["id"], "2024-01-01")
    tables = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "table_name string")
    both = p.unionByName(good)
    got = {r.table_name: r.gate_status for r in quality.quality_gate(both, tables).collect()}
    assert got == {"t1": "WARN", "t2": "PASS", "t3": "NO_DATA"}
