import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lumenbar.operators.guards import assert_complete, folder_completeness, folder_gate_failures
from lumenbar.schemas import REPORT_ARTIFACTS
from lumenbar.sources.reports import metrics_scan, read_artifacts, read_training_metrics

CUTOFF = "2024-01-10 00:00:00"


def put(path, text, day):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    at = datetime(2024, 1, day, tzinfo=timezone.utc).timestamp()
    os.utime(path, (at, at))


@pytest.fixture
def reports(tmp_path):
    folder = tmp_path / "reports"
    for name in REPORT_ARTIFACTS:
        put(folder / f"silver_good_{name}", '{"horizons": [{"horizon": "1y"}]}', 20)
        put(folder / f"silver_stale_{name}", '{"horizons": []}', 5)
        # as Spark writes them: a folder of parts, the newest of which counts
        put(folder / f"silver_spark_{name}" / "part-0.json", '{"horizons": [1]}\n', 5)
        put(folder / f"silver_spark_{name}" / "part-1.json", '{"horizons": [2]}\n', 20)
        put(folder / f"silver_spark_{name}" / "_SUCCESS", "", 25)
        for table in ("cut", "object", "binary"):
            put(folder / f"silver_{table}_{name}", "a,b", 20)
    put(folder / "silver_cut_walk_forward_summary.json", '{"horizons": [1], "x": ', 20)
    put(folder / "silver_object_walk_forward_summary.json", '{"horizons": {"a": 1}}', 20)
    put(folder / "silver_binary_walk_forward_summary.json", "\0\1 not json", 5)
    (folder / "silver_object_walk_forward_drift.csv").unlink()
    put(folder / "notes.txt", "x", 20)
    return str(folder)


def test_report_folders_are_checked_by_their_files(spark, reports):
    tables = [f"silver.{t}" for t in ("good", "stale", "spark", "cut", "object", "binary", "none")]
    checked = folder_completeness(spark, reports, tables, CUTOFF)
    flags = {}
    for r in checked.collect():
        for f in ("missing", "stale", "invalid"):
            flags.setdefault((r.source_table.split(".")[1], f), set()).update([r.artifact] if r[f"is_{f}"] else [])
    every, summary = set(REPORT_ARTIFACTS), {"walk_forward_summary.json"}
    found = {k: v for k, v in flags.items() if v}
    assert found == {
        ("stale", "stale"): every,
        ("cut", "invalid"): summary,
        ("object", "invalid"): summary,
        ("object", "missing"): {"walk_forward_drift.csv"},
        ("binary", "invalid"): summary,
        ("binary", "stale"): summary,  # an invalid one may be stale as well
        ("none", "missing"): every,
    }
    assert_complete(folder_completeness(spark, reports, ["silver.good", "silver.spark"], CUTOFF))
    with pytest.raises(ValueError, match="stale=7"):
        assert_complete(folder_completeness(spark, reports, ["silver.stale"], CUTOFF))


def test_folders_that_do_not_exist_or_are_empty(spark, tmp_path):
    missing, empty = str(tmp_path / "no"), tmp_path / "empty"
    empty.mkdir()
    for folder in (missing, str(empty)):
        assert read_artifacts(spark, folder).count() == 0
        assert folder_completeness(spark, folder, ["a.b"], CUTOFF).where("is_missing").count() == 7
        assert folder_gate_failures(spark, folder).count() == 0
        scan = metrics_scan(read_training_metrics(spark, folder)).first()
        assert tuple(scan) == (0, 0, 0)


def test_metrics_files_newest_of_a_model_wins(spark, tmp_path):
    folder = tmp_path / "models"
    failed = '{{"source_table": "{}", "horizon": "{}", "status": "FALLBACK", "reason": "{}"}}'
    schema = "schema_gate_failed_missing_columns=close"
    stale = "freshness_gate_failed_stale_data_age_days=12"
    put(folder / "a_old_metrics.json", failed.format("silver.a", "1y", schema), 1)
    put(folder / "a_new_metrics.json", '{"source_table": "silver.a", "horizon": "1y", "status": "ok"}', 2)
    put(folder / "b_new_metrics.json", failed.format("silver.b", "1y", stale), 5)
    put(folder / "b_old_metrics.json", failed.format("silver.b", "1y", schema), 4)
    put(folder / "c_metrics.json", failed.format("silver.c", "5y", "insufficient_rows_1_lt_5"), 3)
    put(folder / "d_metrics.json", f'{{"status": "fallback", "reason": "{schema}"}}', 3)
    put(folder / "corrupt_metrics.json", '{"status": "fallback", ', 9)
    put(folder / "list_metrics.json", "[1, 2]", 9)
    put(folder / "other.json", failed.format("silver.z", "1y", schema), 9)
    rows = folder_gate_failures(spark, str(folder)).collect()
    got = [(r.source_table, r.horizon, r.gate_type, r.gate_detail) for r in rows]
    assert got == [
        ("d_metrics", "unknown", "schema", "missing_columns=close"),
        ("silver.b", "1y", "freshness", "stale_data_age_days=12"),
    ]
    metrics = read_training_metrics(spark, str(folder))
    assert tuple(metrics_scan(metrics).first()) == (8, 2, 4)
    days = {r.source_table: r.d for r in metrics.select("source_table", F.dayofmonth("updated_at").alias("d")).collect()}
    assert days["d_metrics"] == 3
