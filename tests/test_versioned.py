from datetime import date

import pytest
from pyspark.sql import functions as F

from lumenbar.operators.merge import merge_partitions
from lumenbar.plans.scoring import column_scorer, write_signals
from lumenbar.schemas import FEATURES
from lumenbar.sources.versioned import ConcurrentWrite, VersionedTable

KEYS = ["k", "day"]


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, rows, schema="k string, day string, v double"):
    return spark.createDataFrame(rows, schema)


def test_added_column_survives_later_merges(spark, table):
    table.merge(frame(spark, [("a", "d1", 1.0), ("b", "d2", 2.0)]), KEYS, ["day"])
    wide = "k string, day string, v double, w double"
    table.merge(frame(spark, [("c", "d2", 3.0, 9.0)], wide), KEYS)
    for n in (1, 2):  # a narrower batch into the same partition, twice
        table.merge(frame(spark, [("e", "d2", 5.0 + n)]), KEYS)
    want = [("a", "d1", 1.0, None), ("b", "d2", 2.0, None), ("c", "d2", 3.0, 9.0), ("e", "d2", 7.0, None)]
    assert rows_of(table.read()) == want
    assert table.read().schema.names == ["k", "day", "v", "w"]
    assert table.versions() == [1, 2, 3, 4]
    # earlier versions stay readable with their own schema
    assert rows_of(table.read(1)) == [("a", "d1", 1.0), ("b", "d2", 2.0)]
    assert rows_of(table.read(2))[2] == ("c", "d2", 3.0, 9.0)


@pytest.mark.parametrize("value,other,kind", [
    ("001", "1", "string"), ("2024-01-01", "x/=%", "string"), (date(2024, 1, 1), None, "date"), (None, 7, "int"),
])
def test_partition_values_keep_their_type(spark, table, value, other, kind):
    schema = f"k string, day {kind}, v double"
    for n in (1.0, 2.0):
        table.merge(frame(spark, [("a", value, n), ("a", other, n), ("b", value, n)], schema), ["k", "day"], ["day"])
    assert rows_of(table.read()) == sorted([("a", value, 2.0), ("a", other, 2.0), ("b", value, 2.0)], key=str)
    assert {r.day: r.rows for r in table.partitions().collect()} == {value: 2, other: 1}
    assert table.read().schema["day"].dataType.simpleString() == kind


def test_untouched_partitions_keep_their_folders_and_are_not_read(spark, table):
    table.merge(frame(spark, [("a", "d1", 1.0), ("a", "d2", 1.0)]), KEYS, ["day"])
    first = {p["values"]: p["folder"] for p in table.manifest().parts.values()}
    table.merge(frame(spark, [("a", "d2", 2.0), ("a", "d3", 3.0)]), KEYS)
    second = {p["values"]: p["folder"] for p in table.manifest().parts.values()}
    assert second['{"day":"d1"}'] == first['{"day":"d1"}']
    assert second['{"day":"d2"}'] != first['{"day":"d2"}'] and len(second) == 3
    recent = table.read_partitions(F.col("day") >= "d3")
    assert rows_of(recent) == [("a", "d3", 3.0)] and len(recent.inputFiles()) == 1


def test_failure_before_the_rename_leaves_the_old_version(spark, table, monkeypatch):
    table.merge(frame(spark, [("a", "d1", 1.0)]), KEYS, ["day"])

    def fail(manifest):
        raise OSError("lost")

    monkeypatch.setattr(table, "_publish", fail)
    with pytest.raises(OSError):
        table.merge(frame(spark, [("a", "d1", 2.0)]), KEYS)
    monkeypatch.undo()
    assert rows_of(table.read()) == [("a", "d1", 1.0)] and table.versions() == [1]
    table.merge(frame(spark, [("a", "d1", 3.0)]), KEYS)
    assert rows_of(table.read()) == [("a", "d1", 3.0)]


def test_second_writer_of_a_version_fails(spark, table):
    table.merge(frame(spark, [("a", "d1", 1.0)]), KEYS, ["day"])
    taken = table.manifest()
    with pytest.raises(ConcurrentWrite):
        table._publish(taken)
    assert rows_of(table.read()) == [("a", "d1", 1.0)] and table.versions() == [1]


def test_types_widen_or_are_refused(spark, table):
    table.merge(frame(spark, [("a", "d1", 1)], "k string, day string, v int"), KEYS, ["day"])
    table.merge(frame(spark, [("b", "d1", 2**40)], "k string, day string, v bigint"), KEYS)
    table.merge(frame(spark, [("c", "d2", 3)], "k string, day string, v int"), KEYS)
    assert rows_of(table.read()) == [("a", "d1", 1), ("b", "d1", 2**40), ("c", "d2", 3)]
    with pytest.raises(ValueError, match="column v"):
        table.merge(frame(spark, [("a", "d1", "x")], "k string, day string, v string"), KEYS)


def test_insert_update_and_repeated_keys(spark, table):
    rows = [("a", "d1", 1.0), ("a", "d1", 4.0), ("b", "d1", 2.0)]
    table.merge(frame(spark, rows), KEYS, ["day"], newest_by="v")
    table.insert(frame(spark, [("a", "d1", 9.0), ("c", "d1", 3.0)]), KEYS)
    assert rows_of(table.read()) == [("a", "d1", 4.0), ("b", "d1", 2.0), ("c", "d1", 3.0)]
    wide = frame(spark, [("a", "d1", 7.0, "x"), ("n", "d1", 8.0, "y")], "k string, day string, v double, w string")
    table.update(wide, KEYS, ["w"])
    want = [("a", "d1", 4.0, "x"), ("b", "d1", 2.0, None), ("c", "d1", 3.0, None), ("n", "d1", 8.0, "y")]
    assert rows_of(table.read()) == want
    assert table.merge(frame(spark, []), KEYS).version == 3
    with pytest.raises(ValueError):
        table.merge(frame(spark, rows), ["k"])


def test_vacuum_and_rollback(spark, table):
    for n in range(4):
        table.merge(frame(spark, [("a", f"d{n % 2}", float(n))]), KEYS, ["day"])
    assert table.vacuum(keep=2) == [1, 2] and table.versions() == [3, 4]
    assert rows_of(table.read()) == [("a", "d0", 2.0), ("a", "d1", 3.0)]
    assert rows_of(table.read(3)) == [("a", "d0", 2.0), ("a", "d1", 1.0)]
    table.rollback(3)
    assert table.versions()[-1] == 5 and rows_of(table.read()) == rows_of(table.read(3))
    with pytest.raises(LookupError):
        table.read(1)


def test_unpartitioned_and_clashing_names(spark, table):
    schema = "k string, `count` long, `a b` double"
    table.merge(frame(spark, [("x", 1, 1.0)], schema), ["k"])
    table.merge(frame(spark, [("x", 2, 2.0), ("y", 3, None)], schema), ["k"])
    assert rows_of(table.read()) == [("x", 2, 2.0), ("y", 3, None)]


def test_signals_are_written_by_day(spark, table):
    def features(day, close):
        rows = [(s, date(2024, 1, day), close, *[float(close)] * len(FEATURES)) for s in "ab"]
        names = ", ".join(f"{c} double" for c in FEATURES)
        return spark.createDataFrame(rows, f"symbol string, event_time date, close double, {names}")

    score = column_scorer(F.lit(0.7))
    write_signals(features(1, 10.0), score, score, table)
    write_signals(features(2, 20.0), score, score, table)
    untouched = {p["folder"] for p in table.manifest().parts.values()}
    write_signals(features(2, 30.0), score, score, table)
    stored = table.read()
    got = rows_of(stored.select("symbol", F.dayofmonth("trade_date"), "confidence"))
    assert got == [("a", 1, 0.7), ("a", 2, 0.7), ("b", 1, 0.7), ("b", 2, 0.7)]
    assert len(untouched & {p["folder"] for p in table.manifest().parts.values()}) == 1


def test_folder_merge_keeps_columns_and_string_partitions(spark, tmp_path):
    path = str(tmp_path / "folders")
    merge_partitions(path, frame(spark, [("a", "001", 1.0), ("b", "002", 2.0)]), KEYS, "day")
    wide = "k string, day string, v double, w double"
    merge_partitions(path, frame(spark, [("c", "002", 3.0, 9.0)], wide), KEYS, "day")
    for n in (1, 2):
        merge_partitions(path, frame(spark, [("a", "001", 5.0 * n), ("b", "002", 7.0)]), KEYS, "day")
    found = spark.read.schema(wide).parquet(path).select("k", "day", "v", "w")
    assert rows_of(found) == [("a", "001", 10.0, None), ("b", "002", 7.0, None), ("c", "002", 3.0, 9.0)]
