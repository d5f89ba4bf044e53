"""Merges, payloads, sinks, incremental ingest."""

import json
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from lumenbar.operators import merge
from lumenbar.plans.feature_etl import run_feature_etl
from lumenbar.schemas import BAR_SCHEMA, SIGNAL_SCHEMA
from lumenbar.sources import payloads, tables
from lumenbar.streaming.incremental import ingest_new_files

OLD = [(1, "a", 10.0, 1.0), (2, "b", 20.0, 2.0)]
NEW = [(2, "B", 25.0, 2.5), (3, "C", 30.0, 3.0)]
SCHEMA = "k int, name string, close double, open double"


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame(OLD, SCHEMA), spark.createDataFrame(NEW, SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_only(pair):
    assert rows(merge.insert_only(*pair, ["k"])) == sorted([*OLD, NEW[1]])


def test_update_columns(pair):
    got = rows(merge.update_columns(*pair, ["k"], ["close", "name"]))
    assert got == [OLD[0], (2, "B", 25.0, 2.0), NEW[1]]


def test_replace_is_idempotent(pair):
    once = merge.replace_rows(*pair, ["k"])
    assert rows(once) == [OLD[0], *NEW]
    assert rows(merge.replace_rows(once, pair[1], ["k"])) == rows(once)


def test_update_keeps_old_value_of_null_flag(spark):
    old = spark.createDataFrame([(1, None, 1.0, 1.0)], SCHEMA)
    new = spark.createDataFrame([(1, "x", None, 9.0)], SCHEMA)
    assert merge.update_columns(old, new, ["k"], ["close"]).first() == (1, None, None, 1.0)


def test_additive_columns(spark, pair):
    wide = pair[1].withColumn("extra", F.lit("e"))
    got = merge.replace_rows(merge.evolve(pair[0], wide), wide, ["k"])
    assert {r.k: r.extra for r in got.collect()} == {1: None, 2: "e", 3: "e"}


def test_watermark(spark):
    schema = "symbol string, event_time date"
    stored = spark.createDataFrame([("A", date(2020, 1, 5))], schema)
    incoming = spark.createDataFrame(
        [("A", date(2020, 1, d)) for d in (4, 5, 6)] + [("B", date(2015, 1, 1)), ("B", date(2016, 1, 1))], schema
    )
    assert merge.newer_than_watermark(incoming, stored).count() == 2
    assert merge.newer_than_watermark(incoming, stored, inclusive=True).count() == 3


def test_change_log(pair):
    got = {r.k: r for r in merge.change_log(*pair, ["k"]).collect()}
    assert got[1].operation == "DELETE" and got[3].operation == "INSERT"
    assert got[2].changed_columns == ["name", "close", "open"]
    assert json.loads(got[2].new_values)["name"] == "B"
    assert merge.change_log(pair[0], pair[0], ["k"]).count() == 0


def test_klines(spark):
    body = json.dumps([[1704067200000, "1.5", "2", "1", "1.75", "10", "x"]])
    row = payloads.decode_klines(spark.createDataFrame([("BTC", body)], "symbol string, payload string")).first()
    at = spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp").first()[0]
    assert (row.symbol, row.open, row.close, row.volume) == ("BTC", 1.5, 1.75, 10.0)
    assert row.event_time.replace(tzinfo=timezone.utc).year in (2023, 2024) and at


def test_navs_skip_bad_entries(spark):
    body = json.dumps({"data": [{"date": "02-01-2024", "nav": "12.5"}, {"date": "2024-01-03", "nav": "1"}, {"date": "04-01-2024", "nav": "n/a"}, {"nav": "3"}]})
    got = payloads.decode_navs(spark.createDataFrame([(77, "Fund", body)], "code int, name string, payload string")).collect()
    assert len(got) == 1 and got[0].symbol == "MF77" and got[0].event_time == date(2024, 1, 2)
    assert got[0].open == got[0].close == 12.5 and got[0].volume == 0


def test_fund_filter(spark):
    names = {
        "HDFC Top 100 Direct Growth": True,
        "hdfc Top 100 Direct Growth": True,
        "HDFC Top 100 direct Growth": False,
        "HDFC Top 100 Direct Growth Monthly": False,
        "HDFC Top 100 Direct Growth idcw": False,
        "Unknown Direct Growth": False,
    }
    df = spark.createDataFrame([(n,) for n in names], "schemeName string")
    kept = {r[0] for r in payloads.select_funds(df).collect()}
    assert kept == {n for n, ok in names.items() if ok}


def test_constituents_csv(spark, tmp_path):
    (tmp_path / "index.csv").write_text("Company Name,Symbol\nA Ltd,AAA\nB Ltd,BBB\n")
    got = payloads.read_constituents(spark, str(tmp_path / "index.csv")).collect()
    assert [r.ticker for r in got] == ["AAA.NS", "BBB.NS"]


def test_jdbc_partitions():
    assert [tables.jdbc_partitions(n) for n in (None, 0, 100_000, 2_800_000, 10**9)] == [3, 1, 1, 5, 100]
    assert tables.jdbc_partitions(10**9, cap=8) == 8


def test_missing_table_is_empty(spark, tmp_path):
    df = tables.read_or_empty(spark, str(tmp_path / "none"), SIGNAL_SCHEMA)
    assert df.count() == 0 and df.columns == SIGNAL_SCHEMA.names
    assert not tables.table_exists(spark, "no_such_table")


def bars(spark, days, close=10.0):
    data = [("A", None, d, close, close + 1, close - 1, close, None) for d in days]
    return spark.createDataFrame(data, BAR_SCHEMA)


def test_feature_etl_writes_once(spark, tmp_path):
    path = str(tmp_path / "silver")
    days = [date(2024, 1, d) for d in range(1, 20)]
    assert run_feature_etl(bars(spark, days), path, is_fund=True)
    out = spark.read.parquet(path)
    assert out.count() == 19 and "sortino_30d" in out.columns
    # constant prices: flat oscillators
    last = out.orderBy(F.col("event_time").desc()).first()
    assert (last.rsi_14, last.stoch_k, last.asset_name, last.volume) == (50.0, 50.0, "A", 0.0)
    assert not run_feature_etl(bars(spark, days).limit(0), path)
    assert spark.read.parquet(path).count() == 19


def test_stream_merges_new_keys_only(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    first = [date(2024, 1, d) for d in (1, 2, 3)]
    bars(spark, first).write.parquet(source)
    ingest_new_files(spark, source, target, check).awaitTermination()
    bars(spark, [date(2024, 1, d) for d in (3, 4)], close=99.0).write.mode("append").parquet(source)
    ingest_new_files(spark, source, target, check).awaitTermination()
    got = {r.event_time.day: r.close for r in spark.read.parquet(target).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 10.0, 4: 99.0}
