from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbar.operators.incremental import TAIL, append_features, late_bars, run_append
from lumenbar.operators.indicators import all_indicators
from lumenbar.operators.nav import nav_features
from lumenbar.schemas import FEATURES, NAV_FEATURES
from lumenbar.sources.versioned import VersionedTable

SHAPE = "symbol string, event_time date, open double, high double, low double, close double, volume double"
FIRST = date(2020, 1, 1)


def series(symbol, days, seed, start=0):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 1, days))
    return [
        (symbol, FIRST + timedelta(start + i), c, c + 1.5, c - 1.0, c, 10.0)
        for i, c in enumerate(close.tolist())
    ]


@pytest.fixture(scope="module")
def rows():
    return [*series("long", 520, 1), *series("short", 30, 2, 480), *series("late", 25, 3, 495), *series("old", 300, 4)]


def close_to(got, want, names):
    got = {(r.symbol, r.event_time): r for r in got.collect()}
    want = {(r.symbol, r.event_time): r for r in want.collect()}
    assert got.keys() == want.keys() and got
    for key, r in want.items():
        for c in names:
            a, b = got[key][c], r[c]
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-7), (key, c, a, b)


def test_appended_days_equal_a_run_over_everything(spark, tmp_path, rows):
    bars = spark.createDataFrame(rows, SHAPE)
    silver, state = (VersionedTable(spark, str(tmp_path / n)) for n in ("silver", "state"))
    cuts = [FIRST + timedelta(n) for n in (0, 490, 500, 501, 520)]
    for low, high in zip(cuts, cuts[1:]):
        batch = bars.where((F.col("event_time") >= F.lit(low)) & (F.col("event_time") < F.lit(high)))
        assert run_append(batch, silver, state, is_fund=True) == batch.count()
    full = nav_features(all_indicators(bars))
    close_to(silver.read(), full, [*FEATURES, *NAV_FEATURES, "close", "volume"])
    kept = {r.symbol: r for r in state.read().collect()}
    assert {s: len(r.tail) for s, r in kept.items()} == {"long": TAIL, "short": 30, "late": 25, "old": TAIL}
    assert kept["old"].last_time == FIRST + timedelta(299)
    # a batch that came before adds nothing, and leaves its symbols as they are
    again = bars.where(F.col("event_time") >= F.lit(cuts[3]))
    assert run_append(again, silver, state, is_fund=True) == 0
    assert silver.versions()[-1] == 4


def test_an_append_reads_the_state_and_the_batch_only(spark, tmp_path, rows):
    bars = spark.createDataFrame(rows, SHAPE)
    history, batch = str(tmp_path / "history"), str(tmp_path / "batch")
    cut = F.lit(FIRST + timedelta(519))
    bars.where(F.col("event_time") < cut).write.parquet(history)
    bars.where(F.col("event_time") >= cut).write.parquet(batch)
    first = append_features(None, spark.read.parquet(history))
    first.state.write.parquet(str(tmp_path / "state"))
    state, new = spark.read.parquet(str(tmp_path / "state")), spark.read.parquet(batch)
    found = append_features(state, new)
    assert {f.split("/")[-2] for f in found.features.inputFiles()} == {"state", "batch"}
    want = all_indicators(bars).where(F.col("event_time") >= cut)
    close_to(found.features, want, FEATURES)
    # only symbols of the batch get a new state
    assert sorted(r.symbol for r in found.state.collect()) == ["late", "long"]


def test_late_repeated_and_keyless_bars(spark):
    start = spark.createDataFrame(series("a", 40, 5), SHAPE)
    state = append_features(None, start).state
    day = FIRST + timedelta(40)
    odd = spark.createDataFrame(
        [("a", day, 1.0, 2.0, 0.5, 1.0, 1.0), ("a", day, 1.0, 9.0, 0.5, 7.0, 1.0),
         ("a", FIRST, 1.0, 2.0, 0.5, 1.0, 1.0), (None, day, 1.0, 2.0, 0.5, 1.0, 1.0),
         ("a", None, 1.0, 2.0, 0.5, 1.0, 1.0), ("b", day, 3.0, 3.0, 3.0, 3.0, 0.0)], SHAPE,
    )
    found = append_features(state, odd)
    got = sorted((r.symbol, r.event_time, r.close) for r in found.features.collect())
    assert got == [("a", day, 7.0), ("b", day, 3.0)]
    assert late_bars(state, odd).count() == 3 and late_bars(None, odd).count() == 2
    assert append_features(state, odd.limit(0)).state.count() == 0
    assert append_features(state, odd.limit(0)).features.count() == 0
