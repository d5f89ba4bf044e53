import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenbar.plans.training import (
    Artifact,
    Component,
    ModelSettings,
    fit_model,
    held_for_stopping,
    load_artifact,
    rounds_of,
    save_artifact,
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 2))
    noisy = (x[:, 0] + rng.normal(0, 1.5, 900) > 0).astype(int)
    data = [(f"s{i % 9}", i // 9, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, noisy))]
    return spark.createDataFrame(data, "symbol string, event_time long, a double, b double, target int").cache()


SIZES = {"boost_rounds": 40, "boost_depth": 3, "boost_min_rows": 5, "boost_rate": 0.4}


def test_boosting_stops_on_held_rows_above_a_size(rows):
    settings = ModelSettings(**SIZES, boost_stop_rows=500)
    stopped = fit_model(rows, "histgb", ["a", "b"], 900, "1y", settings)
    assert 0 < rounds_of(stopped) < 40
    held = rows.where(held_for_stopping(rows, 0.1, settings.seed))
    losses = stopped.stages[-1].evaluateEachIteration(stopped.stages[0].transform(held))
    assert losses[-1] <= min(losses) + 1e-6
    # at or below the size, and without one, every round is made
    for other, count in ((settings, 500), (ModelSettings(**SIZES, boost_stop_rows=None), 900)):
        assert rounds_of(fit_model(rows, "histgb", ["a", "b"], count, "1y", other)) == 40
    assert rounds_of(fit_model(rows, "logreg", ["a", "b"], 900, "1y", settings)) is None


def test_held_rows_do_not_depend_on_the_layout(rows):
    names = ["symbol", "event_time"]
    one = {tuple(r) for r in rows.coalesce(1).where(held_for_stopping(rows, 0.1, 42)).select(names).collect()}
    many = {tuple(r) for r in rows.repartition(7).where(held_for_stopping(rows, 0.1, 42)).select(names).collect()}
    assert one == many and 50 < len(one) < 140
    assert one != {tuple(r) for r in rows.where(held_for_stopping(rows, 0.1, 7)).select(names).collect()}
    odd = rows.withColumn("symbol", F.lit(None).cast("string"))
    assert 0 < odd.where(held_for_stopping(odd, 0.5, 1)).count() < 900


def test_rounds_are_kept_with_the_artifact(spark, rows, tmp_path):
    settings = ModelSettings(**SIZES, boost_stop_rows=500)
    model = fit_model(rows, "histgb", ["a", "b"], 900, "1y", settings)
    made = Artifact(["a", "b"], [Component("histgb", model, rounds=rounds_of(model))])
    save_artifact(spark, made, str(tmp_path / "artifact"))
    back = load_artifact(spark, str(tmp_path / "artifact"))
    assert back.components[0].rounds == rounds_of(model) == rounds_of(back.components[0].model)
