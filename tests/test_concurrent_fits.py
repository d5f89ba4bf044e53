"""Walk-forward fits submitted together."""

import threading
from datetime import date, timedelta

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from lumenbar.plans import walkforward


@pytest.fixture
def labelled(spark):
    rows = [
        (s, date(2024, 1, 1) + timedelta(days=d), (d + k) % 2, 0.01, float(d))
        for k, s in enumerate("ab")
        for d in range(60)
    ]
    return spark.createDataFrame(
        rows, "symbol string, event_date date, target int, realized_return double, rsi double"
    ).cache()


def settings(at_once):
    return walkforward.ValidationSettings(
        candidates=("m1", "m2", "m3"), features=("rsi",), min_train_days=20, test_days=10,
        step_days=10, fits_at_once=at_once,
    )


def run(labelled, monkeypatch, fit, at_once, failures=None):
    chosen = settings(at_once)
    monkeypatch.setattr(walkforward, "fit_model", fit)
    monkeypatch.setattr(
        walkforward, "component_score",
        lambda test, component, name: component.model.transform(test).withColumnRenamed("p", name),
    )
    checks = walkforward.usable_splits(labelled, chosen)
    assert len(checks) > 2
    return walkforward.predict_splits(labelled, checks, "1y", chosen, failures)


def mean_model(train, name, features, rows, horizon, models):
    p = train.agg(F.avg("target") / int(name[1])).first()[0]
    return PipelineModel([SQLTransformer(statement=f"SELECT *, double({p}) AS p FROM __THIS__")])


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_same_predictions_at_any_width(labelled, monkeypatch):
    lock, now, most = threading.Lock(), [0], [0]

    def counted(*args):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            return mean_model(*args)
        finally:
            with lock:
                now[0] -= 1

    alone = rows_of(run(labelled, monkeypatch, counted, 1))
    assert most[0] == 1 and len(alone) > 0
    assert rows_of(run(labelled, monkeypatch, counted, 4)) == alone
    assert 1 < most[0] <= 4


def test_failing_fit_is_isolated_and_fatal_ones_are_not(labelled, monkeypatch):
    def broken(train, name, *rest):
        if name == "m2":
            raise ValueError("no")
        return mean_model(train, name, *rest)

    failures = []
    found = run(labelled, monkeypatch, broken, 4, failures)
    assert {r.model_type for r in found.select("model_type").distinct().collect()} == {"m1", "m3"}
    assert {f["reason"] for f in failures} == {"ValueError: no"} and {f["model_type"] for f in failures} == {"m2"}
    with pytest.raises(ValueError):
        run(labelled, monkeypatch, broken, 4)

    def mistake(train, name, *rest):
        raise TypeError("code")

    with pytest.raises(TypeError):
        run(labelled, monkeypatch, mistake, 4, [])
