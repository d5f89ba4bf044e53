"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, compare
from lumenbar.catalog.queries import registered

FOLDER = "/root/testdata/sf0.001"
SLOW = {"train_candidates", "ensemble_scores", "walk_forward_ml", "boost_stopping"}
NAMES = sorted(set(registered()) - SLOW)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert not set(registered()) - set(entry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    status, _, _, detail = compare(
        spark, con, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER
    )
    assert status == "ok", detail


def test_entry(spark):
    assert entry.entry(spark).count() == 6
