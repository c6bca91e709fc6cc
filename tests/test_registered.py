"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
SLOW = {"trained_model_forecast", "training_run_records", "selected_feature_gains", "training_errors", "trained_walk_forward"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(name, spark, con):
    ours = entry.queries()[name](spark, FOLDER).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert difference(ours, con.execute(sql).df()) is None
    else:
        assert len(ours)


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
