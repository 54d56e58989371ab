import os

import pytest

import __spark_entry__ as e

SMALL = "/root/testdata/sf0.001"


def test_names_match():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 50


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
def test_entry_runs(spark):
    assert e.entry(spark).count() > 0
