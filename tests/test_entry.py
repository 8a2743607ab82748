"""The driver's contract."""

from pathlib import Path

import pytest

import __spark_entry__ as entry


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_flagship_runs(spark):
    df = entry.entry(spark)
    assert df.count() == 1 and df.columns[:3] == ["cells", "occupied", "total"]


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
    assert all(isinstance(x, str) and "SELECT" in x for x in entry.oracle_sql().values())
