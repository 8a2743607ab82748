"""Every registered query against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from stitchlake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    d = duckdb.connect()
    d.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        d.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return d


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in found)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert got == rows(want.columns, want.fetchall())
