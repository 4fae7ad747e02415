"""Every query of the core against DuckDB over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sievework.plans import catalog
from sievework.sources.ship import ship


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def _rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    one = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf, duck, name):
    ship(spark)
    df = catalog.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.oracle_sql():
        assert got
        return
    r = duck.sql(catalog.oracle_sql()[name])
    assert sorted(r.columns) == sorted(df.columns)
    assert _rows(got, df.columns) == _rows(r.fetchall(), list(r.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
