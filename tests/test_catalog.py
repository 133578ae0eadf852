"""Each query against its SQL in DuckDB over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from questrel.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert cols == sorted(want.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    names = ", ".join(f'"{c}"' for c in cols)
    assert sorted(map(str, got)) == sorted(str(tuple(map(plain, r))) for r in duck.sql(f"select {names} from want").fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
