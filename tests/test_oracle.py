"""Every query with SQL against DuckDB on the smallest tables; the others must run and return their columns."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from voxloom.plans import registry

SF = os.environ.get("VOXLOOM_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(columns).collect()) if name in registry.oracle_sql() else df.limit(5).collect()
    if name in registry.oracle_sql():
        cur = duck.execute(registry.oracle_sql()[name])
        names = [x[0] for x in cur.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
