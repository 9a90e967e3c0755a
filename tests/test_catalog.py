"""Every query against its SQL on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from quartzite.plans import catalog, flows, more  # noqa: F401 (they add to the catalog)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    return repr(float(v)) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    assert name in catalog.ORACLE_SQL or rows is not None
    if name in catalog.ORACLE_SQL:
        want = db.sql(catalog.ORACLE_SQL[name])
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        at = [want.columns.index(c) for c in columns]
        mine = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
        assert mine == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
