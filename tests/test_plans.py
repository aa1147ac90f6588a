"""Every registered query against its DuckDB SQL, or at least run, on the smallest tables."""

import math
import os
from collections import Counter
from datetime import datetime, timezone

import duckdb
import pytest

from ledgerloom import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime):
        return v.astimezone(timezone.utc).replace(tzinfo=None) if v.tzinfo else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for n in os.listdir(SF):
        c.sql(f"CREATE VIEW {n.split('.')[0]} AS SELECT * FROM '{SF}/{n}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    got = plans.queries()[name](spark, SF)
    rows = Counter(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    assert rows
    sql = plans.oracle_sql().get(name)
    if sql is not None:
        want = db.sql(sql)
        cols = [d[0] for d in want.description]
        assert sorted(cols) == sorted(got.columns)
        order = [cols.index(c) for c in sorted(cols)]
        assert rows == Counter(tuple(plain(r[i]) for i in order) for r in want.fetchall())


def test_flagship_and_names():
    assert set(plans.oracle_sql()) <= set(plans.queries())
    assert len(plans.queries()) > 120
