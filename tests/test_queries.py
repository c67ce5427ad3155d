"""The catalogue against its SQL, on the smallest tables."""

import glob
import os
from collections import Counter

import pytest

from rulewright import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_rows(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    told = duck.execute(Q.SQL[name])
    names = [d[0] for d in told.description]
    assert sorted(got.columns) == sorted(names)
    assert Counter(str(tuple(r[n] for n in names)) for r in got.collect()) == Counter(str(tuple(r)) for r in told.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0
