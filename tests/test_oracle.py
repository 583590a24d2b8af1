"""Every query that has SQL, against DuckDB on the same small tables."""

import glob
import math
import os

import duckdb
import pytest

from evalforge.plans import evaluation, experiments, ledgers, reporting, rollups, searching

SF = "/root/testdata/sf0.01"
QUERIES, SQL = {**evaluation.QUERIES, **ledgers.QUERIES, **reporting.QUERIES, **searching.QUERIES, **experiments.QUERIES, **rollups.QUERIES}, {**evaluation.SQL, **ledgers.SQL, **reporting.SQL, **searching.SQL, **experiments.SQL, **rollups.SQL}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows(frame, columns):
    def one(v):
        if v is None or str(v) == "<NA>" or isinstance(v, float) and math.isnan(v):
            return "~"
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(map(one, r)) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
    assert len(got)


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert all(f.__doc__ for f in QUERIES.values())
