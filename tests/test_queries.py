import glob
import os

import duckdb
import pytest

from groundplan.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, values):
    """Doubles as the query rounds them."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "nan" if v != v else v + 0.0 if isinstance(v, float) else v
    return sorted(repr(tuple(cell(v[i]) for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    result = want.fetchall()
    assert result and rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, result)
