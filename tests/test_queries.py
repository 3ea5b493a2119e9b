"""Every query against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from folioscope import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def value(x):
        return round(float(x), 9) if isinstance(x, float) else x

    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    mine = queries.QUERIES[name](spark, SF)
    got = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in got.description]
    assert sorted(mine.columns) == sorted(columns)
    a, b = plain([tuple(r) for r in mine.collect()], mine.columns), plain(got.fetchall(), columns)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, float) and math.isclose(p, q, abs_tol=2e-9)), (x, y)


def test_queries_without_sql_run(spark):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"ask"}):
        assert queries.QUERIES[name](spark, SF).count() > 0
