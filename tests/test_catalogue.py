"""Every registered query against DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pandas as pd
import pytest

from docloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    if v is None or v != v:
        return None
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    if isinstance(v, (datetime.datetime, pd.Timestamp)):
        return str(pd.Timestamp(v))
    try:
        return round(float(v), 5)
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    got = duck.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in got.description]
    want = got.fetchall()
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    a = sorted((tuple(norm(r[df.columns.index(c)]) for c in order) for r in rows), key=str)
    b = sorted((tuple(norm(r[names.index(c)]) for c in order) for r in want), key=str)
    assert a == b


@pytest.mark.parametrize("name", ["filter_elemMatch", "filter_array_element", "filter_array_none", "filter_array_index"])
def test_floats_at_a_limit_equal_sql(spark, tmp_path, name):
    """A limit as a float is not the limit as a double: 0.3 and 0.4 lie above, 0.35 below."""
    rows = [[0.3, 0.1], [0.35], [0.3, 0.35], [0.30000004, 0.1], [0.34999996], [0.32], [0.4], [0.40000004], [0.39999998], [0.0], [-0.0, 1.0], [None, 0.3], [None, 0.31], [float("nan")]]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(catalogue.oracle_sql()[name]).fetchall()
    assert sorted(r.vec_id for r in catalogue.queries()[name](spark, str(tmp_path)).collect()) == sorted(r[0] for r in want)
