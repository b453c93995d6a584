"""Every registered query against its SQL twin, on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tempolith.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool, bytes)):
        return v
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6)
    if isinstance(v, (int, np.integer, decimal.Decimal)):
        return float(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    if name not in catalogue.SQL:
        assert rows
        return
    rel = con.sql(catalogue.SQL[name])
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    want = [tuple(plain(r[i]) for i in place) for r in rel.fetchall()]
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(rows, key=order) == sorted(want, key=order)


def test_every_sql_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
