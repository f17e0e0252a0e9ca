"""Every query with SQL gives DuckDB's rows on the smallest tables; the others give rows at all."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from larder.plans import registry

DATA = os.environ.get("LARDER_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in SQL:
        assert got
        return
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    said = db.execute(SQL[name])
    names = [d[0] for d in said.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in said.fetchall())
