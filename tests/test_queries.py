"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES
from compare import rows as canonical
from quarrydex import problems, queries

NAMES = [*problems.QUERIES, *queries.QUERIES]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql()[name]
    cur = duck.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert canonical(df.columns, got) == canonical(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id"]
