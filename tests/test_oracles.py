"""Every query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

CORE = sorted(k for k in entry.queries() if not k.startswith("p") or not k[1:2].isdigit())


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda x: "null" if x is None else f"{x:.9g}" if isinstance(x, float) else str(list(x)) if isinstance(x, (list, tuple)) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    rows = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    r = duck.execute(sql)
    columns = [x[0] for x in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.columns, rows) == normal(columns, r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns
