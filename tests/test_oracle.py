"""Every reference query with oracle SQL against DuckDB, on whole small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gridloom.plans import catalogue

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def canon(rows, order):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return str(v).lower() if isinstance(v, bool) else str(v)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in catalogue.ORACLE:
        assert got
        return
    cur = duck.execute(catalogue.ORACLE[name])
    names, want = [d[0] for d in cur.description], cur.fetchall()
    assert sorted(names) == sorted(df.columns)
    both = sorted(names)
    assert canon(got, [df.columns.index(n) for n in both]) == canon(want, [names.index(n) for n in both])
