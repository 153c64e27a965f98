"""Every query with an oracle, on the smallest tables, against DuckDB."""

import math
import os
from collections import Counter

import duckdb
import pytest

from narrata.plans import catalogue

DATA = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    if sql := catalogue.oracle_sql().get(name):
        want = duck.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()
        assert got == Counter(tuple(plain(v) for v in r) for r in want)
