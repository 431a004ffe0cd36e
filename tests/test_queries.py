"""Every registered query of the library against its SQL twin, on the smallest tables."""

import math

import duckdb
import pytest

from orefield.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def text(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(text, v)) + "]"
    return f"{float(v):.9g}" if hasattr(v, "quantize") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(text(r[c]) for c in columns) for r in rows) == want
