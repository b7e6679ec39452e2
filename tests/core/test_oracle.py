"""Every registered query against its SQL in DuckDB, as multisets of rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from lexiflow.queries import oracle_sql, queries

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else str(v) if isinstance(v, (dict, list)) else v


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    assert got
    if name not in oracle_sql():
        return
    rel = duck.sql(oracle_sql()[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
