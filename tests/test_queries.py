"""Every registered query that has SQL gives the same rows as DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, (bool, int, float)) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in want.fetchall())
    assert a == b


def test_every_query_is_registered_once():
    names = list(entry.queries())
    assert len(names) == len(set(names)) and set(ORACLE) <= set(names)


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["cond", "country", "side", "n", "accuracy"]
    assert frame.count() > 0
