"""Every registered query against its SQL over a small data folder; those without SQL must give rows."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from quern.queries import registered

FOLDER = os.environ.get("QUERN_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = registered()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    found = rows_of([tuple(r) for r in df.collect()], df.columns)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    wanted = rows_of(result.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert len(found) == len(wanted)
    assert [(a, b) for a, b in zip(found, wanted) if a != b][:2] == []


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert SQL.keys() <= QUERIES.keys()
