"""The registered queries of the training-data operators: columns, SQL, and the pipeline."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entries
from quern.llm import pipeline
from quern.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("QUERN_DATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": "item_kind string, item_id string, boundary string",
    "p2_found": "doc_id string, line_no int",
    "p3_found": "doc_id string",
    "p4_found": "doc_id string, line_no int",
    "p5_found": "item_kind string, id_a string, id_b string",
    "p7_ids": "doc_id bigint, ids array<int>",
    "p8_found": "doc_id bigint, item_id bigint",
    "p9_found": "doc_id bigint, kind string",
}


def by_sql(sql, folder=FOLDER):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con.execute(sql).fetchall()


def test_added_to_the_entry():
    assert QUERIES.keys() <= entries.queries().keys() and SQL.keys() <= entries.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_distinct_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    rows = [tuple(r) for r in QUERIES[name](spark, FOLDER).collect()]
    assert sorted(rows) == sorted(by_sql(SQL[name]))


def test_every_document_gets_ids(spark):
    rows = {r.doc_id: r.ids for r in QUERIES["p7_ids"](spark, FOLDER).collect()}
    texts = dict(by_sql("SELECT doc_id, text FROM documents"))
    assert rows.keys() == texts.keys()
    assert all((rows[k] is None) == (t is None) and (rows[k] == []) == (t == "") for k, t in texts.items())


def test_pipeline_keeps_every_prose_document(spark, tmp_path):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = []
    for name, f in pipeline.STAGES:
        f(spark, df, FOLDER).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        kept.append(df.select("doc_id").distinct().count())
    assert kept[0] == kept[1] == kept[2] > 0
