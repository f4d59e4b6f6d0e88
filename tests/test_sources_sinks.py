"""Sources, sinks, streams and plan helpers on files in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluate
from quern.operators.snapshots import snapshot_changes
from quern.plans import lineage
from quern.sinks import writers
from quern.sources import pages, recorded
from quern.streaming import ingest


def test_lists_and_configurations(spark, tmp_path):
    (tmp_path / "u.txt").write_text("# head\n\n https://a \nhttps://b\n#x\n")
    assert [r.url for r in pages.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["https://a", "https://b"]
    (tmp_path / "u.csv").write_text("city,url,suspect\nx,https://a,yes\ny,https://b,Yes\n")
    assert pages.url_csv(spark, str(tmp_path / "u.csv")).count() == 2 and [r.city for r in pages.url_csv(spark, str(tmp_path / "u.csv"), True).collect()] == ["x"]
    folder = tmp_path / "configs"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"institution": "I", "short_name": "i", "pages": [{"url": "https://a", "category": "c", "label": "l"}]}))
    (folder / "2.json").write_text(json.dumps({"country": "New Land", "layer": "State ", "institutions": [{"institution": "J", "short_name": "j", "pages": [{"url": "https://b", "cell_name": "N", "category": "c"}, {"url": "https://a", "cell_name": ""}]}]}))
    (folder / "3.json").write_text("{broken")
    found = pages.read_configs(spark, str(folder))
    assert {(r.url, r.institution, r.category, r.corpus) for r in found.collect()} == {("https://a", "I", "c", None), ("https://b", "J", "N", "new_land_state_corpus"), ("https://a", "J", "", "new_land_state_corpus")}
    meta = {r.url: r.institution for r in pages.url_metadata(spark.createDataFrame([("https://a",), ("https://z",)], "url string"), found).collect()}
    assert meta == {"https://a": "I", "https://z": ""}
    (tmp_path / "m.txt").write_text("  body \n")
    row = pages.read_manual_text(spark, str(tmp_path / "m.txt"), "https://m").first()
    assert row.full_text == "body" and json.loads(row.extra_json) == {"manual_insert": True}


def test_recorded(spark, tmp_path):
    spark.createDataFrame([("a", "<p>x</p>", None, 200), ("b", "<p>y</p>", "z", 404), ("c", "w", None, None)], "url string, html string, html_static string, status int").write.parquet(str(tmp_path / "p"))
    assert {r.url: r.html for r in recorded.fetched_pages(spark, str(tmp_path / "p")).collect()} == {"a": "<p>x</p>", "b": None, "c": None}
    (tmp_path / "c.jsonl").write_text('{"doc_id":"d","pairs":[{"question":"q"}]}\n\n{bad\n{"doc_id":"e","pairs":[]}\n')
    pairs, done = recorded.read_checkpoint(spark, str(tmp_path / "c.jsonl"))
    assert [r.doc_id for r in pairs.collect()] == ["d"] and {r.doc_id for r in done.collect()} == {"d", "e"}
    (tmp_path / "bad.json").write_text("{x")
    (tmp_path / "cache.json").write_text(json.dumps({"k": {"text": "t", "searched": True}, "old": "bare {text"}))
    assert evaluate.cache_rows(recorded.read_cache(spark, str(tmp_path / "bad.json"))).count() == 0 == evaluate.cache_rows(recorded.read_cache(spark, str(tmp_path / "none.json"))).count()
    assert {r.cache_key: r.text for r in evaluate.cache_rows(recorded.read_cache(spark, str(tmp_path / "cache.json"))).collect()} == {"k": "t", "old": "bare {text"}
    with pytest.raises(ValueError):
        recorded.read_cache(spark, str(tmp_path / "bad.json"), must_be_whole=True)
    (tmp_path / "p.yaml").write_text("# note\nsystem: |\n  You\n    are: x\nuser: >\n  Ask {q}\n")
    assert recorded.read_prompt(str(tmp_path / "p.yaml")) == ("You\n  are: x", "Ask {q}")
    assert recorded.text_completions(spark.createDataFrame([(None,)], "text string")).first()[0] == ""


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "x", "Cell 1"), ("../b.txt", None, "Cell 2"), (None, "y", "Cell 1")], "file_name string, body string, sheet string")
    assert writers.write_text_files(df, str(tmp_path / "t")).agg(F.sum("written")).first()[0] == 2
    assert {p.name: p.read_text() for p in (tmp_path / "t").iterdir()} == {"a.txt": "x", "b.txt": ""}
    writers.write_json_lines(df, str(tmp_path / "j"))
    writers.write_json_lines(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    writers.write_log(df, str(tmp_path / "l"))
    writers.write_cells(df, str(tmp_path / "c"), order=["file_name"])
    writers.write_keyed(df, str(tmp_path / "k"))
    assert sorted(p.name for p in (tmp_path / "c").iterdir() if p.is_dir()) == ["sheet=Cell 1", "sheet=Cell 2"] and spark.read.parquet(str(tmp_path / "k")).count() == 3


def test_stream_ingest_goes_on_where_it_stopped(spark, tmp_path):
    def deliver(name, rows):
        spark.createDataFrame([(i, "web", f"https://{i}", "t", "h", ts, text, "{}") for i, ts, text in rows], ingest.DOCUMENTS).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        ingest.ingest_stream(spark, str(tmp_path / "in" / "*"), str(tmp_path / "docs"), str(tmp_path / "chunks"), str(tmp_path / "state")).awaitTermination(120)
        docs, chunks = writers.read_current(spark, str(tmp_path / "docs"), ingest.DOCUMENTS), writers.read_current(spark, str(tmp_path / "chunks"), ingest.CHUNKS)
        return {r.doc_id: r.full_text for r in docs.collect()}, sorted((r.doc_id, r.text) for r in chunks.collect())

    deliver("1", [("a", "2024-01-01", "old a"), ("b", "2024-01-01", "only b")])
    assert run() == ({"a": "old a", "b": "only b"}, [("a", "old a"), ("b", "only b")])
    deliver("2", [("a", "2024-02-01", "new a"), ("a", "2024-01-15", "middle a"), ("c", "2024-02-01", "")])
    want = ({"a": "new a", "b": "only b", "c": ""}, [("a", "new a"), ("b", "only b")])
    assert run() == want and run() == want


def test_windows(spark):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "x", 1.5), (1, "2024-01-01 00:50:00", "x", 2.5), (1, "2024-01-01 01:00:00", "x", 1.0), (None, None, "x", None)], "user_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((str(r.window_start), r.n, r.total) for r in ingest.event_windows(events).collect()) == [("2024-01-01 00:00:00", 2, 4.0), ("2024-01-01 01:00:00", 1, 1.0)]
    assert sorted(r.n for r in ingest.user_sessions(events).collect()) == [1, 2]
    assert ingest.event_windows(events.limit(0)).count() == 0


def test_snapshots(spark):
    rows = [(1, "a", "H1", "2024-01-01T00:00:00Z"), (1, "a", "h2 ", "2024-01-01T02:00:00+05:00"), (1, "b", None, None), (1, "c", "x", "bad"), (1, None, "n", None), (4, "a", "h1", None), (4, "b", None, "2024-01-01T00:00:00"), (4, "d", "x", None), (None, "z", "x", None), (9, "a", "H1", None), (9, "a", "H1", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "snapshot_no int, doc_id string, content_hash string, fetch_timestamp string, change string")
    found = sorted(map(tuple, snapshot_changes(df).collect()), key=str)
    assert found == sorted([(4, "c", "removed"), (4, None, "removed"), (4, "d", "added"), (9, "b", "removed"), (9, "d", "removed")], key=str)
    assert snapshot_changes(df.limit(0)).count() == 0 == snapshot_changes(df.where("snapshot_no = 1")).count()


def test_checked_broadcast(spark):
    df = spark.range(10)
    hint = lambda x: "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hint(lineage.checked_broadcast(df, 10)) and not hint(lineage.checked_broadcast(df, 9))
    with pytest.raises(ValueError):
        lineage.checked_broadcast(df.select(F.col("id").cast("string")))
