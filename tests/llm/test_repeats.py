"""p2_found and the sequences that it comes from."""

import pyarrow as pa
from pyspark.sql import functions as F

from quern.llm.repeats import frequent_sequences, line_contents, repeated_lines, without_lines

SCHEMA = "doc_id string, full_text string, source string, line_no int"


def test_contents():
    assert line_contents(pa.array(["  © 2024 – Town of  X! ", "12-34", "", "ÉTÉ\r", "a1b22"])).to_pylist() == ["0 town of x", "", "", "été", "a0b0"]


def test_rows_and_texts(spark):
    rows = [(f"d{k}", f"Own {chr(97 + k)} text\nShare this\n\n© {2000 + k} Town", "s", k) for k in range(5)] + [("e", "Share this", "other", 1), ("f", None, "s", 2), ("g", "", "s", 3), ("h", "Share this", None, 4), (None, "Share this", "s", 5)]
    df = spark.createDataFrame(rows + rows[:1], SCHEMA)
    found = repeated_lines(df, source=F.col("source"))
    assert sorted(map(tuple, found.collect())) == sorted((f"d{k}", n) for k in range(5) for n in (2, 4))
    clean = {r.doc_id: r.clean_text for r in without_lines(df, found).collect()}
    assert clean["d0"] == "Own a text\n" and clean["e"] == "Share this" and clean["f"] is None and clean["g"] == "" and clean[None] == "Share this"
    assert repeated_lines(df.limit(0), source=F.col("source")).count() == 0
    four = df.where("doc_id != 'd4'")
    assert repeated_lines(four, source=F.col("source")).count() == 0


def test_sequences_with_gaps_of_any_length(spark):
    """alpha ... omega stand in six documents with other repeated lines between; a template of six lines in seven."""
    fill = ["one", "two", "three", "four", "five", "six"]
    rows = [(f"a{k}", "\n".join(["alpha", fill[k], fill[(k + 1) % 6], fill[(k + 3) % 6], "omega"]), "s", 0) for k in range(6)]
    rows += [(f"b{k}", f"head\nown {chr(97 + k)}\nmenu\nlogin\nown {chr(104 + k)}\nprint\nlegal\nfoot", "t", 0) for k in range(7)]
    found = [(len(r.lines), r.documents) for r in frequent_sequences(spark.createDataFrame(rows, SCHEMA), source=F.col("source"), least=5).collect()]
    assert sorted(found) == [(2, 6), (6, 7)]


def test_no_sequences(spark):
    df = spark.createDataFrame([("a", "x\ny", "s", 0)], SCHEMA)
    assert frequent_sequences(df, source=F.col("source")).count() == 0
