"""Inputs that several queries derive from the tables, in Spark and in SQL, and pieces of SQL.

``@NAME@`` in a SQL text stands for the piece of that name."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import HWS, WS
from quern.sources.tables import table

MODELS = [f"m{i}" for i in range(10)]

PIECES = {
    "WS": WS,
    "HWS": HWS,
    # each table without repeated rows
    "docs": "SELECT DISTINCT * FROM corpus_docs",
    # the questions with a number made from their id
    "questions": "SELECT DISTINCT question_id, question, answer, category, institution, city, source_url, page_title, supporting_quotes, model_used, CAST('0x' || substr(md5(question_id), 1, 7) AS BIGINT) AS n FROM question_table",
}
PIECES["answers"] = """
SELECT q.question_id, q.question, q.answer, q.category, q.city, q.source_url, q.n, 'm' || m AS model,
  CASE WHEN (n * 13 + m * 7) % 10 < 6 THEN 'See ' || coalesce(source_url, 'nothing') || '.' || chr(10) || chr(10) || 'Answer: ' || coalesce(answer, 'none')
       WHEN (n + m) % 11 = 0 THEN 'I do not have enough information.' ELSE 'Answer: ' || chr(CAST(65 + (n + m) % 8 AS INTEGER)) END AS response,
  (n * 3 + m) % 5 <> 0 AS searched, (n * 5 + m) % 4 <> 0 AS diag_correct,
  CASE WHEN (n + 2 * m) % 3 = 0 THEN 'https://other.example/x | ' || replace(coalesce(source_url, ''), 'https:', 'http:') ELSE 'https://other.example/' || m END AS cited
FROM (@questions@) q, (SELECT unnest(range(10)) AS m)
"""
PIECES["letters"] = "list_sort(list_distinct(regexp_extract_all(upper(coalesce(@x@, '')), '[A-Z]')))"
PIECES["scored"] = """
SELECT *, list_sort(list_filter(list_distinct(regexp_extract_all(upper(coalesce(answer, '')), '[A-Z]')), lambda x: list_contains(valid, x))) AS gold,
  list_sort(list_filter(list_distinct(regexp_extract_all(CASE WHEN regexp_matches(tail, '(?i)^[A-Z]( *(,|;|/|&| and ) *[A-Z])*[ .]*$') THEN regexp_replace(upper(tail), ' AND ', ',', 'g') ELSE '' END, '[A-Z]')), lambda x: list_contains(valid, x))) AS extracted
FROM (SELECT *, list_sort(list_distinct(regexp_extract_all(coalesce(question, ''), '(?m)^@WS@*([A-Z])\\.', 1))) AS valid, regexp_extract(response, 'Answer: (.*)$', 1) AS tail FROM (@answers@))
"""
#: The normal form of the address ``u``.
PIECES["url_parts"] = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^@WS@+|@WS@+$', '', 'g')"


def url_sql(x: str) -> str:
    """SQL for ``normalize_url`` of the expression ``x``."""
    u = strip_sql(x)
    part = lambda n: f"regexp_extract({u}, '@url_parts@', {n})"
    path = f"CASE WHEN {part(3)} = '/' THEN '/' ELSE regexp_replace({part(3)}, '/+(;[^/]*)?$', '\\1') END"
    head = f"CASE WHEN {part(1)} = '' THEN '' ELSE CASE WHEN lower({part(1)}) = 'http' THEN 'https' ELSE lower({part(1)}) END || ':' END"
    host = f"CASE WHEN {part(2)} = '' THEN '' ELSE '//' || regexp_replace(lower({part(2)}), '^www\\.', '') END"
    tail = f"CASE WHEN {part(4)} = '?' THEN '' ELSE {part(4)} END || CASE WHEN {part(5)} = '#' THEN '' ELSE {part(5)} END"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {u} = '' THEN '' ELSE {head} || {host} || {path} || {tail} END)"


def sql(text: str, **more: str) -> str:
    """``text`` with its pieces filled in."""
    pieces = PIECES | more
    while re.search(r"@\w+@", text):
        text = re.sub(r"@(\w+)@", lambda m: pieces[m[1]], text)
    return text.strip()


def docs(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The documents without repeated rows, which are equal in all columns: with the key and the ``columns`` that are
    wanted, so that no other is read or shuffled; all of them if none is named."""
    documents = table(spark, folder, "corpus_docs")
    return (documents.select("doc_id", *columns) if columns else documents).distinct()


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The questions without repeated rows, with a number ``n`` made from their id."""
    return table(spark, folder, "question_table").distinct().withColumn("n", F.conv(F.substring(F.md5("question_id"), 1, 7), 16, 10).cast("bigint"))


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Ten recorded answers to each question, made from its number: most right, some wrong, some refusals."""
    from quern.operators.evaluate import cross_models

    rows = cross_models(questions(spark, folder).select("question_id", "question", "answer", "category", "city", "source_url", "n"), MODELS)
    m, n = F.substring("model", 2, 2).cast("bigint"), F.col("n")
    right = F.concat(F.lit("See "), F.coalesce("source_url", F.lit("nothing")), F.lit(".\n\nAnswer: "), F.coalesce("answer", F.lit("none")))
    response = F.when((n * 13 + m * 7) % 10 < 6, right).when((n + m) % 11 == 0, "I do not have enough information.").otherwise(F.concat(F.lit("Answer: "), F.chr(65 + (n + m) % 8)))
    cited = F.when((n + 2 * m) % 3 == 0, F.concat(F.lit("https://other.example/x | "), F.replace(F.coalesce("source_url", F.lit("")), F.lit("https:"), F.lit("http:"))))
    return rows.withColumns(
        {"response": response, "searched": (n * 3 + m) % 5 != 0, "diag_correct": (n * 5 + m) % 4 != 0, "cited": cited.otherwise(F.concat(F.lit("https://other.example/"), m.cast("string")))}
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    from quern.operators.evaluate import score

    return score(answers(spark, folder), gold="answer")
