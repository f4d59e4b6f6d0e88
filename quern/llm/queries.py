"""The queries of the operators for training data, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.boilerplate import boilerplate_lines
from quern.llm.encode import token_ids
from quern.llm.leaks import leaked_items
from quern.llm.near import near_groups, near_pairs
from quern.llm.quality import text_quality
from quern.llm.repeats import repeated_lines
from quern.llm.split import split_texts
from quern.llm.templates import template_records
from quern.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_kind, item_id, boundary) of every text over the limit. White space at its ends can leave a text without
    a second piece, never without a first."""
    found = [
        split_texts(table(spark, sf_dir, name), key, text, with_text=False).where("piece_no = 0").select(F.lit(kind).alias("item_kind"), F.col(key).alias("item_id"), "boundary")
        for kind, name, key, text in (("document", "corpus_docs", "doc_id", "full_text"), ("chunk", "chunks", "chunk_id", "text"))
    ]
    return found[0].unionByName(found[1]).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(table(spark, sf_dir, "corpus_docs"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_records(table(spark, sf_dir, "corpus_docs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate_lines(table(spark, sf_dir, "corpus_docs"))


def _comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "corpus_docs").select(F.lit("document").alias("item_kind"), F.col("doc_id").alias("id"), F.col("full_text").alias("text"))
    questions = table(spark, sf_dir, "question_table").select(F.lit("question").alias("item_kind"), F.col("question_id").alias("id"), F.col("question").alias("text"))
    return documents.unionByName(questions)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(_comparable(spark, sf_dir))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_comparable(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id is unique in documents, so the rows are distinct as they are."""
    return token_ids(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id is unique in documents, so the rows are distinct as they are."""
    return text_quality(table(spark, sf_dir, "documents")).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind")


#: A text's paragraphs, then the sentences of each, then the stretches of each without white space; the first kind
#: of which none is over 2,000 characters is the boundary.
_P1 = r"""
WITH texts AS (
  SELECT DISTINCT 'document' AS item_kind, doc_id AS item_id, full_text AS t FROM corpus_docs WHERE length(full_text) > 2000
  UNION SELECT DISTINCT 'chunk', chunk_id, text FROM chunks WHERE length(text) > 2000
), paragraphs AS (
  SELECT item_kind, item_id, t, unnest(regexp_split_to_array(t, '[ \t\r]*\n([ \t\r]*\n)+[ \t\r\n]*')) AS p FROM texts
), sentences AS (
  SELECT item_kind, item_id, t, length(trim(p, E' \t\r\n')) AS n,
    list_max(list_transform(string_split(regexp_replace(trim(p, E' \t\r\n'), '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x))) AS s,
    list_max(list_transform(regexp_split_to_array(p, '[ \t\r\n]+'), lambda x: length(x))) AS w
  FROM paragraphs
), most AS (SELECT item_kind, item_id, t, max(n) AS n, max(s) AS s, max(w) AS w FROM sentences GROUP BY ALL)
SELECT DISTINCT item_kind, item_id,
  CASE WHEN n <= 2000 THEN 'paragraph' WHEN s <= 2000 THEN 'sentence' WHEN w <= 2000 THEN 'word' ELSE 'none' END AS boundary
FROM most
"""

_P2 = r"""
WITH docs AS (
  SELECT DISTINCT doc_id, full_text,
    CASE WHEN source_type = 'pdf' THEN 'pdf:' || nullif(lower(trim(CASE WHEN json_valid(extra_json) THEN json_extract_string(extra_json, '$.institution_short_name') END)), '')
    ELSE 'web:' || nullif(regexp_replace(regexp_replace(regexp_extract(lower(trim(source_uri)), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), '\.+$', ''), '^www\.', ''), '') END AS source
  FROM corpus_docs
), cut AS (
  SELECT doc_id, source, string_split(full_text, chr(10)) AS parts FROM docs WHERE full_text IS NOT NULL AND source IS NOT NULL
), lines AS (
  SELECT doc_id, source, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS line_no FROM cut
), contents AS (
  SELECT doc_id, source, line_no, trim(regexp_replace(regexp_replace(lower(raw), '[0-9]+', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS content FROM lines
), repeated AS (
  SELECT source, content FROM contents WHERE regexp_matches(content, '\p{L}') GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5
)
SELECT DISTINCT doc_id, CAST(line_no AS INTEGER) AS line_no FROM contents JOIN repeated USING (source, content)
"""

QUERIES = {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p5_found, p5_groups, p7_ids, p8_found, p9_found)}
SQL = {"p1_found": _P1, "p2_found": _P2}
