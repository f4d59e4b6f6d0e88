"""The pipeline over ``documents``: each stage takes what the one before has written.

A stage is (name, function of (spark, its input, the data folder)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.encode import token_ids
from quern.llm.quality import text_quality
from quern.llm.split import split_texts


def prose(spark: SparkSession, documents: DataFrame, folder: str) -> DataFrame:
    """(doc_id, text) of the documents that are prose. doc_id is unique."""
    kinds = text_quality(documents).where("kind = 'prose'").select("doc_id")
    return documents.select("doc_id", "text").join(kinds, "doc_id", "left_semi")


def pieces(spark: SparkSession, texts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, piece_no, piece): texts over the limit in pieces, the others as one piece, untouched."""
    parts = split_texts(texts, "doc_id", "text").select("doc_id", "piece_no", "piece")
    return parts.unionByName(texts.where("length(text) <= 2000").selectExpr("doc_id", "0 AS piece_no", "text AS piece"))


def ids(spark: SparkSession, parts: DataFrame, folder: str) -> DataFrame:
    """(doc_id, piece_no, ids): the token ids of every piece."""
    keyed = parts.selectExpr("struct(doc_id, piece_no) AS at", "piece")
    return token_ids(keyed, "at", "piece").select("at.doc_id", "at.piece_no", "ids")


STAGES = [("prose", prose), ("pieces", pieces), ("ids", ids)]
