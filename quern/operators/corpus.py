"""The corpus of documents and chunks: reading, joining, writing over, exporting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import json_field, not_blank, slugify
from quern.functions.urls import title_from_uri
from quern.plans.ordering import row_numbers

METADATA = ["doc_id", "source_type", "source_uri", "title", "content_hash", "fetch_timestamp", "extra_json"]


def list_documents(documents: DataFrame) -> DataFrame:
    """The metadata of all documents; their texts are never read."""
    return documents.select(*METADATA)


def document_metadata(documents: DataFrame, doc_id: str | Column) -> DataFrame:
    """All columns of one document; no row if it is not there."""
    return documents.where(F.col("doc_id") == doc_id)


def full_text(documents: DataFrame, doc_id: str | Column) -> DataFrame:
    return document_metadata(documents, doc_id).select("full_text")


def chunks_in_order(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("doc_id", "idx", "chunk_id")


def chunks_of(chunks: DataFrame, doc_id: str | Column) -> DataFrame:
    return chunks_in_order(chunks.where(F.col("doc_id") == doc_id))


def chunk_by_id(chunks: DataFrame, chunk_id: str | Column) -> DataFrame:
    return chunks.where(F.col("chunk_id") == chunk_id)


def chunks_by_source(chunks: DataFrame, documents: DataFrame, source_type: str) -> DataFrame:
    """The chunks of the documents of one kind of source. Documents that stand twice count once, chunks of a page
    that is gone have no source; the documents are reduced to their keys before the join."""
    wanted = documents.where(F.col("source_type") == source_type).select("doc_id")
    return chunks.join(wanted, "doc_id", "left_semi").select(*chunks.columns)


def corpus_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(documents, chunks): one row with the number of rows of both."""
    tagged = documents.select(F.lit(1).alias("d"), F.lit(0).alias("c")).unionAll(chunks.select(F.lit(0), F.lit(1)))
    return tagged.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("documents"), F.coalesce(F.sum("c"), F.lit(0)).alias("chunks"))


def union_corpora(corpora: dict[str, DataFrame]) -> DataFrame:
    """All corpora as one table with their name, in the order of the names."""
    parts = [df.withColumn("corpus", F.lit(name)) for name, df in sorted(corpora.items())]
    return reduce(DataFrame.unionByName, parts)


def filter_documents(documents: DataFrame, doc_ids: list[str] | None = None, source_type: str | None = None, url_part: str | None = None) -> DataFrame:
    """Given ids go before a kind of source; without either all documents. ``url_part`` must stand in the address."""
    if doc_ids:
        documents = documents.where(F.col("doc_id").isin(doc_ids))
    elif source_type:
        documents = documents.where(F.col("source_type") == source_type)
    return documents.where(F.col("source_uri").contains(url_part)) if url_part else documents


def upsert_documents(old: DataFrame, new: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row for each doc_id: the last of ``new`` by ``order`` where it has one, else that of ``old``. Rows without
    doc_id are left out. The last row is a partial maximum, so a key with many rows is reduced before the shuffle."""
    rank = F.struct(*(order or [F.lit(0)]), F.struct(*new.columns))
    latest = new.where("doc_id is not null").groupBy("doc_id").agg(F.max_by(F.struct(*new.columns), rank).alias("row")).select("row.*")
    kept = old.where("doc_id is not null").dropDuplicates(["doc_id"]).join(latest.select("doc_id"), "doc_id", "left_anti").select(*old.columns)
    return kept.unionByName(latest.select(*old.columns))


def upsert_chunks(old: DataFrame, new: DataFrame, written: DataFrame) -> DataFrame:
    """The chunks after the documents ``written`` came in: theirs are replaced by ``new``, all others stay. A document
    that came in without chunks loses its old ones."""
    return old.join(written.select("doc_id").distinct(), "doc_id", "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def chunk_export(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, file_name, body): each chunk as a text file with a head of its document's metadata; empty head
    lines are left out. Chunks of a document that is gone keep their own lines."""
    heads = documents.dropDuplicates(["doc_id"]).select("doc_id", "title", "source_uri", "source_type")
    joined = chunks.join(heads, "doc_id", "left")
    section = json_field(F.col("meta_json"), "section_title")

    def line(label: str, value: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))

    body = F.concat_ws(
        "\n",
        line("Title: ", F.col("title")),
        line("Source: ", F.col("source_uri")),
        line("Type: ", F.col("source_type")),
        line("Section: ", section),
        F.concat(F.lit("Chunk: "), F.col("idx").cast("string")),
        F.lit(""),
        F.coalesce("text", F.lit("")),
    )
    return joined.select("chunk_id", F.concat(F.col("doc_id"), F.lit("_"), F.format_string("%04d", "idx"), F.lit(".txt")).alias("file_name"), body.alias("body"))


def page_export(documents: DataFrame, url_part: str | None = None) -> DataFrame:
    """(doc_id, page_no, file_name): the pages in the order of their addresses with a number and a file name.
    Numbers go on over pages without text, which have no file name. Repeated rows count once."""
    pages = filter_documents(documents, url_part=url_part).select("doc_id", "source_uri", "title", F.col("full_text").isNull().alias("gone")).dropDuplicates(["doc_id"])
    numbered = row_numbers(pages, ["source_uri", "doc_id"], "page_no")
    name = slugify(F.coalesce(not_blank(F.col("title")), title_from_uri(F.col("source_uri")), F.lit("")))
    return numbered.select("doc_id", "page_no", F.when(~F.col("gone"), F.concat(F.format_string("%02d_", "page_no"), name, F.lit(".txt"))).alias("file_name"))


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row for each chunk_id."""
    return chunks.dropDuplicates(["chunk_id"])


def per_source_cap(documents: DataFrame, by: str, order: list[str], cap: int) -> DataFrame:
    """The first ``cap`` documents of each ``by``, a sampling operator; groups are cut before the shuffle."""
    return documents.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= cap).drop("_n")
