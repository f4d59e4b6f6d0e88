"""Streams: documents that come in are chunked and upserted, events are counted in windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.chunking import chunk_documents
from quern.operators.corpus import upsert_chunks, upsert_documents
from quern.sinks.writers import read_current, replace_table

DOCUMENTS = "doc_id string, source_type string, source_uri string, title string, content_hash string, fetch_timestamp string, full_text string, extra_json string"
CHUNKS = "chunk_id string, doc_id string, idx int, text string, meta_json string"


def ingest(batch: DataFrame, documents_path: str, chunks_path: str) -> None:
    """One batch of documents into the corpus: its documents replace those of the same id, with their chunks. Writing
    the same batch twice gives the same tables."""
    spark = batch.sparkSession
    new = upsert_documents(spark.createDataFrame([], DOCUMENTS), batch, [F.col("fetch_timestamp")])
    documents = upsert_documents(read_current(spark, documents_path, DOCUMENTS), new)
    chunks = upsert_chunks(read_current(spark, chunks_path, CHUNKS), chunk_documents(new), new)
    replace_table(chunks, chunks_path)
    replace_table(documents, documents_path)


def ingest_stream(spark: SparkSession, folder: str, documents_path: str, chunks_path: str, checkpoint: str) -> StreamingQuery:
    """Reads the Parquet files that come into ``folder`` and ingests each batch; the checkpoint remembers the files
    that are done, so a restart goes on where it stopped."""
    stream = spark.readStream.schema(DOCUMENTS).parquet(folder)
    return stream.writeStream.foreachBatch(lambda df, _: ingest(df, documents_path, chunks_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total): events in windows of ``width``; on a stream, events later than ``late``
    are left out and each window is closed once. The same function serves tables."""
    watermarked = events.withWatermark("ts", late) if events.isStreaming else events
    return watermarked.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): the sessions of each user, ended by a ``gap`` without events."""
    watermarked = events.withWatermark("ts", late) if events.isStreaming else events
    sessions = watermarked.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return sessions.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
