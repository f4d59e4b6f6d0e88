"""Structured Streaming: incremental ingest of documents, windowed counts of events."""
