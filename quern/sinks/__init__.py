"""Sinks: JSON lines, tab-separated logs, one text file a row, tables parted by cell, upserted Parquet tables."""
