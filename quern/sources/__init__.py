"""Sources: Parquet tables, lists and configurations of pages, sheets, caches and checkpoints, recorded calls."""
