"""Identities made from content, so that the same input always has the same key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doc_id(uri: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the address."""
    return F.substring(F.sha2(uri, 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(doc: Column, index: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat(doc, F.lit("::"), index.cast("string"), F.lit("::"), text), 256), 1, 16)


def request_key(*parts: Column | str) -> Column:
    """The key of a recorded call: its parts joined by bars, null as empty."""
    return F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))
