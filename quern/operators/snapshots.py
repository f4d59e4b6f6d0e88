"""What changed between full snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def instant(ts: Column) -> Column:
    """ISO-8601 text as an instant; a time without offset is UTC; null and unreadable texts give null."""
    t = F.trim(ts)
    t = F.regexp_replace(t, r"(T.*[+-]\d\d)(\d\d)$", "$1:$2")
    return F.when(t.rlike(r"(?i)T.*(Z|[+-]\d\d:\d\d)$"), t).otherwise(F.concat(t, F.lit("Z"))).try_cast("timestamp")


def canonical_hash(h: Column) -> Column:
    """Hash texts compared without case and outer white space; null stays null."""
    return F.lower(F.regexp_replace(h, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))


def latest_rows(snapshots: DataFrame, no: str, key: str, value: str, ts: str) -> DataFrame:
    """(no, key, value): for each snapshot and key the value of the row with the latest instant.

    A null or unreadable time is the earliest. Of rows with the same instant the one with the greatest hash holds
    (null is the least), so the result never depends on the order of the rows. The maximum is taken before the
    shuffle already, so a key that holds a great part of the rows costs its shuffle one row a task. Rows without
    snapshot number are in no snapshot and give nothing; a null key is a key like any other."""
    return (
        snapshots.where(F.col(no).isNotNull())
        .select(F.col(no).alias("no"), F.col(key).alias("key"), F.struct(instant(F.col(ts)).alias("t"), canonical_hash(F.col(value)).alias("value")).alias("row"))
        .groupBy("no", "key")
        .agg(F.max("row").alias("row"))
        .select("no", "key", F.col("row.value").alias("value"))
    )


def snapshot_changes(snapshots: DataFrame, no: str = "snapshot_no", key: str = "doc_id", value: str = "content_hash", ts: str = "fetch_timestamp") -> DataFrame:
    """(no, key, change): for each snapshot but the first, the keys ``added``, ``removed`` or ``changed`` since the
    snapshot with the next lower number that exists.

    EXCEPT ALL both ways drops the rows that both snapshots share; what is left, a small part of a delivery, is full
    joined by key. Each row stands once as the newer side under its own number and once as the older side under the
    number of its successor, so all pairs of snapshots are compared in one pass. The successors come from one scalar
    subquery, the sorted distinct numbers (one number a delivery, formed in parts before the shuffle), so no join is
    on the snapshot number alone. An empty table and a single snapshot give no rows; null equals null and differs
    from every hash; extra columns are never read."""
    rows = latest_rows(snapshots, no, key, value, ts)
    known = snapshots.select(F.array_sort(F.collect_set(no))).scalar()
    at = F.array_position(known, F.col("no")).cast("int")
    newer = rows.where(at > 1).select("no", "key", "value")
    older = rows.where(at < F.size(known)).select(F.element_at(known, at + 1).alias("no"), "key", "value")
    gained = newer.exceptAll(older).select("no", "key", F.lit(1).alias("new"))
    lost = older.exceptAll(newer).select("no", "key", F.lit(1).alias("old"))
    n, o = gained.alias("n"), lost.alias("o")
    joined = n.join(o, (F.col("n.no") == F.col("o.no")) & F.col("n.key").eqNullSafe(F.col("o.key")), "full")
    change = F.when(F.col("o.old").isNull(), "added").when(F.col("n.new").isNull(), "removed").otherwise("changed")
    return joined.select(F.coalesce("n.no", "o.no").alias(no), F.coalesce("n.key", "o.key").alias(key), change.alias("change"))
