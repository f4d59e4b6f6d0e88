"""What changed between the deliveries of ``doc_snapshots``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators.snapshots import snapshot_changes
from quern.sources.tables import table


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "doc_snapshots"))


_P6 = r"""
WITH stamped AS (
  SELECT snapshot_no, doc_id, lower(trim(content_hash, E' \t\r\n')) AS hash, trim(fetch_timestamp) AS t FROM doc_snapshots
), instants AS (
  SELECT snapshot_no, doc_id, hash,
    try_cast(CASE WHEN regexp_matches(t, '(?i)T.*(Z|[+-]\d\d:?\d\d)$') THEN regexp_replace(t, '(T.*[+-]\d\d)(\d\d)$', '\1:\2') ELSE t || 'Z' END AS TIMESTAMPTZ) AS moment
  FROM stamped
), held AS (
  SELECT snapshot_no, doc_id, hash FROM instants
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, doc_id ORDER BY moment DESC NULLS LAST, hash DESC NULLS LAST) = 1
), steps AS (
  SELECT snapshot_no AS old_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS new_no FROM (SELECT DISTINCT snapshot_no FROM doc_snapshots)
), newer AS (SELECT new_no AS no, doc_id, hash FROM held JOIN steps ON snapshot_no = new_no),
older AS (SELECT new_no AS no, doc_id, hash FROM held JOIN steps ON snapshot_no = old_no WHERE new_no IS NOT NULL)
SELECT coalesce(n.no, o.no) AS snapshot_no, coalesce(n.doc_id, o.doc_id) AS doc_id,
  CASE WHEN o.no IS NULL THEN 'added' WHEN n.no IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM newer n FULL JOIN older o ON n.no = o.no AND n.doc_id = o.doc_id
WHERE o.no IS NULL OR n.no IS NULL OR n.hash IS DISTINCT FROM o.hash
"""

QUERIES = {"p6_found": p6_found}
SQL = {"p6_found": _P6}
