"""How much of each page's text the corpus holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, EMPTY_PAGE, TOP = 0.5, 100, 50


def extraction_ratio(stored: Column, page: Column) -> Column:
    """Stored characters by those of the page; -1 where the page failed or is empty."""
    return F.when(F.coalesce(page, F.lit(0)) <= 0, F.lit(-1.0)).otherwise(F.coalesce(stored, F.lit(0)) / page)


def audited(pages: DataFrame, stored: str = "current_chars", page: str = "page_chars", threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``ratio`` and ``status``: fetch_failed (no page), yes (suspect), empty_page, no."""
    ratio = extraction_ratio(F.col(stored), F.col(page))
    status = F.when(F.col(page).isNull(), "fetch_failed").when((ratio > 0) & (ratio < threshold), "yes").when(F.col(page) < EMPTY_PAGE, "empty_page").otherwise("no")
    return pages.withColumn("ratio", ratio).withColumn("status", status)


def suspects(audits: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` worst pages, failed ones first: a report, so the limit is its feature."""
    order = [F.when(F.col("ratio") < 0, F.lit(-999.0)).otherwise(F.col("ratio")), F.col("corpus"), F.col("url")]
    return audits.where(F.col("status").isin("yes", "fetch_failed", "empty_page")).orderBy(*order).limit(top)


def audit_counts(audits: DataFrame) -> DataFrame:
    """(corpus, status, n): counts by both, by corpus, by status and in all, in one pass; null stands for all."""
    return audits.groupingSets([["corpus", "status"], ["corpus"], ["status"], []], "corpus", "status").agg(F.count(F.lit(1)).alias("n"))


def audit_total(audits: DataFrame, cap: int) -> DataFrame:
    """(total): the pages that an audit of at most ``cap`` a corpus looks at."""
    return audits.groupBy("corpus").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.least("n", F.lit(cap))), F.lit(0)).alias("total"))
