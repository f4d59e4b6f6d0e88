"""Pages: HTML made from ``corpus_docs``, configurations, audits, event streams as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import audit, html
from quern.queries.shared import docs, sql, strip_sql
from quern.sources import pages as sources
from quern.sources.tables import table
from quern.streaming.ingest import event_windows, user_sessions


def _escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _html(spark, folder):
    """An HTML page for each document: head, navigation, a cookie banner, the text as main region, footer."""
    body = _escaped(F.replace("full_text", F.lit("\r"), F.lit("")))
    page = F.concat(
        F.lit("<!doctype html><html><head><title> "), _escaped(F.coalesce("title", F.lit(""))), F.lit(" </title><script>var a = '</p>';</script></head><body><nav><a href='/'>Home</a></nav><div class='x cookie-banner'>Cookies</div><main>"),
        body, F.lit("</main><footer>Footer &copy;</footer></body></html>"),
    )
    return docs(spark, folder, "source_uri", "title", "full_text").select("doc_id", "source_uri", "title", F.col("full_text"), page.alias("html")).drop("title")


def q_title_extract(spark, folder):
    return html.page_candidates(_html(spark, folder)).select("doc_id", "title")


def q_main_text(spark, folder):
    found = F.filter("candidates", lambda c: c["strategy"] == "main_region")
    return html.page_candidates(_html(spark, folder)).select("doc_id", F.md5(F.coalesce(F.get(found, 0)["text"], F.lit("none"))).alias("text_hash"))


def q_extract_best(spark, folder):
    """The longest candidate that is no junk, of two given ones: the text, and its first half twice."""
    half = F.expr("repeat(substring(full_text, 1, int(length(full_text) / 2)), 2)")
    given = F.array(F.struct(F.lit("main_region").alias("strategy"), F.lit(3).alias("prio"), F.col("full_text").alias("text")), F.struct(F.lit("scored").alias("strategy"), F.lit(2).alias("prio"), half.alias("text")))
    best = html.best_candidate(F.when(F.col("full_text").isNotNull(), given).otherwise(F.slice(given, 1, 0)))
    return docs(spark, folder, "full_text").select("doc_id", best["strategy"].alias("strategy"), F.length(best["text"]).alias("n_chars"))


def q_fallback_ratio(spark, folder):
    chosen = html.prefer_region(F.col("title"), F.expr("substring(full_text, 1, 60)"))
    return docs(spark, folder, "title", "full_text").select("doc_id", chosen.alias("chosen"))


def q_build_documents(spark, folder):
    return html.build_documents(_html(spark, folder), "source_uri").select("doc_id", "source_uri", "title", "strategy", "status", "content_hash")


def q_strategy_counts(spark, folder):
    return html.strategy_counts(html.build_documents(_html(spark, folder), "source_uri"))


def _configs(spark, folder):
    """A configuration for each country and layer of ``institutions``, and one of the old shape for each institution
    of the country AU."""
    i = table(spark, folder, "institutions")
    page = F.struct(F.concat(F.lit("https://"), "host", F.lit("/a")).alias("url"), F.lit("c").alias("category"), F.col("short_name").alias("label"), F.lit("03").alias("cell"), F.when(F.col("layer") == "federal", "").otherwise("Order").alias("cell_name"))
    one = F.struct("institution", "short_name", F.array(page).alias("pages"))
    new = i.groupBy("country", "layer").agg(F.collect_list(one).alias("institutions")).select(F.to_json(F.struct("country", "layer", "institutions")).alias("value"))
    return new.union(i.where("country = 'AU'").select(F.to_json(one)))


def q_config_explode(spark, folder):
    return sources.config_pages(_configs(spark, folder))


def q_url_metadata(spark, folder):
    i = table(spark, folder, "institutions")
    wanted = i.select(F.concat(F.lit("https://"), "host", F.lit("/a")).alias("url")).union(i.select(F.concat(F.lit("https://"), "host", F.lit("/b"))))
    return sources.url_metadata(wanted, sources.config_pages(_configs(spark, folder)))


def q_url_list(spark, folder):
    lines = docs(spark, folder, "source_type", "source_uri").select(F.when(F.col("source_type") == "pdf", F.concat(F.lit("# "), "source_uri")).otherwise(F.concat(F.lit(" "), "source_uri", F.lit("\t"))).alias("value"))
    return sources.url_lines(lines.unionByName(lines.select(F.lit("  ").alias("value"))))


def q_manual_documents(spark, folder):
    texts = table(spark, folder, "documents").select(F.col("text").alias("value"), "doc_id")
    rows = sources.manual_documents(texts, F.concat(F.lit("manual:"), "doc_id"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", "source_uri", "title", "content_hash", "extra_json")


def _audits(spark, folder):
    """Stored characters against those of a page that is longer by a share which the id gives."""
    d = docs(spark, folder, "source_uri", "extra_json", "full_text").select("doc_id", F.col("source_uri").alias("url"), F.coalesce(F.get_json_object("extra_json", "$.country"), F.lit("none")).alias("corpus"), F.coalesce(F.length("full_text"), F.lit(0)).alias("current_chars"), F.conv(F.substring("doc_id", 1, 2), 16, 10).cast("int").alias("b"))
    page = F.when(F.col("b") < 8, F.lit(None)).when(F.col("b") < 16, 50).otherwise(F.col("current_chars") + F.col("current_chars") * F.col("b") / 100)
    return audit.audited(d.withColumn("page_chars", F.floor(page)))


def q_audit(spark, folder):
    return _audits(spark, folder).select("doc_id", "status", F.round("ratio", 6).alias("ratio"))


def q_audit_suspects(spark, folder):
    return audit.suspects(_audits(spark, folder)).select("corpus", "url", "status")


def q_audit_counts(spark, folder):
    return audit.audit_counts(_audits(spark, folder))


def q_audit_total(spark, folder):
    return audit.audit_total(_audits(spark, folder), 100)


def q_event_windows(spark, folder):
    rows = event_windows(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def q_user_sessions(spark, folder):
    rows = user_sessions(table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


_CLEAN = "replace(full_text, chr(13), '')"
_TIDY = strip_sql(f"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '\\t+', ' ', 'g'), ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_JUNK = "(len(list_filter(regexp_split_to_array({0}, '@WS@+'), lambda x: x <> '')) < 30 OR regexp_matches(lower({0}), 'think you were a bot|pardon our interruption|please enable javascript|access to this page has been denied|request unsuccessful\\. incapsula|checking your browser before accessing'))"
_CONFIG_PAGES = """
SELECT 'https://' || host || '/a' AS url, institution, short_name, CASE WHEN layer = 'federal' THEN 'c' ELSE 'Order' END AS category, short_name AS label, '03' AS cell, country, layer, lower(country) || '_' || lower(layer) || '_corpus' AS corpus FROM institutions
UNION ALL SELECT 'https://' || host || '/a', institution, short_name, CASE WHEN layer = 'federal' THEN 'c' ELSE 'Order' END, short_name, '03', NULL, NULL, NULL FROM institutions WHERE country = 'AU'"""
_AUDIT = """
SELECT doc_id, url, corpus, CASE WHEN p IS NULL OR p <= 0 THEN -1.0 ELSE current_chars / p END AS ratio,
  CASE WHEN p IS NULL THEN 'fetch_failed' WHEN p > 0 AND current_chars > 0 AND current_chars / p < 0.5 THEN 'yes' WHEN p < 100 THEN 'empty_page' ELSE 'no' END AS status
FROM (SELECT *, CASE WHEN b < 8 THEN NULL WHEN b < 16 THEN 50 ELSE floor(current_chars + current_chars * b / 100) END AS p FROM (
  SELECT doc_id, source_uri AS url, coalesce(CASE WHEN json_valid(extra_json) THEN json_extract_string(extra_json, '$.country') END, 'none') AS corpus, coalesce(length(full_text), 0) AS current_chars, CAST('0x' || substr(doc_id, 1, 2) AS INTEGER) AS b FROM (@docs@)))"""

SQL = {
    "q_title_extract": sql("SELECT doc_id, CASE WHEN full_text IS NULL THEN '' ELSE " + strip_sql("regexp_extract(" + strip_sql("coalesce(title, '')") + ", '^(?s)(.*?)(?:\\s*[|\\-–—]\\s*(?s:.*))?$', 1)") + " END AS title FROM (@docs@)"),
    "q_main_text": sql(f"SELECT doc_id, md5(coalesce(nullif({_TIDY}, ''), 'none')) AS text_hash FROM (@docs@)"),
    "q_extract_best": sql(f"""
        SELECT doc_id, CASE WHEN a THEN 'main_region' WHEN b THEN 'scored' ELSE 'none' END AS strategy, CASE WHEN a THEN length(full_text) WHEN b THEN length(h) ELSE 0 END AS n_chars
        FROM (SELECT *, ga AND (NOT gb OR length(full_text) > length(h)) AS a, gb AND (NOT ga OR length(h) >= length(full_text)) AS b
          FROM (SELECT *, coalesce(NOT {_JUNK.format('full_text')}, false) AS ga, coalesce(NOT {_JUNK.format('h')}, false) AS gb FROM (SELECT *, repeat(substr(full_text, 1, CAST(length(full_text) // 2 AS BIGINT)), 2) AS h FROM (@docs@))))"""),
    "q_fallback_ratio": sql("SELECT doc_id, CASE WHEN coalesce(length(title), 0) < 0.4 * coalesce(length(substr(full_text, 1, 60)), 0) THEN substr(full_text, 1, 60) ELSE title END AS chosen FROM (@docs@)"),
    "q_config_explode": sql("@c@", c=_CONFIG_PAGES),
    "q_url_metadata": sql("""
        WITH first AS (SELECT url, institution, short_name, category, label, coalesce(corpus, '') AS corpus FROM (@c@) QUALIFY row_number() OVER (PARTITION BY url ORDER BY coalesce(corpus, ''), institution, short_name, category, label) = 1),
        wanted AS (SELECT 'https://' || host || '/a' AS url FROM institutions UNION ALL SELECT 'https://' || host || '/b' FROM institutions)
        SELECT url, coalesce(institution, '') AS institution, coalesce(short_name, '') AS short_name, coalesce(category, '') AS category, coalesce(label, '') AS label, coalesce(corpus, '') AS corpus FROM wanted LEFT JOIN first USING (url)""", c=_CONFIG_PAGES),
    "q_url_list": sql(f"SELECT {strip_sql('source_uri')} AS url FROM (@docs@) WHERE source_type <> 'pdf'"),
    "q_manual_documents": sql(f"""
        SELECT substr(sha256('manual:' || doc_id), 1, 16) AS doc_id, 'manual:' || doc_id AS source_uri, CAST(doc_id AS VARCHAR) AS title, sha256(t) AS content_hash, '{{"manual_insert":true}}' AS extra_json
        FROM (SELECT doc_id, {strip_sql('text')} AS t FROM documents) WHERE t <> ''"""),
    "q_audit": sql("SELECT doc_id, status, CAST(round(ratio, 6) AS DOUBLE) AS ratio FROM (@a@)", a=_AUDIT),
    "q_audit_suspects": sql("SELECT corpus, url, status FROM (@a@) WHERE status <> 'no' ORDER BY CASE WHEN ratio < 0 THEN -999 ELSE ratio END, corpus, url LIMIT 50", a=_AUDIT),
    "q_audit_counts": sql("SELECT corpus, status, count(*) AS n FROM (@a@) GROUP BY GROUPING SETS ((corpus, status), (corpus), (status), ())", a=_AUDIT),
    "q_audit_total": sql("SELECT CAST(sum(least(n, 100)) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM (@a@) GROUP BY corpus)", a=_AUDIT),
    "q_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, CAST(round(sum(value), 2) AS DOUBLE) AS total FROM events GROUP BY ALL",
    "q_user_sessions": """
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n FROM (
          SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s""",
}
QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
