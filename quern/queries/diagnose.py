"""Diagnosis: source lookup, attribution, samples, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import diagnose
from quern.queries.shared import answers, docs, questions, scored, sql, url_sql
from quern.sources.tables import table


def _corpora(spark, folder):
    """The corpus parted by country of its institutions' metadata, with the scan order of the address."""
    d = docs(spark, folder, "source_uri", "full_text", "extra_json")
    return d.select("source_uri", "full_text", F.lower(F.coalesce(F.get_json_object("extra_json", "$.institution_short_name"), F.lit("none"))).alias("corpus"), F.col("doc_id").alias("seq"))


def q_source_lookup(spark, folder):
    found = diagnose.source_lookup(questions(spark, folder), _corpora(spark, folder))
    return found.select("question_id", F.md5(F.coalesce("source_text", F.lit("none"))).alias("text_hash"))


def _diagnosed(spark, folder):
    wrong = scored(spark, folder).where("not correct")
    reason = diagnose.skip_reason(F.col("source_url"), F.col("question"))
    mode = diagnose.failure_mode(F.col("searched"), diagnose.cites(F.col("cited"), F.col("source_url")), F.col("diag_correct"))
    return wrong.withColumn("failure_mode", F.when(reason.isNotNull(), "skipped_no_source").otherwise(mode))


def q_failure_modes(spark, folder):
    return _diagnosed(spark, folder).select("question_id", "model", "failure_mode")


def q_failure_matrix(spark, folder):
    return diagnose.failure_matrix(_diagnosed(spark, folder))


def q_diag_summary(spark, folder):
    return diagnose.metric_summary(_diagnosed(spark, folder))


def q_skip_log(spark, folder):
    return diagnose.skip_log(answers(spark, folder), "source_url", "answer")


def q_eligible(spark, folder):
    return diagnose.eligible(answers(spark, folder), "source_url", "answer").select("question_id", "model")


def _done(spark, folder):
    return _diagnosed(spark, folder).where("n % 4 = 1").select("question_id", "model", "failure_mode", "diag_correct")


def q_exclude_existing(spark, folder):
    tasks = scored(spark, folder).where("not correct").select("question_id", "model", "category")
    return diagnose.exclude_existing(tasks, _done(spark, folder), ["question_id", "model"])


def q_append_refresh(spark, folder):
    new = _diagnosed(spark, folder).where("n % 4 = 2").select("question_id", "model", "failure_mode", "diag_correct", "category")
    return diagnose.append_results(_done(spark, folder), new)[1]


def q_bucket_counts(spark, folder):
    return diagnose.bucket_counts(_diagnosed(spark, folder), ["model", "category"])


def q_pool_counters(spark, folder):
    rows = scored(spark, folder).withColumn("correct", F.col("correct").cast("int")).withColumnRenamed("city", "jurisdiction").where("jurisdiction is not null").withColumn("question_id", F.concat_ws("|", "model", "question_id"))
    return diagnose.pool_counters(rows, rows.where("n % 4 = 1"))


def _failed(spark, folder):
    return _diagnosed(spark, folder).select("model", "category", F.concat_ws("|", "model", "question_id").alias("key"))


def q_cap_sample(spark, folder):
    return diagnose.cap_per_bucket(_failed(spark, folder), ["model", "category"], "key", 5)


def q_even_sample(spark, folder):
    return diagnose.even_sample(_failed(spark, folder), ["model", "category"], "key")


def q_round_robin(spark, folder):
    return diagnose.round_robin_sample(_failed(spark, folder).where("category is not null"), ["model", "category"], "key")


def q_failed_rows(spark, folder):
    events = table(spark, folder, "events").withColumn("correct", F.when(F.col("event_id") % 3 == 0, F.lit("0")).when(F.col("event_id") % 3 == 1, F.get_json_object("props", "$.k")))
    return diagnose.failed_rows(events).select("event_id")


def q_known_models(spark, folder):
    return answers(spark, folder).where(F.col("model").isin("m1", "m3", "nobody")).select("question_id", "model")


def q_diagnostic_rows(spark, folder):
    rows = diagnose.diagnostic_rows(_diagnosed(spark, folder))
    return rows.select("question_id", "model", F.coalesce("source_url", F.lit("")).alias("source_url"), "category", "city", F.md5("response").alias("response_hash"), F.col("diag_correct").cast("int").alias("diag_correct"), F.col("searched").cast("int").alias("searched"), "failure_mode", "n_cited")


def q_per_model_columns(spark, folder):
    return diagnose.per_model_columns(_diagnosed(spark, folder).select("question_id", "model", "category", "failure_mode"), "m3")


_DIAGNOSED = f"""
SELECT *, CASE WHEN trim(coalesce(source_url, '')) = '' THEN 'skipped_no_source' WHEN NOT diag_correct THEN 'comprehension' WHEN NOT searched THEN 'search_bypass'
  WHEN (n + 2 * CAST(model[2:] AS INTEGER)) % 3 = 0 AND source_url <> '' THEN 'grounding' ELSE 'retrieval' END AS failure_mode
FROM (@scored@) WHERE extracted <> gold"""
_MODES = ("search_bypass", "retrieval", "grounding", "comprehension", "skipped_no_source")
_METRICS = "SELECT unnest(['total_diagnosed', 'diagnostic_correct', 'failure_mode=search_bypass', 'failure_mode=retrieval', 'failure_mode=grounding', 'failure_mode=comprehension', 'failure_mode=api_error']) AS metric, unnest([count(*), count(*) FILTER (diag_correct), count(*) FILTER (failure_mode = 'search_bypass'), count(*) FILTER (failure_mode = 'retrieval'), count(*) FILTER (failure_mode = 'grounding'), count(*) FILTER (failure_mode = 'comprehension'), 0]) AS count FROM"
_CAP = "SELECT model, category, key FROM (SELECT model, category, model || '|' || question_id AS key FROM (@d@)) QUALIFY row_number() OVER (PARTITION BY model, category ORDER BY md5('42|' || key), key) <= 5"
_ROUND = "SELECT model, category, key FROM (SELECT *, row_number() OVER (PARTITION BY model, category ORDER BY md5('42|' || key), key) AS r FROM (SELECT model, category, model || '|' || question_id AS key FROM (@d@) WHERE category IS NOT NULL)) ORDER BY r, model, category LIMIT 100"

SQL = {
    "q_source_lookup": sql(f"""
        WITH asked AS (SELECT question_id, {url_sql('source_url')} AS u, lower(coalesce(city, '')) AS c FROM (@questions@)),
        pages AS (SELECT {url_sql('source_uri')} AS u, lower(coalesce(CASE WHEN json_valid(extra_json) THEN json_extract_string(extra_json, '$.institution_short_name') END, 'none')) AS corpus, doc_id, full_text FROM (@docs@) WHERE full_text IS NOT NULL),
        found AS (SELECT question_id, full_text FROM asked JOIN pages USING (u) WHERE u <> '' QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY corpus <> c, corpus, doc_id, full_text) = 1)
        SELECT question_id, md5(coalesce(full_text, 'none')) AS text_hash FROM asked LEFT JOIN found USING (question_id)"""),
    "q_failure_modes": sql("SELECT question_id, model, failure_mode FROM (@d@)", d=_DIAGNOSED),
    "q_failure_matrix": sql("SELECT model, " + ", ".join(f"count(*) FILTER (failure_mode = '{m}') AS {m}" for m in _MODES) + ", count(*) AS total FROM (@d@) GROUP BY model", d=_DIAGNOSED),
    "q_diag_summary": sql(f"{_METRICS} (@d@)", d=_DIAGNOSED),
    "q_skip_log": sql("SELECT question_id, model, coalesce(source_url, '') AS url, CASE WHEN trim(coalesce(source_url, '')) = '' THEN 'no_source_url' ELSE 'no_source_text' END AS reason FROM (@answers@) WHERE trim(coalesce(source_url, '')) = '' OR coalesce(answer, '') = ''"),
    "q_eligible": sql("SELECT question_id, model FROM (@answers@) WHERE trim(coalesce(source_url, '')) <> '' AND coalesce(answer, '') <> ''"),
    "q_exclude_existing": sql("SELECT question_id, model, category FROM (@d@) WHERE n % 4 <> 1", d=_DIAGNOSED),
    "q_append_refresh": sql(f"{_METRICS} (SELECT * FROM (@d@) WHERE n % 4 IN (1, 2))", d=_DIAGNOSED),
    "q_bucket_counts": sql("SELECT model, category, count(*) AS n FROM (@d@) GROUP BY ALL", d=_DIAGNOSED),
    "q_pool_counters": sql("SELECT city AS jurisdiction, count(*) AS wrong, count(*) FILTER (n % 4 = 1) AS already_done, count(*) FILTER (n % 4 <> 1) AS kept FROM (@d@) WHERE city IS NOT NULL GROUP BY city", d=_DIAGNOSED),
    "q_cap_sample": sql(_CAP, d=_DIAGNOSED),
    "q_round_robin": sql(_ROUND, d=_DIAGNOSED),
    "q_failed_rows": "SELECT event_id FROM events WHERE event_id % 3 = 0 OR (event_id % 3 = 1 AND json_extract_string(props, '$.k') = '0')",
    "q_diagnostic_rows": sql("SELECT question_id, model, coalesce(source_url, '') AS source_url, category, city, md5(response) AS response_hash, CAST(diag_correct AS INTEGER) AS diag_correct, CAST(searched AS INTEGER) AS searched, failure_mode, CASE WHEN (n + 2 * CAST(model[2:] AS INTEGER)) % 3 = 0 AND coalesce(source_url, '') <> '' THEN 2 ELSE 1 END AS n_cited FROM (@d@)", d=_DIAGNOSED),
    "q_per_model_columns": sql("SELECT question_id, category, failure_mode AS failure_mode_m3 FROM (@d@) WHERE model = 'm3'", d=_DIAGNOSED),
    "q_known_models": sql("SELECT question_id, model FROM (@answers@) WHERE model IN ('m1', 'm3')"),
}
QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
