"""Evaluation: labels, scores, caches, search traces, over answers derived from ``question_table`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import labels, urls
from quern.functions.identity import request_key
from quern.functions.text import pipe_join
from quern.operators import evaluate
from quern.queries.shared import MODELS, answers, questions, scored, sql
from quern.sources.tables import table


def q_labels_gold(spark, folder):
    valid = labels.valid_labels(F.col("question"))
    return questions(spark, folder).select("question_id", F.array_join(valid, ",").alias("valid"), F.array_join(labels.gold_labels(F.col("answer"), valid), ",").alias("gold"))


def q_score_mc(spark, folder):
    return scored(spark, folder).select("question_id", "model", F.array_join("gold", ",").alias("gold"), F.array_join("extracted", ",").alias("extracted"), F.col("correct").cast("int").alias("correct"))


def q_accuracy_summary(spark, folder):
    return evaluate.accuracy_summary(scored(spark, folder))


def q_pct_models_correct(spark, folder):
    return evaluate.share_correct(scored(spark, folder), len(MODELS))


def q_results_wide(spark, folder):
    return evaluate.results_wide(scored(spark, folder), MODELS)


def q_unpivot_models(spark, folder):
    return evaluate.unpivot_models(evaluate.results_wide(scored(spark, folder), MODELS), [*MODELS, "unknown"], ["extracted", "correct"], ["question_id"])


def q_column_subset(spark, folder):
    return evaluate.column_subset(questions(spark, folder), ["question_id", "city", "not_there", "category"])


def _keyed(spark, folder):
    tasks = answers(spark, folder).withColumn("cache_key", request_key(F.col("model"), F.col("question_id"), "v1"))
    cache = tasks.where("n % 3 = 0").select("cache_key", F.col("response").alias("text"))
    return evaluate.probe_cache(tasks.select("cache_key", "question_id", "model"), cache)


def q_cache_hits(spark, folder):
    return _keyed(spark, folder)[0]


def q_cache_misses(spark, folder):
    return _keyed(spark, folder)[1]


def q_cache_scan(spark, folder):
    """A cache file of the answers of each model, one JSON object, half of its entries in the old form."""
    a = answers(spark, folder).groupBy("question_id", "response").agg(F.first("n").alias("n"), F.first("searched").alias("s")).where("response is not null")
    entry = F.when(F.col("n") % 2 == 0, F.to_json(F.struct(F.col("response").alias("text"), F.lit(True).alias("searched"), F.lit(2).alias("search_count")))).otherwise(F.col("response"))
    files = a.groupBy("question_id", "response").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.md5(F.concat("question_id", "response")), entry)))).alias("value"))
    return evaluate.cache_rows(files).select("cache_key", "text", F.col("searched").cast("int").alias("searched"), "search_count")


def q_cited_urls(spark, folder):
    found = urls.cited_urls(F.concat_ws(" ", F.lit("(see"), "source_url", F.lit("), also"), "source_url", F.lit("and http://a.example/x]; HTTPS://B.example/y?z=1.")))
    return questions(spark, folder).select("question_id", pipe_join(found).alias("urls"), F.size(found).alias("n"))


def q_retry_on_empty(spark, folder):
    """Second attempts of the answers whose first has no letters: every other one says A."""
    first = scored(spark, folder).select("question_id", "model", F.lit(1).alias("attempt"), "extracted", "n")
    second = first.where(F.size("extracted") == 0).withColumn("attempt", F.lit(2)).withColumn("extracted", F.when(F.col("n") % 2 == 0, F.array(F.lit("A"))).otherwise(F.col("extracted")))
    chosen = evaluate.retry_resolved(first.unionByName(second), ["question_id", "model"])
    return chosen.select("question_id", "model", "attempt", F.array_join("extracted", ",").alias("extracted"))


def _trace(spark, folder):
    """Events as search hits: the user is the question, the day of the user's first three days the round."""
    from pyspark.sql import Window

    days = table(spark, folder, "events").withColumn("round", F.dense_rank().over(Window.partitionBy("user_id").orderBy(F.to_date("ts"))))
    return days.where("round <= 3").select("user_id", "round", "ts", "event_id", F.concat(F.lit("https://ex.org/"), F.col("event_id") % 23).alias("url"), "value")


def q_url_budget(spark, folder):
    return evaluate.within_budget(_trace(spark, folder), ["user_id"], ["ts", "event_id"]).select("user_id", "url_no", "url", "event_id")


def q_tool_result(spark, folder):
    shown = evaluate.within_budget(_trace(spark, folder), ["user_id"], ["round", "ts", "event_id"]).withColumn("text", F.concat(F.lit("hit "), "event_id"))
    return evaluate.tool_result(shown, ["user_id"])


def q_token_totals(spark, folder):
    v = F.col("value").cast("int")
    turns = _trace(spark, folder).select("user_id", "round", v.alias("prompt_tokens"), (v % 7).alias("completion_tokens"), F.lit(0).alias("reasoning_tokens"))
    return evaluate.token_totals(turns, ["user_id"]).withColumn("searched", F.col("searched").cast("int"))


def _turns(spark, folder):
    """Recorded assistant turns made from events: a tool call each, some unreadable, some of another tool."""
    arguments = F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("q"), F.col("event_id") % 50).alias("query"))))
    name = F.when(F.col("event_id") % 5 == 0, "other_tool").otherwise("web_search")
    call = F.struct(F.col("event_id").cast("string").alias("id"), F.struct(name.alias("name"), arguments.alias("arguments")).alias("function"))
    return _trace(spark, folder).select("user_id", "round", "event_id", F.to_json(F.struct(F.lit("").alias("content"), F.array(call).alias("tool_calls"))).alias("message"))


def q_tool_calls(spark, folder):
    return evaluate.tool_calls(_turns(spark, folder))


def q_agentic_trace(spark, folder):
    """Each query has seven recorded results, of which one has no address."""
    results = spark.range(50).select(F.concat(F.lit("q"), "id").alias("query"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("rank"), F.col("id"))
    results = results.select("query", "rank", F.when(F.col("rank") != 3, F.concat(F.lit("https://ex.org/"), (F.col("id") * 3 + F.col("rank")) % 90)).otherwise("").alias("url"), F.lit("t").alias("text"))
    turns = _turns(spark, folder).groupBy("user_id", "round").agg(F.max_by("message", "event_id").alias("message"))
    return evaluate.agentic_trace(turns, results, ["user_id"])


def q_agent_annotations(spark, folder):
    kind = F.when(F.col("n") % 4 == 0, "file").otherwise("url_citation")
    notes = F.to_json(F.array(F.struct(kind.alias("type"), F.struct(F.col("source_url").alias("url")).alias("url_citation")), F.struct(F.lit("url_citation").alias("type"), F.struct(F.lit("").alias("url")).alias("url_citation"))))
    rows = questions(spark, folder).select("question_id", F.when(F.col("n") % 5 == 0, "broken").otherwise(notes).alias("annotations"), (F.col("n") % 2).alias("search_count"))
    return evaluate.annotated_citations(rows).withColumn("searched", F.col("searched").cast("int"))


_TRACE = "SELECT user_id, round, ts, event_id, 'https://ex.org/' || (event_id % 23) AS url, value FROM (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS round FROM events) WHERE round <= 3"
_BUDGET = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY @o@) AS url_no FROM (SELECT * FROM (@trace@) QUALIFY row_number() OVER (PARTITION BY user_id, url ORDER BY @o@) = 1)) WHERE url_no <= 10"
_WIDE = ", ".join(f"coalesce(max(response) FILTER (model = '{m}'), '') AS response_{m}, coalesce(max(array_to_string(extracted, ', ')) FILTER (model = '{m}'), '') AS extracted_{m}, coalesce(max(CAST(extracted = gold AS INTEGER)) FILTER (model = '{m}'), 0) AS correct_{m}" for m in MODELS)
_PCT = "CAST(round_even(CAST(count(*) FILTER (extracted = gold) AS DOUBLE) * 100 / @d@, 1) AS DOUBLE)"

SQL = {
    "q_labels_gold": sql("SELECT question_id, array_to_string(valid, ',') AS valid, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(upper(coalesce(answer, '')), '[A-Z]')), lambda x: list_contains(valid, x))), ',') AS gold FROM (SELECT *, list_sort(list_distinct(regexp_extract_all(coalesce(question, ''), '(?m)^@WS@*([A-Z])\\.', 1))) AS valid FROM (@questions@))"),
    "q_score_mc": sql("SELECT question_id, model, array_to_string(gold, ',') AS gold, array_to_string(extracted, ',') AS extracted, CAST(extracted = gold AS INTEGER) AS correct FROM (@scored@)"),
    "q_accuracy_summary": sql(f"SELECT model, count(*) AS total_count, {_PCT} AS accuracy FROM (@scored@) GROUP BY model", d="count(*)"),
    "q_pct_models_correct": sql(f"SELECT question_id, {_PCT} AS pct_of_models_correct FROM (@scored@) GROUP BY question_id", d="10"),
    "q_results_wide": sql(f"SELECT question_id, {_WIDE}, {_PCT} AS pct_of_models_correct FROM (@scored@) GROUP BY question_id", d="10"),
    "q_unpivot_models": sql("SELECT question_id, model, array_to_string(extracted, ', ') AS extracted, CAST(extracted = gold AS INTEGER) AS correct FROM (@scored@)"),
    "q_column_subset": sql("SELECT question_id, city, category FROM (@questions@)"),
    "q_cache_hits": sql("SELECT model || '|' || question_id || '|v1' AS cache_key, question_id, model, response AS text FROM (@answers@) WHERE n % 3 = 0"),
    "q_cache_misses": sql("SELECT model || '|' || question_id || '|v1' AS cache_key, question_id, model FROM (@answers@) WHERE n % 3 <> 0"),
    "q_cache_scan": sql("SELECT DISTINCT md5(question_id || response) AS cache_key, response AS text, CASE WHEN n % 2 = 0 THEN 1 END AS searched, CASE WHEN n % 2 = 0 THEN 2 END AS search_count FROM (@answers@)"),
    "q_cited_urls": sql("SELECT question_id, concat_ws(' | ', u, 'http://a.example/x', 'HTTPS://B.example/y?z=1') AS urls, CASE WHEN u IS NULL THEN 2 ELSE 3 END AS n FROM (SELECT question_id, CASE WHEN regexp_matches(source_url, '^https?://') THEN source_url END AS u FROM (@questions@))"),
    "q_retry_on_empty": sql("SELECT question_id, model, CASE WHEN len(extracted) = 0 THEN 2 ELSE 1 END AS attempt, CASE WHEN len(extracted) = 0 AND n % 2 = 0 THEN 'A' ELSE array_to_string(extracted, ',') END AS extracted FROM (@scored@)"),
    "q_url_budget": sql(f"SELECT user_id, url_no, url, event_id FROM ({_BUDGET})", trace=_TRACE, o="ts, event_id"),
    "q_tool_result": sql(f"SELECT user_id, round, 'Round ' || round || ' results:' || chr(10) || chr(10) || string_agg('[' || url_no || '] ' || url || chr(10) || 'hit ' || event_id, chr(10) || chr(10) ORDER BY url_no) AS message FROM ({_BUDGET}) GROUP BY user_id, round", trace=_TRACE, o="round, ts, event_id"),
    "q_token_totals": sql("SELECT user_id, nullif(sum(trunc(value)::INT), 0)::BIGINT AS prompt_tokens, nullif(sum(trunc(value)::INT % 7), 0)::BIGINT AS completion_tokens, CAST(NULL AS BIGINT) AS reasoning_tokens, max(round) AS rounds_used, 1 AS searched FROM (@trace@) GROUP BY user_id", trace=_TRACE),
    "q_tool_calls": sql("SELECT user_id, round, event_id, 0 AS call_no, CASE WHEN event_id % 5 = 0 THEN 'other_tool' ELSE 'web_search' END AS tool, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'q' || (event_id % 50) END AS query FROM (@trace@)", trace=_TRACE),
    "q_agentic_trace": sql("""
        WITH calls AS (SELECT user_id, round, max(event_id) AS e FROM (@trace@) GROUP BY ALL),
        hits AS (SELECT user_id, round, r AS rank, 'https://ex.org/' || ((e % 50 * 3 + r) % 90) AS url FROM calls, (SELECT unnest([1, 2, 4, 5]) AS r) WHERE e % 5 <> 0 AND e % 7 <> 0),
        firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY user_id, url ORDER BY round, rank) = 1)
        SELECT user_id, round, row_number() OVER (PARTITION BY user_id ORDER BY round, rank) AS url_no, url FROM firsts QUALIFY url_no <= 10""", trace=_TRACE),
    "q_agent_annotations": sql("SELECT question_id, n % 2 AS search_count, CASE WHEN c THEN source_url ELSE '' END AS cited_urls, CAST(n % 2 > 0 OR c AS INTEGER) AS searched FROM (SELECT *, n % 5 <> 0 AND n % 4 <> 0 AND coalesce(source_url, '') <> '' AS c FROM (@questions@))"),
}
QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
