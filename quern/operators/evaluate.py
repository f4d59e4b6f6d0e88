"""Evaluation of recorded model answers: tasks, caches, search traces, scores, summaries.

Inside the engine results are long (one row a question and model); they are made wide at the sink only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.labels import extract_labels, gold_labels, same_set, valid_labels
from quern.functions.text import clip, percent, pipe_join

#: Searches, addresses, results a search, characters of a result.
ROUNDS, URLS, RESULTS, SNIPPET = 3, 10, 5, 1_200


def cross_models(questions: DataFrame, models: list[str]) -> DataFrame:
    """One row for each question and model: an explode of the short, fixed list, no join."""
    return questions.withColumn("model", F.explode(F.array(*map(F.lit, models))))


def probe_cache(tasks: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): the tasks with what the cache holds for their key, and those without. A key that the cache
    holds twice gives its greatest entry, so a task is never doubled."""
    others = [c for c in cache.columns if c != key]
    one = cache.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*others)).alias("_e")).select(key, *(F.col(f"_e.{c}").alias(c) for c in others))
    return tasks.join(one, key), tasks.join(one.select(key), key, "left_anti")


def cache_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """(cache_key, text, searched, search_count): a cache file, one JSON object of entries, as rows. An entry is an
    object or, in old files, the bare text; an unreadable file has no entries."""
    entries = text.select(F.explode(F.from_json(F.col(column), "map<string,string>")).alias("cache_key", "entry"))
    parsed = F.from_json("entry", "struct<text:string,searched:boolean,search_count:int>")
    is_object = F.ltrim("entry").startswith("{")
    return entries.select("cache_key", F.when(is_object, parsed["text"]).otherwise(F.col("entry")).alias("text"), F.when(is_object, parsed["searched"]).alias("searched"), F.when(is_object, parsed["search_count"]).alias("search_count"))


def score(answers: DataFrame, question: str = "question", gold: str = "gold_answer", response: str = "response", extracted: Column | None = None) -> DataFrame:
    """``answers`` with ``valid``, ``gold``, ``extracted`` (arrays of labels) and ``correct``: whether the extracted
    labels are exactly the gold ones. Null answers and questions have no labels; empty equals empty."""
    with_valid = answers.withColumn("valid", valid_labels(F.col(question)))
    own = extract_labels(F.col(response), F.col("valid")) if extracted is None else F.array_sort(F.array_intersect(extracted, F.col("valid")))
    return with_valid.withColumn("gold", gold_labels(F.col(gold), F.col("valid"))).withColumn("extracted", own).withColumn("correct", same_set(F.col("extracted"), F.col("gold")))


def accuracy_summary(scored: DataFrame) -> DataFrame:
    """(model, total_count, accuracy), percent with one decimal."""
    return scored.groupBy("model").agg(F.count(F.lit(1)).alias("total_count"), percent(F.count_if("correct"), F.count(F.lit(1))).alias("accuracy"))


def share_correct(scored: DataFrame, models: int, key: str = "question_id") -> DataFrame:
    """(key, pct_of_models_correct): percent of all ``models``, those without an answer included; 0 without models."""
    share = percent(F.count_if("correct"), F.lit(models)) if models else F.lit(0.0)
    return scored.groupBy(key).agg(share.alias("pct_of_models_correct"))


def results_wide(scored: DataFrame, models: list[str], key: str = "question_id") -> DataFrame:
    """One row a question with response_, extracted_ and correct_ of each model, and the share of models correct. The
    models are a fixed list, so the pivot is one aggregation and costs no job of its own."""

    def of(model: str, value: Column, empty: Column) -> Column:
        return F.coalesce(F.max(F.when(F.col("model") == model, value)), empty)

    columns = []
    for m in models:
        columns.append(of(m, F.coalesce("response", F.lit("")), F.lit("")).alias(f"response_{m}"))
        columns.append(of(m, F.array_join("extracted", ", "), F.lit("")).alias(f"extracted_{m}"))
        columns.append(of(m, F.col("correct").cast("int"), F.lit(0)).alias(f"correct_{m}"))
    return scored.groupBy(key).agg(*columns, percent(F.count_if(F.col("correct") & F.col("model").isin(models)), F.lit(max(1, len(models)))).alias("pct_of_models_correct"))


def unpivot_models(wide: DataFrame, models: list[str], fields: list[str], keys: list[str]) -> DataFrame:
    """The long form of wide results: one row a question and model, for the models that have columns."""
    known = [m for m in models if all(f"{f}_{m}" in wide.columns for f in fields)]
    rows = F.array(*(F.struct(F.lit(m).alias("model"), *(F.col(f"{f}_{m}").alias(f) for f in fields)) for m in known))
    return wide.select(*keys, F.inline(rows))


def column_subset(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns of ``order`` that are there, in this order."""
    return df.select(*[c for c in order if c in df.columns])


def retry_resolved(attempts: DataFrame, keys: list[str], letters: str = "extracted") -> DataFrame:
    """The answer that counts of at most two attempts: the second where the first has no letters, else the first."""
    by = [F.col(k) for k in keys]
    first = F.max(F.when(F.col("attempt") == 1, F.struct(F.col(letters).alias("l"), F.struct(*attempts.columns).alias("row"))))
    second = F.max(F.when(F.col("attempt") == 2, F.struct(*attempts.columns)))
    held = attempts.groupBy(*by).agg(first.alias("a"), second.alias("b"))
    chosen = F.when(F.col("b").isNotNull() & ((F.col("a").isNull()) | (F.size("a.l") == 0)), F.col("b")).otherwise(F.col("a.row"))
    return held.select(chosen.alias("r")).select("r.*")


def within_budget(hits: DataFrame, question: list[str], order: list[str], url: str = "url", most: int = URLS) -> DataFrame:
    """The search hits that are shown: of each question the first place of each address, at most ``most`` of them in
    order, with their number from 1. The first place is a partial minimum, and the cap prunes before the shuffle."""
    named = hits.where(F.coalesce(F.col(url), F.lit("")) != "")
    first = named.groupBy(*question, url).agg(F.min(F.struct(*order)).alias("_o")).select(*question, url, "_o.*")
    return first.withColumn("url_no", F.row_number().over(Window.partitionBy(*question).orderBy(*order, url))).where(F.col("url_no") <= most)


def search_hits(results: DataFrame, most: int = RESULTS, chars: int = SNIPPET) -> DataFrame:
    """Recorded results of a search (query, rank, url, text): those with an address, the first ``most``, clipped as
    they are shown."""
    return results.where((F.coalesce(F.col("url"), F.lit("")) != "") & (F.col("rank") <= most)).withColumn("text", clip(F.col("text"), chars))


def tool_result(hits: DataFrame, question: list[str], round_: str = "round") -> DataFrame:
    """(question, round, message): the numbered hits of a round as the text that a model is shown. Numbers go on from
    round to round."""
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("url_no", "url", "text"))), lambda h: F.concat(F.lit("["), h["url_no"].cast("string"), F.lit("] "), h["url"], F.lit("\n"), F.coalesce(h["text"], F.lit(""))))
    grouped = hits.groupBy(*question, round_).agg(F.array_join(blocks, "\n\n").alias("_b"))
    return grouped.select(*question, round_, F.concat(F.lit("Round "), F.col(round_).cast("string"), F.lit(" results:\n\n"), F.col("_b")).alias("message"))


def token_totals(turns: DataFrame, by: list[str]) -> DataFrame:
    """Tokens summed over the rounds of each ``by`` (none at all is null), the rounds used, and whether it searched."""
    total = lambda c: F.nullif(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(c)
    sums = [total(c) for c in ("prompt_tokens", "completion_tokens", "reasoning_tokens")]
    return turns.groupBy(*by).agg(*sums, F.max("round").alias("rounds_used")).withColumn("searched", F.col("rounds_used") > 0)


def tool_calls(turns: DataFrame, message: str = "message") -> DataFrame:
    """(…, call_no, tool, query): the tool calls of recorded assistant messages; unreadable arguments have no query."""
    kind = "struct<content:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>"
    calls = turns.select("*", F.posexplode(F.from_json(F.col(message), kind)["tool_calls"]).alias("call_no", "_c")).drop(message)
    return calls.withColumn("tool", F.col("_c.function.name")).withColumn("query", F.coalesce(F.get_json_object("_c.function.arguments", "$.query"), F.lit(""))).drop("_c")


def agentic_trace(turns: DataFrame, results: DataFrame, by: list[str], most_rounds: int = ROUNDS, most_urls: int = URLS) -> DataFrame:
    """(by, round, url_no, url): what recorded runs were shown. Calls of the tool ``web_search`` with a query, in the
    first rounds, are joined with the recorded results of their query; then the budget of addresses holds."""
    calls = tool_calls(turns).where((F.col("tool") == "web_search") & (F.col("query") != "") & (F.col("round") <= most_rounds))
    hits = calls.select(*by, "round", "call_no", "query").join(search_hits(results).select("query", "rank", "url"), "query")
    return within_budget(hits, by, ["round", "call_no", "rank"], most=most_urls).select(*by, "round", "url_no", "url")


def annotated_citations(completions: DataFrame, column: str = "annotations") -> DataFrame:
    """``completions`` with ``cited_urls``, the addresses of its annotations of the kind url_citation, and
    ``searched``: whether it counted a search or cites anything."""
    kind = "array<struct<type:string,url_citation:struct<url:string>>>"
    cited = F.transform(F.filter(F.from_json(F.col(column), kind), lambda a: (a["type"] == "url_citation") & (F.coalesce(a["url_citation"]["url"], F.lit("")) != "")), lambda a: a["url_citation"]["url"])
    out = completions.withColumn("_c", F.coalesce(cited, F.array().cast("array<string>")))
    return out.withColumn("cited_urls", pipe_join(F.col("_c"))).withColumn("searched", (F.coalesce(F.col("search_count"), F.lit(0)) > 0) | (F.size("_c") > 0)).drop("_c", column)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
