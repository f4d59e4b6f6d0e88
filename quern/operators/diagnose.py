"""Why answers were wrong: candidate pool, sampling, source lookup, attribution, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import is_zero, not_blank, pipe_split, strip
from quern.functions.urls import normalize_url

#: The ways to fail, in the order of the summaries.
MODES = ("search_bypass", "retrieval", "grounding", "comprehension")


def failed_rows(results: DataFrame, correct: str = "correct") -> DataFrame:
    return results.where(is_zero(F.col(correct)))


def exclude_existing(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The tasks that are not done yet; a null key is never done."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti").select(*tasks.columns)


def source_lookup(questions: DataFrame, corpora: DataFrame, key: str = "question_id", url: str = "source_url", city: str = "city") -> DataFrame:
    """(key, source_text): the text of the page of each question, addresses compared in their normal form. The corpus
    with the name of the question's city goes first, then the others by name and scan order (``seq``); a null text is
    passed over, an empty one is found. Questions without a page have a null text.

    Both sides are reduced before the join: questions to their key, pages to the first of each address and corpus."""
    asked = questions.select(key, normalize_url(F.col(url)).alias("_u"), F.lower(F.coalesce(F.col(city), F.lit(""))).alias("_city")).dropDuplicates([key])
    pages = corpora.where("full_text is not null").select(normalize_url(F.col("source_uri")).alias("_u"), "corpus", "seq", "full_text")
    first = pages.where("_u != ''").groupBy("_u", "corpus").agg(F.min(F.struct("seq", "full_text")).alias("_p"))
    best = F.min_by("_p.full_text", F.struct((F.col("corpus") != F.col("_city")).alias("other"), "corpus", "_p.seq"))
    found = asked.join(first, "_u").groupBy(key).agg(best.alias("source_text"))
    return asked.select(key).join(found, key, "left")


def skip_reason(url: Column, text: Column) -> Column:
    """Why a question can't be diagnosed; null if it can."""
    return F.when(F.coalesce(strip(url), F.lit("")) == "", "no_source_url").when(F.coalesce(text, F.lit("")) == "", "no_source_text")


def cites(cited: Column, url: Column) -> Column:
    """Whether a list of cited addresses, joined by bars, holds the address, in normal form."""
    return F.coalesce(F.array_contains(F.transform(pipe_split(cited, trimmed=True), normalize_url), normalize_url(url)), F.lit(False))


def failure_mode(searched: Column, cites_source: Column, diag_correct: Column, error: Column | None = None) -> Column:
    """comprehension if the answer is wrong with the source at hand; else search_bypass without a search; else
    grounding if the source was cited, retrieval if not. A recorded error is api_error."""
    mode = F.when(~diag_correct, "comprehension").when(~searched, "search_bypass").when(cites_source, "grounding").otherwise("retrieval")
    return mode if error is None else F.when(error.isNotNull(), "api_error").otherwise(mode)


def failure_matrix(diagnosed: DataFrame, modes: tuple[str, ...] = (*MODES, "skipped_no_source")) -> DataFrame:
    """(model, one column a mode, total): counts, zero where there are none."""
    counts = [F.count_if(F.col("failure_mode") == m).alias(m) for m in modes]
    return diagnosed.groupBy("model").agg(*counts, F.count_if(F.col("failure_mode").isin(*modes)).alias("total"))


def metric_summary(diagnosed: DataFrame, modes: tuple[str, ...] = (*MODES, "api_error")) -> DataFrame:
    """(metric, count): total diagnosed, correct with the source, and each mode; one aggregation, then unpivoted."""
    metrics = {"total_diagnosed": F.count(F.lit(1)), "diagnostic_correct": F.count_if("diag_correct")} | {f"failure_mode={m}": F.count_if(F.col("failure_mode") == m) for m in modes}
    one = diagnosed.agg(*(v.alias(k) for k, v in metrics.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(f"`{k}`").alias("count")) for k in metrics))))


def append_results(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all rows by column name, their summary): columns that one side lacks are null there."""
    rows = old.unionByName(new, allowMissingColumns=True)
    return rows, metric_summary(rows)


def bucket_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def pool_counters(results: DataFrame, done: DataFrame, by: str = "jurisdiction", key: str = "question_id") -> DataFrame:
    """(by, wrong, already_done, kept) of the failed rows: a left join keeps the groups in which all is done."""
    marked = failed_rows(results).join(done.select(by, key).distinct().withColumn("_done", F.lit(1)), [by, key], "left")
    return marked.groupBy(by).agg(F.count(F.lit(1)).alias("wrong"), F.count("_done").alias("already_done"), F.count_if(F.col("_done").isNull()).alias("kept"))


def sample_order(key: Column, seed: int) -> Column:
    """The order of a seeded sample: the same in every run and every engine with MD5."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def cap_per_bucket(rows: DataFrame, by: list[str], key: str, most: int = 38, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each bucket, chosen by seeded hash. The rank's limit prunes each task's rows of a
    bucket before the shuffle, so a hot bucket moves ``most`` rows a task."""
    ordered = Window.partitionBy(*by).orderBy(sample_order(F.col(key), seed), F.col(key))
    return rows.withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= most).drop("_n")


def even_quotas(sizes: list[tuple], wanted: int) -> list[int]:
    """How many of each bucket (in the given order) make up ``wanted`` rows spread evenly: rounds in which each bucket
    that still has rows gets an equal share of what is left, at least one."""
    left = [int(n) for *_, n in sizes]
    quotas = [0] * len(left)
    rest = wanted
    while rest > 0 and any(left):
        active = [i for i, n in enumerate(left) if n]
        share = max(1, rest // len(active))
        for i in active:
            take = min(share, left[i], rest)
            quotas[i] += take
            left[i] -= take
            rest -= take
            if not rest:
                break
    return quotas


def even_sample(rows: DataFrame, by: list[str], key: str, wanted: int = 100, seed: int = 42, most_buckets: int = 10_000) -> DataFrame:
    """``wanted`` rows spread evenly over the buckets, chosen by seeded hash; repeated keys of a bucket count once.

    Only the sizes of the buckets come to the driver, whose number is checked (jurisdictions times categories). No
    bucket gets more than ``wanted`` rows, so ranks above it are pruned before the shuffle."""
    once = rows.dropDuplicates([*by, key])
    sizes = [tuple(r) for r in once.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(*by).limit(most_buckets + 1).collect()]
    if len(sizes) > most_buckets:
        raise ValueError(f"more than {most_buckets} buckets")
    quotas = even_quotas(sizes, wanted)
    limit = F.lit(0)
    for (*names, _), quota in zip(sizes, quotas):
        same = F.lit(True)
        for column, name in zip(by, names):
            same = same & F.col(column).eqNullSafe(F.lit(name))
        limit = F.when(same, quota).otherwise(limit) if quota else limit
    ordered = Window.partitionBy(*by).orderBy(sample_order(F.col(key), seed), F.col(key))
    ranked = once.withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= wanted)
    return ranked.where(F.col("_n") <= limit).drop("_n")


def round_robin_sample(rows: DataFrame, by: list[str], key: str, wanted: int = 100, seed: int = 42) -> DataFrame:
    """``wanted`` rows taken from the buckets in turn: first of each, second of each, and so on."""
    ordered = Window.partitionBy(*by).orderBy(sample_order(F.col(key), seed), F.col(key))
    ranked = rows.dropDuplicates([*by, key]).withColumn("_n", F.row_number().over(ordered)).where(F.col("_n") <= wanted)
    return ranked.orderBy("_n", *by).limit(wanted).drop("_n")


def eligible(candidates: DataFrame, url: str = "source_url", text: str = "source_text") -> DataFrame:
    return candidates.where(skip_reason(F.col(url), F.col(text)).isNull())


def skip_log(candidates: DataFrame, url: str = "source_url", text: str = "source_text") -> DataFrame:
    """(question_id, model, url, reason) of what can't be diagnosed."""
    reason = skip_reason(F.col(url), F.col(text))
    return candidates.where(reason.isNotNull()).select("question_id", "model", F.coalesce(not_blank(F.col(url)), F.lit("")).alias("url"), reason.alias("reason"))


def diagnostic_rows(diagnosed: DataFrame) -> DataFrame:
    """The columns of a diagnosis as they are exported, in their order, missing ones left out."""
    order = ["question_id", "model", "source_url", "category", "city", "response", "diagnostic_response", "diag_correct", "searched", "cited", "failure_mode"]
    present = diagnosed.select(*[c for c in order if c in diagnosed.columns])
    return present.withColumn("n_cited", F.size(pipe_split(F.col("cited")))) if "cited" in present.columns else present


def per_model_columns(diagnosed: DataFrame, model: str) -> DataFrame:
    """The rows of one model with its name in the columns that belong to it."""
    own = ["response", "searched", "cited", "diag_correct", "failure_mode"]
    rows = diagnosed.where(F.col("model") == model).drop("model")
    return rows.withColumnsRenamed({c: f"{c}_{model}" for c in own if c in rows.columns})
