"""Questions made from documents: parsing recorded completions, validating, checking quotes, numbering, exporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.labels import correct_labels
from quern.functions.text import json_field, not_blank, quote_normalize, strip
from quern.plans.ordering import row_numbers, running_sum

OPTIONS = "array<struct<label:string,text:string,is_correct:boolean>>"
COMPLETION = f"struct<questions:array<struct<question:string,options:{OPTIONS},quotes:array<string>>>>"
#: The cells that are exported first, in their order.
CELLS = ("03", "04", "07", "10")


def explode_questions(completions: DataFrame, column: str = "completion") -> DataFrame:
    """One row for each question of a recorded completion, with its place, text, options, quotes and answer. A null
    or unreadable completion gives none."""
    parsed = completions.withColumn("_q", F.from_json(F.col(column), COMPLETION)["questions"])
    rows = parsed.select(*completions.columns, F.posexplode("_q").alias("question_no", "_one")).drop(column)
    return rows.select("*", "_one.question", "_one.options", "_one.quotes", correct_labels(F.col("_one.options")).alias("answer")).drop("_one")


def issues(question: Column, options: Column, wanted: int) -> Column:
    """What is wrong with a question, as an array of texts; empty if nothing is."""
    opts = F.coalesce(options, F.array().cast(OPTIONS))
    labels = F.transform(opts, lambda o: o["label"])
    found = F.array(
        F.when(F.coalesce(strip(question), F.lit("")) == "", "blank question"),
        F.when(F.size(opts) != wanted, F.concat(F.lit("options: "), F.size(opts).cast("string"))),
        F.when(F.size(F.array_distinct(labels)) != F.size(labels), "labels repeat"),
        F.when(~F.exists(opts, lambda o: F.coalesce(o["is_correct"], F.lit(False))), "no correct option"),
    )
    return F.array_compact(found)


def validated(questions: DataFrame, wanted: int = 8) -> DataFrame:
    """``questions`` with ``issues`` and ``is_valid``."""
    return questions.withColumn("issues", issues(F.col("question"), F.col("options"), wanted)).withColumn("is_valid", F.size("issues") == 0)


def first_good_attempt(questions: DataFrame, key: str = "doc_id", attempt: str = "attempt", most: int = 3) -> DataFrame:
    """The valid questions of the first attempt of each document that has one. ``questions`` has attempt and is_valid."""
    tried = questions.where(F.col("is_valid") & F.col(attempt).between(1, most))
    first = tried.groupBy(F.col(key).alias("_key")).agg(F.min(attempt).alias("_first"))
    return tried.join(first, (F.col(key) == F.col("_key")) & (F.col(attempt) == F.col("_first"))).drop("_key", "_first")


def failing_quotes(quotes: Column, source: Column) -> Column:
    """The quotes that do not stand in the source, compared without case, signs and double spaces. A quote of which
    nothing is left stands everywhere; a null source holds nothing."""
    there = F.array(quote_normalize(F.coalesce(source, F.lit(""))))
    # bound as a lambda's variable, the source is normalized once a row and not once a quote
    return F.get(F.transform(there, lambda t: F.filter(quotes, lambda q: ~F.contains(t, quote_normalize(F.coalesce(q, F.lit("")))))), 0)


def verify_quotes(questions: DataFrame, quotes: str = "quotes", source: str = "full_text") -> DataFrame:
    """``questions`` with ``passed`` and ``failing_quote``: passed are those with quotes that all stand in the source;
    the first that does not is named. The source is normalized once a row."""
    q = F.coalesce(F.col(quotes), F.array().cast("array<string>"))
    bad = questions.withColumn("_bad", failing_quotes(q, F.col(source)))
    out = bad.withColumn("passed", (F.size(q) > 0) & (F.size("_bad") == 0)).withColumn("failing_quote", F.try_element_at("_bad", F.lit(1)))
    return out.drop("_bad")


def rejected(verified: DataFrame) -> DataFrame:
    """The log of rejected questions."""
    return verified.where("not passed").select("doc_id", "question", "failing_quote", F.when(F.size(F.coalesce("quotes", F.array().cast("array<string>"))) == 0, "no quotes").otherwise("quote not in source").alias("reason"))


def verification_counts(verified: DataFrame) -> DataFrame:
    return verified.groupBy("doc_id").agg(F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_rejected"))


def attach_metadata(questions: DataFrame, extra: str = "extra_json") -> DataFrame:
    """The fields of a document's open metadata that its questions carry; absent ones are empty."""
    fields = {"category": "category", "institution_short_name": "institution_short_name", "cell": "cell", "institution": "institution", "label": "label"}
    return questions.withColumns({out: json_field(F.col(extra), name) for out, name in fields.items()})


def number_questions(questions: DataFrame, prefix: str, order: list[str]) -> DataFrame:
    """``questions`` with ``question_id``: prefix, ``_q`` and the number in the prefix's own count, three digits at
    least; a null or empty prefix is ``qa``."""
    named = questions.withColumn("_prefix", F.coalesce(not_blank(F.col(prefix)), F.lit("qa")))
    numbered = row_numbers(named, order, "_no", by=["_prefix"])
    return numbered.withColumn("question_id", F.format_string("%s_q%03d", "_prefix", "_no")).drop("_prefix", "_no")


def rotate_models(documents: DataFrame, models: list[str], order: list[str], text: str = "full_text") -> DataFrame:
    """The documents with text, each with the next of ``models`` in turn."""
    numbered = row_numbers(documents.where(F.coalesce(F.col(text), F.lit("")) != ""), order, "_no")
    return numbered.withColumn("model", F.element_at(F.array(*map(F.lit, models)), (F.pmod(F.col("_no") - 1, F.lit(len(models))) + 1).cast("int"))).drop("_no")


def until_cap(documents: DataFrame, made: str, cap: int, order: list[str], already: int = 0) -> DataFrame:
    """The documents that are processed before the number of questions ``made`` reaches ``cap``; the last may go over
    it. ``already`` counts what was made before."""
    summed = running_sum(documents, order, F.coalesce(F.col(made), F.lit(0)), "_before", inclusive=False)
    return summed.where(F.col("_before") + already < cap).drop("_before")


def without_completed(documents: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """The documents that no checkpoint names."""
    return documents.join(checkpoint.select(F.col("doc_id").alias("_done")).distinct(), F.col("doc_id") == F.col("_done"), "left_anti")


def export_order(questions: DataFrame) -> DataFrame:
    """``questions`` with ``sheet`` and ``cell_order``: known cells first, then others by name, without a cell last
    under the name other."""
    cell = F.coalesce(not_blank(F.col("cell")), F.lit("other"))
    known = F.array_position(F.array(*map(F.lit, CELLS)), cell)
    return questions.withColumn("sheet", F.concat(F.lit("Cell "), cell)).withColumn("cell_order", F.when(known > 0, known).otherwise(len(CELLS) + 1).cast("int"))


def format_question(question: Column, options: Column) -> Column:
    """The question, a blank line and a line for each option; without options the question alone."""
    lines = F.transform(options, lambda o: F.concat(F.lit("  "), o["label"], F.lit(". "), o["text"]))
    return F.when(F.size(F.coalesce(options, F.array().cast(OPTIONS))) > 0, F.concat(question, F.lit("\n\n"), F.array_join(lines, "\n"))).otherwise(question)


def format_quotes(quotes: Column) -> Column:
    return F.array_join(F.transform(quotes, lambda q: F.concat(F.lit('"'), q, F.lit('"'))), "\n")


def export_rows(questions: DataFrame, city: str = "") -> DataFrame:
    """The ten columns of an exported question: formatted question and quotes, the institution's short name or
    ``city`` as its place, address and title of its document; null as empty."""
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    return questions.select(
        "question_id", format_question(F.col("question"), F.col("options")).alias("question"), "answer", empty("category").alias("category"), empty("institution").alias("institution"), F.coalesce(not_blank(F.col("institution_short_name")), F.lit(city)).alias("city"),
        empty("source_uri").alias("source_url"), empty("title").alias("page_title"), format_quotes(F.coalesce("quotes", F.array().cast("array<string>"))).alias("supporting_quotes"), empty("model_used").alias("model_used"),
    )


def checkpoint_lines(questions: DataFrame, key: str = "doc_id") -> DataFrame:
    """(value): one JSON line a document with all its questions, as a checkpoint holds them. The questions of a
    document come from one completion, so the group is small."""
    pair = F.struct(*[c for c in questions.columns if c != key])
    return questions.groupBy(key).agg(F.array_sort(F.collect_list(pair)).alias("pairs")).select(F.to_json(F.struct(key, "pairs")).alias("value"))
