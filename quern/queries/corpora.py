"""The corpus: scans, joins, upserts, exports, generated questions, sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import corpus, generate, sheets
from quern.queries.shared import docs, questions, sql, strip_sql, url_sql
from quern.sources.tables import table


def _chunks(spark, folder, *columns):
    """The chunks without repeated rows, with the key and the ``columns`` that are wanted; all if none is named."""
    chunks = table(spark, folder, "chunks")
    return (chunks.select("chunk_id", *columns) if columns else chunks).distinct()


def q_list_documents(spark, folder):
    return corpus.list_documents(docs(spark, folder, "source_type", "source_uri", "title", "content_hash", "fetch_timestamp", "extra_json"))


def q_chunks_in_order(spark, folder):
    return corpus.chunks_in_order(_chunks(spark, folder, "doc_id", "idx")).select("chunk_id", "doc_id", "idx")


def q_chunks_by_doc(spark, folder):
    """The chunks of one document, the first of all that have some."""
    chunks = _chunks(spark, folder, "doc_id", "idx")
    return corpus.chunks_of(chunks, chunks.select(F.min("doc_id")).scalar()).select("chunk_id", "doc_id", "idx")


def q_chunk_by_id(spark, folder):
    chunks = _chunks(spark, folder)
    return corpus.chunk_by_id(chunks, chunks.select(F.max("chunk_id")).scalar())


def q_full_text(spark, folder):
    d = docs(spark, folder, "full_text")
    return corpus.full_text(d, d.where("full_text is not null").select(F.min("doc_id")).scalar())


def q_document_metadata(spark, folder):
    """Metadata and text of each document whose title is ``Error``."""
    return docs(spark, folder).where("title = 'Error'").select("doc_id", "source_type", "source_uri", "title", "content_hash", "fetch_timestamp", "full_text")


def q_chunks_by_source(spark, folder):
    return corpus.chunks_by_source(_chunks(spark, folder, "doc_id", "idx"), docs(spark, folder, "source_type"), "pdf").select("chunk_id", "doc_id", "idx")


def q_chunk_counts(spark, folder):
    return corpus.corpus_counts(docs(spark, folder, "source_type"), _chunks(spark, folder, "doc_id"))


def q_union_corpora(spark, folder):
    d = docs(spark, folder, "source_uri", "full_text", "source_type").select("source_uri", F.length("full_text").alias("n_chars"), "source_type")
    united = corpus.union_corpora({k: d.where(F.col("source_type") == k) for k in ("web", "pdf")})
    return united.select("corpus", "source_uri", "n_chars")


def q_doc_filter(spark, folder):
    return corpus.filter_documents(docs(spark, folder, "source_type", "source_uri"), source_type="web", url_part="/services/").select("doc_id", "source_uri")


def q_corpus_upsert(spark, folder):
    """Each delivery of the page list upserted over the first one, the last delivery of a page holding."""
    pages = table(spark, folder, "doc_snapshots").select("doc_id", "snapshot_no", "source_uri", "title")
    least = pages.select(F.min("snapshot_no")).scalar()
    merged = corpus.upsert_documents(pages.where(F.col("snapshot_no") == least).distinct(), pages.where(F.col("snapshot_no") > least), [F.col("snapshot_no")])
    return merged.groupBy("snapshot_no").agg(F.count(F.lit(1)).alias("n"))


def q_chunk_upsert(spark, folder):
    """The pdf documents come in again with one chunk each; the others keep theirs."""
    written = docs(spark, folder, "source_type").where("source_type = 'pdf'").select("doc_id")
    new = written.select(F.concat(F.lit("n"), "doc_id").alias("chunk_id"), "doc_id", F.lit(0).alias("idx"), F.lit("new").alias("text"), F.lit("{}").alias("meta_json"))
    return corpus.upsert_chunks(_chunks(spark, folder, "doc_id", "idx"), new, written).select("chunk_id", "doc_id", "idx")


def q_chunk_export(spark, folder):
    return corpus.chunk_export(_chunks(spark, folder), docs(spark, folder, "title", "source_uri", "source_type")).select("chunk_id", "file_name", F.md5("body").alias("body_hash"))


def q_export_names(spark, folder):
    return corpus.page_export(docs(spark, folder, "source_uri", "title", "full_text"))


def q_per_source_cap(spark, folder):
    return corpus.per_source_cap(table(spark, folder, "documents"), "source", ["doc_id"], 3).select("source", "doc_id")


def _completions(spark, folder):
    """A recorded completion for each question of the table, with planted faults: seven options, a label twice, no
    correct option, no quotes, broken JSON."""
    q, n = questions(spark, folder), F.col("n")
    found = F.regexp_extract_all("question", F.lit(r"(?md)^  ([A-Z])\. (.*)$"), 0)
    options = F.transform(
        found,
        lambda x, i: F.struct(
            F.when((n % 11 == 0) & (i == 1), "A").otherwise(F.substring(x, 3, 1)).alias("label"), F.substring(x, 6, 100_000).alias("text"), (F.contains(F.coalesce("answer", F.lit("")), F.substring(x, 3, 1)) & (n % 13 != 0)).alias("is_correct")
        ),
    )
    options = F.when(n % 7 == 0, F.slice(options, 1, 7)).otherwise(options)
    stem = F.element_at(F.split("question", "\n", -1), 1)
    quotes = F.when(n % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.coalesce("supporting_quotes", F.lit(""))))
    one = F.struct(F.when(n % 17 == 0, " ").otherwise(stem).alias("question"), options.alias("options"), quotes.alias("quotes"))
    text = F.when(n % 19 == 0, "{broken").otherwise(F.to_json(F.struct(F.array(one).alias("questions"))))
    return q.select("question_id", "n", text.alias("completion"))


def q_answer_labels(spark, folder):
    rows = generate.explode_questions(_completions(spark, folder))
    return rows.select("question_id", "question_no", F.size("options").alias("n_options"), "answer", F.md5(generate.format_question(F.col("question"), F.col("options"))).alias("text_hash"), generate.format_quotes(F.col("quotes")).alias("quotes"))


def q_validate_questions(spark, folder):
    rows = generate.validated(generate.explode_questions(_completions(spark, folder)))
    return rows.select("question_id", F.array_join("issues", "; ").alias("issues"), F.col("is_valid").cast("int").alias("is_valid"))


def q_retry_resolution(spark, folder):
    """Three attempts a question, of which the valid ones depend on its number."""
    rows = questions(spark, folder).select("question_id", "n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("attempt")).withColumn("is_valid", (F.col("n") + F.col("attempt") * 3) % 4 == 0)
    return generate.first_good_attempt(rows, "question_id").select("question_id", "attempt")


def _quoted(spark, folder):
    """Each question with the quotes of its table and the text of the page of its address: the page is found by keys
    alone, and its text is joined to the questions that have one."""
    from quern.functions.urls import normalize_url

    d = docs(spark, folder, "source_uri", "full_text").where("full_text is not null")
    page = d.groupBy(normalize_url(F.col("source_uri")).alias("u")).agg(F.min("doc_id").alias("page_id"))
    q = questions(spark, folder).withColumn("u", normalize_url(F.col("source_url"))).join(page, "u", "left")
    texts = d.select(F.col("doc_id").alias("page_id"), "full_text").dropDuplicates(["page_id"])
    quotes = F.filter(F.transform(F.split("supporting_quotes", "\n", -1), lambda x: F.regexp_replace(x, '^"|"$', "")), lambda x: x != "")
    return q.join(texts, "page_id", "left").select(F.coalesce("page_id", F.lit("none")).alias("doc_id"), F.col("question_id").alias("question"), quotes.alias("quotes"), "full_text")


def q_quote_grounding(spark, folder):
    return generate.verify_quotes(_quoted(spark, folder)).select("doc_id", "question", F.col("passed").cast("int").alias("passed"), F.coalesce("failing_quote", F.lit("")).alias("failing_quote"))


def q_quote_rejects(spark, folder):
    return generate.rejected(generate.verify_quotes(_quoted(spark, folder))).select("doc_id", "question", "reason")


def q_verification_counts(spark, folder):
    return generate.verification_counts(generate.verify_quotes(_quoted(spark, folder)))


def q_metadata_fields(spark, folder):
    return generate.attach_metadata(docs(spark, folder, "extra_json").select("doc_id", "extra_json")).drop("extra_json")


def q_question_numbering(spark, folder):
    rows = questions(spark, folder).select(F.col("question_id").alias("old_id"), F.col("city").alias("prefix"))
    return generate.number_questions(rows, "prefix", ["old_id"]).select("old_id", "question_id")


def q_model_rotation(spark, folder):
    return generate.rotate_models(table(spark, folder, "documents"), ["m0", "m1", "m2"], ["doc_id"], "text").select("doc_id", "model")


def q_global_cap(spark, folder):
    made = table(spark, folder, "documents").select("doc_id", (F.col("doc_id") % 11).alias("made"))
    return generate.until_cap(made, "made", 400, ["doc_id"], already=7)


def q_completed_docs(spark, folder):
    from quern.sources.recorded import checkpoint_pairs

    lines = docs(spark, folder, "source_type").select(F.when(F.col("doc_id") < "4", F.concat(F.lit('{"doc_id":"'), "doc_id", F.lit('","pairs":[{"question":"q","answer":"A"}]}'))).when(F.col("doc_id") < "5", "{bad").otherwise("").alias("value"))
    return generate.without_completed(docs(spark, folder, "source_type").select("doc_id"), checkpoint_pairs(lines)[1])


def q_checkpoint_pairs(spark, folder):
    from quern.sources.recorded import checkpoint_pairs

    pair = F.struct(F.col("question"), F.col("answer"))
    lines = questions(spark, folder).select(F.when(F.col("n") % 6 == 0, "{bad").otherwise(F.to_json(F.struct(F.col("question_id").alias("doc_id"), F.array(pair, pair).alias("pairs")))).alias("value"))
    return checkpoint_pairs(lines)[0].select("doc_id", "pair_no", "answer", F.md5("question").alias("question_hash"))


def q_cell_routing(spark, folder):
    rows = docs(spark, folder, "extra_json").select("doc_id", F.get_json_object("extra_json", "$.cell").alias("cell"))
    return generate.export_order(rows).select("doc_id", "sheet", "cell_order")


def q_union_sheets(spark, folder):
    t = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return sheets.sheet_counts(sheets.union_sheets({k: t.where(F.col("lang") == k) for k in ("en", "es", "fr")}, ["doc_id"]))


def q_rename_missing(spark, folder):
    return sheets.rename_missing(questions(spark, folder).select("question_id", "question", "answer"), {"answer": "gold_answer", "question": "question_text", "question_id": "gold_answer"})


def q_existing_keys(spark, folder):
    return sheets.existing_keys(table(spark, folder, "question_table"), ["city", "category"])


def q_export_rows(spark, folder):
    rows = generate.explode_questions(_completions(spark, folder)).join(questions(spark, folder).select("question_id", "category", "institution", F.col("city").alias("institution_short_name"), F.col("source_url").alias("source_uri"), F.col("page_title").alias("title"), "model_used"), "question_id")
    out = generate.export_rows(rows, "nowhere")
    return out.select("question_id", "answer", "category", "institution", "city", "source_url", "page_title", "model_used", F.md5("question").alias("question_hash"), F.md5("supporting_quotes").alias("quotes_hash"))


def q_checkpoint_lines(spark, folder):
    return generate.checkpoint_lines(questions(spark, folder).select(F.col("question_id").alias("doc_id"), F.md5("question").alias("question"), F.coalesce("answer", F.lit("")).alias("answer")))


def q_search_hits(spark, folder):
    """Events as recorded search results: those with an address, five a query, clipped."""
    from quern.operators.evaluate import search_hits

    e = table(spark, folder, "events").select(F.col("user_id").alias("query"), (F.col("event_id") % 9).alias("rank"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("https://ex.org/"), "event_id")).otherwise("").alias("url"), F.repeat("props", F.lit(200)).alias("text"))
    return search_hits(e).select("query", "rank", "url", F.length("text").alias("n_chars"))


def q_recorded_calls(spark, folder):
    """Requests joined with what was recorded for their key, and the completions read by their schema."""
    from quern.sources.recorded import joined_calls, parsed_completions

    requests = _completions(spark, folder).select(F.col("question_id").alias("request_key"))
    calls = _completions(spark, folder).where("n % 3 != 0").select(F.col("question_id").alias("request_key"), F.col("completion").alias("text"))
    read = parsed_completions(joined_calls(requests, calls.union(calls)), generate.COMPLETION)
    return read.select("request_key", F.col("failed").cast("int").alias("failed"), F.coalesce(F.size("parsed.questions"), F.lit(0)).alias("n_questions"))


_NORM = strip_sql("regexp_replace(regexp_replace(lower({}), '[$€£¥₹%''\"`‘’“”–—-]', '', 'g'), '@WS@+', ' ', 'g')")
_QUOTED = f"""
SELECT coalesce(doc_id, 'none') AS doc_id, question_id AS question, quotes, list_filter(quotes, lambda x: NOT contains({_NORM.format("coalesce(full_text, '')")}, {_NORM.format('x')})) AS bad
FROM (SELECT *, coalesce(list_filter(list_transform(string_split(supporting_quotes, chr(10)), lambda x: regexp_replace(x, '^"|"$', '', 'g')), lambda x: x <> ''), []) AS quotes, {url_sql('source_url')} AS u FROM (@questions@))
LEFT JOIN (SELECT {url_sql('source_uri')} AS u, doc_id, full_text FROM (@docs@) WHERE full_text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {url_sql('source_uri')} ORDER BY doc_id, full_text) = 1) USING (u)"""
_FIELD = "coalesce(CASE WHEN json_valid(extra_json) THEN json_extract_string(extra_json, '$.{}') END, '')"
_PARSED = """
SELECT question_id, n, CASE WHEN n % 17 = 0 THEN ' ' ELSE string_split(question, chr(10))[1] END AS stem, CASE WHEN n % 7 = 0 THEN found[:7] ELSE found END AS o, answer, supporting_quotes
FROM (SELECT *, regexp_extract_all(question, '(?m)^  [A-Z]\\. .*$') AS found FROM (@questions@)) WHERE n % 19 <> 0"""
_LABEL = "CASE WHEN n % 11 = 0 AND i = 2 THEN 'A' ELSE o[i][3] END"
_RIGHT = "list_filter(range(1, len(o) + 1), lambda i: n % 13 <> 0 AND contains(coalesce(answer, ''), o[i][3]))"

SQL = {
    "q_list_documents": sql("SELECT doc_id, source_type, source_uri, title, content_hash, fetch_timestamp, extra_json FROM (@docs@)"),
    "q_chunks_in_order": "SELECT DISTINCT ON (chunk_id, doc_id, idx, text, meta_json) chunk_id, doc_id, idx FROM chunks",
    "q_chunks_by_doc": "SELECT chunk_id, doc_id, idx FROM (SELECT DISTINCT * FROM chunks) WHERE doc_id = (SELECT min(doc_id) FROM chunks)",
    "q_chunk_by_id": "SELECT DISTINCT * FROM chunks WHERE chunk_id = (SELECT max(chunk_id) FROM chunks)",
    "q_full_text": sql("SELECT full_text FROM (@docs@) WHERE doc_id = (SELECT min(doc_id) FROM corpus_docs WHERE full_text IS NOT NULL)"),
    "q_document_metadata": sql("SELECT doc_id, source_type, source_uri, title, content_hash, fetch_timestamp, full_text FROM (@docs@) WHERE title = 'Error'"),
    "q_chunks_by_source": "SELECT chunk_id, doc_id, idx FROM (SELECT DISTINCT * FROM chunks) WHERE doc_id IN (SELECT doc_id FROM corpus_docs WHERE source_type = 'pdf')",
    "q_chunk_counts": sql("SELECT (SELECT count(*) FROM (@docs@)) AS documents, (SELECT count(*) FROM (SELECT DISTINCT * FROM chunks)) AS chunks"),
    "q_union_corpora": sql("SELECT source_type AS corpus, source_uri, length(full_text) AS n_chars FROM (@docs@)"),
    "q_doc_filter": sql("SELECT doc_id, source_uri FROM (@docs@) WHERE source_type = 'web' AND contains(source_uri, '/services/')"),
    "q_corpus_upsert": "SELECT no AS snapshot_no, count(*) AS n FROM (SELECT doc_id, max(snapshot_no) AS no FROM doc_snapshots WHERE doc_id IS NOT NULL GROUP BY doc_id) GROUP BY no",
    "q_chunk_upsert": sql("SELECT chunk_id, doc_id, idx FROM (SELECT DISTINCT * FROM chunks) WHERE doc_id NOT IN (SELECT doc_id FROM corpus_docs WHERE source_type = 'pdf') UNION ALL SELECT 'n' || doc_id, doc_id, 0 FROM (@docs@) WHERE source_type = 'pdf'"),
    "q_chunk_export": sql(f"""
        SELECT chunk_id, c.doc_id || '_' || printf('%04d', idx) || '.txt' AS file_name, md5(concat_ws(chr(10), 'Title: ' || nullif(title, ''), 'Source: ' || nullif(source_uri, ''), 'Type: ' || nullif(source_type, ''),
          'Section: ' || nullif({_FIELD.format('section_title').replace('extra_json', 'meta_json')}, ''), 'Chunk: ' || idx, '', coalesce(text, ''))) AS body_hash
        FROM (SELECT DISTINCT * FROM chunks) c LEFT JOIN (@docs@) d ON c.doc_id = d.doc_id"""),
    "q_export_names": sql("""
        SELECT doc_id, no AS page_no, CASE WHEN full_text IS NOT NULL THEN printf('%02d', no) || '_' || regexp_replace(regexp_replace(lower(coalesce(nullif(title, ''), string_split(regexp_replace(source_uri, '/+$', ''), '/')[-1], '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '.txt' END AS file_name
        FROM (SELECT *, row_number() OVER (ORDER BY source_uri, doc_id) AS no FROM (@docs@))"""),
    "q_per_source_cap": "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3",
    "q_answer_labels": sql(f"""
        SELECT question_id, 0 AS question_no, len(o) AS n_options, array_to_string(list_sort(list_transform({_RIGHT}, lambda i: {_LABEL})), ', ') AS answer,
          md5(stem || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(o) + 1), lambda i: '  ' || {_LABEL} || '. ' || o[i][6:]), chr(10))) AS text_hash,
          CASE WHEN n % 5 = 0 THEN '' ELSE '"' || coalesce(supporting_quotes, '') || '"' END AS quotes
        FROM (@p@)""", p=_PARSED),
    "q_validate_questions": sql(f"""
        SELECT question_id, issues, CAST(issues = '' AS INTEGER) AS is_valid FROM (SELECT question_id, concat_ws('; ', CASE WHEN n % 17 = 0 THEN 'blank question' END, CASE WHEN len(o) <> 8 THEN 'options: ' || len(o) END,
          CASE WHEN n % 11 = 0 THEN 'labels repeat' END, CASE WHEN len({_RIGHT}) = 0 THEN 'no correct option' END) AS issues FROM (@p@))""", p=_PARSED),
    "q_retry_resolution": sql("SELECT question_id, min(a)::INTEGER AS attempt FROM (@questions@), (SELECT unnest([1, 2, 3]) AS a) WHERE (n + a * 3) % 4 = 0 GROUP BY question_id"),
    "q_quote_grounding": sql("SELECT doc_id, question, CAST(len(quotes) > 0 AND len(bad) = 0 AS INTEGER) AS passed, coalesce(bad[1], '') AS failing_quote FROM (@q@)", q=_QUOTED),
    "q_quote_rejects": sql("SELECT doc_id, question, CASE WHEN len(quotes) = 0 THEN 'no quotes' ELSE 'quote not in source' END AS reason FROM (@q@) WHERE len(quotes) = 0 OR len(bad) > 0", q=_QUOTED),
    "q_verification_counts": sql("SELECT doc_id, count(*) FILTER (len(quotes) > 0 AND len(bad) = 0) AS n_passed, count(*) FILTER (len(quotes) = 0 OR len(bad) > 0) AS n_rejected FROM (@q@) GROUP BY doc_id", q=_QUOTED),
    "q_metadata_fields": sql("SELECT doc_id, " + ", ".join(f"{_FIELD.format(x)} AS {x}" for x in ("category", "institution_short_name", "cell", "institution", "label")) + " FROM (@docs@)"),
    "q_question_numbering": sql("SELECT question_id AS old_id, p || '_q' || printf('%03d', row_number() OVER (PARTITION BY p ORDER BY question_id)) AS question_id FROM (SELECT question_id, coalesce(nullif(city, ''), 'qa') AS p FROM (@questions@))"),
    "q_model_rotation": "SELECT doc_id, 'm' || ((row_number() OVER (ORDER BY doc_id) - 1) % 3) AS model FROM documents WHERE text <> ''",
    "q_global_cap": "SELECT doc_id, made FROM (SELECT doc_id, doc_id % 11 AS made, coalesce(sum(doc_id % 11) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b + 7 < 400",
    "q_completed_docs": sql("SELECT doc_id FROM (@docs@) WHERE doc_id >= '4'"),
    "q_checkpoint_pairs": sql("SELECT question_id AS doc_id, p AS pair_no, answer, md5(question) AS question_hash FROM (@questions@), (SELECT unnest([0, 1]) AS p) WHERE n % 6 <> 0"),
    "q_cell_routing": sql(f"SELECT doc_id, 'Cell ' || c AS sheet, CASE WHEN c IN ('03', '04', '07', '10') THEN list_position(['03', '04', '07', '10'], c) ELSE 5 END AS cell_order FROM (SELECT doc_id, coalesce(nullif({_FIELD.format('cell')}, ''), 'other') AS c FROM (@docs@))"),
    "q_union_sheets": "SELECT lang AS sheet, count(*) AS n FROM documents WHERE lang IN ('en', 'es', 'fr') GROUP BY ROLLUP (lang)",
    "q_rename_missing": sql("SELECT question_id, question AS question_text, answer AS gold_answer FROM (@questions@)"),
    "q_export_rows": sql(f"""
        SELECT p.question_id, array_to_string(list_sort(list_transform({_RIGHT.replace('answer', 'p.answer')}, lambda i: {_LABEL})), ', ') AS answer, coalesce(category, '') AS category, coalesce(institution, '') AS institution, coalesce(nullif(city, ''), 'nowhere') AS city,
          coalesce(source_url, '') AS source_url, coalesce(page_title, '') AS page_title, coalesce(model_used, '') AS model_used,
          md5(stem || chr(10) || chr(10) || array_to_string(list_transform(range(1, len(o) + 1), lambda i: '  ' || {_LABEL} || '. ' || o[i][6:]), chr(10))) AS question_hash,
          md5(CASE WHEN p.n % 5 = 0 THEN '' ELSE '"' || coalesce(p.supporting_quotes, '') || '"' END) AS quotes_hash
        FROM (@p@) p JOIN (SELECT question_id, category, institution, city, source_url, page_title, model_used FROM (@questions@)) q USING (question_id)""", p=_PARSED).replace("n % 11", "p.n % 11").replace("n % 13", "p.n % 13"),
    "q_checkpoint_lines": sql("SELECT '{\"doc_id\":\"' || question_id || '\",\"pairs\":[{\"question\":\"' || md5(question) || '\",\"answer\":\"' || coalesce(answer, '') || '\"}]}' AS value FROM (@questions@)"),
    "q_search_hits": "SELECT user_id AS query, event_id % 9 AS rank, 'https://ex.org/' || event_id AS url, least(1200, 200 * length(props)) AS n_chars FROM events WHERE event_id % 4 <> 0 AND event_id % 9 <= 5",
    "q_recorded_calls": sql("SELECT question_id AS request_key, CAST(n % 3 = 0 OR n % 19 = 0 AS INTEGER) AS failed, CASE WHEN n % 3 = 0 OR n % 19 = 0 THEN 0 ELSE 1 END AS n_questions FROM (@questions@)"),
    "q_existing_keys": "SELECT DISTINCT city, category FROM question_table",
}
QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
