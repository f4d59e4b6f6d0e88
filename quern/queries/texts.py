"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import identity, text, urls
from quern.operators import chunking
from quern.queries.shared import docs, questions, sql, strip_sql, url_sql
from quern.sources.tables import table


def q_text_normalize(spark, folder):
    """Without NFKC, which no SQL has (``q_text_nfkc`` has it)."""
    return table(spark, folder, "documents").select("doc_id", text.normalize(F.col("text"), unicode=False).alias("normalized"))


def q_text_nfkc(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


def q_keep_blank_lines(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.normalize(F.col("text"), least=0, unicode=False).alias("normalized"))


def q_short_line_filter(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.short_line_filter(F.col("text"), 20).alias("kept"))


def q_doc_identity(spark, folder):
    return docs(spark, folder, "source_uri", "full_text").select("source_uri", identity.doc_id(F.col("source_uri")).alias("made_id"), identity.content_hash(F.col("full_text")).alias("made_hash"), (F.col("doc_id") == identity.doc_id(F.col("source_uri"))).cast("int").alias("same"))


def q_chunk_identity(spark, folder):
    chunks = table(spark, folder, "chunks").distinct()
    return chunks.select("chunk_id", identity.chunk_id(F.col("doc_id"), F.col("idx"), F.col("text")).alias("made_id"))


def q_word_count_junk(spark, folder):
    t = F.col("text")
    return table(spark, folder, "documents").select("doc_id", text.word_count(t).alias("n_words"), text.is_junk(t).cast("int").alias("junk"))


def q_sentence_split(spark, folder):
    parts = text.sentence_split(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.size(parts).alias("n_sentences"), F.array_max(F.transform(parts, F.length)).alias("longest"))


def q_paragraph_split(spark, folder):
    parts = text.paragraph_split(F.col("full_text"))
    return docs(spark, folder, "full_text").select("doc_id", F.size(parts).alias("n_paragraphs"), F.element_at(F.when(F.size(parts) > 0, parts), 1).alias("first_one"))


def q_sentence_pack(spark, folder):
    return chunking.sentence_pieces(table(spark, folder, "documents").where("text != ''"), "doc_id", "text").select("doc_id", "idx", "text")


def q_chunks(spark, folder):
    return chunking.chunk_documents(docs(spark, folder, "full_text"))


def q_heading_sections(spark, folder):
    return chunking.section_bodies(docs(spark, folder, "full_text").select("doc_id", F.replace("full_text", F.lit("\r"), F.lit("")).alias("full_text")))


def q_url_normalize(spark, folder):
    uris = docs(spark, folder, "source_uri").select(F.col("source_uri").alias("url")).union(questions(spark, folder).select("source_url")).distinct()
    return uris.select("url", urls.normalize_url(F.col("url")).alias("normalized"), F.coalesce(urls.host_of(F.col("url")), F.lit("")).alias("host"))


def q_url_slug(spark, folder):
    return docs(spark, folder, "title", "source_uri").select("doc_id", text.slugify(F.col("title")).alias("slug"), urls.title_from_uri(F.col("source_uri")).alias("last_part"), text.path_part(F.col("title")).alias("part"))


def q_tool_url_filter(spark, folder):
    from quern.sources.pages import without_tool_pages

    return without_tool_pages(docs(spark, folder, "source_uri"), "source_uri").select("doc_id", "source_uri")


def q_city_display(spark, folder):
    return table(spark, folder, "institutions").select("short_name", text.display_name(F.col("short_name")).alias("display"))


def q_quote_normalize(spark, folder):
    return table(spark, folder, "eval_items").select("item_id", text.quote_normalize(F.col("text")).alias("normalized"))


def q_coercions(spark, folder):
    events = table(spark, folder, "events")
    props = F.get_json_object("props", "$.k")
    return events.select(
        "event_id", text.is_zero(F.floor("value").cast("string")).cast("int").alias("is_zero"), text.truthy(F.when(F.col("event_id") % 3 == 0, F.lit(" TRUE ")).otherwise(props)).cast("int").alias("truthy"),
        text.or_empty(props).alias("k"), text.clamp(props.cast("int"), 7, 10).alias("clamped"), text.letter(text.clamp(props.cast("int"), 7, 10)).alias("max_label"),
        text.percent(props.cast("int"), F.lit(64)).alias("pct"), text.pipe_join(F.array("event_type", props)).alias("joined"), F.size(text.pipe_split(F.concat_ws(" | ", "event_type", F.lit(""), props))).alias("n_parts"),
    )


def q_prompt(spark, folder):
    """A prompt filled from columns; braces in a value stay as they are."""
    header = F.when(F.col("institution").isNotNull(), F.concat(F.lit("Institution: "), "institution", F.lit("\n\n"))).otherwise("")
    filled = text.fill_template("{header}Question for {place}: {question}\n(Select all that apply)", header=header, place=text.display_name(F.col("city")), question=F.col("question"))
    return questions(spark, folder).select("question_id", filled.alias("prompt"), identity.request_key("m1", F.col("question_id"), "v1").alias("request_key"))


def q_context_prompt(spark, folder):
    from quern.functions import prompts

    name = prompts.context_name(F.when(F.col("n") % 2 == 0, F.col("institution")), F.col("city"), suffix="Oceania")
    return questions(spark, folder).select("question_id", name.alias("context"), F.md5(prompts.question_prompt(name, F.col("question"))).alias("prompt_hash"), F.md5(prompts.source_prompt(F.col("supporting_quotes"), F.col("question"))).alias("source_hash"))


def q_institution_header(spark, folder):
    from quern.functions import prompts

    return table(spark, folder, "institutions").select("short_name", prompts.institution_header(F.col("institution"), F.col("country"), F.col("layer")).alias("header"))


_NORMAL = "regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '@HWS@+', ' ', 'g')"
_LINES = "array_to_string(list_filter(string_split(@t@, chr(10)), lambda x: length({}) >= @n@), chr(10))".format(strip_sql("x"))
_TIDY = "regexp_replace({}, '\\n{{3,}}', chr(10) || chr(10), 'g')"

SQL = {
    "q_text_normalize": sql("SELECT doc_id, " + strip_sql(_TIDY.format(_LINES)) + " AS normalized FROM documents", t=_NORMAL, n="3"),
    "q_keep_blank_lines": sql("SELECT doc_id, " + strip_sql(_TIDY.format(_NORMAL)) + " AS normalized FROM documents"),
    "q_short_line_filter": sql(f"SELECT doc_id, {_LINES} AS kept FROM documents", t="text", n="20"),
    "q_doc_identity": sql("SELECT source_uri, substr(sha256(source_uri), 1, 16) AS made_id, sha256(full_text) AS made_hash, CAST(doc_id = substr(sha256(source_uri), 1, 16) AS INTEGER) AS same FROM (@docs@)"),
    "q_chunk_identity": "SELECT chunk_id, substr(sha256(doc_id || '::' || idx || '::' || text), 1, 16) AS made_id FROM (SELECT DISTINCT * FROM chunks)",
    "q_word_count_junk": sql("""
        SELECT doc_id, len(w) AS n_words, CAST(coalesce(len(w) < 30 OR regexp_matches(lower(text), 'think you were a bot|pardon our interruption|please enable javascript|access to this page has been denied|request unsuccessful\\. incapsula|checking your browser before accessing'), true) AS INTEGER) AS junk
        FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '@WS@+'), lambda x: x <> '') AS w FROM documents)"""),
    "q_sentence_split": sql("SELECT doc_id, len(p) AS n_sentences, list_max(list_transform(p, lambda x: length(x))) AS longest FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])@WS@+', '\\1' || chr(1), 'g'), chr(1)) AS p FROM documents)"),
    "q_paragraph_split": sql(f"""
        SELECT doc_id, len(p) AS n_paragraphs, p[1] AS first_one
        FROM (SELECT doc_id, list_filter(list_transform(string_split(full_text, chr(10) || chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS p FROM (@docs@))"""),
    "q_heading_sections": sql(f"""
        WITH lines AS (
          SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS no FROM (SELECT doc_id, string_split(replace(full_text, chr(13), ''), chr(10)) AS l FROM (@docs@) WHERE full_text IS NOT NULL)
        ), bare AS (
          SELECT *, {strip_sql('line')} AS b FROM lines
        ), marked AS (
          SELECT *, coalesce(lag(b = '') OVER w, true) AND length(b) BETWEEN 1 AND 120 AND (regexp_matches(b, '^(?:[0-9]+\\.)+@WS@+[^\\s].*$') OR regexp_matches(b, '^[A-Z][A-Z0-9 \\-&:,/]{{3,}}$') OR regexp_matches(b, '^#{{1,4}}@WS@+[^\\s].*$')) AS h
          FROM bare WINDOW w AS (PARTITION BY doc_id ORDER BY no)
        ), numbered AS (
          SELECT *, CAST(sum(h::INT) OVER (PARTITION BY doc_id ORDER BY no) AS INTEGER) AS section_no FROM marked
        ), joined AS (
          SELECT doc_id, section_no, coalesce(max(b) FILTER (h), '') AS title, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT h), '') AS t FROM numbered GROUP BY ALL
        )
        SELECT doc_id, section_no, title, {strip_sql('t')} AS body FROM joined WHERE title <> '' OR {strip_sql('t')} <> ''"""),
    "q_url_normalize": sql(f"""
        SELECT url, {url_sql('url')} AS normalized,
          coalesce(regexp_replace(regexp_replace(regexp_extract(lower({strip_sql('url')}), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)', 1), '\\.+$', ''), '^www\\.', ''), '') AS host
        FROM (SELECT source_uri AS url FROM corpus_docs UNION SELECT source_url FROM question_table)"""),
    "q_url_slug": sql(f"""
        SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, string_split(regexp_replace(source_uri, '/+$', ''), '/')[-1] AS last_part,
          replace(lower({strip_sql('title')}), ' ', '_') AS part FROM (@docs@)"""),
    "q_tool_url_filter": sql("SELECT doc_id, source_uri FROM (@docs@) WHERE NOT regexp_matches(lower(source_uri), 'finder|tool|submit|submission|application-submission')"),
    "q_city_display": "SELECT short_name, array_to_string(list_transform(list_filter(string_split(replace(short_name, '-', '_'), '_'), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS display FROM institutions",
    "q_quote_normalize": sql("SELECT item_id, " + strip_sql("regexp_replace(regexp_replace(lower(text), '[$€£¥₹%''\"`‘’“”–—-]', '', 'g'), '@WS@+', ' ', 'g')") + " AS normalized FROM eval_items"),
    "q_coercions": """
        SELECT event_id, CAST(floor(value) = 0 AS INTEGER) AS is_zero, CAST(CASE WHEN event_id % 3 = 0 THEN true ELSE k = '1' END AS INTEGER) AS truthy, coalesce(trim(k), '') AS k,
          least(10, greatest(7, CAST(k AS INTEGER))) AS clamped, chr(64 + least(10, greatest(7, CAST(k AS INTEGER)))) AS max_label, CAST(round_even(CAST(k AS DOUBLE) * 100 / 64, 1) AS DOUBLE) AS pct, event_type || ' | ' || k AS joined, 2 AS n_parts
        FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)""",
    "q_context_prompt": sql("""
        SELECT question_id, c AS context, md5(CASE WHEN c <> '' THEN 'This question is about ' || c || '.' || chr(10) || chr(10) ELSE '' END || coalesce(question, '') || chr(10) || chr(10) || '(Select all that apply)') AS prompt_hash,
          md5('Use ONLY the source text below to answer. Do not use any outside knowledge.' || chr(10) || chr(10) || 'Source page:' || chr(10) || coalesce(supporting_quotes, '') || chr(10) || chr(10) || 'Question:' || chr(10) || coalesce(question, '') || chr(10)) AS source_hash
        FROM (SELECT *, coalesce(CASE WHEN n % 2 = 0 THEN nullif(institution, '') END, CASE WHEN coalesce(city, '') = '' THEN '' ELSE array_to_string(list_transform(list_filter(string_split(replace(city, '-', '_'), '_'), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), ' ') || ', Oceania' END) AS c FROM (@questions@))"""),
    "q_institution_header": "SELECT short_name, 'Institution: ' || institution || ' (' || country || ', ' || layer || ' level)' || chr(10) || chr(10) AS header FROM institutions",
    "q_prompt": sql("""
        SELECT question_id, coalesce('Institution: ' || institution || chr(10) || chr(10), '') || 'Question for '
          || array_to_string(list_transform(list_filter(string_split(replace(coalesce(city, ''), '-', '_'), '_'), lambda x: x <> ''), lambda x: upper(x[1]) || lower(x[2:])), ' ')
          || ': ' || coalesce(question, '') || chr(10) || '(Select all that apply)' AS prompt, 'm1|' || question_id || '|v1' AS request_key
        FROM (@questions@)"""),
}
QUERIES = {k: f for k, f in list(globals().items()) if k.startswith("q_")}
