"""Operators on small tables: nulls, ties, repeated rows, empty tables, clashing columns, and rules SQL can't express."""

import random

import pytest
from pyspark.sql import functions as F

from quern.functions import identity, labels, prompts, text, urls
from quern.operators import audit, chunking, corpus, diagnose, evaluate, generate, html, sheets
from quern.plans.ordering import row_numbers, running_sum
from quern.queries.shared import strip_sql  # noqa: F401  (the pieces of SQL are importable by themselves)


def one(spark, value, *columns, kind="string"):
    """The values of column expressions over one row with the column v."""
    r = spark.createDataFrame([(value,)], f"v {kind}").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return r[0] if len(columns) == 1 else tuple(r)


def test_white_space_and_lines(spark):
    v = F.col("v")
    exotic = "\x1c a 　b \x85\n\n\n\nxy\r\nabc\rdef\t\t g "
    assert one(spark, exotic, text.strip(v)) == exotic.strip()
    assert one(spark, exotic, text.word_count(v)) == len(exotic.split())
    assert one(spark, exotic, text.normalize(v)) == "a b \nabc\ndef g"
    assert one(spark, exotic, text.normalize(v, least=0)) == "a b \n\nxy\nabc\ndef g"
    assert one(spark, "ﬁ ① ＡＢ", text.nfkc(v)) == "fi 1 AB" and one(spark, None, text.normalize(v)) is None and one(spark, "", text.normalize(v)) == ""


@pytest.mark.parametrize("line,held", [("1. Scope", True), ("1.2. Scope of it", True), ("1.2 Scope", False), ("FEES AND COSTS", True), ("FEE", False), ("## Fees", True), ("##### Fees", False), ("Fees", False), ("", False), ("# " + "x" * 130, False), (None, False)])
def test_heading(spark, line, held):
    assert one(spark, line, text.is_heading(F.col("v"))) is held


def test_values(spark):
    v = F.col("v")
    assert [one(spark, x, text.is_zero(v)) for x in ("0", "00", "0.0", "1", None, "x", "")] == [True, True, False, False, False, False, False]
    assert [one(spark, x, text.truthy(v)) for x in (" TRUE ", "1", "yes", "no", "", None)] == [True, True, True, False, False, False]
    assert one(spark, "a |  b | | c", text.pipe_split(v), text.pipe_split(v, trimmed=True)) == (["a", " b", "| c"], ["a", "b", "| c"])
    assert one(spark, None, text.pipe_split(v)) == [] and one(spark, "new-south_wALES_", text.display_name(v)) == "New South Wales" and one(spark, None, text.display_name(v)) == ""
    assert one(spark, '{"a": {"b"', text.json_field(v, "a")) == "" and one(spark, '{"a": "x"}', text.json_field(v, "a")) == "x"
    assert one(spark, "{b}", text.fill_template("{a}-{b}", a=v, b=F.lit("B"))) == "{b}-B"
    assert one(spark, "“Fee” is $1,0–5 %", text.quote_normalize(v)) == "fee is 1,05"


@pytest.mark.parametrize(
    "url,normal",
    [("HTTP://WWW.Ex.org/A/?q=1#f", "https://ex.org/A?q=1#f"), ("https://a", "https://a"), ("https://a/", "https://a/"), ("https://a//", "https://a"), ("http://a:80/x//", "https://a:80/x"), ("https://a/x?#", "https://a/x"), ("", ""), (" ", ""), (None, None), ("/data/x.pdf/", "/data/x.pdf"), ("ftp://www.a/b", "ftp://a/b")],
)
def test_url(spark, url, normal):
    assert one(spark, url, urls.normalize_url(F.col("v"))) == normal


def test_cited_urls(spark):
    found = one(spark, "See (https://a.b/c), HTTP://x.y/z?q=1. and https://a.b/c; <https://q.r> https://", urls.cited_urls(F.col("v")))
    assert found == ["https://a.b/c", "HTTP://x.y/z?q=1", "https://q.r"] and one(spark, None, urls.cited_urls(F.col("v"))) == []


@pytest.mark.parametrize(
    "response,found",
    [
        ("The bill has three parts.\n\nAnswer: F", ["F"]), ("A. half — TRUE per the page\nB. more — FALSE\nE. again — TRUE\n\nFinal answer: A, E", ["A", "E"]),
        ("A. Correct — matches\nB. Incorrect\nC. Correct — stated\nD. Incorrect — contradicts\nF. Correct\nH. Incorrect", ["A", "C", "F"]), ("I don't have enough information to decide.", []), ("Cities use A lot of Taxes. Option A says X.", []),
        ("Answer: A\nOn reflection.\nTherefore: B and C.", ["B", "C"]), ("**Answer:** Z, B", ["B"]), ("The correct option is D", ["D"]), ("", []), (None, []), ("A: True, see page\nB: not correct\nC: no", ["A"]),
    ],
)
def test_extract_labels(spark, response, found):
    assert one(spark, response, labels.extract_labels(F.col("v"), F.array(*map(F.lit, "ABCDEFGH")))) == found


def test_labels(spark):
    v = F.col("v")
    q = "Which U.S. fee?\n\n  A. one\n B. two\nC) three\n\tD. four\n  A. again"
    assert one(spark, q, labels.valid_labels(v)) == ["A", "B", "D"] and one(spark, None, labels.valid_labels(v)) == []
    assert one(spark, "d, a; x", labels.gold_labels(v, F.array(F.lit("A"), F.lit("D")))) == ["A", "D"]
    assert one(spark, None, labels.same_set(labels.letters(v), F.array().cast("array<string>"))) is True
    answers = spark.createDataFrame([("q", q, None, None, "m"), ("q", q, "a", "Answer: A", "m")], "question_id string, question string, gold_answer string, response string, model string")
    scored = evaluate.score(answers)
    assert [r.correct for r in scored.collect()] == [True, True]
    assert evaluate.accuracy_summary(scored.limit(0)).count() == 0 and evaluate.share_correct(scored, 3).first().pct_of_models_correct == 66.7 and evaluate.share_correct(scored, 0).first()[1] == 0.0


def test_cache_hit_is_never_doubled(spark):
    tasks = spark.createDataFrame([("k1",), ("k2",), (None,)], "cache_key string")
    cache = spark.createDataFrame([("k1", "a"), ("k1", "b"), (None, "c")], "cache_key string, text string")
    hits, misses = evaluate.probe_cache(tasks, cache)
    assert [tuple(r) for r in hits.collect()] == [("k1", "b")] and {r[0] for r in misses.collect()} == {"k2", None}


def test_pack_sentences_and_paragraphs():
    assert chunking.pack_sentences("Aa. Bb! Cc? Dd", 7) == ["Aa. Bb!", "Cc? Dd"] and chunking.pack_sentences("x" * 20 + ". y", 5) == ["x" * 20 + ".", "y"] and chunking.pack_sentences("", 5) == []
    assert chunking.pack_paragraphs("aaa\n\nbbb\n\nccc", 8, 3) == ["aaa\n\nbbb", "ccc"]
    assert chunking.pack_paragraphs("aaa\n\nb\n\nccc", 7, 3) == ["aaa\n\nb", "b\n\nccc"]
    assert chunking.pack_paragraphs("a\n\n" + "Long one. " * 3 + "\n\nb", 12, 5) == ["a", "Long one.", "Long one.", "Long one.", "b"]
    pick = random.Random(4)
    for _ in range(200):
        t = "\n\n".join("w" * pick.randrange(1, 60) for _ in range(pick.randrange(1, 30)))
        out = chunking.pack_paragraphs(t, 100, 20)
        assert all(len(c) <= 120 for c in out) and set(t.split("\n\n")) == {p for c in out for p in c.split("\n\n")}


def test_sections_carry_the_overlap():
    t = "intro\n\n# One\nbody a\n\nbody b\n\n# Empty\n\n# Two\nlast"
    assert chunking.sections(t) == [("", "intro"), ("# One", "body a\n\nbody b"), ("# Empty", ""), ("# Two", "last")]
    assert chunking.section_chunks(t, 100, 10) == [("", "intro"), ("# One", "intro\n\nbody a\n\nbody b"), ("# Two", "body b\n\nlast")]


def test_chunks_of_a_table(spark):
    df = spark.createDataFrame([("d", "# T\nx", 0), (None, "y", 0), ("e", None, 0), ("f", " ", 0)], "doc_id string, full_text string, idx int")
    rows = {(r.doc_id, r.idx, r.text, r.meta_json) for r in chunking.chunk_documents(df).collect()}
    assert rows == {("d", 0, "x", '{"section_title": "# T"}'), (None, 0, "y", "{}")}
    assert chunking.chunk_documents(df.limit(0)).count() == 0
    packed = chunking.sentence_pieces(spark.createDataFrame([("d", "Aa. Bb! Cc? Dd")], "doc_id string, full_text string"), limit=7)
    assert [r.text for r in packed.orderBy("idx").collect()] == chunking.pack_sentences("Aa. Bb! Cc? Dd", 7)


def test_sections_by_windows_same_as_by_python(spark):
    t = "x\n1. A b\n\n1. A b\ny\n\n\n# C d\n\nZZZZ\nq"
    rows = chunking.section_bodies(spark.createDataFrame([("d", t)], "doc_id string, full_text string")).orderBy("section_no").collect()
    assert [(r.title, r.body) for r in rows] == chunking.sections(t)


PAGE = """<!doctype html><html><head><title>Fees &amp; costs - Site</title><script>var a='</p>'</script></head><body><nav><a href=/>Home</a></nav>
<div class="x cookie-banner">We use cookies</div><div role="alert">Closed</div><main><h1>Fees</h1><p>One <b>two</b> three<p>Unclosed four<script>x()</script> tail</main><footer>Foot</footer></body></html>"""


def test_html(spark):
    root = html.parse(PAGE)
    assert html.title_of(root) == "Fees & costs" and "cookies" not in html.clean(root).text() and "Closed" not in html.clean(root).text()
    assert html.main_region(html.clean(root)) == "FeesOne two threeUnclosed four tail"
    assert html.main_region(html.parse("<p>x</p>")) is None and html.title_of(html.parse('<meta property="og:title" content=" T "><title>x</title>')) == "T"
    df = spark.createDataFrame([("u", PAGE, "old"), ("v", None, "old"), ("w", "", "old"), ("x", "<<<>>>&&", "old")], "url string, html string, title string")
    rows = {r.source_uri: r for r in html.build_documents(df, least=3).collect()}
    assert len(rows) == 4 and rows["v"].status == rows["w"].status == "no_page" and rows["x"].status == "no_text" and rows["u"].title == "Fees & costs"
    ok = html.build_documents(spark.createDataFrame([("u", "<main><p>" + "word and more, " * 40 + "</p></main>")], "url string, html string")).first()
    assert ok.status == "ok" and ok.strategy == "dense_recall" and ok.doc_id and ok.content_hash
    assert one(spark, "short", html.prefer_region(F.col("v"), F.lit("a much longer region text"))) == "a much longer region text" and one(spark, None, html.prefer_region(F.col("v"), F.lit(None).cast("string"))) is None


def test_running_sums_same_as_plain(spark):
    pick = random.Random(9)
    rows = [(i, pick.choice(["a", "b", None]), pick.choice([0, 1, 5, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, g string, v long").repartition(7)
    found = {r.i: (r.n, r.s) for r in running_sum(row_numbers(df, ["i"], "n"), ["i"], F.col("v"), "s", by=["g"], inclusive=False).collect()}
    held: dict = {}
    for i, g, v in rows:
        assert found[i] == (i + 1, held.get(g, 0))
        held[g] = held.get(g, 0) + (v or 0)
    assert row_numbers(df.limit(0), ["i"]).count() == 0


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("b", 1, "x"), (None, 1, "x")], "doc_id string, no int, t string")
    new = spark.createDataFrame([("a", 2, "y"), ("a", 3, "z"), ("c", 1, None)], "doc_id string, no int, t string")
    assert sorted(map(tuple, corpus.upsert_documents(old, new, [F.col("no")]).collect()), key=str) == sorted([("a", 3, "z"), ("b", 1, "x"), ("c", 1, None)], key=str)
    assert corpus.upsert_documents(old.limit(0), new.limit(0)).count() == 0
    chunks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", None)], "chunk_id string, doc_id string")
    kept = corpus.upsert_chunks(chunks, chunks.limit(0), new)
    assert {r.chunk_id for r in kept.collect()} == {"2", "3"}


def test_even_quotas():
    assert diagnose.even_quotas([("a", 100), ("b", 100), ("c", 2)], 10) == [4, 4, 2] and diagnose.even_quotas([("a", 1), ("b", 1)], 10) == [1, 1] and diagnose.even_quotas([], 5) == []
    assert diagnose.even_quotas([(k, 9) for k in "abcdefg"], 3) == [1, 1, 1, 0, 0, 0, 0] and sum(diagnose.even_quotas([("a", 50), ("b", 7), ("c", 31)], 60)) == 60


def test_samples(spark):
    rows = [(b, f"{b}{i}") for b in ("x", "y", None) for i in range(20)]
    df = spark.createDataFrame(rows + rows[:5], "bucket string, k string")
    even = diagnose.even_sample(df, ["bucket"], "k", 12).collect()
    assert len(even) == len({r.k for r in even}) == 12 and {sum(1 for r in even if r.bucket == b) for b in ("x", "y", None)} == {4}
    assert diagnose.even_sample(df.limit(0), ["bucket"], "k", 5).count() == 0 and diagnose.round_robin_sample(df, ["bucket"], "k", 7).count() == 7
    assert diagnose.cap_per_bucket(df, ["bucket"], "k", 3).count() == 9


def test_source_lookup(spark):
    questions = spark.createDataFrame([("q1", "http://www.a/x/", "North"), ("q2", "https://a/y", None), ("q3", None, "x"), ("q4", "", "x"), ("q1", "http://www.a/x/", "North")], "question_id string, source_url string, city string")
    pages = spark.createDataFrame([("https://a/x", "north", 2, "second"), ("https://A/x", "north", 1, "first"), ("https://a/x", "aaa", 0, "other"), ("https://a/y", "b", 0, None), ("https://a/y", "c", 0, "")], "source_uri string, corpus string, seq int, full_text string")
    found = {r.question_id: r.source_text for r in diagnose.source_lookup(questions, pages).collect()}
    assert found == {"q1": "first", "q2": "", "q3": None, "q4": None}


def test_failure_modes(spark):
    v = F.lit(True)
    assert one(spark, None, diagnose.failure_mode(v, v, ~v), diagnose.failure_mode(~v, v, v), diagnose.failure_mode(v, v, v), diagnose.failure_mode(v, ~v, v), diagnose.failure_mode(v, v, v, F.lit("x"))) == ("comprehension", "search_bypass", "grounding", "retrieval", "api_error")
    assert one(spark, "http://www.A/b/ | x", diagnose.cites(F.col("v"), F.lit("https://a/b"))) is True and one(spark, None, diagnose.cites(F.col("v"), F.lit("https://a/b"))) is False


def test_quotes(spark):
    df = spark.createDataFrame([(["“Fee”: $5", "x"], "the FEE: 5 and x"), ([], "t"), (None, "t"), (["—"], "t"), (["q"], None), (["absent", "y"], "y")], "quotes array<string>, full_text string")
    assert [(r.passed, r.failing_quote) for r in generate.verify_quotes(df).collect()] == [(True, None), (False, None), (False, None), (True, None), (False, "q"), (False, "absent")]


def test_question_faults(spark):
    good = ",".join(f'{{"label":"{c}","text":"t","is_correct":{"true" if c == "B" else "false"}}}' for c in "ABCDEFGH")
    texts = [f'{{"questions":[{{"question":"q","options":[{good}],"quotes":["x"]}}]}}', '{"questions":[{"question":" ","options":[]}]}', "{bad", None, '{"questions":[{"question":"q"}]}']
    rows = generate.validated(generate.explode_questions(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, completion string"))).collect()
    assert {r.k: (r.is_valid, len(r.issues)) for r in rows} == {0: (True, 0), 1: (False, 3), 4: (False, 2)} and next(r.answer for r in rows if r.k == 0) == "B"


def test_retries(spark):
    a = spark.createDataFrame([("q1", 1, []), ("q1", 2, ["B"]), ("q2", 1, ["A"]), ("q2", 2, ["C"]), ("q3", 1, []), ("q4", 2, ["D"])], "q string, attempt int, extracted array<string>")
    assert {r.q: r.extracted for r in evaluate.retry_resolved(a, ["q"]).collect()} == {"q1": ["B"], "q2": ["A"], "q3": [], "q4": ["D"]}


def test_audit(spark):
    df = spark.createDataFrame([("a", "u1", 10, 100), ("a", "u2", 90, 100), ("b", "u3", 5, None), ("b", "u4", 0, 50), ("b", "u5", 0, 0)], "corpus string, url string, current_chars int, page_chars int")
    rows = {r.url: (r.status, r.ratio) for r in audit.audited(df).collect()}
    assert rows == {"u1": ("yes", 0.1), "u2": ("no", 0.9), "u3": ("fetch_failed", -1.0), "u4": ("empty_page", 0.0), "u5": ("empty_page", -1.0)}
    assert [r.url for r in audit.suspects(audit.audited(df), 3).collect()] == ["u3", "u5", "u4"]


def test_sheets(spark):
    a, b = spark.createDataFrame([(1, "x"), (None, None)], "i int, t string"), spark.createDataFrame([("y", 2)], "t string, i int")
    assert sheets.union_sheets({"a": a}).count() == 1
    for bad in ({"a": a, "b": b}, {}):
        with pytest.raises(ValueError):
            sheets.union_sheets(bad)
    with pytest.raises(ValueError):
        sheets.union_sheets({"a": a}, ["k"])


def test_prompts_and_models():
    models = {"m1": "Lab/x", "m2": "other/y"}
    assert prompts.chosen_models(models, ["m2"], ["lab"]) == {"m2": "other/y"} and prompts.chosen_models(models, None, ["LAB "]) == {"m1": "Lab/x"} and prompts.chosen_models(models) == models
    for arguments in ((models, ["m3"]), (models, None, ["nobody"])):
        with pytest.raises(ValueError):
            prompts.chosen_models(*arguments)
    schema = {"type": "object", "additionalProperties": False, "properties": {"a": {"type": "number", "enum": [1]}, "b": {"type": "array", "items": {"type": "object", "additionalProperties": False, "properties": {"c": {"type": "string", "enum": ["x"]}}}}}}
    out = prompts.ordered_schema(schema)
    assert out["propertyOrdering"] == ["a", "b"] and "enum" not in out["properties"]["a"] and out["properties"]["b"]["items"]["propertyOrdering"] == ["c"] and "additionalProperties" in schema


def test_identity(spark):
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    v = F.col("v")
    assert one(spark, "é", identity.doc_id(v), identity.content_hash(v), identity.chunk_id(v, F.lit(3), F.lit("t")), identity.request_key("m", v, F.lit(None).cast("string"))) == (sha("é")[:16], sha("é"), sha("é::3::t")[:16], "m|é|")
