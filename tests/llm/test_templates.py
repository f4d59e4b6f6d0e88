"""p3_found: placeholders, messages and filler, and pages that only look like them."""

import numpy as np
import pytest

import __spark_entry__ as entries
from quern.llm.templates import PLACEHOLDER, SPAN, fit, judged_records, learn, template_records, without_templates
from quern.sources.tables import table

PAGE = "Fees\n\n" + "Every household can return the form to the counter within ten days of the notice, and the licensed clerk must file a copy of the original permit. " * 3
CASES = {
    "a": ("T", PAGE + "\n\nCall {{ phone }} for help."), "b": ("[Insert fee here]", PAGE), "c": ("T", PAGE + "\nAsk $fee_schedule$ or {0}"), "d": ("{page.title}", None),
    "e": ("T", "Skip to content\n\nThe page /x could not be found."), "f": ("T", "Lorem ipsum dolor amet elit sed magna " * 90), "g": ("T", "You need to enable JavaScript to run the app."),
    "h": ("Error", "Object reference not set: mefe.aspx line 19\nStack trace for Mefe hidden\n\nAccessibility statement"), "i": ("T", PAGE + "\n\nClosed on XX/XX/XXXX."),
}
OTHERS = {
    "p": ("Error in your rates notice", PAGE), "q": ("Lost and not found", PAGE + "\n\nAccess denied can be appealed [form 12B] {see note 3} [PDF, 2 MB], $ 20 and 30%."),
    "r": ("T", None), "s": ("T", " \r\n "), "t": (None, PAGE + "\n\nTurn on JavaScript. A page was not found."), "u": (None, None),
}


@pytest.fixture(scope="module")
def model(spark):
    return fit(table(spark, "/root/testdata/sf0.01", "corpus_docs"))


def test_cases_and_look_alikes(spark, model):
    rows = [(k, *v, True) for k, v in (CASES | OTHERS).items()]
    df = spark.createDataFrame(rows + rows[:1] + [(None, "T", PAGE, None)], "doc_id string, title string, full_text string, message boolean")
    assert sorted(r.doc_id for r in template_records(df, model=model).collect()) == sorted(CASES)
    assert {r.doc_id for r in without_templates(df, model=model).collect()} == {*OTHERS, None}
    assert judged_records(df, model=model).count() == len(rows) + 2


def test_empty_table_and_table_without_trusted_records(spark):
    df = spark.createDataFrame([("a", "T", PAGE), ("b", None, "short"), ("c", "x {{y}}", None)], "doc_id string, title string, full_text string")
    assert [r.doc_id for r in template_records(df).collect()] == ["c"]
    assert template_records(df.limit(0)).count() == 0


def test_learning_finds_positives_without_a_trusted_word():
    """Words 0..9 are trusted, 10..19 only stand with them or in hidden positives, 20..99 in the others."""
    pick = np.random.RandomState(3)
    make = lambda words: np.unique(pick.choice(words, 12), return_counts=True)
    positive = [make([*range(20)]) for _ in range(60)]
    hidden, others = [make([*range(10, 20)]) for _ in range(40)], [make([*range(20, 100)]) for _ in range(900)]
    weights, prior = learn(positive, hidden + others)
    score = lambda x: float((weights[x[0]] * x[1]).sum()) + prior
    assert all(score(x) > 0 for x in hidden) and all(score(x) < 0 for x in others)


def test_every_placeholder_form_is_seen_as_a_span():
    forms = "{{a.b}} {% block x %} ${a.b} {!a.b} {officer_name} {0} %(deadline)s <%= x %> <<Department Name>> [[map]] [[[title]]] %%X%% @@x_y@@ &&X&& #FIRST_NAME# __X_Y__ $x$ XX/XX/XXXX".split(" ")
    text = " and ".join([*forms, "[object Object]", "undefined undefined", "[Insert fee]", "[TBC - add link]", "<insert hours>", "[your council name]"])
    found = [x for x in SPAN.findall("{% block x %} <%= x %> <<Department Name>> " + text) if PLACEHOLDER.fullmatch(x)]
    assert len(found) >= 22


def test_registered(spark):
    df = entries.queries()["p3_found"](spark, "/root/testdata/sf0.001")
    assert df.dtypes == [("doc_id", "string")] and df.count() > 0
