"""p4_found: what stays of a page and what goes."""

import pyarrow as pa

import __spark_entry__ as entries
from quern.llm.boilerplate import boilerplate_lines, line_labels, main_content

LONG = "The rules of Ripotaki. Every household can return the form to the counter within ten days of the notice, and the clerk of the ward will keep a copy of it with the rest of the papers that came before, and so will the council. "
#: (main content or not, line); blank lines separate blocks
PAGE = [
    (False, "Skip to main content"), (None, ""), (False, "Forms | Login | Contact | Permits and licences | A to Z index"), (None, ""), (False, "Home » Payments / Renew a Ripotaki card"), (None, ""),
    (False, "• BY THE WEB TEAM"), (None, ""), (True, "Renew a Ripotaki card"), (None, ""), (True, LONG), (None, ""), (True, "## Deadlines at Ripotaki"), (None, ""), (True, LONG), (None, ""),
    (False, "We use cookies to make this site work."), (False, "Got it"), (None, ""), (True, "- the original permit from the counter and a copy of the notice with the stamp of the clerk on it"),
    (True, "- a signed letter of the landlord for the rest of the year and the number of the meter in the house"), (None, ""), (True, "Cookies and baked goods sold at Ripotaki stalls must carry a label."), (None, ""),
    (False, "Popular services"), (False, "Help with Tikagosa"), (False, "Report to Filafunu centre"), (None, ""), (False, "All content on this page is owned by District of Sarumere unless stated."), (None, ""), (True, LONG), (None, ""),
    (False, "© 2024 District of Sarumere"), (False, "Legal notices and privacy"), (False, "12 Harrow Lane, Sarumere"),
]


def test_page_line_by_line():
    text = "\r\n".join(x for _, x in PAGE)
    doc, number, main = line_labels(pa.array([text, None, "", " \n\t"]), pa.array(["Renew a Ripotaki card | District of Sarumere", None, "x", "y"]))
    assert set(doc.tolist()) == {0}
    assert {n: m for n, m in zip(number.tolist(), main.tolist())} == {i: m for i, (m, _) in enumerate(PAGE, 1) if m is not None}


def test_text_without_blank_lines():
    text = "\n".join(x for m, x in PAGE if m is not None)
    _, number, main = line_labels(pa.array([text]), pa.array([None], pa.string()))
    want = [m for m, _ in PAGE if m is not None]
    assert sum(a == b for a, b in zip(main.tolist(), want)) >= len(want) - 2


def test_message_of_an_error_page_is_content():
    _, _, main = line_labels(pa.array(["Skip to content\nMenu\n\nThe page /x could not be found.\nTry the map.\n\n© 2020 Town of Z"]), pa.array(["Error"]))
    assert main.tolist() == [False, False, True, True, False]


def test_rows_nulls_and_clashing_columns(spark):
    rows = [("a", LONG + "\n\nShare this page", "T", 1, True), ("a", LONG + "\n\nShare this page", "T", 1, True), (None, "Menu\n\n" + LONG, None, 2, False), ("c", None, "T", 3, None), ("d", "", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, full_text string, title string, line_no int, main boolean")
    assert sorted(map(tuple, boilerplate_lines(df).collect()), key=str) == [("a", 3), (None, 1)]
    kept = {r.doc_id: r.main_text for r in main_content(df).collect()}
    assert kept == {"a": LONG.strip(), None: LONG.strip(), "c": None, "d": ""}
    assert boilerplate_lines(df.limit(0)).count() == 0


def test_registered_over_the_whole_table(spark):
    df = entries.queries()["p4_found"](spark, "/root/testdata/sf0.001")
    assert df.dtypes == [("doc_id", "string"), ("line_no", "int")]
    rows = [tuple(r) for r in df.collect()]
    assert rows and len(rows) == len(set(rows))
