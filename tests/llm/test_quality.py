"""p9_found: statistics, published rules, kinds."""

import pyarrow as pa
import pytest

from quern.llm.quality import STATISTICS, failed_rules, judge, statistics, text_quality

PROSE = "The clerk of the ward will keep a copy of the form. It is returned with the notice, and that is the end of the matter for most of us."
KINDS = {
    PROSE: "prose", "The office is open on Monday": "prose", "- apples\n- pears\n- plums\n- figs": "list", "Home | About | Maps | News | Contact | Search": "list",
    "a | 10 | 20\nb | 30 | 40\nc | 5 | 6": "table", "name\tcount\nx\t1\ny\t2\nz\t3": "table", "click here " * 5: "junk", "click here " * 40: "junk", "%$#@ ^^&* !!~~ ##": "junk",
    "xkcdq zzrtw bcdfg hjklm qwrtp sdfgh": "junk", "�� abc �� def �": "junk", "": "none", " \r\n\t": "none",
}


@pytest.mark.parametrize("text", KINDS, ids=lambda t: repr(t[:20]))
def test_kind(text):
    kinds, _ = judge(statistics(pa.array([text])))
    assert kinds[0] == KINDS[text]


def test_statistics_and_published_rules():
    s = {k: v[0] for k, v in statistics(pa.array([PROSE + "\nShort line\n* item (x) ..."])).items()}
    assert s["n_words"] == 34 and s["n_lines"] == 3 and s["stop_words"] == 5 and s["alphabetic_share"] == 1
    assert abs(s["end_punctuation_share"] - 2 / 3) < 1e-9 and abs(s["bullet_share"] - 1 / 3) < 1e-9 and abs(s["ellipsis_share"] - 1 / 3) < 1e-9 and abs(s["symbol_word_ratio"] - 1 / 34) < 1e-9
    failed = {name for name, hit in failed_rules(statistics(pa.array([PROSE]))) if hit[0]}
    assert failed == {"word_count"}
    long = {name for name, hit in failed_rules(statistics(pa.array([" ".join([PROSE] * 3)]))) if hit[0]}
    assert long == set()


def test_rows_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, PROSE, "x", "r"), (1, PROSE, "x", "r"), (None, "", "x", "r"), (3, None, "x", "r")], "doc_id bigint, text string, kind string, reasons string")
    rows = sorted((r.doc_id or 0, r.kind, r.n_words, tuple(r.failed_rules)) for r in text_quality(df).collect())
    assert rows == [(0, "none", 0.0, ()), (1, "prose", 30.0, ("word_count",)), (1, "prose", 30.0, ("word_count",)), (3, "none", None, ())]
    assert text_quality(df.limit(0)).count() == 0
    assert set(STATISTICS) <= set(text_quality(df).columns)
