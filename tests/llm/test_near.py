"""p5_found against a comparison of all pairs."""

import __spark_entry__ as entries
from quern.sources.tables import table
from quern.llm.near import near_pairs, similarity, words

FOLDER = "/root/testdata/sf0.01"


def plain(rows):
    """All pairs by counting common runs."""
    at, sizes, common = {}, {}, {}
    for kind, i, text in set(rows):
        w = words(text or "")
        if len(w) < 40:
            continue
        runs = set(zip(w, w[1:], w[2:]))
        sizes[kind, i] = len(runs)
        for r in runs:
            for j in at.setdefault((kind, r), []):
                k = (kind, min(i, j), max(i, j))
                common[k] = common.get(k, 0) + 1
            at[kind, r].append(i)
    return sorted(k for k, n in common.items() if n >= 0.6 * (sizes[k[0], k[1]] + sizes[k[0], k[2]] - n))


def test_query_same_as_all_pairs(spark):
    rows = [("document", r[0], r[1]) for r in table(spark, FOLDER, "corpus_docs").select("doc_id", "full_text").collect()]
    rows += [("question", r[0], r[1]) for r in table(spark, FOLDER, "question_table").select("question_id", "question").collect()]
    found = sorted(tuple(r) for r in entries.queries()["p5_found"](spark, FOLDER).collect())
    assert found and found == plain(rows)


def test_kinds_stay_apart_and_short_texts_are_none(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [("document", "a", text), ("document", "b", text.upper()), ("document", "b", text.upper()), ("question", "a", text), ("document", "c", "word1 word2"), ("document", "d", "word1 word2"), ("document", "e", None)]
    df = near_pairs(spark.createDataFrame(rows, "item_kind string, id string, text string"))
    assert [tuple(r) for r in df.collect()] == [("document", "a", "b")]
    assert similarity(text, text + " end") == 58 / 59 and similarity("a b", "a b") == 0
