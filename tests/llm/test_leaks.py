"""p8_found against a plain comparison of all runs of words."""

import random

import __spark_entry__ as entries
from quern.sources.tables import table
from quern.llm.leaks import RUN, Items, words

FOLDER = "/root/testdata/sf0.001"


def plain(documents, items):
    def runs(text):
        w = words(text)
        return {tuple(w[i : i + RUN]) for i in range(len(w) - RUN + 1)}

    held = [(i, runs(t)) for i, t in items]
    return sorted({(k, i) for k, t in documents for mine in [runs(t)] for i, r in held if mine & r})


def test_words_are_normalized_and_joined():
    assert words("Co­operate ＡＢＣ１ ét​e, snake_case") == ["cooperate", "abc1", "éte", "snake", "case"]


def test_same_as_plain_on_random_texts():
    pick = random.Random(3)
    for size in (2, 3, 400):
        text = lambda n: " ".join(pick.choice("abcdefghij") * (1 + pick.randrange(size)) for _ in range(n))
        items = [(i, text(pick.randrange(5, 60))) for i in range(30)] + [(99, "")]
        docs = [text(pick.randrange(40)) + " " + pick.choice(items)[1][: pick.randrange(300)] + " zz " + text(5) for _ in range(60)]
        assert Items(items).found(docs) == plain(list(enumerate(docs)), items)


def test_eleven_words_are_not_enough_and_documents_do_not_run_on():
    item = [(7, " ".join(f"w{i}" for i in range(12)))]
    whole, most = item[0][1], " ".join(f"w{i}" for i in range(11))
    assert Items(item).found([most, "w11", "x " + whole + " x", whole.upper().replace(" ", ", ")]) == [(2, 7), (3, 7)]


def test_query_same_as_plain(spark):
    docs = [tuple(r) for r in table(spark, FOLDER, "documents").where("text is not null").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, FOLDER, "eval_items").select("item_id", "text").collect()]
    df = entries.queries()["p8_found"](spark, FOLDER)
    assert df.dtypes == [("doc_id", "bigint"), ("item_id", "bigint")]
    found = sorted(tuple(r) for r in df.collect())
    assert found and found == plain(docs, items)


def test_wavelet_ranks_and_places_same_as_counting():
    import numpy as np

    from quern.llm.leaks import Index, WaveletMatrix

    pick = np.random.RandomState(4)
    for top in (1, 2, 9, 300):
        s = pick.randint(0, top + 1, 500)
        tree = WaveletMatrix(s)
        c, i = pick.randint(0, top + 1, 200), pick.randint(0, 501, 200)
        assert tree.rank(c, i).tolist() == [int((s[:b] == a).sum()) for a, b in zip(c, i)]
        assert tree.at(np.arange(500)).tolist() == s.tolist()
    text = pick.randint(1, 4, 400)
    index = Index(text)
    pattern = text[37:42]
    low, high = index.ranges(pattern[None])
    there = [i for i in range(396) if (text[i : i + 5] == pattern).all()]
    assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == there


def test_spans_are_merged_and_removed(spark):
    from quern.llm.leaks import without_leaks

    passage = " ".join(f"word{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "before " + passage + ", after", "x"), (2, "nothing here", "y"), (3, None, "z"), (4, "Ｗide é " + passage.upper() + " end", "w")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, passage), (8, passage[: len(passage) - 7]), (9, None)], "item_id bigint, text string")
    found = {r.doc_id: r.clean_text for r in without_leaks(docs, items).collect()}
    assert found == {1: "before , after", 2: "nothing here", 3: None, 4: "Ｗide é  end"}
    assert without_leaks(docs.limit(0), items).count() == 0 and without_leaks(docs, items.limit(0)).count() == 4
