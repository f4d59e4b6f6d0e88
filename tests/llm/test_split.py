"""The pieces of a text: within the limit, in order, and each with the end of the one before."""

import pytest

from quern.llm.split import pieces

LIMIT, OVERLAP = 2_000, 200


def overlaps(text):
    spans, _ = pieces(text)
    assert spans[0][0] == len(text) - len(text.lstrip()) and spans[-1][1] == len(text.rstrip())
    assert all(e - s <= LIMIT for s, e in spans)
    for (s, e), (t, f) in zip(spans, spans[1:]):
        assert s < t and e < f and not text[e:t].strip() and e - t <= OVERLAP
    return [max(0, e - t) for (_, e), (t, _) in zip(spans, spans[1:])]


def test_unbroken_run_repeats_the_whole_overlap():
    assert set(overlaps("x" * 10_000)) == {OVERLAP}


@pytest.mark.parametrize("size", [30, 45, 90])
def test_short_paragraphs_leave_room_for_the_overlap(size):
    paragraph = ("a civic page tells people what to do " * 5)[: size - 1].strip() + "."
    found = overlaps("\n\n".join([paragraph] * (3_900 // (size + 2))))
    assert found and all(x >= OVERLAP - size - 4 for x in found)


def test_a_unit_that_leaves_no_room_gets_what_is_left():
    first, second = overlaps("aa " * 333 + "\n\n" + "b c" * 633 + "\n\n" + "d e " * 100)
    assert 90 <= first < 100 and second >= 190


def test_a_long_last_sentence_is_repeated_from_a_word():
    long = ("word " * 60).strip() + "."
    text = "\n\n".join(["Short one. " * 120 + long, "Another. " * 150 + long, "Last. " * 100])
    found = overlaps(text)
    assert found and all(x > OVERLAP - 6 for x in found)


def test_one_long_stretch_at_the_end_is_repeated_by_characters():
    assert overlaps("word " * 300 + "x" * 250 + "\n\n" + "word " * 300) == [OVERLAP]


def test_no_room_for_any_overlap_starts_at_the_unit():
    text = "aa " * 600 + "\n\n\n\n" + "b c" * 666 + "b"
    spans, _ = pieces(text)
    assert spans[1] == (text.index("b"), len(text))


def test_narrow_and_wide_comparison_give_the_same_cuts():
    import random

    from quern.llm.split import cuts, units

    pick = random.Random(8)
    for size in (3, 30, 300):
        text = "".join(pick.choice(["word ", "ab. ", "x" * pick.randrange(1, size), "\n\n", " "]) for _ in range(2_500))
        for limit, overlap in ((2_000, 200), (500, 50), (60, 10)):
            parts, _ = units(text, limit, overlap)
            assert cuts(parts, limit, overlap, wide=0) == cuts(parts, limit, overlap, wide=10**9)


def test_rows_nulls_ties_and_clashing_columns(spark):
    from quern.llm.split import split_texts

    df = spark.createDataFrame([("a", "word " * 900, 1), ("a", "word " * 900, 1), (None, "x" * 2001, 2), ("c", None, 3), ("d", "", 4), ("e", " " * 3000, 5), ("f", "y" * 2000, 6)], "k string, t string, piece_no int")
    rows = split_texts(df, "k", "t").collect()
    assert {r.k for r in rows} == {"a", None, "e"} and all(r.piece is None or len(r.piece) <= 2000 for r in rows)
    assert [r.piece for r in rows if r.k == "e"] == [None] and {r.boundary for r in rows if r.k is None} == {"none"}
    assert split_texts(df.limit(0), "k", "t").count() == 0
