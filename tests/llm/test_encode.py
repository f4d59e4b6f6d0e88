"""p7_ids against the public library, the rank queue, and its cost on long pre-tokens."""

import random
import time

import pytest

from quern.llm.encode import Encoder, RankQueue, token_ids, vocabulary_path

TEXTS = ["", " ", "Hello  world's\n\n end", "ＡＢ é ñ 漢字 🙂‍🙂 \x00 ", "<|endoftext|> x", "a" * 3000, "0123456789" * 50, "'s't're" * 9, "\r\n\t  \xa0x", "ß" * 500, "co­op ​ zero"]


@pytest.fixture(scope="module")
def encoder():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return Encoder(f.read())


def test_same_ids_as_the_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    pick = random.Random(5)
    texts = TEXTS + ["".join(chr(pick.choice([pick.randrange(32, 127), pick.randrange(160, 0x2FFF), 32, 10])) for _ in range(80)) for _ in range(300)]
    for text, found in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert encoder.encode(text) == found.ids, repr(text)


def test_queue_takes_the_lowest_rank_with_sorted_positions():
    pick, queue, held = random.Random(1), RankQueue(), {}
    for _ in range(3000):
        if held and pick.random() < 0.3:
            rank, positions = queue.take()
            assert rank == min(held) and positions == sorted(held.pop(rank))
        else:
            rank, at = pick.randrange(50_000), pick.randrange(10**6)
            queue.put(rank, at)
            held.setdefault(rank, []).append(at)


def test_long_pretokens_cost_in_proportion(encoder):
    def seconds(n):
        began = time.perf_counter()
        encoder.piece("".join(random.Random(n).choice("abcdefgh") for _ in range(n)))
        return time.perf_counter() - began

    seconds(20_000)
    assert seconds(200_000) < 40 * seconds(20_000)


def test_nulls_empty_repeated_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (2, "", 0), (None, None, 0)], "doc_id bigint, text string, ids int")
    rows = sorted(((r.doc_id or 0, r.ids) for r in token_ids(df).collect()), key=str)
    assert rows == sorted([(1, [64, 275]), (1, [64, 275]), (2, []), (0, None)], key=str)
    assert token_ids(df.limit(0)).count() == 0
