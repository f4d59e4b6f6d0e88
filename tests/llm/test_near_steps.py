"""The steps of near-duplicate search: pruning, candidates, groups."""

import random

import numpy as np
import pyarrow as pa

from quern.llm import near


def test_pruning_keeps_true_pairs_and_drops_random_ones():
    pick = np.random.RandomState(1)
    a = pick.randint(0, 65536, (2000, near.SIZE)).astype(np.uint16)
    for share, kept in ((0.7, 2000), (0.6, 1990), (0.05, 0)):
        b = np.where(pick.rand(*a.shape) < share, a, a + 1).astype(np.uint16)
        n = len(near.pruned(a, b))
        assert n >= kept if kept else n == 0


def test_least_matches_grow_with_the_evidence():
    least = near.least_matches()
    assert (np.diff(least) > 0).all() and 0 < least[0] < 0.6 * near.BATCH and least[-1] < 0.6 * near.SIZE


def test_signature_estimates_the_similarity():
    pick = random.Random(5)
    base = [f"w{pick.randrange(5000)}" for _ in range(600)]
    other = base[:400] + [f"x{pick.randrange(5000)}" for _ in range(200)]
    rows, identity, sig = near.signatures(pa.array([" ".join(base), None, "too short", " ".join(other), " ".join(base).upper()]))
    assert rows.tolist() == [0, 3, 4] and identity[0] == identity[2] != identity[1]
    true = near.similarity(" ".join(base), " ".join(other))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.1


def test_groups_join_chains_and_copies(spark):
    pick = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(6):  # each differs from the next by a little, the first from the last by much
        rows.append(("document", f"d{k}", " ".join(base)))
        for i in pick.sample(range(120), 7):
            base[i] = f"n{k}_{i}"
    rows += [("document", "copy", rows[0][2].upper()), ("question", "q", rows[0][2]), ("document", "lone", " ".join(f"z{i}" for i in range(50))), ("document", "none", None)]
    df = spark.createDataFrame(rows, "item_kind string, id string, text string")
    found = {(r.item_kind, r.id): r.group_id for r in near.near_groups(df).collect()}
    assert {found["document", f"d{k}"] for k in range(6)} == {"copy"} == {found["document", "copy"]}
    assert found["question", "q"] == "q" and found["document", "lone"] == "lone" and ("document", "none") not in found
    assert near.near_groups(df.limit(0)).count() == 0 == near.near_pairs(df.limit(0)).count()
