"""Records that are copies of one another up to small edits: pairs, and the groups made of them.

1. Each text gets a signature of ``BANDS * ROWS`` min-hashes over its runs of three words, and an identity of its
   whole word sequence. Exact copies fall together under one identity before anything is compared.
2. Distinct texts that share a band of ``ROWS`` min-hashes are candidates.
3. Sequential Bayesian verification: the signatures of a candidate are compared batch by batch. After n min-hashes
   with m equal, the posterior of the similarity (uniform prior) is a Beta distribution; a candidate is pruned as soon
   as its probability to reach ``LEAST`` falls below ``MISS``.
4. The survivors are verified exactly on their whole texts, so no pair is reported that is not one.

A pair is lost by the bands with probability (1 - s**ROWS)**BANDS: 0.003 at s = 0.6 exactly, 0.0001 at 0.65, and by
the pruning with at most ``MISS`` for each batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import slices
from quern.llm.words import per_word, word_table
from quern.plans.lineage import checked_broadcast, cut

WORDS, RUN, LEAST = 40, 3, 0.6
BANDS, ROWS = 72, 5
#: Min-hashes compared at once, and the probability at which a true pair may be pruned by one comparison.
BATCH, MISS = 40, 1e-5
SIZE = BANDS * ROWS
_WORD = re.compile(r"[^\W_]+")
_seed = np.random.RandomState(7)
_A = _seed.randint(0, 2**31, SIZE).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_B = _seed.randint(0, 2**31, SIZE).astype(np.uint32)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def words(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return " ".join(_WORD.findall(text)).lower().split(" ")


def similarity(a: str, b: str) -> float:
    """The share of the union of the runs of both texts that both have; 0 if one has fewer than ``WORDS`` words."""
    sets = []
    for w in (words(a), words(b)):
        if len(w) < WORDS:
            return 0.0
        sets.append(set(zip(w, w[1:], w[2:])))
    both = len(sets[0] & sets[1])
    return both / (len(sets[0]) + len(sets[1]) - both)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, identities, signatures) of the texts with at least ``WORDS`` words; 16 bits of each min-hash are kept."""
    offsets, codes, vocabulary = word_table(texts)
    h = per_word(vocabulary, lambda w: xxhash.xxh3_64_intdigest(w.encode()), np.uint64)[codes]
    rows = np.flatnonzero(np.diff(offsets) >= WORDS)
    identity = np.empty(len(rows), np.int64)
    out = np.empty((len(rows), SIZE), np.uint16)
    for k, i in enumerate(rows.tolist()):
        w = h[offsets[i] : offsets[i + 1]]
        identity[k] = xxhash.xxh3_64_intdigest(w.tobytes()) - 2**63
        x = w[:-2] * _MIX[0] + (w[1:-1] ^ (w[:-2] << np.uint64(29))) * _MIX[1] + w[2:] * _MIX[2]
        x ^= x >> np.uint64(31)
        x = ((x * _MIX[1]) >> np.uint64(32)).astype(np.uint32)
        least = np.full(SIZE, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 128):
            np.minimum(least, (x[at : at + 128, None] * _A + _B).min(axis=0), out=least)
        out[k] = least >> np.uint32(16)
    return rows, identity, out


def bands(signature: np.ndarray) -> np.ndarray:
    """The band keys (64 bits) of each signature, one column a band."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[2], (len(signature), 1))
    for r in range(ROWS):
        key = (key ^ rows[:, :, r]) * _MIX[0]
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def least_matches(least: float = LEAST, miss: float = MISS, size: int = SIZE, batch: int = BATCH) -> np.ndarray:
    """For each number of batches the fewest equal min-hashes with which a pair is kept.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1), and the probability that it
    is at least ``least`` is that of at most m successes in n + 1 trials of probability ``least``."""
    out = []
    for n in range(batch, size + 1, batch):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * least**m * (1 - least) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def pruned(a: np.ndarray, b: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
    """The rows of two signature matrices that survive the sequential comparison; each batch is compared for the rows
    still alive only."""
    least = least_matches() if least is None else least
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, need in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches += (a[alive, part] == b[alive, part]).sum(axis=1)
        kept = matches >= need
        alive, matches = alive[kept], matches[kept]
        if not len(alive):
            break
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SIZE)


def signed_records(texts: DataFrame) -> DataFrame:
    """(item_kind, id, row, key, sig) of ``texts`` (item_kind, id, text): ``row`` is a hash of kind and id, ``key`` the
    identity of kind and word sequence. Null and short texts and null ids are left out."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows, identity, signature = signatures(batch.column("text"))
            if len(rows):
                at = pa.array(rows)
                sig = pa.array([x.tobytes() for x in signature], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("item_kind", "id", "row")), pa.array(identity), sig], names=["item_kind", "id", "row", "key", "sig"])

    keyed = texts.where("text is not null and id is not null and item_kind is not null").select("item_kind", "id", F.xxhash64("item_kind", "id").alias("row"), "text")
    signed = keyed.mapInArrow(sign, "item_kind string, id string, row bigint, key bigint, sig binary")
    return signed.withColumn("key", F.xxhash64("item_kind", "key"))


def candidates(distinct: DataFrame) -> DataFrame:
    """(a, b), a < b, distinct: the keys of ``distinct`` (key, sig) that share a band. The bands meet in a join by
    their key, whose large groups adaptive execution splits; no group is gathered into one row."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = pa.array(np.repeat(np.arange(batch.num_rows, dtype=np.int32), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(bands(_matrix(batch.column("sig"))).ravel()), batch.column("key").take(at)], names=["band", "key"])

    banded = distinct.select("key", "sig").mapInArrow(explode, "band bigint, key bigint")
    a, b = banded.select("band", F.col("key").alias("a")), banded.select("band", F.col("key").alias("b"))
    return a.join(b, "band").where("a < b").select("a", "b").distinct()


def survivors(pairs: DataFrame, distinct: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of keys that the sequential comparison of their signatures leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                kept = pa.array(pruned(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b"))))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(kept) for c in "ab"], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    held = distinct.join(checked_broadcast(wanted), "key").select("key", "sig")
    a, b = (held.select(F.col("key").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, representatives: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``pairs`` of keys whose texts are exactly similar enough. ``representatives``: (key, row), one row a key.
    Only the texts of these pairs are gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], "text_a"):
                held = [x >= LEAST for x in map(similarity, part.column("text_a").to_pylist(), part.column("text_b").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(held, pa.bool_())) for c in "ab"], names=["a", "b"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    rows = cut(wanted.join(representatives, "key").select("key", "row"))
    keyed = texts.select(F.xxhash64("item_kind", "id").alias("row"), "text").where("text is not null")
    held = keyed.join(checked_broadcast(rows), "row").dropDuplicates(["key"]).select("key", "text")
    a, b = (held.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").mapInArrow(run, "a bigint, b bigint")


def near_links(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has (item_kind, id, key), one row for each record with enough words; links has the
    pairs (a, b) of keys of different word sequences that are similar. Copies are not expanded."""
    signed = cut(signed_records(texts))
    distinct = signed.groupBy("key").agg(F.min("row").alias("row"), F.min_by("sig", "row").alias("sig"))
    pairs = cut(candidates(distinct))
    left = cut(survivors(pairs, signed.select("key", "sig").dropDuplicates(["key"])))
    links = cut(verified(left, distinct.select("key", "row"), texts))
    return signed.select("item_kind", "id", "key").distinct(), links


def near_pairs(texts: DataFrame) -> DataFrame:
    """(item_kind, id_a, id_b), distinct, of ``texts`` (item_kind, id, text): the pairs of different ids of one kind
    whose texts have a similarity of at least ``LEAST``. Null and short texts give nothing; repeated rows count once;
    an empty table gives no rows; extra columns are never read.

    The links between different texts are expanded to all their copies, and copies to pairs, as the pairs of records
    are what is asked for; ``near_groups`` says the same without that expansion."""
    members, links = near_links(texts)
    a, b = (members.select(F.col("key").alias(x), F.col("item_kind").alias(f"kind_{x}"), F.col("id").alias(f"id_{x}")) for x in "ab")
    copies = a.join(b, F.col("a") == F.col("b")).where("id_a < id_b and kind_a = kind_b")
    linked = links.join(a, "a").join(b, "b").where("id_a != id_b and kind_a = kind_b")
    found = [x.select(F.col("kind_a").alias("item_kind"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")) for x in (copies, linked)]
    return found[0].unionByName(found[1]).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of the connected component of each node of ``links`` (a, b).

    Alternating large-star and small-star steps: every node's larger neighbours, then its smaller ones, are hung on
    its least neighbour. Nothing is collected but one count a round, a node of high degree is one partial minimum,
    and the rounds end when the links no longer change (their number grows with the logarithm of the nodes)."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small)
        changed = after.exceptAll(edges).limit(1).count() + edges.exceptAll(after).limit(1).count()
        edges = after
        if not changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_groups(texts: DataFrame) -> DataFrame:
    """(item_kind, id, group_id, links): one row for each record with enough words; ``group_id`` is the least id of
    the group that its pairs make (its own, if it has none), ``links`` the number of different texts that its text is
    linked to. Copies are in one group without links between them."""
    members, links = near_links(texts)
    degree = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("links"))
    rooted = members.join(components(links).withColumnRenamed("node", "key"), "key", "left").join(degree, "key", "left")
    rooted = rooted.select("item_kind", "id", F.coalesce("root", "key").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = rooted.groupBy("item_kind", "root").agg(F.min("id").alias("group_id"))
    return rooted.join(least, ["item_kind", "root"]).select("item_kind", "id", "group_id", "links")
