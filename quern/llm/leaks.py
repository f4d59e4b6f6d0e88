"""Documents that hold a passage of a held-out item.

Every shard of documents gets an FM-index over word numbers. Its transform (the word before each suffix in their
sorted order) stands in a wavelet matrix, whose ranks answer how often a word occurs before a place. All runs of
``RUN`` words of all items are searched at once, backwards, word by word from their last. The places of the suffixes
found come from sampled suffix positions: one in ``SAMPLE`` text positions is kept, the others are reached by steps to
the word before. Runs that overlap are merged to the spans to remove. Only words that occur in an item have a number,
and only stretches of at least ``RUN`` of them are indexed, as no other stretch can hold a run of an item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.llm.batches import slices

#: Consecutive words that a document and an item must share.
RUN = 12
#: Distance of the text positions whose suffixes are kept.
SAMPLE = 16
#: Bytes of item texts that are broadcast at once; more items are searched in blocks.
ITEM_BYTES = 32_000_000
_WORD = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"\S+")
_INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])


def words(text: str) -> list[str]:
    """Runs of letters and digits after NFKC, without soft hyphens and zero-width characters, in lower case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_INVISIBLE)
    return _WORD.findall(text.lower())


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of each word of ``words``, as far as the stretch without white space that it is in."""
    if text.isascii():
        return [m.span() for m in _WORD.finditer(text)]
    return [m.span() for m in _TOKEN.finditer(text) for _ in words(m.group())]


class WaveletMatrix:
    """Ranks over a sequence of numbers: one level of prefix counts of ones for each bit, from the highest."""

    def __init__(self, sequence: np.ndarray) -> None:
        self.bits = max(1, int(sequence.max()).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits):
            bit = (sequence >> (self.bits - 1 - level)) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each of ``symbols`` stands before the place in ``ends``."""
        low, high = np.zeros(len(ends), np.int64), ends.astype(np.int64)
        for level in range(self.bits):
            one = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            ones = self.ones[level]
            low, high = (np.where(one, self.zeros[level] + ones[x], x - ones[x]) for x in (low, high))
        return high - low

    def at(self, places: np.ndarray) -> np.ndarray:
        """The numbers at ``places``."""
        out, places = np.zeros(len(places), np.int64), places.astype(np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[places + 1] - ones[places]
            places = np.where(bit == 1, self.zeros[level] + ones[places], places - ones[places])
            out = out << 1 | bit
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of ``text`` in their order, by doubling the compared length."""
    n, rank, reach = len(text), np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while int(rank.max()) < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        rank = np.unique(rank * (n + 1) + after, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return np.argsort(rank)


class Index:
    """FM-index of a sequence of numbers from 1; 0 separates stretches and is in no pattern. Inside, all numbers are
    one higher, as the end of the whole sequence has a number of its own."""

    def __init__(self, sequence: np.ndarray) -> None:
        text = np.append(sequence.astype(np.int64) + 1, 0)
        self.n = len(text)
        order = suffix_order(text)
        before = text[order - 1]
        self.tree = WaveletMatrix(before)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        sampled = order % SAMPLE == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled)])
        self.positions = order[sampled]

    def ranges(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern (a row) the range of suffixes that begin with it, by backward search."""
        patterns = patterns + 1
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        there = patterns.max(axis=1) < len(self.first) - 1
        high[~there] = 0
        for column in patterns.T[::-1]:
            live = np.flatnonzero(high > low)
            if not len(live):
                break
            c = column[live]
            low[live], high[live] = (self.first[c] + self.tree.rank(c, x[live]) for x in (low, high))
        return low, high

    def locate(self, suffixes: np.ndarray) -> np.ndarray:
        """The text positions of suffixes, given by their place in the order."""
        out, at, left = np.zeros(len(suffixes), np.int64), suffixes.astype(np.int64), np.arange(len(suffixes))
        for steps in range(SAMPLE):
            kept = self.sampled[at + 1] > self.sampled[at]
            out[left[kept]] = self.positions[self.sampled[at[kept]]] + steps
            left, at = left[~kept], at[~kept]
            if not len(left):
                break
            c = self.tree.at(at)
            at = self.first[c] + self.tree.rank(c, at)
        return out


def merge(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The spans [start, start + length), merged where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for s in np.unique(starts).tolist():
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + length)
        else:
            out.append((s, s + length))
    return out


class Items:
    """The word numbers of the items, their distinct runs, and the items of each run."""

    def __init__(self, items: list[tuple]) -> None:
        self.number: dict[str, int] = {}
        held: dict[tuple[int, ...], set] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            for i in range(len(ids) - RUN + 1):
                held.setdefault(tuple(ids[i : i + RUN]), set()).add(item)
        self.runs = np.array(list(held), np.int64).reshape(-1, RUN)
        self.items = [sorted(x, key=str) for x in held.values()]

    def spans(self, texts: list[str]) -> list[tuple]:
        """(place in ``texts``, item, spans of words that both share), one for each text and item with a run in
        common, in order."""
        number, sequence, owner, numbers = self.number.get, [], [], []
        for k, text in enumerate(texts):
            ids = [number(w, 0) for w in words(text)]
            if len(ids) >= RUN:
                sequence.append(np.array([*ids, 0], np.int64))
                owner.append(np.full(len(ids) + 1, k, np.int64))
                numbers.append(np.arange(len(ids) + 1))
        if not sequence or not len(self.runs):
            return []
        flat, of, no = np.concatenate(sequence), np.concatenate(owner), np.concatenate(numbers)
        lengths = np.diff(np.flatnonzero(flat == 0), prepend=-1)  # each stretch with the 0 that ends it
        kept = np.repeat(lengths > RUN, lengths)
        flat, of, no = flat[kept], of[kept], no[kept]
        if not len(flat):
            return []
        index = Index(flat)
        low, high = index.ranges(self.runs)
        hit = np.flatnonzero(high > low)
        counts = high[hit] - low[hit]
        run = np.repeat(hit, counts)
        rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low[hit], counts)
        at = index.locate(rows)
        starts: dict[tuple, list[int]] = {}
        for j, k, start in zip(run.tolist(), of[at].tolist(), no[at].tolist()):
            for item in self.items[j]:
                starts.setdefault((k, item), []).append(start)
        return [(k, item, merge(np.array(x), RUN)) for (k, item), x in sorted(starts.items(), key=lambda x: (x[0][0], str(x[0][1])))]

    def found(self, texts: list[str]) -> list[tuple]:
        """(place in ``texts``, item), distinct."""
        return [(k, item) for k, item, _ in self.spans(texts)]


def item_blocks(items: DataFrame, item: str, text: str, limit: int = ITEM_BYTES) -> Iterator[Items]:
    """The held-out items in blocks of about ``limit`` bytes of text, so that what is broadcast is bounded."""
    there = items.select(F.col(item).alias("item"), F.col(text).alias("text")).where("text is not null and item is not null").distinct()
    total = there.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // limit))
    for k in range(blocks):
        yield Items([tuple(r) for r in there.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()])


def leak_spans(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, spans): for each document and item that have ``RUN`` consecutive words in common the character
    spans of the document that the item covers, in order.

    The documents are a narrow map, whole texts; the items, a held-out set, are broadcast in blocks of bounded size.
    Null texts and texts of fewer words give nothing; repeated rows are reported as often as they stand; an empty
    table gives no rows; extra columns are never read."""
    kinds = documents.schema[key].dataType, items.schema[item].dataType
    schema = f"{key} {kinds[0].simpleString()}, {item} {kinds[1].simpleString()}, spans array<struct<start:int,end:int>>"
    item_type, span_type = to_arrow_type(kinds[1]), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")

    def runner(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shipped.value
            for batch in slices(batches, "text"):
                texts = batch.column("text").to_pylist()
                found = held.spans(texts)
                if found:
                    at, which, spans = zip(*found)
                    places = {k: word_places(texts[k]) for k in set(at)}
                    out = [[{"start": places[k][a][0], "end": places[k][b - 1][1]} for a, b in x] for k, x in zip(at, spans)]
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int32())), pa.array(which, item_type), pa.array(out, span_type)], names=[key, item, "spans"])

        return run

    context, out = documents.sparkSession.sparkContext, None
    for block in item_blocks(items, item, item_text):
        part = source.mapInArrow(runner(context.broadcast(block)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item), distinct: the documents and items that have ``RUN`` consecutive words in common."""
    return leak_spans(documents, items, key, text, item, item_text).select(key, item).distinct()


def without_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", out: str = "clean_text") -> DataFrame:
    """``documents`` with the column ``out``, the text without the spans that any item covers; overlapping spans of
    several items are taken out once. Texts without leaks are untouched, null texts stay null. Only the spans are
    shuffled to the documents' keys; rows with a null key keep their text."""
    spans = leak_spans(documents, items, key, text, item, item_text).select(F.col(key).alias("_key"), F.explode("spans").alias("s")).distinct()
    gone = spans.groupBy("_key").agg(F.array_sort(F.collect_set("s")).alias("_spans"))
    zero = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    after = F.aggregate(
        "_spans",
        zero,
        lambda a, s: F.struct(
            F.concat(a["kept"], F.when(s["start"] > a["at"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"])).otherwise("")).alias("kept"), F.greatest(a["at"], s["end"]).alias("at")
        ),
        lambda a: F.concat(a["kept"], F.substring(F.col(text), a["at"] + 1, F.length(F.col(text)))),
    )
    joined = documents.join(gone, documents[key] == gone["_key"], "left")
    return joined.withColumn(out, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(after)).drop("_key", "_spans")
