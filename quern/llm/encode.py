"""Encoding of a corpus with a public byte-level BPE tokenizer.

A text is cut into pre-tokens, each pre-token into bytes, and the bytes are merged by rank. The queue of merges is a
hierarchical bitmap over the ranks: one bucket of left positions for each rank that occurs, one bit for each non-empty
bucket, and above it one bit for each non-zero word of the level below. The next rank is found by find-first-set from
the top level down; a bucket's entries whose pair has changed since they were put in are skipped. A pre-token of n
bytes costs O(n) queue steps apart from sorting each bucket, so very long pre-tokens (dumps without white space) do
not go quadratic.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import slices

#: Folder of the public vocabularies, and the file of the one that is meant; the path is a parameter of every
#: function that needs it.
FOLDER, FILE = "/opt/tokenizers", "byte_bpe_50k.json"


def vocabulary_path(file: str = FILE) -> str:
    """The place of a public vocabulary: where the installed package ``public_tokenizers`` says, else in ``FOLDER``."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path(file))
    except ImportError:
        return f"{FOLDER}/{file}"


#: The file is shipped to the workers, so its size is checked.
MAX_VOCABULARY_BYTES = 64_000_000
#: Pre-tokens kept with their ids in each worker, and the longest pre-token that is kept.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 64


class RankQueue:
    """Buckets of positions by merge rank under three levels of bitmap words of 64 bits (ranks below 64**3)."""

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.low: dict[int, int] = {}
        self.mid: dict[int, int] = {}
        self.top = 0

    def put(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 6, rank >> 12
        self.low[a] = self.low.get(a, 0) | 1 << (rank & 63)
        self.mid[b] = self.mid.get(b, 0) | 1 << (a & 63)
        self.top |= 1 << b

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions from left to right; the bucket is emptied."""
        top = self.top
        b = (top & -top).bit_length() - 1
        word = self.mid[b]
        a = b << 6 | (word & -word).bit_length() - 1
        word = self.low[a]
        rank = a << 6 | (word & -word).bit_length() - 1
        word &= word - 1
        self.low[a] = word
        if not word:
            word = self.mid[b] = self.mid[b] & ~(1 << (a & 63))
            if not word:
                self.top &= ~(1 << b)
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


def byte_letters() -> dict[str, int]:
    """The printable stand-in for each byte in files of byte-level vocabularies: a printable Latin-1 character stands
    for itself, the other bytes in order take the code points from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Byte-level BPE of a vocabulary file (its JSON text)."""

    def __init__(self, source: str) -> None:
        model = json.loads(source)["model"]
        vocabulary: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocabulary[letter]
        #: (left id << 20 | right id) -> (rank << 20 | merged id)
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocabulary[left] << 20 | vocabulary[right]] = rank << 20 | vocabulary[left + right]
        self.memo: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        ids: list[int] = [self.of_byte[b] for b in text.encode()]
        n, merges = len(ids), self.merges
        if n == 1:
            return ids
        after, before, queue = list(range(1, n + 1)), list(range(-1, n - 1)), RankQueue()
        for i in range(n - 1):
            found = merges.get(ids[i] << 20 | ids[i + 1])
            if found is not None:
                queue.put(found >> 20, i)
        while queue.top:
            rank, positions = queue.take()
            for i in positions:
                if ids[i] < 0 or (j := after[i]) >= n:
                    continue  # stale: merged into its left neighbour, or now the last
                found = merges.get(ids[i] << 20 | ids[j])
                if found is None or found >> 20 != rank:
                    continue  # stale: the pair has changed
                ids[i], ids[j] = found & 0xFFFFF, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    found = merges.get(ids[i] << 20 | ids[k])
                    if found is not None:
                        queue.put(found >> 20, i)
                h = before[i]
                if h >= 0:
                    found = merges.get(ids[h] << 20 | ids[i])
                    if found is not None:
                        queue.put(found >> 20, h)
        return [x for x in ids if x >= 0]

    def lookup(self, text: str) -> list[int]:
        ids = self.memo.get(text)
        if ids is None:
            ids = self.piece(text)
            if len(text) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_ENTRIES:
                    self.memo.clear()
                self.memo[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without special tokens; their strings in a text are ordinary text."""
        return list(chain.from_iterable(map(self.lookup, pretokens(text))))


def _ranges(test) -> str:
    """The code points for which ``test(category)`` holds, as the inside of a character class."""
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        held = c <= sys.maxunicode and test(unicodedata.category(chr(c)))
        if held and start is None:
            start = c
        elif not held and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@lru_cache(1)
def _patterns():
    """The pre-token pattern of the vocabulary, with its classes written out: one for texts in ASCII, one for all."""
    import re

    def build(letter: str, number: str, space: str):
        return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")

    wide = build(_ranges(lambda c: c[0] == "L"), _ranges(lambda c: c[0] == "N"), WHITE_SPACE)
    return build("A-Za-z", "0-9", "\\t-\\r ").findall, wide.findall


def pretokens(text: str) -> list[str]:
    narrow, wide = _patterns()
    return narrow(text) if text.isascii() else wide(text)


@lru_cache(2)
def _encoder(source: str) -> Encoder:
    return Encoder(source)


def token_ids(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the ids of every text; an empty text gives an empty list, a null text gives null.

    A narrow map without shuffle; rows that are repeated are encoded again and kept, null keys too. Only the two
    columns are read, so extra columns never clash. The vocabulary file (bounded by ``MAX_VOCABULARY_BYTES``) is
    read on the driver and broadcast."""
    vocabulary = vocabulary or vocabulary_path()
    if Path(vocabulary).stat().st_size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY_BYTES} bytes")
    shipped = documents.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    schema = f"{key} {documents.schema[key].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        lookup = encoder.lookup
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            lengths, flat = [], []
            for t in texts:
                ids = np.fromiter(chain.from_iterable(map(lookup, pretokens(t))), dtype=np.int32) if t else np.empty(0, np.int32)
                flat.append(ids)
                lengths.append(len(ids))
            offsets = np.zeros(len(texts) + 1, np.int32)
            np.cumsum(lengths, out=offsets[1:])
            nulls = pa.array([t is None for t in texts], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)), mask=nulls)
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=[key, "ids"])

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
