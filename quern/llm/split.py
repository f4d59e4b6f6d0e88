"""Splitting oversized texts at natural boundaries.

A text over the limit is cut into units at the coarsest boundaries that keep every unit under the limit: paragraphs;
sentences only inside a paragraph that is too long; words only inside such a sentence; characters only inside such a
word. Dynamic programming over the ends of the units then chooses the cuts: it minimises the sum of a penalty for the
kind of each cut and the squared imbalance of each piece, over all ways in which no piece is over the limit with the
overlap that it gets: each piece but the first starts earlier, by up to ``overlap`` characters, at a sentence or word
where one starts there. Only a unit that alone leaves less room than that gets a shorter overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import slices

LIMIT, OVERLAP = 2_000, 200
#: The boundary that a text needs, from the coarsest; a cut's penalty grows with its place here.
KINDS = ("paragraph", "sentence", "word", "none")
PENALTY = (0.0, 1.0, 4.0, 16.0)

_PARAGRAPH = re.compile(r"[ \t\r]*\n(?:[ \t\r]*\n)+[ \t\r\n]*")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\n]+")
_WORD = re.compile(r"[ \t\r\n]+")


def _spans(text: str, start: int, end: int, separator: re.Pattern) -> list[tuple[int, int]]:
    out, at = [], start
    for m in separator.finditer(text, start, end):
        if m.start() > at:
            out.append((at, m.start()))
        at = max(at, m.end())
    if at < end:
        out.append((at, end))
    return out


def units(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], int]:
    """The units (start, end, kind of the boundary after it) of a text, and the finest kind that it needs (index into
    ``KINDS``). White space around the text and between units belongs to none."""
    a, b = len(text) - len(text.lstrip(" \t\r\n")), len(text.rstrip(" \t\r\n"))
    out: list[tuple[int, int, int]] = []
    need = 0

    def add(start: int, end: int, kind: int) -> None:
        nonlocal need
        if end - start <= limit:
            out.append((start, end, kind))
            return
        need = max(need, kind + 1)
        if kind == 2:  # one stretch without white space: a position every quarter of what the overlap leaves will do
            step = max(1, (limit - overlap) // 4)
            out.extend((s, min(s + step, end), 3) for s in range(start, end, step))
        else:
            for s, e in _spans(text, start, end, (_SENTENCE, _WORD)[kind]):
                add(s, e, kind + 1)
        last = out[-1]
        out[-1] = (last[0], last[1], kind)

    for s, e in _spans(text, a, b, _PARAGRAPH):
        add(s, e, 0)
    return out, need


#: From so many candidates on the starts of a piece are compared by numpy; the result is the same.
WIDE = 40


def cuts(parts: list[tuple[int, int, int]], limit: int = LIMIT, overlap: int = OVERLAP, wide: int = WIDE) -> list[tuple[int, int]]:
    """The pieces, as (first unit, last unit), of least cost. Of equal costs the longer last piece is taken."""
    n = len(parts)
    starts, ends = [p[0] for p in parts], [p[1] for p in parts]
    # where a piece that begins with unit i begins with its whole overlap
    least = [starts[0]] + [max(starts[0], e - overlap) for e in ends[:-1]]
    total = ends[-1] - starts[0]
    target = total / max(1, -(-total // max(1, limit - overlap)))
    # a piece costs 1, so that no more pieces are made than the limit asks for, its cut and its imbalance
    cost, back = [0.0] * (n + 1), [0] * (n + 1)
    start_of = np.array(starts, dtype=np.float64)
    cost_of = np.zeros(n + 1)
    low = 0
    for j in range(1, n + 1):
        end = ends[j - 1]
        while low < j - 1 and end - least[low] > limit:  # one unit alone always fits, if with less overlap
            low += 1
        here = 0.0 if j == n else PENALTY[parts[j - 1][2]]
        if j - low > wide:
            off = (end - start_of[low:j] - target) / target
            every = cost_of[low:j] + off * off
            k = int(every.argmin())
            best, arg = float(every[k]), low + k
        else:
            best, arg = float("inf"), low
            for i in range(low, j):
                off = (end - starts[i] - target) / target
                c = cost[i] + off * off
                if c < best:
                    best, arg = c, i
        cost[j] = cost_of[j] = best + here + 1.0
        back[j] = arg
    out, j = [], n
    while j:
        out.append((back[j], j - 1))
        j = back[j]
    return out[::-1]


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], int]:
    """The spans (start, end) of the pieces of a text in order, and the finest kind of boundary that it needs.

    A text without content gives no piece; one of at most ``limit`` characters gives itself, untouched."""
    if len(text) <= limit:
        return ([(0, len(text))] if text.strip(" \t\r\n") else []), 0
    parts, need = units(text, limit)
    if not parts:
        return [], 0
    spans: list[tuple[int, int]] = []
    starts = [p[0] for p in parts]
    for first, last in cuts(parts, limit, overlap):
        start, end = parts[first][0], parts[last][1]
        if spans:
            earlier_start, earlier_end = spans[-1]
            least = max(earlier_end - overlap, end - limit, earlier_start + 1)
            if least < earlier_end:
                k = bisect_left(starts, least)
                if k < first:
                    start = starts[k]
                else:  # only up to the end of the earlier piece, so that the cut's own separator is none
                    m = _SENTENCE.search(text, least - 1, earlier_end) or _WORD.search(text, least - 1, earlier_end)
                    start = m.end() if m else least
        spans.append((start, end))
    return spans, need


def split_texts(texts: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(key, piece_no, start, end, boundary[, piece]): the ordered pieces of every text of more than ``limit``
    characters (Unicode code points); ``boundary`` is the coarsest kind of boundary that suffices for the text.

    A narrow map: short and null texts are dropped before Python sees them. A text over the limit that holds white
    space only has one row with a null piece and boundary ``paragraph``. Repeated rows give repeated pieces. Only two
    columns are read, so extra columns never clash; a null key is kept."""
    kind = texts.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, piece_no int, start int, end int, boundary string" + ", piece string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                spans, need = pieces(t, limit, overlap)
                if not spans:
                    rows.append((i, 0, 0, 0, KINDS[0], None))
                for no, (s, e) in enumerate(spans):
                    rows.append((i, no, s, e, KINDS[need], t[s:e] if with_text else None))
            if not rows:
                continue
            index, no, s, e, b, p = zip(*rows)
            columns = [batch.column("key").take(pa.array(index, pa.int32())), pa.array(no, pa.int32()), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(b, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(p, pa.string())] * with_text, names=[x.split(" ")[0] for x in schema.split(", ")])

    long = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > limit)
    return long.mapInArrow(run, schema)
