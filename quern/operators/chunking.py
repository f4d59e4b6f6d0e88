"""Cutting texts into chunks: by paragraphs with overlap, by sentences, by sections.

Packing carries an overlap from chunk to chunk and over sections, so each document is packed by one Python call; the
documents are a narrow map. Sections alone are also found by windows over lines (``section_lines``)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.identity import chunk_id
from quern.functions.text import HEADING_CHARS, HEADINGS, is_heading, strip

MAX_CHARS, OVERLAP_CHARS = 2_000, 200
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_HEADING = [re.compile(p) for p in (r"^(?:[0-9]+\.)+\s+\S.*$", HEADINGS[1], r"^#{1,4}\s+\S.*$")]


def pack_sentences(text: str, limit: int = MAX_CHARS) -> list[str]:
    """Sentences joined by spaces as long as they stay within ``limit``; one that is longer alone stays whole."""
    out: list[str] = []
    held = ""
    for sentence in _SENTENCE_END.split(text):
        if held and len(held) + 1 + len(sentence) > limit:
            out.append(held)
            held = sentence
        else:
            held = f"{held} {sentence}" if held else sentence
    return [*out, held] if held else out


def overlap_tail(parts: list[str], overlap: int) -> list[str]:
    """The last paragraphs that fit into ``overlap`` characters, each with its blank line."""
    room, k = overlap, len(parts)
    while k and len(parts[k - 1]) + 2 <= room:
        k -= 1
        room -= len(parts[k]) + 2
    return parts[k:]


def pack_paragraphs(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, carried: list[str] | None = None) -> list[str]:
    """Paragraphs joined by blank lines up to ``limit`` characters. Each chunk begins with the last paragraphs of the
    one before that fit into ``overlap``; after them the limit is not asked again. A paragraph over the limit ends
    the chunk before it, is packed by sentences and leaves no overlap. ``carried`` is overlap from before."""
    out: list[str] = []
    held, size = list(carried or []), 0
    size = sum(map(len, held)) + 2 * max(0, len(held) - 1)
    fresh = 0
    for paragraph in filter(None, (p.strip() for p in text.split("\n\n"))):
        if len(paragraph) > limit:
            if held:
                out.append("\n\n".join(held))
            out += pack_sentences(paragraph, limit)
            held, size, fresh = [], 0, 0
            continue
        if held and size + len(paragraph) + 2 > limit:
            out.append("\n\n".join(held))
            held = overlap_tail(held, overlap)
            size = sum(map(len, held)) + 2 * max(0, len(held) - 1)
        size += len(paragraph) + (2 if held else 0)
        held.append(paragraph)
        fresh += 1
    if fresh and held:
        out.append("\n\n".join(held))
    return out


def sections(text: str) -> list[tuple[str, str]]:
    """(title, body) of each section: a heading is the first line or follows a blank one. Sections with neither are
    left out; a text without headings is one section without title."""

    def heading(line: str) -> bool:
        return 0 < len(line) <= HEADING_CHARS and any(p.match(line) for p in _HEADING)

    out: list[tuple[str, str]] = []
    title, body, blank = "", [], True
    for line in text.split("\n"):
        bare = line.strip()
        if blank and heading(bare):
            out.append((title, "\n".join(body).strip()))
            title, body = bare, []
        else:
            body.append(line)
        blank = not bare
    out.append((title, "\n".join(body).strip()))
    return [x for x in out if any(x)] or [("", text)]


def section_chunks(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[str, str]]:
    """(section title, chunk text): the sections in order, each packed by paragraphs. The overlap of a section's last
    chunk is carried into the next section; a section with a heading only gives no chunk."""
    out: list[tuple[str, str]] = []
    carried: list[str] = []
    for title, body in sections(text):
        if not body:
            continue
        packed = pack_paragraphs(body, limit, overlap, carried)
        out += [(title, x) for x in packed]
        carried = overlap_tail([p for p in packed[-1].split("\n\n") if p], overlap) if packed else []
    return out


def chunk_documents(documents: DataFrame, key: str = "doc_id", text: str = "full_text", limit: int = MAX_CHARS, overlap: int = OVERLAP_CHARS, by_section: bool = True) -> DataFrame:
    """(chunk_id, key, idx, text, meta_json): the chunks of every text in order. A null, empty or blank text gives
    none; repeated rows give repeated chunks; a null key gives a null chunk_id. Only two columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, body, meta = [], [], [], []
            for i, t in enumerate(batch.column("_text").to_pylist()):
                found = section_chunks(t, limit, overlap) if by_section else [("", x) for x in pack_paragraphs(t, limit, overlap)]
                for n, (title, chunk) in enumerate(x for x in found if x[1]):
                    at.append(i), index.append(n), body.append(chunk)
                    meta.append(json.dumps({"section_title": title}, ensure_ascii=False) if title else "{}")
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(at, pa.int32())), pa.array(index, pa.int32()), pa.array(body, pa.string()), pa.array(meta, pa.string())], names=["_key", "idx", "text", "meta_json"])

    kind = documents.schema[key].dataType.simpleString()
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_text is not null and trim(_text) != ''")
    chunks = rows.mapInArrow(run, f"_key {kind}, idx int, text string, meta_json string")
    return chunks.select(chunk_id(F.col("_key").cast("string"), F.col("idx"), F.col("text")).alias("chunk_id"), F.col("_key").alias(key), "idx", "text", "meta_json")


def sentence_pieces(documents: DataFrame, key: str = "doc_id", text: str = "full_text", limit: int = MAX_CHARS) -> DataFrame:
    """(key, idx, text): every text packed by sentences, in expressions only: a fold over the array of sentences."""
    from quern.functions.text import sentence_split

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    step = lambda a, s: F.when(
        (a["held"] != "") & (F.length(a["held"]) + 1 + F.length(s) > limit), F.struct(F.array_append(a["done"], a["held"]).alias("done"), s.alias("held"))
    ).otherwise(F.struct(a["done"].alias("done"), F.when(a["held"] != "", F.concat(a["held"], F.lit(" "), s)).otherwise(s).alias("held")))
    packed = F.aggregate(sentence_split(F.col(text)), start, step, lambda a: F.when(a["held"] != "", F.array_append(a["done"], a["held"])).otherwise(a["done"]))
    return documents.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(packed).alias("idx", "text"))


def section_lines(documents: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """(key, line_no, section_no, title, is_heading, line): the lines of every text with the section that they are in,
    by windows over the lines of a document: a heading follows a blank line, and the running count of headings is the
    section's number (0 before the first). A document is one window; repeated rows must be dropped before."""
    lines = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    order = Window.partitionBy("_key").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after_blank = F.coalesce(F.lag(strip(F.col("line")) == "").over(order), F.lit(True))
    marked = lines.withColumn("is_heading", after_blank & is_heading(F.col("line")))
    numbered = marked.withColumn("section_no", F.sum(F.col("is_heading").cast("int")).over(so_far).cast("int"))
    titled = numbered.withColumn("title", F.last(F.when(F.col("is_heading"), strip(F.col("line"))), ignorenulls=True).over(so_far))
    return titled.select(F.col("_key").alias(key), "line_no", "section_no", F.coalesce("title", F.lit("")).alias("title"), "is_heading", "line")


def section_bodies(documents: DataFrame, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """(key, section_no, title, body): one row a section that has a title or a body."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    grouped = section_lines(documents, key, text).groupBy(key, "section_no").agg(F.first("title").alias("title"), strip(body).alias("body"))
    return grouped.where("title != '' or body != ''")
