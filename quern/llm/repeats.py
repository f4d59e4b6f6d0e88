"""Lines repeated across the documents of one source.

PrefixSpan over sequences of line identifiers, level by level: a document is the sequence of its lines, a sequence
database is all documents of a source, and the support of a sequence is the number of distinct documents of the source
that hold its lines in order, with any gaps. Level 1 are the frequent single lines. For each further level every
document is projected on what follows the earliest match of a frequent sequence, and the sequence is extended by a
line of the projections. Every line in an occurrence of a frequent sequence is deleted.

A line of a frequent sequence is in at least as many documents as the sequence, so it is frequent alone: level 1
already holds every line that any level would delete, and ``repeated_lines`` takes its rows there. The longer levels
say which lines go together (``frequent_sequences``). n lines of one layout have 2**n frequent subsequences, all saying
the same; so of a sequence's extensions only those are followed that at least ``SHARE`` of its documents hold, and of
these the nearest, and sequences that a longer one holds with the same support are dropped (closed sequences). With
this each level is at most as large as level 1, and the levels end when none is left; no length is set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import slices
from quern.plans.lineage import cut

MIN_DOCUMENTS = 5
#: Share of a sequence's documents that must hold an extension for it to be followed.
SHARE = 0.9
#: Lines that are in more than one of this many occurrences are joined by broadcast: there can be no more than so many.
HOT_LINES = 10_000


def source_of(source_type: Column, uri: Column, extra: Column) -> Column:
    """The source of a record: ``web:`` and the host in lower case without port and leading ``www.``; for a pdf
    ``pdf:`` and the institution of its JSON. Null where neither is known."""
    host = F.regexp_extract(F.lower(F.trim(uri)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    institution = F.lower(F.trim(F.get_json_object(extra, "$.institution_short_name")))
    return F.when(source_type == "pdf", F.concat(F.lit("pdf:"), F.when(institution != "", institution))).otherwise(F.concat(F.lit("web:"), F.when(host != "", host)))


def line_contents(lines: pa.Array) -> pa.Array:
    """What two lines must share to count as the same: lower case, each run of digits one 0, each run of other
    characters than letters and digits one space, trimmed; empty if no letter is left."""
    t = pc.replace_substring_regex(pc.utf8_lower(lines), pattern="[0-9]+", replacement="0")
    t = pc.utf8_trim(pc.replace_substring_regex(t, pattern=r"[^\p{L}\p{N}]+", replacement=" "), characters=" ")
    return pc.if_else(pc.match_substring_regex(t, r"\p{L}"), t, "")


def line_occurrences(records: DataFrame, key: str, text: str, source: Column) -> DataFrame:
    """(line, doc, line_no): the 128-bit identifier, of source and content, of every line that counts; lines are
    numbered from 1. The shuffles after it carry no text. Each distinct content of a batch is hashed once a source."""
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            split = pc.split_pattern(batch.column("text"), "\n")
            bounds = split.offsets.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            number = np.arange(bounds[-1] - bounds[0]) - (bounds - bounds[0])[doc] + 1
            coded = line_contents(split.flatten()).dictionary_encode()
            sources = batch.column("source").dictionary_encode()
            contents, hosts = [x.encode() for x in coded.dictionary.to_pylist()], [x.encode() for x in sources.dictionary.to_pylist()]
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            kept = np.array([bool(x) for x in contents], bool)[codes] if len(codes) else np.zeros(0, bool)
            doc, number, codes = doc[kept], number[kept], codes[kept]
            of = sources.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
            pairs, back = np.unique(of * (len(contents) + 1) + codes, return_inverse=True)
            ids = [xxhash.xxh3_128_digest(hosts[p // (len(contents) + 1)] + b"\0" + contents[p % (len(contents) + 1)]) for p in pairs.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()).take(pa.array(back)), batch.column("doc").take(pa.array(doc)), pa.array(number, pa.int32())], names=["line", "doc", "line_no"])

    rows = records.select(source.alias("source"), F.col(key).alias("doc"), F.col(text).alias("text")).where("source is not null and doc is not null and text is not null")
    return rows.mapInArrow(run, f"line binary, doc {kind}, line_no int")


def supported(occurrences: DataFrame, by: list[str], least: int) -> DataFrame:
    """(by, documents): what at least ``least`` distinct documents hold. Distinct documents are formed before the
    count, both with partial aggregation, so what a third of all rows hold is counted in parts."""
    return occurrences.groupBy(*by, F.xxhash64("doc").alias("d")).agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("one").alias("documents")).where(F.col("documents") >= least)


def held_by(occurrences: DataFrame, lines: DataFrame, total: int) -> DataFrame:
    """The ``occurrences`` of ``lines`` (line, documents). Lines in more than ``total / HOT_LINES`` documents, of which
    there can't be more than ``HOT_LINES``, are broadcast, so the occurrences of a line that stands in a third of all
    documents are never brought together; the others meet in a shuffle, none of which is a large group."""
    hot = F.col("documents") > total / HOT_LINES
    often = occurrences.join(F.broadcast(lines.where(hot).select("line")), "line", "left_semi")
    seldom = occurrences.join(lines.where(~hot).select("line"), "line", "left_semi")
    return often.unionByName(seldom)


def repeated_lines(records: DataFrame, key: str = "doc_id", text: str = "full_text", source: Column | None = None, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(key, line_no), distinct: the lines that stand in an occurrence of a frequent sequence of their source.

    The texts are read once; their hashed lines are written to the shared checkpoint folder. Null and empty texts,
    records without source and an empty table give no rows. A record that stands twice counts once. Only the needed
    columns are read, so extra columns never clash."""
    s = source_of(F.col("source_type"), F.col("source_uri"), F.col("extra_json")) if source is None else source
    occurrences = cut(line_occurrences(records, key, text, s))
    frequent = cut(supported(occurrences, ["line"], least))
    return held_by(occurrences, frequent, occurrences.count()).select(F.col("doc").alias(key), "line_no").distinct()


def frequent_sequences(records: DataFrame, key: str = "doc_id", text: str = "full_text", source: Column | None = None, least: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """(lines, documents): the closed frequent sequences of at least two lines, each an array of line identifiers, and
    in how many documents of their source they stand, with any gaps. An identifier belongs to one source.

    Each level is one join of the projections with the frequent lines of the same document, two partial aggregations
    and one checkpoint; nothing is collected but a count a level."""
    s = source_of(F.col("source_type"), F.col("source_uri"), F.col("extra_json")) if source is None else source
    occurrences = cut(line_occurrences(records, key, text, s).distinct())
    single = cut(supported(occurrences, ["line"], least))
    items = cut(held_by(occurrences, single, occurrences.count()).join(single, "line").select("doc", "line_no", "line", "documents"))
    level = items.groupBy("doc", "line").agg(F.min("line_no").alias("at"), F.first("documents").alias("documents")).select("doc", F.array("line").alias("lines"), "at", "documents")
    found: DataFrame | None = None
    while True:
        level = level.withColumn("pattern", F.xxhash64("lines"))
        after = level.join(items.select("doc", "line_no", "line"), "doc").where("line_no > at")
        grown = after.groupBy("pattern", "lines", "documents", "doc", "at", "line").agg(F.min("line_no").alias("next_at"))
        counted = grown.groupBy("pattern", "line", F.col("documents").alias("before")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("next_at") - F.col("at")).alias("gap"))
        kept = counted.where((F.col("n") >= least) & (F.col("n") >= share * F.col("before")))
        nearest = kept.groupBy("pattern").agg(F.min(F.struct("gap", "line", "n")).alias("x")).select("pattern", "x.line", F.col("x.n").alias("n"))
        level = cut(grown.join(nearest, ["pattern", "line"]).select("doc", F.array_append("lines", F.col("line")).alias("lines"), F.col("next_at").alias("at"), F.col("n").alias("documents")))
        patterns = level.select("lines", "documents").distinct()
        if not level.limit(1).count():
            break
        found = patterns if found is None else found.unionByName(patterns)
    if found is None:
        return single.select(F.array("line").alias("lines"), "documents").limit(0)
    # a sequence that is the beginning or the end of a longer one with the same support is not closed
    found = cut(found)
    n = F.size("lines")
    inner = found.where(n > 2).select(F.explode(F.array(F.slice(F.col("lines"), F.lit(1), n - 1), F.slice(F.col("lines"), F.lit(2), n - 1))).alias("lines"), "documents").distinct()
    return found.join(inner, ["lines", "documents"], "left_anti")


def without_lines(records: DataFrame, lines: DataFrame, key: str = "doc_id", text: str = "full_text", out: str = "clean_text") -> DataFrame:
    """``records`` with the text that is left when the given (key, line_no) are taken out; null texts stay null, rows
    with a null key and documents without such lines keep their text. The numbers of a document's lines to take out
    are a map, so each line is looked up by its number."""
    gone = lines.groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_set(F.struct(F.col("line_no"), F.lit(True)))).alias("_gone"))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: F.try_element_at(F.col("_gone"), (i + 1).cast("int")).isNull())
    joined = records.join(gone, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(out, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_key", "_gone")
