"""Per-document text quality statistics, published fixed-threshold rules on them, and the kind of each text.

The statistics of a whole batch of texts are counted at once: words, lines and their ends by Arrow kernels, sums by
numpy; what depends on one word is looked up once for each distinct word. The published rules are applied with their
own thresholds, and each that a text fails is recorded in ``failed_rules``. They were made to keep long English pages
and would drop what must stay prose here (a sentence, a page without end punctuation, a page that holds a list), so
the kind of a text follows from rules of this module, each recorded in ``reasons``:

* ``bullets`` from 0.7 of the lines with less than half of the words in sentences (published: over 0.9);
* ``symbols`` as a share of 0.4 of all characters that are not white space (published: 0.1 of the words);
* cells and their values, short lines, items in a line, strange words, broken characters and repeated phrases.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import slices
from quern.llm.words import per_word, sums, word_table

#: Frequent function words of English, French and Spanish.
COMMON_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been before between both but by can cannot could do does during each
    every for from had has have he her his how i if in into is it its may might more most must near no not of off on once one only or
    other our out over shall she should since so some such than that the their them then there these they this those to
    under unless until up upon was we were what when where whether which while who will with within without would you your
    au aux avant avec car ce ces cette chaque comme dans de depuis des donc du elle elles en est et il ils la le les leur leurs lorsque mais ne
    ni nos notre nous on ont ou par pas pendant peut plus pour quand que qui sa sans se selon ses si son sont sous sur tout toute un une vers
    vos votre vous
    al ante antes cada como con cuando cuyo debe del desde donde durante el ella ellas ellos entre era es esa ese esta este estos fue
    ha hasta la las lo los mientras muy más ni para pero porque por puede que quien se según ser sin sobre son su sus también tiene todo
    un una uno y ya
    """.split()
)
#: The eight stop words of the published rule, of which a text must have two.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")
#: The line starts that mark an item, and the ends of lines and sentences with what may stand after them.
BULLET = r"^[ \t]*(?:[-*•◦▪‣·–—→»☐☑✓■□●○>+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])[ \t]+\S"
CLOSERS = "[\"'”’»)\\]]*$"
SENTENCE_END, LINE_END = r"[.!?…。！？]" + CLOSERS, r"[.!?…。！？:;]" + CLOSERS
ELLIPSIS = r"(?:…|\.\.\.)" + CLOSERS
#: Separators that cut a line into cells.
BAR, TAB, GAP, SEMICOLON, COMMA = (re.compile(p) for p in (r"[ \t]*\|[ \t]*", r"\t+", r"[ \t]{2,}", r"[ \t]*;[ \t]*", r","))
VALUE = re.compile(r"(?:[-–—]|n/?a|[$€£]?[ \t]?[\d.,:/-]*\d[\d.,:/-]*[ \t]?[%€$£]?|-{2,}|:?-{3,}:?)", re.IGNORECASE)
#: A word unlike those of a language: letters and digits mixed, five vowels or consonants in a row, no vowel, very long.
STRANGE = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|[aeiouy]{5}|[a-zà-ÿ]\d|\d[a-zà-ÿ]|^[bcdfghjklmnpqrstvwxz]{3,}$|^.{26,}$|q(?!u)")
HEXADECIMAL = re.compile(r"[0-9a-f]*\d[0-9a-f]*|[0-9a-f]{2}|0x[0-9a-f]+")
#: Characters that whole texts hold only if their decoding went wrong, and accented capitals inside of words.
BROKEN = "[\ufffd\x00-\x08\x0e-\x1f\x7f-\x9f\ue000-\uf8ff]|[ÃÂ][\x80-\xbf]|â€|[a-z][À-ÖØ-Þ]|[À-ÖØ-Þ][a-zÀ-ÖØ-Þ]"

STATISTICS = (
    "n_chars n_words mean_word_length symbol_share symbol_word_ratio end_punctuation_share ellipsis_share common_word_share stop_words alphabetic_share n_lines duplicate_line_share "
    "bullet_share cell_share value_share short_line_share sentence_share item_share strange_share repeat_share broken_share".split()
)
#: The published rules (Rae et al. 2021, quality heuristics of MassiveText): name, statistic, least, most.
PUBLISHED = (
    ("word_count", "n_words", 50, 100_000), ("mean_word_length", "mean_word_length", 3, 10), ("symbol_word_ratio", "symbol_word_ratio", 0, 0.1), ("bullet_lines", "bullet_share", 0, 0.9), ("ellipsis_lines", "ellipsis_share", 0, 0.3),
    ("alphabetic_words", "alphabetic_share", 0.8, 1), ("stop_words", "stop_words", 2, 8), ("duplicate_lines", "duplicate_line_share", 0, 0.3),
)


def _cells(text: str, lines: list[str], prose: float) -> tuple[int, int, int]:
    """Lines that are rows of cells, their cells, and the cells that are values (numbers, dates, shares, blanks). A
    separator counts if at least two lines have it and most of these have the same number of cells."""
    marks = [m for m, there in ((BAR, "|" in text), (TAB, "\t" in text), (GAP, "  " in text), (SEMICOLON, ";" in text and prose < 0.5), (COMMA, "," in text and prose < 0.5)) if there]
    best = (0, 0, 0)
    for mark in marks:
        rows = [r for r in ([c for c in mark.split(x) if c] for x in lines) if len(r) > 1]
        if len(rows) < 2 or len(rows) <= best[0]:
            continue
        if Counter(map(len, rows)).most_common(1)[0][1] >= 0.6 * len(rows):
            cells = [c for r in rows for c in r]
            best = (len(rows), len(cells), sum(1 for c in cells if VALUE.fullmatch(c.strip())))
    return best


def _items(text: str) -> float:
    """The greatest share of short parts among at least five that one separator cuts a text into."""
    best = 0.0
    for mark in ("|", "·", "•", "/", ">", "»", ",", ";"):
        if mark in text:
            parts = [p for p in (q.split() for q in text.split(mark)) if p]
            if len(parts) >= 5:
                best = max(best, sum(1 for p in parts if len(p) <= 4) / len(parts))
    return best


def _distinct_share(doc: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """For each document the share of the weight of its values that distinct ones make up; 1 where there is none."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    total = np.bincount(doc, weight, n)
    return np.where(total > 0, np.bincount(d[first], weight[order][first], n) / np.maximum(total, 1e-9), 1.0)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The ``STATISTICS`` of every text; all but the characters are 0 for null, empty and blank texts."""
    n = len(texts)
    texts = pc.fill_null(texts, "")
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)
    solid = pc.utf8_length(pc.replace_substring_regex(texts, pattern=r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+", replacement="")).to_numpy(zero_copy_only=False).astype(np.float64)
    share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1e-9), 0.0)

    # words
    offsets, codes, vocabulary = word_table(texts, lower=False)
    k = np.diff(offsets).astype(np.float64)
    word_doc = np.repeat(np.arange(n), np.diff(offsets))
    size = per_word(vocabulary, len)
    low = [w.lower() for w in vocabulary.to_pylist()]
    common, alphabetic = np.fromiter((w in COMMON_WORDS for w in low), float, len(low)), np.fromiter((any(c.isalpha() for c in w) for w in low), float, len(low))
    strange, hexes = np.fromiter((len(w) * bool(STRANGE.search(w)) for w in low), float, len(low)), np.fromiter((bool(HEXADECIMAL.fullmatch(w)) for w in low), float, len(low))
    of = lambda values: sums(values[codes], offsets)
    letters = of(size)
    stops = np.zeros(n)
    for stop in STOP_WORDS:
        stops += of(np.fromiter((w == stop for w in low), float, len(low))) > 0
    runs = np.zeros(len(codes), np.uint64)
    for i in range(4):  # runs of four words
        runs[: max(0, len(codes) - 3)] = (runs[: max(0, len(codes) - 3)] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[i : len(codes) - 3 + i].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    whole = np.zeros(len(codes), bool)
    whole[: max(0, len(codes) - 3)] = word_doc[: max(0, len(codes) - 3)] == word_doc[3:] if len(codes) > 3 else False
    repeat = 1 - _distinct_share(word_doc[whole], runs[whole], np.ones(int(whole.sum())), n)

    # lines
    split = pc.split_pattern(texts, "\n")
    bounds = split.offsets.to_numpy().astype(np.int64)
    lines = pc.utf8_trim_whitespace(split.flatten())
    there = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(n), np.diff(bounds))[there]
    lines = lines.filter(pa.array(there))
    flag = lambda pattern: pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)
    per_doc = lambda values: np.bincount(doc, values, n).astype(np.float64)
    tokens = pc.list_value_length(pc.utf8_split_whitespace(lines)).to_numpy(zero_copy_only=False).astype(np.float64)
    m, bullet, sentence = per_doc(None), flag(BULLET), flag(SENTENCE_END)
    inside = per_doc(tokens * (sentence & (tokens > 5) & ~bullet))
    prose = np.minimum(1.0, share(inside, np.maximum(1, per_doc(tokens))))
    line_chars = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.float64)
    line_codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    duplicate_chars, duplicates = 1 - _distinct_share(doc, line_codes, line_chars, n), 1 - _distinct_share(doc, line_codes, np.ones(len(doc)), n)
    repeat = np.where(m > 0, np.maximum(repeat, duplicate_chars), 0.0)

    # cells and items: only texts with a separator that could count are looked at one by one
    cells, values, items = np.zeros(n), np.zeros(n), np.zeros(n)
    tables = pc.match_substring_regex(texts, r"\||\t|  ").to_numpy(zero_copy_only=False) | (pc.match_substring_regex(texts, "[;,]").to_numpy(zero_copy_only=False) & (prose < 0.5))
    listed = pc.match_substring_regex(texts, "[|·•/>»,;]").to_numpy(zero_copy_only=False) & (prose < 0.3) & (m > 0)
    for i in np.flatnonzero((tables & (m > 1)) | listed).tolist():
        text = texts[i].as_py()
        if tables[i] and m[i] > 1:
            rows, own, found = _cells(text, [x for x in map(str.strip, text.split("\n")) if x], float(prose[i]))
            cells[i], values[i] = rows / m[i], found / max(1, own)
        if listed[i]:
            items[i] = _items(text)
    out = {
        "n_words": k, "mean_word_length": share(letters, k), "symbol_share": share(solid - letters, solid), "symbol_word_ratio": share(pc.count_substring_regex(texts, r"#|…|\.\.\.").to_numpy(zero_copy_only=False).astype(np.float64), k),
        "end_punctuation_share": share(per_doc(flag(LINE_END)), m), "ellipsis_share": share(per_doc(flag(ELLIPSIS)), m), "common_word_share": share(of(common), k), "stop_words": stops, "alphabetic_share": share(of(alphabetic), k), "n_lines": m, "duplicate_line_share": duplicates,
        "bullet_share": share(per_doc(bullet), m), "cell_share": cells, "value_share": values, "short_line_share": share(per_doc(~sentence & (tokens <= 5)), m), "sentence_share": prose, "item_share": items,
        "strange_share": np.maximum(share(of(strange), letters), share(of(hexes), k)), "repeat_share": repeat, "broken_share": share(pc.count_substring_regex(texts, BROKEN).to_numpy(zero_copy_only=False).astype(np.float64), solid),
    }
    return {"n_chars": chars} | {name: np.where(m > 0, x, 0.0) for name, x in out.items()}


def failed_rules(s: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray]]:
    """The published rules, each with the texts that fail it. Null, empty and blank texts fail none."""
    there = s["n_lines"] > 0
    return [(name, there & ((s[x] < least) | (s[x] > most))) for name, x, least, most in PUBLISHED]


def judge(s: dict[str, np.ndarray]) -> tuple[np.ndarray, list[tuple[str, str, np.ndarray]]]:
    """The kind of each text and the rules as (kind, reason, broken). A text is junk, else a table, else a list, if it
    breaks a rule of that kind, else prose; ``none`` are null and blank texts."""
    table = (s["cell_share"] >= 0.7) & (s["value_share"] >= 0.15) & (s["n_lines"] >= 2)
    text = s["n_lines"] > 0
    rules = [
        ("junk", "no_words", text & (s["n_words"] == 0)),
        ("junk", "broken_characters", text & (s["broken_share"] > 0.03)),
        ("junk", "repeated_phrase", text & (s["repeat_share"] > 0.6) & ~table),
        ("junk", "strange_words", text & (s["strange_share"] > 0.4) & (s["common_word_share"] < 0.15) & ~table),
        ("junk", "symbols", text & (s["symbol_share"] > 0.4) & ~table),
        ("table", "cells", table),
        ("list", "bullets", (s["bullet_share"] >= 0.7) & (s["sentence_share"] < 0.5)),
        ("list", "short_lines", (s["short_line_share"] >= 0.7) & (s["n_lines"] >= 4) & (s["sentence_share"] < 0.35)),
        ("list", "items_in_a_line", (s["item_share"] >= 0.8) & (s["sentence_share"] < 0.3)),
    ]
    kinds = np.where(text, "prose", "none").astype(object)
    for kind in ("list", "table", "junk"):
        kinds[np.logical_or.reduce([broken for k, _, broken in rules if k == kind])] = kind
    return kinds, rules


def text_quality(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, the ``STATISTICS``, kind, reasons, failed_rules): one row for each row of ``documents``.

    A narrow map over the two columns; extra columns never clash. Null texts have null statistics, and like empty and
    blank texts the kind ``none`` without reasons; repeated rows and null keys are kept."""
    kind = documents.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join(f"{x} double" for x in STATISTICS) + ", kind string, reasons array<string>, failed_rules array<string>"

    def named(rules: list[tuple[str, np.ndarray]], n: int) -> pa.Array:
        hit = np.stack([x for _, x in rules], axis=1)
        names = pa.array([name for name, _ in rules])
        offsets = np.concatenate([[0], np.cumsum(hit.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(np.nonzero(hit)[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            values = statistics(texts)
            kinds, rules = judge(values)
            missing = texts.is_null().to_numpy(zero_copy_only=False)
            columns = [batch.column("key")] + [pa.array(values[x], pa.float64(), mask=missing) for x in STATISTICS]
            columns += [pa.array(kinds, pa.string()), named([(reason, hit) for _, reason, hit in rules], len(texts)), named(failed_rules(values), len(texts))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *STATISTICS, "kind", "reasons", "failed_rules"])

    return documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
