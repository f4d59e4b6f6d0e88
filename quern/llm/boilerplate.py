"""Main content of pages whose text mixes it with menus, notices, side boxes and footers.

Pass 1 labels blocks by rules. A block is a stretch of lines between blank lines; in a text without blank lines each
line is one, except that neighbouring items of a list are taken together. Rules look at length, stop-word density,
link density (the share of words in short cells between separators, or of words in a row of capitalised labels), the
words of page furniture, and whether a short line speaks of the page's subject. Pass 2 gives each block that is still
ambiguous (short, no decided sign) the label of its nearest decided neighbours.

The subject of a page are the names in its long, decided paragraphs: words with a capital inside of a sentence, and
the words of the title that occur in these paragraphs. A heading or one-line paragraph about the page's subject thus
stays, while the name of another page in a side box does not.

All counts are made over whole batches by Arrow kernels and numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import slices
from quern.llm.words import sums, word_table

#: Frequent function words of English, French and Spanish.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been before between both but by can cannot could do does during each every for from
    had has have he her his how i if in into is it its may might more most must near no not of off on once one only or other our out over she
    should since so some such than that the their them then there these they this those to under unless until up upon was we were what when
    where whether which while who will with within without would you your
    au aux avant avec car ce ces cette chaque comme dans de depuis des donc du elle en est et il la le les leur lors mais malgré ne ni nos notre
    nous on ont ou par pas pendant plus pour quand que qui sa sans se selon ses si son sont sous sur tout une un vers votre vous à l d n
    al ante antes cada como con cual cuando de del desde donde durante el ella en entre es esa ese esta este fue ha hasta las lo los mientras
    muy más ni o para pero por que quien se según ser si sin sobre son su sus también todo una y ya
    """.split()
)
#: A block of so many characters or words is long; a line of at most so many characters is short.
LONG, LONG_WORDS, SHORT = 200, 30, 140
#: Stop-word density from which a block reads as text, and below which it is none.
STOPS_HIGH, STOPS_LOW = 0.25, 0.12
#: A line of so many characters is no label of a menu or box, whatever its words are (tables of words, dumps).
PARAGRAPH = 300
#: Words of a line above which words of furniture do not count against it.
FURNITURE_WORDS = 24
#: Words of page furniture, on lower-cased lines whose runs of digits are one 0.
FURNITURE = "|".join(
    (
        r"\bcookies?\b", r"\bstores? (?:small )?files? on your\b", r"^(?:got it|i agree|(?:accept|reject|allow|decline|manage)(?: all| optional| non-essential| preferences)?(?: optional)?(?: cookies)?)$", r"\byour choices$",
        r"^(?:skip|jump) to\b", r"^(?:☰ ?)?(?:menu|search|close|login|log in|sign in|my account|translate|home|top|back to top|next|previous)$", r"^search this\b",
        r"^(?:share|print|email|e-mail|copy link|tweet|like|save|download)(?: this| or\b.*)?(?: page| link| article)?(?: as a file)?$", r"^share:", r"^tell (?:someone|a friend)\b", r"\bthis page helpful\b", r"\b(?:send|give|leave)(?: us)? (?:your )?feedback\b",
        r"\b0 min(?:ute)?s? read\b", r"\bstaff writer\b", r"^(?:published|posted|written|reviewed) (?:by|on)\b", r"^by the [\w ]+ (?:unit|team|desk|office|department|staff)$", r"^(?:last )?(?:updated|modified|reviewed|published|viewed|edited)\b ?(?:on |:)", r"^last viewed\b",
        r"^page 0(?: of 0)?$", r"^0(?: ?/ ?0)?$", r"©|^\(c\)|^copyright\b|\ball rights reserved\b", r"\bterms of (?:use|service)\b", r"^(?:privacy|disclaimer|accessibility|legal notices?|site ?map)\b.{0,40}$", r"\bnewsletter\b", r"\bon social media\b", r"^follow us\b",
        r"\bin good faith\b|\bno liability\b|\bnot legal advice\b|\bwithout notice\b", r"\b(?:content|material|information) (?:on this (?:page|site) )?(?:is owned|may be reused)\b|\breused with credit\b", r"\blanguage versions\b",
        r"\backnowledges the\b", r"\bcommitted to accessib", r"\bcall centre open\b", r"\brecord of decisions$", r"^(?:service alert|alert|important|notice|heads up|attention|service notice)\b ?:",
        r"^(?:quick links|related (?:pages|links|content|articles)|see also|you may also like|popular (?:services|pages|topics)|in this section|read more|more like this|most viewed|on this page)$",
    )
)
SEPARATOR = r" (?:\||·|•|»|›|>|/|→) "
ITEM = r"^(?:[-*•◦▪‣·–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S"
GOOD, BAD, OPEN = 1, -1, 0


def _flags(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)


def _same(a: np.ndarray) -> np.ndarray:
    """Whether each entry equals the one before; false at the start."""
    return np.concatenate([[False], a[1:] == a[:-1]]) if len(a) else np.zeros(0, bool)


def _any(flags: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, flags, n) > 0


def line_labels(texts: pa.Array, titles: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, line number from 1, whether it is main content) of each non-blank line of the texts."""
    n_docs = len(texts)
    split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    doc = np.repeat(np.arange(n_docs), np.diff(bounds))
    number = np.arange(len(doc)) - bounds[doc] + 1
    raw = pc.utf8_trim(split.flatten(), characters=" \t\r")
    raw = pc.replace_substring_regex(raw, pattern=r"[ \t]{2,}", replacement=" ")
    there = pc.not_equal(raw, "").to_numpy(zero_copy_only=False)
    if not there.any():
        return doc[:0], number[:0], np.zeros(0, bool)
    blank_before = np.concatenate([[False], ~there[:-1]]) & (number > 1)
    spaced = _any(~there & (number > 1), doc, n_docs)  # documents with blank lines
    blanks = np.cumsum(blank_before & there)
    doc, number, blanks, lines = doc[there], number[there], blanks[there], raw.filter(pa.array(there))

    # what the rules look at, line by line
    bare = pc.replace_substring_regex(lines, pattern=r"^(?:[-*•◦▪‣·] |#{1,6} )|\s*[›»]+$", replacement="")
    low = pc.replace_substring_regex(pc.utf8_lower(bare), pattern=r"[0-9]+", replacement="0")
    low = pc.replace_substring_regex(low, pattern=r"\b0[-/.]0[-/.]0\b", replacement="0")
    chars = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.float64)
    offsets, codes, vocabulary = word_table(bare, lower=False)
    names = vocabulary.to_pylist()
    lower = [w.lower() for w in names]
    stop = np.fromiter((w in STOP_WORDS for w in lower), bool, len(names))
    capital = np.fromiter((w[:1].isupper() for w in names), bool, len(names))
    n_words = np.diff(offsets)
    stops = sums(stop[codes], offsets)
    dense = stops / np.maximum(1, n_words)
    furniture = _flags(low, FURNITURE) & (n_words <= FURNITURE_WORDS)
    cells = pc.count_substring_regex(bare, SEPARATOR).to_numpy(zero_copy_only=False)
    linked = (cells >= 1) & (n_words <= 6 * (cells + 1)) & (cells >= np.where(n_words <= 8, 1, 2))
    sentence = _flags(lines, r"[.!?…:;][\"'”’»)\]]*$")
    item = _flags(lines, ITEM) | _flags(lines, r"^\p{Ll}")
    labels = (capital[codes] & ~stop[codes]).astype(np.float64)
    menu = (n_words >= 5) & (n_words <= 14) & ~sentence & (dense <= 0.34) & (sums(labels, offsets) >= 0.5 * n_words) & (cells == 0)

    # blocks
    joined = np.where(spaced[doc], blanks, 0)
    run = item & (n_words >= 6)
    listed = np.concatenate([[False], run[1:] & run[:-1]])
    fresh = ~_same(doc) | np.where(spaced[doc], ~_same(joined), ~listed)
    block = np.cumsum(fresh) - 1
    n_blocks = int(block[-1]) + 1
    block_doc = doc[fresh]
    count = np.bincount(block, minlength=n_blocks)
    block_words = np.bincount(block, n_words, n_blocks)
    block_chars = np.bincount(block, chars, n_blocks)
    block_dense = np.bincount(block, stops, n_blocks) / np.maximum(1, block_words)

    # pass 1: long blocks of text are content, unless their lines are short labels
    wordy = block_words / count >= 6
    good = ((block_chars >= LONG) | (block_words >= LONG_WORDS)) & (block_dense >= STOPS_HIGH) & wordy & ~_any(linked & (n_words > 8), block, n_blocks)
    line_good = good[block] & ~furniture & ~linked

    # the subject of each page
    codes_line = np.repeat(np.arange(len(doc)), n_words)
    codes_doc = doc[codes_line]
    to_lower: dict[str, int] = {}
    lower_code = np.fromiter((to_lower.setdefault(w, len(to_lower)) for w in lower), np.int64, len(lower))
    word = lower_code[codes]
    base = len(to_lower) + 1
    inside = np.ones(len(codes), bool)
    inside[offsets[:-1][n_words > 0]] = False  # not the first word of a line
    after_end = _sentence_starts(bare, offsets, len(codes))
    long_word = line_good[codes_line]
    keys = codes_doc * base + word
    common = np.unique(keys[long_word & ~capital[codes]])  # also written small on its page: no name
    named = keys[long_word & capital[codes] & ~stop[codes] & inside & ~after_end]
    heads = pc.list_element(pc.split_pattern_regex(pc.fill_null(titles, ""), r"\s[|–—-]\s"), 0)
    t_offsets, t_codes, t_vocabulary = word_table(heads)
    t_word = np.fromiter((to_lower.get(w, -1) for w in t_vocabulary.to_pylist()), np.int64, len(t_vocabulary))[t_codes] if len(t_codes) else np.zeros(0, np.int64)
    t_doc = np.repeat(np.arange(n_docs), np.diff(t_offsets))
    plain = np.zeros(base, bool)
    plain[lower_code[stop]] = True
    t_keep = (t_word >= 0) & ~plain[t_word]
    title_keys = np.unique(t_doc[t_keep] * base + t_word[t_keep])
    subject = np.setdiff1d(np.union1d(named, np.intersect1d(title_keys, keys[long_word])), common)
    about = _member(keys, subject)
    on_subject = sums(about, offsets) > 0
    # a line that is the title itself
    plain_title = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(titles, "")), pattern=r"\s+", replacement=" "), characters=" ")
    own = pc.equal(pc.utf8_lower(bare), plain_title.take(pa.array(doc))).to_numpy(zero_copy_only=False)

    label = np.zeros(len(doc), np.int8)
    label[line_good] = GOOD
    short = (n_words <= FURNITURE_WORDS) & ~line_good
    label[short & (on_subject | own) & ~linked] = GOOD
    label[short & furniture & ~(on_subject & (sentence | (n_words >= 8)))] = BAD
    label[linked] = BAD
    label[short & menu & ~on_subject & ~own] = BAD
    label[~line_good & ~linked & ((~short & (dense >= STOPS_HIGH)) | (chars >= PARAGRAPH))] = GOOD
    # a box of several short lines stands or falls as a whole: side links under their head, footers, prompts
    box = (count >= 2) & ~good & (block_chars / count <= SHORT) & spaced[block_doc]
    tally = np.bincount(block, (label == GOOD) & (sentence | own | (n_words >= 9)), n_blocks)
    boxed_bad = box & (tally == 0) & (_any(label == BAD, block, n_blocks) | (block_dense < STOPS_LOW) | (count >= 3))
    label[boxed_bad[block]] = BAD

    # pages without any long text: what is not furniture is their message
    message = ~_any((label == GOOD) & (n_words >= FURNITURE_WORDS), doc, n_docs)
    label[message[doc] & ~furniture & ~linked & ~menu] = GOOD

    # pass 2: ambiguous lines inherit from the nearest decided lines of their page, before and after
    before, after = _nearest(label, doc), _nearest(label[::-1], doc[::-1])[::-1]
    near_good = (n_words >= 6) & (dense >= STOPS_HIGH)
    inherited = np.where((before == GOOD) & (after == GOOD), GOOD, np.where(((before == GOOD) | (after == GOOD)) & near_good & (before != BAD), GOOD, BAD))
    label = np.where(label == OPEN, inherited, label)
    return doc, number, label == GOOD


def _sentence_starts(lines: pa.Array, offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether each word follows the end of a sentence. Words are counted again with sentence ends kept as words."""
    marked = pc.replace_substring_regex(lines, pattern=r"[.!?:]+[\"'”’»)\]]*\s+", replacement=" 0ε0 ")
    offsets_2, codes, vocabulary = word_table(marked, lower=False)
    mark = pc.index(vocabulary, "0ε0").as_py()
    out = np.zeros(n, bool)
    if mark < 0:
        return out
    is_mark = codes == mark
    follows = np.concatenate([[False], is_mark[:-1]])
    kept = follows[~is_mark]
    if len(kept) == n:  # the words are the same, as a mark never joins two
        return kept
    return out


def _member(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys


def _nearest(label: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The label of the nearest decided line before each line in its document; OPEN where there is none."""
    decided = label != OPEN
    at = np.maximum.accumulate(np.where(decided, np.arange(len(label)), -1))
    found = np.where(at >= 0, label[at], OPEN)
    return np.where((at >= 0) & (doc[at] == doc), found, OPEN)


def labelled_lines(pages: DataFrame, key: str = "doc_id", text: str = "full_text", title: str = "title") -> DataFrame:
    """(key, line_no, main): every non-blank line of every text and whether it is main content.

    A narrow map over three columns and whole texts; a text that one batch can't hold with others is one of its own.
    Null, empty and blank texts give nothing, a null title is an empty one, repeated rows are repeated, null keys are
    kept, extra columns are never read."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, number, main = line_labels(batch.column("text"), batch.column("title"))
            if len(doc):
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), pa.array(number, pa.int32()), pa.array(main)], names=[key, "line_no", "main"])

    source = pages.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(title).alias("title")).where("text is not null")
    return source.mapInArrow(run, f"{key} {kind}, line_no int, main boolean")


def boilerplate_lines(pages: DataFrame, key: str = "doc_id", text: str = "full_text", title: str = "title") -> DataFrame:
    """(key, line_no), distinct: the non-blank lines that are not main content."""
    return labelled_lines(pages, key, text, title).where("not main").select(key, "line_no").distinct()


def main_content(pages: DataFrame, key: str = "doc_id", text: str = "full_text", title: str = "title", out: str = "main_text") -> DataFrame:
    """(key, out): each text with its main content only, lines in their order; blank lines that are left stand at most
    one by one. A null text stays null, one without main content becomes empty."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, number, main = line_labels(batch.column("text"), batch.column("title"))
            gone: dict[int, set[int]] = {}
            for d, n in zip(doc[~main].tolist(), number[~main].tolist()):
                gone.setdefault(d, set()).add(n)
            texts = []
            for i, t in enumerate(batch.column("text").to_pylist()):
                kept: list[str] | None = None if t is None else []
                for n, line in enumerate(t.split("\n") if t is not None else (), 1):
                    if n not in gone.get(i, ()) and (line.strip() or (kept and kept[-1].strip())):
                        kept.append(line)
                texts.append(None if kept is None else "\n".join(kept).strip())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], names=[key, out])

    return pages.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(title).alias("title")).mapInArrow(run, f"{key} {kind}, {out} string")
