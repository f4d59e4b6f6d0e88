"""Records that a template or a server made in place of a page: unfilled placeholders, filler, error pages, notices.

Two naive Bayes classifiers, learned from positive and unlabelled examples by expectation-maximization:

* over the lines of a text. Positive are trusted records, short texts that hold a phrase of the published status
  messages or of sample copy; unlabelled is a sample of all records. Starting with every unlabelled record as
  negative, the E-step gives each its probability to be positive and the M-step counts words with these weights, so
  that messages which hold no trusted phrase are found by what they share with those that do. A line's score is the
  sum of the log odds of its words and of its length; a record's is the sum over its lines.
* over marked spans (in braces, brackets, percent or number signs and so on) of title and text. Positive are spans in
  the form of a template language; unlabelled are all others, most of which are notes in brackets.

Both are fitted on samples of bounded expected size (``FIT_TRUSTED``, ``FIT_UNLABELLED``, ``FIT_MARKED`` records,
chosen by a hash of their key) and then score every line and span of every record, whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.batches import slices
from quern.llm.words import per_word, sums, word_table

#: Records that the classifiers are fitted on: trusted ones, unlabelled ones, and ones with marked spans.
FIT_TRUSTED, FIT_UNLABELLED, FIT_MARKED = 3_000, 6_000, 4_000
#: Features are hashed to so many numbers; rounds of expectation-maximization; added to every count.
FEATURES, ROUNDS, SMOOTHING = 1 << 18, 12, 0.1
#: Characters up to which a text with a trusted phrase is a trusted message.
MESSAGE_CHARS = 400
#: Phrases of status messages and notices, and the words that all sample copy has.
TRUSTED = (
    r"(?i)\b(?:not found|could not be found|(?:4\d\d|5\d\d)\b.{0,20}\berror|internal (?:server )?error|access denied|do not have permission|gateway timeout|timed out|too many requests|service unavailable|temporarily down|something went wrong"
    r"|error establishing|javascript|browser is not supported|not a robot|checking your browser|coming soon|replace this copy|goes here|page .{0,40}introuvable)\b"
)
SAMPLE_COPY = ("lorem", "ipsum", "dolor")
#: What a span may be marked with, cheap to look for.
MARK = r"[\[\]{}<>%$@#&_]|(?:XX|xx)/|undefined|object Object"
SPAN = re.compile(
    r"\{[{%!]?[^{}\n]{0,60}\}{1,2}|\[{1,3}[^\[\]\n]{1,60}\]{1,3}|<{1,2}[^<>\n]{1,60}>{1,2}|\$\{[^{}\n]{1,60}\}|\$[A-Za-z_]\w*\$?|%\(\w+\)[sd]|%{1,2}\w+%{1,2}|@{1,2}\w+@{1,2}|#{1,2}\w+#{1,2}|&{1,2}\w+(?:&{1,2}|;)|__\w+__"
    r"|\b[Xx]{2}/[Xx]{2}/[Xx]{2,4}\b|\bundefined(?: undefined)+\b"
)
#: Spans in the form of a template language, or that say themselves that they are to be replaced.
PLACEHOLDER = re.compile(
    "|".join(
        (
            r"\{\{[^{}\n]{1,60}\}\}", r"\{%[^\n]{1,60}?%\}", r"\$\{[^{}\n]{1,60}\}", r"\{![^{}\n]{1,60}\}", r"\{[A-Za-z_][\w.]*\}", r"\{\d+\}", r"%\(\w+\)[sd]",
            r"<%[^\n]{1,60}?%>", r"<<[^<>\n]{1,60}>>", r"\[\[\[?[^\[\]\n]{1,60}\]\]\]?", r"%%\w+%%", r"%[A-Z][A-Z0-9_]{2,}%", r"@@\w+@@", r"&&\w+&&",
            r"#[A-Z][A-Z0-9_]{2,}#", r"__[A-Z][A-Z0-9_]*__", r"\$[A-Za-z]\w*\$", r"\[object Object\]", r"[Xx]{2}/[Xx]{2}/[Xx]{2,4}", r"undefined(?: undefined)+",
            r"\[(?i:insert|tbc|tbd|todo|your|add|enter)\b[^\[\]\n]{0,60}\]", r"<(?i:insert|your|add|enter)\b[^<>\n]{0,60}>",
        )
    )
)
_DIGITS = re.compile(r"\d+")
_INNER = re.compile(r"[^\W_]+")
#: Upper ends of the classes of line length, in words, and the limits that the longest line of a text may stay under.
_LENGTHS = np.array([1, 3, 6, 10, 16, 26, 40])
_LIMITS = np.array([16, 26, 40])


def _number(feature: str) -> int:
    return crc32(feature.encode()) % FEATURES


_LENGTH_OF_LINE = np.array([_number(f"\x00line {k}") for k in range(len(_LENGTHS) + 1)])
_UNDER = np.array([_number(f"\x00under {k}") for k in range(len(_LIMITS))])


class Lines:
    """The non-blank lines of a batch of texts: the text of each, the word features of each, its length class."""

    def __init__(self, texts: pa.Array) -> None:
        split = pc.split_pattern(pc.fill_null(texts, ""), "\n")
        bounds = split.offsets.to_numpy().astype(np.int64)
        lines = pc.utf8_trim_whitespace(split.flatten())
        there = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
        self.n = len(texts)
        self.doc = np.repeat(np.arange(self.n), np.diff(bounds))[there]
        self.lines = lines.filter(pa.array(there))
        zeros = pc.replace_substring_regex(self.lines, pattern=r"\d+", replacement="0")
        self.offsets, self.codes, self.vocabulary = word_table(zeros)
        self.numbers = per_word(self.vocabulary, _number, np.int64)
        words = np.diff(self.offsets)
        self.length = np.searchsorted(_LENGTHS, words)
        most = np.zeros(self.n, np.int64)
        np.maximum.at(most, self.doc, words)
        #: for each limit whether all lines of the text stay under it; of a short text several hold
        self.under = most[:, None] <= _LIMITS
        self.has = np.bincount(self.doc, minlength=self.n) > 0

    def counts(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """(features, counts) of each text."""
        ends = np.searchsorted(self.doc, np.arange(self.n + 1))
        out = []
        for i in range(self.n):
            a, b = ends[i], ends[i + 1]
            own = np.concatenate([self.numbers[self.codes[self.offsets[a] : self.offsets[b]]], _LENGTH_OF_LINE[self.length[a:b]], _UNDER[self.under[i]]])
            out.append(np.unique(own, return_counts=True))
        return out

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The log odds of each line."""
        return sums(weights[self.numbers][self.codes], self.offsets) + weights[_LENGTH_OF_LINE][self.length]

    def record_scores(self, weights: np.ndarray, prior: float) -> np.ndarray:
        """The log odds of each text: those of its lines and of the limits that its longest line stays under."""
        return np.bincount(self.doc, self.scores(weights), self.n) + self.under @ weights[_UNDER] + prior

    def spans(self) -> list[tuple[int, str]]:
        """(text, span) of every marked span of the lines."""
        marked = pc.match_substring_regex(self.lines, MARK).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(marked)
        return [(d, s) for d, x in zip(self.doc[at].tolist(), self.lines.take(pa.array(at)).to_pylist()) for s in SPAN.findall(x)]


def span_features(span: str) -> list[int]:
    """The features of a marked span: its marks, the letters inside, its words."""
    inner = _INNER.findall(_DIGITS.sub("0", span.replace("_", " _ ")))
    m = re.match(r"^\W*", span)
    open_, close = m.group(), re.search(r"\W*$", span).group()
    body = span[len(open_) : len(span) - len(close)]
    case = "none" if not re.search(r"[A-Za-z]", body) else "upper" if body.isupper() else "lower" if body.islower() else "mixed"
    shape = [f"open {open_}", f"close {close}", f"case {case}", f"joined {'_' in body or '.' in body}", f"space {' ' in body}", f"digits {bool(re.search(r'[0-9]', body))}"]
    return [_number("\x01" + x) for x in shape + [f"word {w.lower()}" for w in inner]]


def learn(positive: list[tuple[np.ndarray, np.ndarray]], unlabelled: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """(log odds of each feature, prior log odds) by naive Bayes and expectation-maximization from trusted positives
    and unlabelled examples, each (features, counts). Without positives nothing is positive."""
    if not positive:
        return np.zeros(FEATURES, np.float32), -1.0
    rows = np.concatenate([np.full(len(f), i) for i, (f, _) in enumerate(unlabelled)]) if unlabelled else np.zeros(0, np.int64)
    features = np.concatenate([f for f, _ in unlabelled]) if unlabelled else np.zeros(0, np.int64)
    counts = np.concatenate([c for _, c in unlabelled]).astype(np.float64) if unlabelled else np.zeros(0)
    trusted = np.bincount(np.concatenate([f for f, _ in positive]), np.concatenate([c for _, c in positive]), FEATURES)
    total = trusted + np.bincount(features, counts, FEATURES)
    seen = total > 0
    chance = np.zeros(len(unlabelled))
    for _ in range(ROUNDS):
        soft = np.bincount(features, counts * chance[rows], FEATURES) if len(rows) else np.zeros(FEATURES)
        a, b = trusted + soft + SMOOTHING, total - trusted - soft + SMOOTHING
        weights = np.where(seen, np.log(a / a[seen].sum()) - np.log(np.maximum(b, SMOOTHING) / np.maximum(b, SMOOTHING)[seen].sum()), 0.0)
        # the share of positives among all records is that among the unlabelled ones, which are a sample of them
        share = min(0.5, (chance.sum() + 1) / (len(unlabelled) + 2))
        prior = float(np.log(share / (1 - share)))
        odds = np.bincount(rows, counts * weights[features], len(unlabelled)) + prior if len(rows) else np.zeros(0)
        chance = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return weights.astype(np.float32), prior


class Model:
    """Both classifiers, ready to be sent to the workers: two arrays of ``FEATURES`` numbers."""

    def __init__(self, lines: tuple[np.ndarray, float], spans: tuple[np.ndarray, float]) -> None:
        self.lines, self.line_prior = lines
        self.span_weights, self.span_prior = spans

    def placeholder(self, span: str) -> bool:
        """Whether a span is an unfilled placeholder: trusted by its form, or by the score of its features."""
        return PLACEHOLDER.fullmatch(span) is not None or float(self.span_weights[span_features(span)].sum()) + self.span_prior > 0

    def judge(self, titles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(whether the text is a message or filler, whether title or text has a placeholder) of each record."""
        body = Lines(texts)
        message = (body.record_scores(self.lines, self.line_prior) > 0) & body.has
        held = np.zeros(len(texts), bool)
        for d, span in body.spans() + Lines(titles).spans():
            if not held[d] and self.placeholder(span):
                held[d] = True
        return message, held


def _trusted(text: Column) -> Column:
    copy = F.lower(text)
    filler = copy.contains(SAMPLE_COPY[0]) & copy.contains(SAMPLE_COPY[1]) & copy.contains(SAMPLE_COPY[2])
    return F.coalesce(((F.length(text) <= MESSAGE_CHARS) & text.rlike(TRUSTED)) | filler, F.lit(False))


def fit(records: DataFrame, key: str = "doc_id", title: str = "title", text: str = "full_text") -> Model:
    """The classifiers of ``records``. One pass counts trusted, marked and all records; a second takes the features of
    those whose key's hash is below the share that gives the wanted number of each."""
    source = records.select(F.col(title).alias("title"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("h"))
    source = source.select("title", "text", (F.shiftrightunsigned("h", 11) / F.lit(float(2**53))).alias("u"), _trusted(F.col("text")).alias("trusted"))
    source = source.withColumn("marked", F.coalesce(F.col("text").rlike(MARK), F.lit(False)) | F.coalesce(F.col("title").rlike(MARK), F.lit(False)))
    there = source.agg(F.count(F.lit(1)).alias("n"), F.count_if("trusted").alias("trusted"), F.count_if("marked").alias("marked")).first()
    share = {name: wanted / max(1, held) for name, wanted, held in (("trusted", FIT_TRUSTED, there.trusted), ("all", FIT_UNLABELLED, there.n), ("marked", FIT_MARKED, there.marked))}
    role = F.array_compact(
        F.array(
            F.when(F.col("trusted") & (F.col("u") < share["trusted"]), "trusted"),
            F.when(~F.col("trusted") & F.col("text").isNotNull() & (F.col("u") < share["all"]), "unlabelled"),
            F.when(F.col("marked") & (F.col("u") < share["marked"]), "marked"),
        )
    )
    chosen = source.where(f"u < {max(share.values())}").select("title", "text", role.alias("roles")).where("size(roles) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            roles = batch.column("roles").to_pylist()
            body = Lines(batch.column("text"))
            names, features, counts = [], [], []
            for role, (f, c) in zip(roles, body.counts()):
                for name in {"trusted", "unlabelled"} & set(role):
                    names.append(name), features.append(f), counts.append(c)
            for d, span in body.spans() + Lines(batch.column("title")).spans():
                if "marked" in roles[d]:
                    f, c = np.unique(span_features(span), return_counts=True)
                    names.append("span" if PLACEHOLDER.fullmatch(span) else "other"), features.append(f), counts.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(features, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["role", "features", "counts"])

    held: dict[str, list] = {"trusted": [], "unlabelled": [], "span": [], "other": []}
    for part in chosen.mapInArrow(run, "role string, features array<int>, counts array<int>").toArrow().to_batches():
        ends = part.column("features").offsets.to_numpy()
        features, counts = part.column("features").values.to_numpy().astype(np.int64), part.column("counts").values.to_numpy().astype(np.float64)
        starts = part.column("counts").offsets.to_numpy()
        for i, name in enumerate(part.column("role").to_pylist()):
            held[name].append((features[ends[i] : ends[i + 1]], counts[starts[i] : starts[i + 1]]))
    return Model(learn(held["trusted"], held["unlabelled"]), learn(held["span"], held["other"]))


def judged_records(records: DataFrame, key: str = "doc_id", title: str = "title", text: str = "full_text", model: Model | None = None) -> DataFrame:
    """(key, message, placeholder), one row for each row of ``records``: whether its text is a message or filler, and
    whether its title or text has an unfilled placeholder. Null and blank texts are no messages, null keys are kept,
    extra columns are never read. ``model`` is fitted on ``records`` unless given."""
    kind = records.schema[key].dataType.simpleString()
    shipped = records.sparkSession.sparkContext.broadcast(model or fit(records, key, title, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shipped.value
        for batch in slices(batches, "text"):
            message, placeholder = held.judge(batch.column("title"), batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(message), pa.array(placeholder)], names=[key, "message", "placeholder"])

    source = records.select(F.col(key).alias("key"), F.col(title).alias("title"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"{key} {kind}, message boolean, placeholder boolean")


def template_records(records: DataFrame, key: str = "doc_id", title: str = "title", text: str = "full_text", model: Model | None = None) -> DataFrame:
    """(key), distinct: the records with a placeholder in title or text, or whose text is a message or filler."""
    return judged_records(records, key, title, text, model).where("message or placeholder").select(key).distinct()


def without_templates(records: DataFrame, key: str = "doc_id", title: str = "title", text: str = "full_text", model: Model | None = None) -> DataFrame:
    """``records`` without those of ``template_records``; rows with a null key stay, as no key names them."""
    return records.join(template_records(records, key, title, text, model).withColumnRenamed(key, "_key"), F.col(key) == F.col("_key"), "left_anti")
