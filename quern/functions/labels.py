"""Option labels of multiple-choice questions and of the answers to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import WHITE

#: Final-answer lines and per-option verdicts, and the words that make a verdict positive.
FINAL = r"(?im)^[\s*#>_-]*(?:(?:final |my )?answers?|therefore|(?:so )?the (?:correct|right) (?:options?|answers?|choices?)(?: is| are)?)[\s*_]*(?::|-|is\b|are\b)?[\s*_]*([A-Z](?:[\s*_]*(?:,|;|/|&|\band\b)[\s*_]*(?:and )?[A-Z])*)[\s*_]*(?:\.|$)"
VERDICT = r"(?im)^[\s*#>_-]*(?:option )?([A-Z])[\s*_]*[.:)–-][^\n]*?(?:\b(?:is )?(?<!not )(?:true|yes|correct|selected)\b|✓|✔|✅)"
NEGATIVE = r"(?i)\b(?:false|no|incorrect|not (?:true|correct|selected)|wrong)\b|✗|✘|❌"


def valid_labels(question: Column) -> Column:
    """The letters that begin a line of the question before a dot, sorted and distinct; null gives none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(rf"(?md)^[{WHITE}]*([A-Z])\."), 1)))


def letters(text: Column) -> Column:
    """The letters A to Z of a text in capitals, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit("([A-Z])"), 1))


def gold_labels(answer: Column, valid: Column) -> Column:
    return F.array_sort(F.array_intersect(letters(answer), valid))


def extract_labels(response: Column, valid: Column) -> Column:
    """The labels that a response commits to, sorted: those of its last final-answer line; without one, those with a
    positive verdict on their own line. A refusal, or letters in running text only, give none. Only valid labels
    count. This is a rule-based stand-in for a recorded extraction by a model."""
    text = F.coalesce(response, F.lit(""))
    finals = F.regexp_extract_all(text, F.lit(FINAL), 1)
    last = F.element_at(finals, -1)
    listed = F.array_distinct(F.regexp_extract_all(F.upper(F.regexp_replace(last, r"(?i)\band\b", ",")), F.lit("([A-Z])"), 1))
    verdicts = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(VERDICT) & ~x.rlike(NEGATIVE))
    marked = F.array_distinct(F.transform(verdicts, lambda x: F.upper(F.regexp_extract(x, VERDICT, 1))))
    return F.array_sort(F.array_intersect(F.when(F.size(finals) > 0, listed).otherwise(marked), valid))


def same_set(a: Column, b: Column) -> Column:
    """Whether two sets of labels are equal; two empty sets are."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def correct_labels(options: Column) -> Column:
    """The labels of the correct ones of options (label, text, is_correct), sorted and joined by commas."""
    return F.array_join(F.array_sort(F.transform(F.filter(options, lambda o: o["is_correct"]), lambda o: o["label"])), ", ")
