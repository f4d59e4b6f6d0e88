"""Text functions as column expressions. A null stays null unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python knows it, which Java's ``\\s`` does not, as the inside of a character class (Java and RE2).
WHITE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WHITE}]"
#: The same characters as a text.
WHITE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: White space without the line feed.
HWS = r"[\t\x{0b}-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters that quote comparison leaves out.
QUOTE_SIGNS = "$€£¥₹%'\"`‘’“”–—-"
#: What the pages of bot checks say.
JUNK_MARKERS = (
    "think you were a bot",
    "pardon our interruption",
    "please enable javascript",
    "access to this page has been denied",
    "request unsuccessful. incapsula",
    "checking your browser before accessing",
)
JUNK_WORDS = 30
#: The forms of a heading line: numbered with a dot after every number, capitals, number signs.
HEADINGS = (rf"^(?:[0-9]+\.)+{WS}+[^{WHITE}].*$", r"^[A-Z][A-Z0-9 \-&:,/]{3,}$", rf"^#{{1,4}}{WS}+[^{WHITE}].*$")
HEADING_CHARS = 120


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Texts in ASCII never reach Python's normalization."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), _nfkc(text)).otherwise(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_CHARS))


def newline_unify(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def hws_collapse(text: Column) -> Column:
    """Runs of white space other than line feeds become one space. Single spaces, the most, are not matched."""
    return F.regexp_replace(text, f"{HWS}{{2,}}|{HWS.replace('-\\x{20}', '-\\x{1f}')}", " ")


def short_line_filter(text: Column, least: int = 3) -> Column:
    """Only the lines of at least ``least`` characters without outer white space; blank lines go too."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: F.length(strip(x)) >= least), "\n")


def blank_run_collapse(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def normalize(text: Column, least: int = 3, unicode: bool = True) -> Column:
    """NFKC, line feeds, spaces, short lines (none if ``least`` is 0, which keeps blank lines), blank runs, outer
    white space."""
    t = hws_collapse(newline_unify(nfkc(text) if unicode else text))
    t = short_line_filter(t, least) if least > 0 else t
    return strip(blank_run_collapse(t))


def quote_normalize(text: Column) -> Column:
    """What two quotes are compared by: lower case, without currency, percent, quote and dash signs, spaces single."""
    return strip(F.regexp_replace(F.translate(F.lower(text), QUOTE_SIGNS, ""), f"{WS}{{2,}}|{WS.replace('-\\x{20}', '-\\x{1f}')}", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WS + "+", -1), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def is_junk(text: Column) -> Column:
    """Null, empty, under ``JUNK_WORDS`` words, or the page of a bot check."""
    low = F.lower(text)
    marked = F.lit(False)
    for marker in JUNK_MARKERS:
        marked = marked | low.contains(marker)
    return F.coalesce((word_count(text) < JUNK_WORDS) | marked, F.lit(True))


def is_heading(line: Column) -> Column:
    t = strip(line)
    form = F.lit(False)
    for pattern in HEADINGS:
        form = form | t.rlike(pattern)
    return F.coalesce(F.length(t).between(1, HEADING_CHARS) & form, F.lit(False))


def sentence_split(text: Column) -> Column:
    """Cut where ``.``, ``!`` or ``?`` is followed by white space."""
    return F.split(text, rf"(?<=[.!?]){WS}+", -1)


def paragraph_split(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n", -1), strip), lambda x: x != "")


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def path_part(text: Column) -> Column:
    return F.replace(F.lower(strip(text)), F.lit(" "), F.lit("_"))


def display_name(text: Column) -> Column:
    """``new-south_wales`` as ``New South Wales``; null and empty give an empty text."""
    parts = F.filter(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("-"), F.lit("_")), "_", -1), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1_000_000)))), " ")


def clip(text: Column, chars: int) -> Column:
    """The first ``chars`` code points, as a display field needs them."""
    return F.substring(text, 1, chars)


def or_empty(text: Column) -> Column:
    """Null as an empty text, else without outer white space."""
    return F.coalesce(strip(text), F.lit(""))


def not_blank(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def pipe_join(parts: Column) -> Column:
    return F.array_join(parts, " | ")


def pipe_split(text: Column, trimmed: bool = False) -> Column:
    """The non-empty parts of a list joined by `` | ``; null gives no parts."""
    parts = F.split(F.coalesce(text, F.lit("")), r" \| ", -1)
    parts = F.transform(parts, strip) if trimmed else parts
    return F.filter(parts, lambda x: x != "")


def truthy(text: Column) -> Column:
    """Whether a text says true, 1 or yes, whatever its case; null is false."""
    return F.coalesce(F.lower(strip(text)).isin("true", "1", "yes"), F.lit(False))


def is_zero(value: Column) -> Column:
    """Whether the whole part of a number is zero; null, NaN and texts that are no whole number are false."""
    return F.coalesce(value.try_cast("int") == 0, F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """Percent with one decimal, half to even; null where the whole is zero."""
    return F.bround(F.try_divide(part.cast("double") * 100, whole.cast("double")), 1)


def json_field(text: Column, name: str) -> Column:
    """A field of a JSON object as text; null, unreadable JSON and absent fields give an empty text."""
    return F.coalesce(F.get_json_object(text, f"$.{name}"), F.lit(""))


def fill_template(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced in one pass: a value that holds braces is not filled again."""
    import re

    parts: list[Column] = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        parts.append(F.coalesce(values[part], F.lit("")) if i % 2 else F.lit(part))
    return F.concat(*parts)


def clamp(value: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def letter(number: Column) -> Column:
    """1 as A, 2 as B and so on."""
    return F.chr(number + 64)
