"""Main text and title of HTML pages.

Trees are built by the standard library's tolerant parser inside Arrow batches; every page gives an array of candidate
texts, and the choice among them is a column expression. No page can fail a task: what cannot be read has no candidate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quern.functions.text import is_junk

#: Elements without content, elements around the content, roles and class words of page furniture.
SILENT = frozenset("script style noscript iframe svg".split())
AROUND = SILENT | frozenset("nav header footer form".split())
ROLES = frozenset("alert alertdialog dialog banner complementary navigation search".split())
NOISE = tuple(
    "cookie-banner cookieconsent cookie-notice consent-banner gdpr notification-bar alert-banner site-alert global-alert emergency-banner announcement-bar "
    "modal-backdrop popup-overlay lightbox-overlay search-widget search-bar-container site-search social-share share-buttons addthis skip-link skip-to-main "
    "a11y-bar newsletter-signup subscribe-form breadcrumbs breadcrumb-trail page-tools page-actions print-tools".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote br dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table td th tr ul".split())
#: Elements that an open one of the same kind ends.
_SELF_CLOSING = {"p": "p", "li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}
STRATEGIES = ("dense_recall", "dense", "scored", "main_region", "static_recall")
SHARE_OF_REGION = 0.4


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, breaks: bool = False) -> str:
        """All text below, without that of elements without content; with ``breaks`` blocks stand on own lines."""
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
                continue
            if breaks and node.tag in _BLOCKS:
                out.append("\n")
                todo.append("\n")
            todo.extend(reversed(node.children))
        return "".join(out)

    def without(self, gone) -> Node:
        """A copy without the elements for which ``gone`` holds; text after them stays. The root is never dropped."""
        copy = Node(self.tag, self.attrs, None)
        todo = [(self, copy)]
        while todo:
            old, new = todo.pop()
            for child in old.children:
                if isinstance(child, str):
                    new.children.append(child)
                elif not gone(child):
                    kept = Node(child.tag, child.attrs, new)
                    new.children.append(kept)
                    todo.append((child, kept))
        return copy


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _SELF_CLOSING and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _noise(node: Node) -> bool:
    if node.tag in SILENT or node.attrs.get("role", "").strip().lower() in ROLES:
        return True
    named = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".lower()
    return any(word in named for word in NOISE)


def clean(root: Node) -> Node:
    """The page without silent elements, furniture roles and furniture classes."""
    return root.without(_noise)


def _region(root: Node) -> Node | None:
    tests = (
        lambda n: n.tag == "main",
        lambda n: n.tag == "article",
        lambda n: "entry-content" in n.attrs.get("class", ""),
        lambda n: "page-content" in n.attrs.get("class", ""),
        lambda n: n.attrs.get("id") == "content",
        lambda n: n.attrs.get("role") == "main",
    )
    for test in tests:
        for node in root.walk():
            if test(node):
                return node
    return None


def _tidy(text: str) -> str:
    text = re.sub(" {2,}", " ", re.sub("\t+", " ", text))
    return re.sub("\n{3,}", "\n\n", text).strip()


def main_region(root: Node) -> str | None:
    """The text of the first region that is marked as the main one; null without one."""
    found = _region(root.without(lambda n: n.tag in AROUND))
    return (_tidy(found.text()) or None) if found is not None else None


def dense_blocks(root: Node, least_words: int, most_links: float) -> str | None:
    """The blocks with enough words and few words in links, and headings; blocks of a few words stay if the block
    before stays (published block rules on text length and link density)."""
    kept: list[str] = []
    stays = False
    for node in root.without(lambda n: n.tag in AROUND).walk():
        if node.tag not in _BLOCKS or any(isinstance(c, Node) and c.tag in _BLOCKS - {"br"} for c in node.children):
            continue
        text = re.sub(r"\s+", " ", node.text()).strip()
        n = len(text.split())
        if not n:
            continue
        linked = sum(len(a.text().split()) for a in node.walk() if a.tag == "a") / n
        stays = linked <= most_links and (n >= least_words or node.tag[0] == "h" and node.tag[1:].isdigit() or stays and n >= 3)
        if stays:
            kept.append(text)
    return "\n".join(kept) or None


def scored_article(root: Node) -> str | None:
    """The element whose own paragraphs score highest by commas and length, with its text."""
    best, score = None, 0.0
    tree = root.without(lambda n: n.tag in AROUND)
    for node in tree.walk():
        own = [c.text() for c in node.children if isinstance(c, Node) and c.tag in ("p", "li", "td", "pre")]
        total = sum(1 + t.count(",") + min(3, len(t) // 100) for t in own if len(t.strip()) >= 25)
        if total > score:
            best, score = node, total
    return (_tidy(best.text(breaks=True)) or None) if best is not None else None


def region_length(root: Node) -> int:
    """Characters of the main region, else of the page without what is around its content."""
    text = main_region(root) or _tidy(root.without(lambda n: n.tag in AROUND).text())
    return len(text)


def title_of(root: Node) -> str:
    """The page's title for sharing, else that of its head up to a dash or bar; empty without one."""
    named = ""
    for node in root.walk():
        if node.tag == "meta" and node.attrs.get("property") == "og:title" and node.attrs.get("content", "").strip():
            return node.attrs["content"].strip()
        if node.tag == "title" and not named:
            named = re.split(r"\s*[|\-–—]\s*", node.text().strip(), maxsplit=1)[0].strip()
    return named


_CANDIDATE = StructType([StructField("strategy", StringType()), StructField("prio", IntegerType()), StructField("text", StringType())])
_CANDIDATES = StructType([StructField("title", StringType()), StructField("length", IntegerType()), StructField("candidates", ArrayType(_CANDIDATE))])


@F.pandas_udf(_CANDIDATES)
def _pages(html: pd.Series, static: pd.Series) -> pd.DataFrame:
    def one(page: str | None, other: str | None) -> tuple:
        out = []
        title, length = "", 0
        if page:
            try:
                raw = parse(page)
                title, length = title_of(raw), region_length(raw)
                tree = clean(raw)
                out += [(0, dense_blocks(tree, 3, 0.6)), (1, dense_blocks(tree, 8, 0.34)), (2, scored_article(tree)), (3, main_region(tree))]
            except Exception:  # what the parser can't read has no candidate
                out = []
        if other:
            try:
                out.append((4, dense_blocks(clean(parse(other)), 3, 0.6)))
            except Exception:
                pass
        return title, length, [{"strategy": STRATEGIES[k], "prio": k, "text": t} for k, t in out if t]

    return pd.DataFrame([one(a, b) for a, b in zip(html, static)], columns=["title", "length", "candidates"])


def page_candidates(pages: DataFrame, html: str = "html", static: str | None = None) -> DataFrame:
    """``pages`` with ``title``, ``region_chars`` and ``candidates`` (strategy, prio, text). A null, empty or
    unreadable page has an empty title and no candidates."""
    other = F.col(static) if static else F.lit(None).cast("string")
    parsed = pages.withColumn("_p", _pages(F.col(html), other))
    return parsed.withColumns({"title": F.col("_p.title"), "region_chars": F.col("_p.length"), "candidates": F.col("_p.candidates")}).drop("_p")


def best_candidate(candidates: Column) -> Column:
    """(strategy, text) of the longest candidate that is no junk; ties go to the earlier strategy; without one the
    strategy is ``none`` and the text empty."""
    good = F.filter(candidates, lambda c: ~is_junk(c["text"]))
    ranked = F.transform(good, lambda c: F.struct(F.length(c["text"]).alias("n"), (-c["prio"]).alias("p"), c["strategy"].alias("strategy"), c["text"].alias("text")))
    top = F.array_max(ranked)
    return F.struct(F.coalesce(top["strategy"], F.lit("none")).alias("strategy"), F.coalesce(top["text"], F.lit("")).alias("text"))


def prefer_region(primary: Column, region: Column, share: float = SHARE_OF_REGION) -> Column:
    """The region's text where the primary one is shorter than ``share`` of it; null has length 0."""
    a, b = F.coalesce(F.length(primary), F.lit(0)), F.coalesce(F.length(region), F.lit(0))
    return F.when(a < b * share, region).otherwise(primary)


def build_documents(pages: DataFrame, url: str = "url", html: str = "html", static: str | None = None, label: str | None = None, least: int = 3) -> DataFrame:
    """(doc_id, source_uri, title, strategy, status, content_hash, full_text) of every page: candidates, choice,
    normalization, identities. ``status`` is ok, no_page or no_text; failed pages stay as rows with a null text, so
    that nothing is lost and no page stops the others."""
    from quern.functions.identity import content_hash, doc_id
    from quern.functions.text import normalize, not_blank

    chosen = page_candidates(pages, html, static).withColumn("_b", best_candidate(F.col("candidates"))).withColumn("_t", normalize(F.col("_b.text"), least))
    status = F.when(F.coalesce(F.col(html), F.lit("")) == "", "no_page").when(F.coalesce(F.col("_t"), F.lit("")) == "", "no_text").otherwise("ok")
    named = F.coalesce(not_blank(F.col(label)) if label else F.lit(None), not_blank(F.col("title")), F.lit(""))
    out = chosen.select(F.col(url).alias("source_uri"), named.alias("title"), F.col("_b.strategy").alias("strategy"), status.alias("status"), F.col("_t").alias("text"))
    ok = F.col("status") == "ok"
    return out.select(doc_id(F.col("source_uri")).alias("doc_id"), "source_uri", "title", "strategy", "status", F.when(ok, content_hash(F.col("text"))).alias("content_hash"), F.when(ok, F.col("text")).alias("full_text"))


def strategy_counts(built: DataFrame) -> DataFrame:
    return built.groupBy("status", "strategy").agg(F.count(F.lit(1)).alias("n"))
