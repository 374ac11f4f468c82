"""Main text of web pages as a maximum-scoring subsequence of words and tags.

A page becomes a sequence of text runs and tags. Words score positive, tags
negative, and one linear scan finds the contiguous region with the largest sum
(Pasternack and Roth, WWW 2009). The weights come from labelled pages: those with
one ``<article>`` element, inside of which is content. For every context (section,
tag) the share of its words and tags inside is counted; a word scores the share
inside, a tag costs ``TAG_COST`` times the share outside. The labelled element is
hidden from the contexts, so the weights also serve pages that mark no article:
an unknown section counts like the labelled one.

The text of a page is the words of its region, without the elements that are no
article wherever they stand: menus, headers, footers, sidebars, forms, scripts,
styles, and what is named as notice, advert or reader comments. Each block is one
line; ``<br>`` is white space inside its block.

The model is fitted on about ``SAMPLE_PAGES`` pages, picked by hash; its contexts
are counted by Spark and number at most a few per page of that sample. Extraction
reads every page, whole, without a shuffle.

Defined results: a null or empty html, and one without words outside such elements,
has the empty text; broken markup is read as browsers do (an unclosed comment or
script takes the rest of the page, a stray ``<`` is text, a truncated reference
stays as it is); ties give the earliest region; repeated rows and ids give a row
each, a null id or url is kept; an empty table gives an empty result, and a table
without labelled pages is read with the weights of an unknown context; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_PAGES = 1_000  # bound of the labelled sample
TAG_COST = 8.0  # words that a tag seen outside only outweighs
TAG_LEAST = 0.05
SMOOTHING = 1.0

# fixed values: elements of HTML
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr")
SECTIONS = ("article", "aside", "body", "dialog", "div", "footer", "form", "head", "main", "menu", "nav", "section")
NOT_TEXT = ("aside", "button", "dialog", "footer", "form", "head", "header", "menu", "nav", "option", "select")
# fixed values: words of class, id and role attributes that name something beside the article
NOT_ARTICLE = ("ad", "ads", "advert", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs",
               "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "disqus", "footer", "masthead",
               "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "related",
               "responses", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar",
               "widget")
# fixed values: a name with one of these describes the page ("has-sidebar"), not the element
STATES = ("has", "no", "with", "without")
UNKNOWN = "?"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^<>]*>|</[^<>]*>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_RAW, _VOID, _INLINE, _SECTIONS = frozenset(RAW), frozenset(VOID), frozenset(INLINE), frozenset(SECTIONS)
_NOT_TEXT, _NOT_ARTICLE, _STATES = frozenset(NOT_TEXT), frozenset(NOT_ARTICLE), frozenset(STATES)


@dataclass(slots=True)
class Token:
    """A text run or a tag: where it stands, and whether its words can be article text."""

    section: str
    tag: str
    text: str | None  # None for a tag
    breaks: bool  # a tag that ends a block
    hidden: bool  # inside an element that is no article
    depth: int  # of open article elements


def _names(attributes: str) -> tuple[str, bool]:
    """The first class of an element, and whether a name says it is beside the article."""
    first, beside = "", False
    for kind, *values in _NAMED.findall(attributes):
        value = "".join(values).lower()
        if kind.lower() == "class" and value.split():
            first = first or value.split()[0]
        words = _WORD.findall(value)
        beside = beside or not (_NOT_ARTICLE.isdisjoint(words) or _STATES.intersection(words))
    return first, beside


def tokens(html: str) -> Iterator[Token]:
    """Text runs and tags of a page in order."""
    stack: list[tuple[str, str, bool, bool]] = []  # open sections: tag, name, hidden, marked as article
    opened: Counter = Counter()  # how many of a tag the stack holds
    inner, depth, at, end = "body", 0, 0, len(html)
    while at < end:
        found = _TOKEN.search(html, at)
        stop = found.start() if found else end
        section, hidden = (stack[-1][1], stack[-1][2]) if stack else ("body", False)
        if stop > at:
            yield Token(section, inner, html[at:stop], False, hidden, depth)
        if not found:
            return
        at = found.end()
        if not found.group(2):
            continue
        closing, tag = bool(found.group(1)), found.group(2).lower()
        if tag in _RAW and not closing:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = html.find(">", close.start()) + 1 if close else end
            at = at or end
            continue
        name, beside = _names(found.group(3)) if found.group(3) and not closing else ("", False)
        if tag == "p" and not closing and stack and stack[-1][0] == "p":
            opened[stack.pop()[0]] -= 1  # a paragraph ends where the next one begins
            section, hidden = (stack[-1][1], stack[-1][2]) if stack else ("body", False)
        heading = tag == "header" and depth > 0 and not opened[tag]  # the head of an article is part of it
        if tag not in _VOID and not heading and (tag in _SECTIONS or tag in _NOT_TEXT or beside or opened[tag]):
            if closing:
                ends = opened[tag] > 0
                while ends:
                    last, section, hidden, marked = stack.pop()
                    opened[last] -= 1
                    depth -= marked
                    ends = last != tag
            else:
                hidden = hidden or beside or tag in _NOT_TEXT
                section = f"{tag}.{name}" if name else tag
                marked = tag == "article" and not hidden
                depth += marked
                stack.append((tag, section, hidden, marked))
                opened[tag] += 1
        if tag not in _INLINE:
            inner = tag if not closing else (stack[-1][0] if stack else "body")
        yield Token(section, tag, None, tag not in _INLINE, hidden, depth)


def _context(token: Token) -> tuple[str, str]:
    """Section and tag; the labelled element goes by the name of an unknown one."""
    return UNKNOWN if token.section.startswith("article") else token.section, token.tag


def label_counts(html: str) -> Counter:
    """``(kind, section, tag, inside)`` of the words and tags of a labelled page; empty for any other page."""
    counts: Counter = Counter()
    page = list(tokens(html))
    if sum(t.text is None and t.tag == "article" and t.depth == 1 for t in page) != 1:
        return counts
    for t in page:
        words = len(t.text.split()) if t.text is not None else 1
        if words and not (t.text is None and t.tag == "article"):
            kind = "tag" if t.text is None else "word"
            counts[(kind, *_context(t), t.depth > 0 and not t.hidden)] += words
    return counts


@dataclass
class Weights:
    """Shares inside the article by (kind, section, tag), by (kind, section), by kind."""

    inside: dict[tuple, float] = field(default_factory=dict)
    every: dict[tuple, float] = field(default_factory=dict)

    def add(self, kind: str, section: str, tag: str, inside: bool, n: int) -> None:
        for key in ((kind, section, tag), (kind, section)):
            self.every[key] = self.every.get(key, 0) + n
            if inside:
                self.inside[key] = self.inside.get(key, 0) + n

    def share(self, kind: str, section: str, tag: str, hidden: bool) -> float:
        """Share inside, smoothed towards that of the section."""
        if hidden and (section == UNKNOWN or (kind, section) not in self.every):
            return 0.0
        if (kind, section) not in self.every:
            section = UNKNOWN
        share = 0.5
        for key in ((kind, section), (kind, section, tag)):
            share = (self.inside.get(key, 0) + SMOOTHING * share) / (self.every.get(key, 0) + SMOOTHING)
        return share

    def score(self, token: Token) -> float:
        section, tag = _context(token)
        if token.text is not None:
            return len(token.text.split()) * self.share("word", section, tag, token.hidden)
        if token.depth and (token.hidden or ("tag", section, tag) not in self.every):
            return -TAG_LEAST  # whatever stands inside a marked article does not cut it
        if tag in _SECTIONS and not token.hidden and ("tag", section, tag) not in self.every:
            return -TAG_COST / 2 - TAG_LEAST  # may open or close an article that is not marked
        return -TAG_COST * (1 - self.share("tag", section, tag, token.hidden)) - TAG_LEAST


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the largest positive sum; the earliest of equals."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(html: str | None, weights: Weights) -> str:
    """The blocks of the best region, one a line."""
    page = list(tokens(html or ""))
    first, last = best_region([weights.score(t) for t in page])
    blocks: list[list[str]] = [[]]
    for t in page[first:last]:
        if t.breaks:
            blocks.append([])
        elif t.tag == "br" and t.text is None:
            blocks[-1].append(" ")
        elif t.text is not None and not t.hidden:
            blocks[-1].append(t.text)
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def fit_weights(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> Weights:
    """Count the contexts of about ``SAMPLE_PAGES`` pages, picked by a hash of id and page."""
    rows = pages.count()
    share = min(1.0, SAMPLE_PAGES / max(rows, 1))
    place = F.pmod(F.xxhash64(F.col(page_id), F.col(html)), F.lit(1_000_000_007))
    picked = pages.filter(place < int(share * 1_000_000_007)).select(F.col(html).alias("html"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                total.update(label_counts(page or ""))
        rows = [dict(zip(("kind", "section", "tag", "inside"), key), n=n) for key, n in total.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [("kind", pa.string()), ("section", pa.string()), ("tag", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))

    counted = picked.mapInArrow(count, "kind string, section string, tag string, inside boolean, n bigint")
    weights = Weights()
    for row in counted.groupBy("kind", "section", "tag", "inside").agg(F.sum("n").alias("n")).collect():
        weights.add(row.kind, row.section, row.tag, row.inside, row.n)
    return weights


def extract_pages(
    pages: DataFrame, weights: Weights | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; ``weights`` are fitted on ``pages`` unless given."""
    model = fit_weights(pages, page_id, html) if weights is None else weights

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, model) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    read = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(html).cast("string").alias("html"))
    return read.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
