"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks: block-level tags end one, inline tags and <br> don't. A block has its number of words
and its link density (share of words inside <a>), those of the blocks before and after it, and what it stands in
(page furniture such as menus, adverts and comments; an article or main element; a heading). A tree grown on the small
labelled table below says which blocks are main text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import tree

# HTML elements by what they do to the text.
SKIPPED = "script style template noscript svg math canvas iframe object select textarea button title audio video map"
BLOCK = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section summary table tbody td tfoot th "
    "thead tr ul"
)
VOID = "area base br col embed hr img input link meta param source track wbr"
FURNITURE = "nav header footer aside form menu dialog fieldset figure"
#: Words of class, id or role names of page furniture.
NAMES = (
    "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget widgets header masthead footer copyright "
    "comment comments respond replies disqus share sharing social related recommended newsletter subscribe subscription signup login "
    "search pagination pager tags toolbar complementary contentinfo"
)
_SKIPPED, _BLOCK, _VOID, _FURNITURE, _NAMES = (frozenset(x.split()) for x in (SKIPPED, BLOCK, VOID, FURNITURE, NAMES))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|svg|iframe|textarea|title)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/)?(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^<>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Class names with such a word say what an element has or lacks, not what it is.
DENIED = frozenset("has have no not non with without free".split())
_BITS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture", "article", "heading")

#: (words, link density, the same of the block before and of the one after, in furniture, in an article, a heading; main text?)
TABLE = (
    # menus, link lists and crumbs
    (1, 1, 0, 0, 1, 1, 1, 0, 0, 0), (2, 1, 1, 1, 3, 1, 1, 0, 0, 0), (5, 1, 2, 1, 30, 0, 1, 0, 0, 0), (4, 1, 3, 1, 4, 1, 0, 0, 0, 0),
    (12, 0.9, 4, 1, 40, 0, 0, 0, 0, 0), (1, 1, 1, 1, 1, 1, 0, 0, 0, 0), (3, 1, 60, 0, 3, 1, 0, 0, 0, 0), (6, 0.8, 2, 1, 2, 1, 0, 0, 0, 0),
    (2, 1, 40, 0, 2, 1, 1, 1, 0, 0), (3, 1, 2, 1, 50, 0, 1, 1, 0, 0), (8, 1, 6, 1, 7, 1, 0, 1, 0, 0), (5, 1, 80, 0, 4, 1, 0, 1, 0, 0),
    # adverts, notices, forms, page headers and footers, comments
    (8, 0, 1, 1, 10, 0, 1, 0, 0, 0), (25, 0, 2, 1, 60, 0, 1, 0, 0, 0), (120, 0, 80, 0, 70, 0, 1, 0, 0, 0), (9, 0.1, 50, 0, 0, 0, 1, 0, 0, 0),
    (14, 0.3, 80, 0, 0, 0, 1, 0, 0, 0), (3, 0, 1, 1, 12, 0, 1, 0, 1, 0), (40, 0, 30, 0, 20, 0, 1, 0, 0, 0), (15, 0, 60, 0, 45, 0, 1, 1, 0, 0),
    (60, 0, 45, 0, 70, 0, 1, 1, 0, 0), (2, 0, 90, 0, 20, 0, 1, 1, 1, 0), (1, 0, 50, 0, 50, 0, 1, 1, 0, 0), (200, 0, 5, 0, 5, 0, 1, 1, 0, 0),
    # short lines of pages without an article
    (3, 0, 0, 0, 2, 1, 0, 0, 0, 0), (5, 0, 2, 1, 1, 1, 0, 0, 0, 0), (6, 0, 40, 0, 0, 0, 0, 0, 0, 0), (4, 0, 3, 0, 5, 0, 0, 0, 0, 0),
    (7, 0.2, 3, 1, 6, 0, 0, 0, 0, 0), (2, 0, 6, 0, 3, 0, 0, 0, 0, 0), (9, 0, 5, 0, 4, 0, 0, 0, 0, 0), (8, 0.4, 20, 0, 8, 0, 0, 0, 0, 0),
    # paragraphs of pages without an article
    (30, 0, 4, 0, 28, 0, 0, 0, 0, 1), (80, 0.1, 30, 0, 60, 0, 0, 0, 0, 1), (18, 0, 70, 0, 40, 0, 0, 0, 0, 1), (150, 0, 1, 1, 4, 1, 0, 0, 0, 1),
    (14, 0, 50, 0, 60, 0, 0, 0, 0, 1), (45, 0.25, 30, 0, 3, 1, 0, 0, 0, 1), (11, 0, 40, 0, 90, 0, 0, 0, 0, 1), (25, 0.05, 2, 1, 2, 1, 0, 0, 0, 1),
    # headings before paragraphs of such pages
    (5, 0, 2, 1, 60, 0, 0, 0, 1, 1), (9, 0, 70, 0, 45, 0, 0, 0, 1, 1), (3, 0, 40, 0, 30, 0, 0, 0, 1, 1), (2, 0, 3, 1, 3, 1, 0, 0, 1, 0),
    # inside an article: paragraphs, short ones too, titles, lists
    (12, 0, 8, 0, 60, 0, 0, 1, 1, 1), (3, 0, 8, 0, 40, 0, 0, 1, 1, 1), (70, 0, 12, 0, 30, 0, 0, 1, 0, 1), (1, 0, 30, 0, 2, 0, 0, 1, 0, 1),
    (2, 0, 1, 0, 5, 0, 0, 1, 0, 1), (5, 0, 2, 1, 6, 0, 0, 1, 0, 1), (4, 0, 60, 0, 0, 0, 0, 1, 0, 1), (25, 0.2, 10, 0, 9, 0, 0, 1, 0, 1),
    (400, 0, 3, 0, 1, 1, 0, 1, 0, 1), (9, 0, 0, 0, 0, 0, 0, 1, 0, 1), (1, 0, 8, 0, 9, 0, 0, 1, 1, 1), (10, 0.4, 60, 0, 40, 0, 0, 1, 0, 1),
)


@cache
def model() -> tuple:
    t = np.array(TABLE, float)
    return tree.grow(t[:, :-1], t[:, -1])


def _furniture(name: str, attrs: str) -> bool:
    if name in _FURNITURE:
        return True
    if not attrs:
        return False
    if _HIDDEN.search(attrs):
        return True
    for m in _ATTR.finditer(attrs):
        for one in (m[1] or m[2] or m[3] or "").split():
            words = {b.lower() for b in _BITS.findall(one)}
            if words & _NAMES and not words & DENIED:
                return True
    return False


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words in links, in furniture, in an article, a heading) of the text blocks in page order."""
    out: list[tuple[str, int, int, int, int, int]] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # element, furniture, article: with those it is in
    words: list[str] = []  # text of the block so far
    linked = depth_link = heading = skipping = 0
    opened: Counter[str] = Counter()
    at = 0
    skip_name = ""

    def leave(k: int) -> None:
        """The elements from k on end."""
        if stack[-1][1] != stack[k - 1][1]:
            flush()
        opened.subtract(x[0] for x in stack[k:])
        del stack[k:]

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a and not skipping:
            t = html.unescape(page[a:b])
            words.append(t)
            if depth_link:
                linked += len(t.split())

    def flush() -> None:
        nonlocal linked
        if words:
            t = " ".join("".join(words).split())
            if t:
                n = t.count(" ") + 1
                out.append((t, n, min(n, linked), int(stack[-1][1]), int(stack[-1][2]), int(heading > 0)))
            words.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        text(at, m.start())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        close = m["close"]
        if skipping:
            if name == skip_name:
                skipping += -1 if close else 1
            continue
        if name in _SKIPPED and name != "title":
            if not close and not m["attrs"].endswith("/"):
                skip_name, skipping = name, 1
            continue
        if name == "a":
            depth_link = 0 if close else int("href" in m["attrs"].lower())
            continue
        if name == "br":
            words.append(" ")
            continue
        block = name in _BLOCK
        if block:
            flush()
            if len(name) == 2 and name[0] == "h" and name[1] in "123456":
                heading = 0 if close else 1
            elif heading:
                heading = 0
        if name in _VOID:
            continue
        if close:
            if opened[name]:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
            continue
        if block and opened["p"]:  # a block ends a paragraph, an item the one before
            k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p")
            if not any(x[0] in _BLOCK for x in stack[k + 1 :]):
                leave(k)
        if name in ("li", "option", "dd", "dt") and opened[name]:
            k = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name)
            if not any(x[0] in ("ul", "ol", "menu", "dl", "select") for x in stack[k + 1 :]):
                leave(k)
        if not m["attrs"].endswith("/"):
            _, was, article = stack[-1]
            now = was or (name not in ("body", "html", "article", "main") and _furniture(name, m["attrs"]))
            if now != was:
                flush()
            opened[name] += 1
            stack.append((name, now, article or name in ("article", "main") or "articlebody" in m["attrs"].lower()))
    text(at, len(page))
    flush()
    return out


def main_text(page: str | None) -> str:
    got = blocks(page or "")
    if not got:
        return ""
    a = np.array([(w, l / w, f, r, h) for _, w, l, f, r, h in got], float)
    before, after = np.zeros((len(a), 2)), np.zeros((len(a), 2))
    before[1:], after[:-1] = a[:-1, :2], a[1:, :2]
    keep = tree.decide(model(), np.column_stack([a[:, :2], before, after, a[:, 2:]])) >= 0.5
    return "\n".join(b[0] for b, k in zip(got, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` (page_id, url) of each row and its main text; n_chars has its code points.

    A null or empty page, and one without main text, has an empty text. Rows with null ids or urls and repeated rows are
    treated each; unclosed and stray tags are allowed, as are very long pages, which are read once from front to back; an empty table
    gives no rows; other columns, whatever their names, are left behind.
    """
    keep = keep or ["page_id", "url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                texts = pa.array([main_text(p) for p in batch.column(len(keep)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), texts], names=[*(f"k{i}" for i in range(len(keep))), "t"])

    ddl = ", ".join(f"k{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = pages.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_col).alias("h")).mapInArrow(run, f"{ddl}, t string")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("t").alias(text_col), F.length("t").cast("long").alias("n_chars"))
