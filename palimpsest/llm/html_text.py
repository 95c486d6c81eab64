"""Main text of web pages: flat blocks, shallow features of neighbours, and a small decision tree.

A page is read once from left to right into blocks: the text between tags that begin or end a
paragraph-like element.  A block has its number of words, its link density (share of words inside
links), both of these for the block before and after, how far an enclosing element says that it is
something else, and whether it lies in an article or main element and the page has one.  A tag, role or
plain name ("sidebar", "user-comments") says so outright; a name that only mentions such a thing
("layout-sidebar-right", "has-comments") counts by the share of the page's plain words that lie outside
its element, so a wrapper around the article counts little.  A decision tree, grown on the labelled table
below, tells the article's blocks from the rest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.scratch import map_arrow

# Element names, roles and name parts that tell what an element holds.
BREAKING = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
UNSEEN = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "canvas", "audio", "video")
CONTAINERS = frozenset("article aside body button details dialog div dl fieldset figure footer form header html main menu nav ol search section select span table tbody td th tr ul p".split())
OTHER_TAGS = frozenset("nav footer aside form menu dialog select button search fieldset".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer "
    "disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related reply replies "
    "respond responses share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets".split()
)

# Parts of a name that speaks of a page's layout and not of what the element holds.
QUALIFIERS = frozenset("has no not with without show hide layout page is".split())
MAIN_NAMES = frozenset("article article-body articlebody article-content post-content post-body entry-content story-body main-content maincontent".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z)))", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for name in UNSEEN}


@dataclass
class Block:
    """Text between two breaks, its words inside links, how far (0 to 100) it is something else, and whether an article's."""

    text: str
    words: int
    linked: int
    other: float
    article: bool


OUTRIGHT, MENTIONED = 2, 1


def _named(value: str) -> int:
    """How far a class or id names something other than an article."""
    found = 0
    for token in value.split():
        parts = [x.lower() for x in _NAME_PART.findall(token)]
        if OTHER_NAMES.isdisjoint(parts):
            continue
        if parts[-1] in OTHER_NAMES and QUALIFIERS.isdisjoint(parts):
            return OUTRIGHT
        found = MENTIONED
    return found


def _speaks_of_other(tag: str, attributes: str, in_article: bool) -> int:
    """How far an element is by its own account no part of an article."""
    if tag in OTHER_TAGS or tag == "header" and not in_article:
        return OUTRIGHT
    if not attributes or tag in ("body", "html", "article", "main"):
        return 0
    found = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return OUTRIGHT
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return OUTRIGHT
        if name == "role" and value.lower() in OTHER_ROLES:
            return OUTRIGHT
        if name in ("class", "id"):
            found = max(found, _named(value))
    return found


def _speaks_of_article(tag: str, attributes: str) -> bool:
    """Whether an element is by its own account the article."""
    if tag in ("article", "main") or not attributes:
        return tag in ("article", "main")
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value == "main" or name == "itemprop" and value == "articlebody" or name in ("class", "id") and not MAIN_NAMES.isdisjoint(value.split()):
            return True
    return False


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; those without a word are left out."""
    out: list[Block] = []
    # of each block, the innermost element around it that mentions something else; of each such
    # element, the one around it and its plain words
    around: list[int] = []
    above: list[int] = []
    plain: list[int] = []
    stack: list[tuple[str, bool, bool, int]] = []
    mention = -1
    pieces: list[str] = []
    linked: list[str] = []
    other = article = link = False
    at = 0

    def close() -> None:
        if pieces:
            words = html.unescape("".join(pieces)).split()
            if words:
                within = len(html.unescape("".join(linked)).split()) if linked else 0
                out.append(Block(" ".join(words), len(words), min(within, len(words)), 100.0 * other, article))
                around.append(mention)
                if mention >= 0 and not other:
                    plain[mention] += len(words) - out[-1].linked
            pieces.clear()
            linked.clear()

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            pieces.append(text)
            if link:
                linked.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if tag in _ENDS and not ending and not m[3].endswith("/>"):
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag in BREAKING:
                close()
            else:
                pieces.append(" ")
            continue
        if tag in BREAKING:
            close()
        elif tag == "br":
            pieces.append(" ")
        if tag == "a":
            link = not ending
            linked.append(" ")
        if tag not in CONTAINERS:
            continue
        if tag == "p" and (ending or not m[3].strip(" />")):
            # a paragraph without attributes says nothing, but ends one that does
            if stack and stack[-1][0] == "p":
                _, other, article, mention = stack.pop()
            continue
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close()
                    _, other, article, mention = stack[i]
                    del stack[i:]
                    break
        elif not m[3].endswith("/>"):
            new = _speaks_of_other(tag, m[3], article)
            if new and not other:
                close()
            stack.append((tag, other, article, mention))
            if new == MENTIONED and not other:
                above.append(mention)
                mention = len(plain)
                plain.append(0)
            other, article = other or new == OUTRIGHT, article or _speaks_of_article(tag, m[3])
    close()
    total = max(1, sum(b.words - b.linked for b in out if not b.other))
    for i in range(len(plain) - 1, -1, -1):  # an element comes after the one around it
        if above[i] >= 0:
            plain[above[i]] += plain[i]
    for b, i in zip(out, around, strict=True):
        if i >= 0:  # those further out hold more
            b.other = max(b.other, 100.0 - 100.0 * plain[i] / total)
    return out


FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "other", "article", "page_article")

# Labelled blocks: the features above (densities and other in percent), then 1 for article text.
LABELLED = """
1 100 0 0 1 100 100 0 1 0
1 100 1 100 1 100 100 0 1 0
2 100 1 100 14 0 100 0 1 0
14 0 1 100 12 0 100 0 1 0
12 0 14 0 60 0 0 1 1 1
60 0 12 0 3 0 0 1 1 1
3 0 60 0 1 0 0 1 1 1
1 0 3 0 80 0 0 1 1 1
80 5 1 0 9 0 0 1 1 1
9 0 80 5 25 8 0 1 1 1
25 8 9 0 7 14 0 1 1 1
6 100 30 0 40 0 0 1 1 1
1 100 40 0 50 0 0 1 1 1
200 0 40 2 0 0 0 1 1 1
1 0 1 0 1 0 0 1 1 1
1 0 2 0 4 0 0 1 1 1
2 0 1 0 12 0 0 1 1 1
3 0 10 0 2 0 0 1 1 1
4 0 8 0 9 0 0 1 1 1
5 0 14 0 8 0 0 1 1 1
7 0 5 0 6 0 0 1 1 1
4 100 3 100 5 100 0 1 1 0
2 100 2 100 20 0 0 1 1 1
8 50 16 0 3 100 0 1 1 1
10 0 14 0 8 0 0 1 1 1
11 0 4 0 10 0 0 1 1 1
15 0 9 0 8 0 0 1 1 1
2 0 16 0 17 0 0 1 1 1
6 0 17 0 7 0 0 1 1 1
5 0 0 0 2 0 0 1 1 1
3 0 2 0 0 0 0 1 1 1
13 0 12 0 14 0 0 1 1 1
16 0 2 100 6 0 0 1 1 1
5 20 1 100 7 0 0 1 1 1
24 4 6 0 8 0 0 1 1 1
70 0 70 0 70 0 0 1 1 1
20 0 2 0 90 0 0 0 1 0
45 0 8 0 60 0 0 0 1 0
90 0 30 0 10 0 0 0 1 0
25 0 100 0 12 0 0 0 1 0
150 2 40 0 40 0 0 0 1 0
7 0 50 0 30 0 0 0 1 0
8 0 200 0 0 0 100 0 1 0
40 0 12 0 9 0 100 1 1 0
15 20 40 0 10 0 100 1 1 0
70 0 30 0 80 0 100 0 1 0
30 0 100 0 20 0 0 0 1 0
60 0 25 0 0 0 0 0 1 0
5 0 60 0 4 100 0 0 1 0
4 100 5 0 3 100 0 0 1 0
1 100 0 0 1 100 0 0 0 0
2 100 1 100 2 100 0 0 0 0
3 67 2 100 10 0 0 0 0 0
9 0 3 100 55 0 0 0 0 1
4 0 1 100 60 0 0 0 0 1
3 0 2 100 25 4 0 0 0 1
7 0 1 100 90 0 0 0 0 1
2 0 1 100 14 0 0 0 0 1
5 0 1 100 2 100 0 0 0 0
8 0 2 100 0 0 0 0 0 0
3 0 1 100 1 100 0 0 0 0
2 0 0 0 1 100 0 0 0 0
3 0 0 0 2 100 0 0 0 0
2 0 22 0 4 0 0 0 0 1
4 0 2 0 2 0 0 0 0 1
2 0 4 0 22 0 0 0 0 1
3 0 30 0 0 0 0 0 0 1
1 0 5 0 1 0 0 0 0 1
8 0 9 10 8 100 0 0 0 1
5 0 6 0 3 100 0 0 0 1
6 0 1 100 15 0 0 0 0 1
3 0 2 100 40 5 0 0 0 1
5 0 3 100 22 10 0 0 0 1
9 0 0 0 30 0 0 0 0 1
2 0 0 0 25 0 0 0 0 1
7 10 14 0 5 0 0 0 0 1
2 0 8 0 5 0 0 0 0 1
20 0 1 100 1 100 0 0 0 1
14 0 1 0 3 33 0 0 0 1
12 0 2 0 4 25 0 0 0 1
16 0 1 0 3 33 0 0 0 1
10 0 1 0 2 50 0 0 0 1
11 0 3 0 0 0 0 0 0 1
13 0 1 100 2 100 0 0 0 1
17 5 3 100 4 50 0 0 0 1
24 0 2 100 3 0 0 0 0 1
2 0 1 100 1 100 0 0 0 0
5 0 2 100 3 0 0 0 0 0
4 0 1 100 5 0 0 0 0 0
6 0 1 100 0 0 0 0 0 0
9 0 3 100 5 100 0 0 0 0
4 20 1 100 6 0 0 0 0 0
3 0 0 0 1 100 0 0 0 0
1 0 0 0 2 100 0 0 0 0
3 0 0 0 1 100 0 0 0 0
55 0 9 0 40 3 0 0 0 1
40 3 55 0 6 0 0 0 0 1
6 0 40 3 70 0 0 0 0 1
1 0 70 0 30 0 0 0 0 1
30 10 6 0 45 0 0 0 0 1
45 0 30 10 18 0 0 0 0 1
18 0 45 0 25 6 0 0 0 1
25 6 18 0 5 100 0 0 0 1
5 100 45 0 4 100 0 0 0 0
4 100 5 100 6 0 0 0 0 0
6 0 4 100 0 0 0 0 0 0
7 0 3 100 2 100 0 0 0 0
8 25 2 100 0 0 0 0 0 0
12 60 20 0 10 70 0 0 0 0
22 55 12 60 9 80 0 0 0 0
90 4 2 100 3 100 0 0 0 1
35 0 0 0 0 0 0 0 0 1
4 0 0 0 0 0 0 0 0 1
150 1 0 0 0 0 0 0 0 1
22 0 22 0 2 0 100 0 0 0
30 0 5 0 0 0 100 0 0 0
25 0 2 0 3 0 100 0 0 0
60 0 4 0 12 0 100 0 0 0
2 0 22 0 4 0 100 0 0 0
4 0 2 0 2 0 100 0 0 0
6 0 22 0 9 0 100 0 0 0
12 0 8 0 15 0 100 0 0 0
15 5 30 0 25 0 100 0 0 0
24 0 2 100 3 0 100 0 0 0
20 0 1 100 1 100 100 0 0 0
3 0 30 0 0 0 100 0 0 0
9 0 0 0 30 0 100 0 0 0
45 0 40 3 6 0 100 0 0 0
55 0 9 0 40 3 100 0 0 0
18 0 45 0 25 6 100 0 0 0
35 0 0 0 0 0 100 0 0 0
28 0 60 0 50 0 100 0 0 0
40 0 30 0 30 0 100 0 0 0
10 0 40 0 12 0 100 0 0 0
3 100 10 0 5 0 100 0 0 0
120 0 60 0 0 0 100 0 0 0
3 100 4 100 2 100 0 1 1 0
2 100 3 100 6 100 0 1 1 0
5 100 9 100 12 100 0 1 1 0
1 100 2 100 1 100 0 1 1 0
8 90 6 100 7 95 0 1 1 0
60 0 12 0 30 0 10 0 0 1
35 3 60 0 5 0 12 0 0 1
14 0 2 0 60 5 8 0 0 1
3 0 2 100 40 0 15 0 0 1
60 0 12 0 30 0 10 1 1 1
35 3 60 0 5 0 12 1 1 1
3 0 60 0 1 0 20 1 1 1
1 0 3 0 80 0 30 1 1 1
45 0 30 0 20 0 40 1 1 1
20 0 5 0 45 0 38 0 0 1
2 100 1 100 2 100 10 0 0 0
1 100 0 0 1 100 12 0 0 0
60 0 12 0 30 0 70 0 0 0
35 3 60 0 5 0 85 0 0 0
14 0 2 0 60 5 92 0 0 0
3 0 2 100 40 0 95 0 0 0
60 0 12 0 30 0 75 1 1 0
25 0 40 0 20 0 88 1 1 0
3 0 60 0 1 0 97 1 1 0
12 0 3 0 30 0 66 1 1 0
30 0 20 0 40 0 64 0 1 0
22 0 80 0 15 0 99 1 1 0
90 0 40 0 30 0 80 0 0 0
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table."""
    rows = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return rows[:, :-1], rows[:, -1].astype(int)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10) -> tuple:
    """Binary decision tree by Gini impurity: (label,) or (feature, threshold, up to it, above it)."""
    share = y.mean() if len(y) else 0.0
    if depth == 0 or share in (0.0, 1.0):
        return (bool(share >= 0.5),)
    best: tuple = ()
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values[:-1], values[1:], strict=True):
            side = x[:, f] <= (low + high) / 2
            p, q = y[side].mean(), y[~side].mean()
            impurity = side.mean() * p * (1 - p) + (~side).mean() * q * (1 - q)
            if not best or impurity < best[0] - 1e-12:
                best = (impurity, f, (low + high) / 2)
    if not best:
        return (bool(share >= 0.5),)
    _, f, cut = best
    side = x[:, f] <= cut
    return (f, cut, grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1))


def decide(tree: tuple, features: tuple[float, ...]) -> bool:
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def features_of(blocks: list[Block]) -> list[tuple[float, ...]]:
    has = any(b.article for b in blocks)
    shape = [(0.0, 0.0), *((float(b.words), 100.0 * b.linked / b.words) for b in blocks), (0.0, 0.0)]
    return [(*shape[i + 1], *shape[i], *shape[i + 2], b.other, float(b.article), float(has)) for i, b in enumerate(blocks)]


def main_text(page: str | None, tree: tuple) -> str:
    """The article's blocks, joined by line breaks."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return "\n".join(b.text for b, f in zip(blocks, features_of(blocks), strict=True) if decide(tree, f))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per input row, repeated rows included.

    The text is empty for a null or empty page and for one without article text.  Character
    references are decoded, white space inside a block becomes one space.  Other columns take no
    part; an empty table gives an empty result.
    """
    tree = grow(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x, tree) for x in part.column(2).to_pylist()]
                n = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(f"`{key}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{page}`").cast("string").alias("html"))
    return map_arrow(source, run, "page_id long, url string, text string, n_chars long")
