"""Operator 1: main text of web pages from flat text blocks.

A page is cut into flat blocks of text at block-level tags. Each block gets its
word count and link density and those of its neighbours, and what its
containers say about it (article, page furniture, neither). A decision tree,
grown at start from the small labelled table below, tells article from the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that end a block, from the HTML standard's rendering of display: block. Fixed values.
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
summary table tbody td tfoot th thead tr ul""".split())
#: Elements whose content is never markup; it is left out.
RAW = set("script style textarea title iframe noembed noframes xmp".split())
#: Elements that hold no prose.
NO_PROSE = set("audio button canvas datalist map math noscript object select svg template video".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that a following one of the same kind closes.
SHORT = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr"},
         "option": {"option"}}

#: Words of class, id and role that mark page furniture, adverts and comments.
FURNITURE = set("""ad ads adv advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment
comments commentlist complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer gdpr infobox
legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination
paywall popular popup promo promoted promotion recommendations recommended related replies reply respond responses search share
sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser teasers toolbar topbar trending widget
widgets""".split())
#: Those of them that count on an article element as well.
FURNITURE_ARTICLE = set("ad ads advert comment comments promo related reply replies respond sponsored teaser".split())
#: Words that mark the article.
ARTICLE = set("article articlebody content entry main post story".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s=>/]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"']?[^\s>]*+))?|=)*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=>/]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?""")
END_OF_RAW = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE) for name in RAW}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

# what the containers of a block say
DROPPED, PLAIN, WEAK, STRONG = -1, 0, 1, 2


@dataclass
class Block:
    text: str
    words: int
    linked: int
    zone: int          # DROPPED, PLAIN, WEAK (article by name) or STRONG (article element)
    heading: int       # 1: h1, 2: h2 to h6
    item: int          # list item


@dataclass
class _Open:
    tag: str
    zone: int
    sealed: bool       # nothing inside can become article again
    title_only: bool   # header of an article: its headings belong to the article
    link: bool
    heading: int
    item: int


def _zone(tag: str, rest: str, above: _Open) -> tuple[int, bool, bool]:
    attrs = {k.lower(): (v[1:-1] if v[:1] in "\"'" and v else v) for k, v in ATTRIBUTE.findall(rest)}
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "")):
        return DROPPED, True, False
    named = " ".join(attrs.get(k, "") for k in ("class", "id", "role", "itemprop"))
    words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower()))
    words |= {w.lower() for w in re.findall(r"[A-Za-z]+", named)}
    if tag in NO_PROSE or tag in ("nav", "aside", "footer", "menu", "dialog", "search"):
        return DROPPED, True, False
    if tag not in ("html", "body", "main") and words & (FURNITURE_ARTICLE if tag == "article" else FURNITURE):
        return DROPPED, True, False
    if above.sealed:
        return above.zone, True, above.title_only
    if tag == "header":
        return (above.zone, False, True) if above.zone > PLAIN else (DROPPED, False, False)
    if tag == "form":
        return DROPPED, False, False
    if tag == "article" or "articlebody" in words:
        return STRONG, False, False
    if tag == "main" or words & ARTICLE and tag not in ("html", "body"):
        return max(above.zone, WEAK), False, False
    return above.zone, False, above.title_only


def blocks(html: str) -> list[Block]:
    """Flat text blocks of a page in order; blocks without text are left out."""
    found: list[Block] = []
    pieces: list[str] = []
    linked = 0
    stack = [_Open("", PLAIN, False, False, False, 0, 0)]
    here = stack[0]
    # where the open elements of each tag stand, the open blocks, and those of them that hold short blocks: an end tag
    # finds its element, or that there is none, at once
    places: dict[str, list[int]] = {}
    containers, holders = [0], [0]

    def open_(element: _Open) -> None:
        places.setdefault(element.tag, [0]).append(len(stack))
        if element.tag in BLOCK:
            containers.append(len(stack))
            if element.tag not in SHORT:
                holders.append(len(stack))
        stack.append(element)

    def close() -> None:
        tag, at = stack.pop().tag, len(stack)
        places[tag].pop()
        for own in (containers, holders):
            if own[-1] == at:
                own.pop()

    def add(text: str) -> None:
        nonlocal linked
        if here.tag in NO_PROSE or not text:
            return
        text = unescape(text) if "&" in text else text
        pieces.append(text)
        if here.link:
            linked += len(text.split())

    def flush() -> None:
        nonlocal linked
        words = "".join(pieces).split()
        if words:
            zone = here.zone
            if here.title_only and not here.heading:
                zone = DROPPED
            found.append(Block(" ".join(words), len(words), min(linked, len(words)), zone, here.heading, here.item))
        pieces.clear()
        linked = 0

    at, size = 0, len(html)
    while at < size:
        tag_at = html.find("<", at)
        if tag_at < 0:
            add(html[at:])
            break
        add(html[at:tag_at])
        after = html[tag_at + 1:tag_at + 4]
        if after.startswith("!--"):
            end = html.find("-->", tag_at + 4)
            at = size if end < 0 else end + 3
            continue
        if after[:1] in ("!", "?") or after[:1] == "/" and not after[1:2].isalpha():
            end = html.find(">", tag_at)
            at = size if end < 0 else end + 1
            continue
        if not (after[:1].isascii() and after[:1].isalpha() or after[:1] == "/"):
            add("<")
            at = tag_at + 1
            continue
        m = TAG.match(html, tag_at)
        if not m:                                   # a tag that the page never closes
            break
        closing, tag, rest = m.group(1), m.group(2).lower(), m.group(3)
        at = m.end()
        if tag == "br":
            add(" ")
        elif closing:
            if tag in BLOCK:
                flush()
            k = places.get(tag, (0,))[-1]
            # an end tag does not reach out of its container
            if k and (tag in BLOCK or k >= containers[-1]) and (tag not in SHORT or k >= holders[-1]):
                while len(stack) > k:
                    close()
            here = stack[-1]
            if tag == "a" and here.tag != "a":
                here.link = False
        elif tag in RAW:
            end = END_OF_RAW[tag].search(html, at)
            at = end.end() if end else size
        elif tag in VOID:
            if tag in BLOCK:
                flush()
        elif tag == "a":
            here.link = True
        else:
            if tag in BLOCK:
                flush()
                if tag in SHORT or here.tag == "p":
                    while stack[-1].tag == "p" or stack[-1].tag in SHORT.get(tag, ()):
                        close()
                    here = stack[-1]
            if tag in BLOCK or tag in NO_PROSE or rest.strip(" /"):
                zone, sealed, title_only = _zone(tag, rest, here)
                if tag in BLOCK or tag in NO_PROSE or (zone, sealed) != (here.zone, here.sealed):
                    if tag not in BLOCK:
                        flush()                     # an inline element of another kind is a block of its own
                    level = 1 if tag == "h1" else 2 if tag in ("h2", "h3", "h4", "h5", "h6") else 0
                    here = _Open(tag, zone, sealed, title_only, here.link and tag not in BLOCK, level or here.heading,
                                 int(tag == "li" or here.item and tag not in ("ul", "ol")))
                    open_(here)
        if closing and tag not in BLOCK and len(stack) and pieces and stack[-1].zone != here.zone:
            flush()
    flush()
    return found


#: Columns of the labelled table. zone: 2 the page's article, 1 article by name on a page that has a better one, 0 no
#: container says anything on this page, -1 outside of the page's article, -2 furniture.
FEATURES = "zone heading item words density words_before density_before words_after density_after".split()

#: Kinds of blocks labelled by hand (last column: 1 article). ``a/b`` stands for one row with each value.
LABELLED = """
-2 0/1/2 0/1 1/4/9/30/120 0/0.3/1 0/3/60 0/1 0/3/60 0/1 0
-1 0/1/2 0/1 1/4/9/30/120 0/0.3/1 0/3/60 0/1 0/3/60 0/1 0
1 0/2 0/1 1/4/9/30/120 0/0.3/1 0/3/60 0/1 0/3/60 0/1 0
1 1 0 1/4/9/30 0/0.3/1 0/3/60 0/1 0/3/60 0/1 1
2 1/2 0 1/4/9/30 0/0.3/1 0/3/60 0/1 0/3/60 0/1 1
2 0 0/1 1/4/9/30/120 0/0.3/0.6 0/3/60 0/1 0/3/60 0/1 1
2 0 0 4/9/30/120 1 0/3/60 0 0/3/60 0 1
2 0 0/1 1/4/9 1 3/60 1 0/3/60 0/1 0
2 0 0/1 1/4/9 1 0/3/60 0/1 3/60 1 0
0 0 0/1 16/30/120 0/0.3 0/3/60 0/1 0/3/60 0/1 1
0 0 0/1 1/4/9 0/0.3 30/60 0 30/60 0 1
0 0 0/1 1/4/9 0/0.3 0/3/9 0/1 0/3/60 0/1 0
0 0 0/1 1/4/9 0/0.3 30/60 0/1 0/3/9 0/1 0
0 0 0/1 1/4/9/30/120 0.6/1 0/3/60 0/1 0/3/60 0/1 0
0 1/2 0 1/4/9 0/0.3 0/3/60 0/1 30/60 0 1
0 1/2 0 1/4/9 0/0.3 0/3/60 0/1 0/3/9 0/1 0
0 1/2 0 1/4/9 1 0/3/60 0/1 0/3/9 0/1 0
"""


def grow(features: np.ndarray, labels: np.ndarray, depth: int = 12) -> tuple | float:
    """Decision tree by Gini impurity: (column, limit, at most, above) or the share of label 1."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for column in range(features.shape[1]):
        values = np.unique(features[:, column])
        for limit in (values[1:] + values[:-1]) / 2:
            low = features[:, column] <= limit
            impurity = sum(part.sum() * labels[part].mean() * (1 - labels[part].mean()) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, column, float(limit), low)
    if best is None:
        return share
    _, column, limit, low = best
    return column, limit, grow(features[low], labels[low], depth - 1), grow(features[~low], labels[~low], depth - 1)


def train(table: str = LABELLED) -> tuple | float:
    """The tree of a labelled table."""
    rows = np.array([row for line in table.strip().splitlines() for row in product(*(x.split("/") for x in line.split()))], dtype=float)
    return grow(rows[:, :-1], rows[:, -1])


def is_article(tree: tuple | float, row: tuple) -> bool:
    while isinstance(tree, tuple):
        column, limit, low, high = tree
        tree = low if row[column] <= limit else high
    return tree >= 0.5


def main_text(html: str | None, tree: tuple | float) -> str:
    """Blocks that the tree calls article, joined by line feeds."""
    found = blocks(html or "")
    top = max((b.zone for b in found), default=PLAIN)
    kept = []
    for k, b in enumerate(found):
        if b.zone == DROPPED:
            zone = -2
        elif top <= PLAIN:
            zone = 0
        else:
            zone = 2 if b.zone == top else 1 if b.zone > PLAIN else -1
        sides = [(x.words, x.linked / x.words) if x else (0, 0.0)
                 for x in (found[k - 1] if k else None, found[k + 1] if k + 1 < len(found) else None)]
        if is_article(tree, (zone, b.heading, b.item, b.words, b.linked / b.words, *sides[0], *sides[1])):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            tree: tuple | float | None = None) -> DataFrame:
    """``<id_col>, <url_col>, text, n_chars`` for every row of ``pages``.

    Rows are mapped one to one without a shuffle. A null or empty page, or one
    without article blocks, has an empty text; nulls in the other columns stay;
    columns not named are left out. Nothing is cut: long pages are read whole.
    """
    grown = train() if tree is None else tree

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(lambda x: main_text(x, grown)).astype(object)

    return (pages.select(F.col(f"`{id_col}`"), F.col(f"`{url_col}`"), text(F.col(f"`{html_col}`")).alias("text"))
            .withColumn("n_chars", F.length("text").cast("bigint")))
