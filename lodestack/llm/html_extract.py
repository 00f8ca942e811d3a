"""Main-text extraction by minimum-cut labelling.

A page is cut into blocks. A logistic classifier over a block's text, links, tag, and the elements and class names around
it gives the cost of calling it content or boilerplate; these costs are the capacities of its edges to the two terminals.
Blocks that follow each other and blocks that are near in the DOM are tied by smoothness edges. The minimum cut, found by
maximum flow, separates content from boilerplate at the least total cost. Blocks whose own cost outweighs all their ties are
settled before the flow runs, which doesn't change the minimum. Only what a page hides is left out before the cut.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What comes before the next end of a tag or value in it.
INSIDE = re.compile(r"[^>=]*(?:=\s*)?")
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose text is never shown as text: those that eat the page if they aren't closed, and those that don't.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
EMBEDDED = frozenset("noscript template svg math object select option datalist audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an opening one of the same kind ends, up to the nearest of the holders.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot div section article aside nav footer header main body html form td th blockquote".split())
#: Elements of boilerplate (the last unless it's in an article), of content, and words of class names. Words of
#: ``CLEARED`` say nothing about an article inside.
OUTER_TAGS, GOOD_TAGS, HEADINGS = frozenset("nav footer aside form dialog menu button head header".split()), frozenset(("article", "main")), frozenset("h1 h2 h3 h4 h5 h6".split())
OUTER_WORDS = frozenset("nav navbar navigation menu menubar footer sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr comment comments commentlist disqus reply replies respond breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login popup modal share sharing social search searchbox complementary contentinfo related recommended recommendations widget teaser rail header masthead banner notice notices alert announcement toolbar topbar aside skip copyright legal disclaimer tags byline meta hidden".split())
CLEARED = frozenset("search searchbox social share sharing login header masthead banner notice notices alert announcement toolbar topbar skip legal meta hidden tags byline".split())
GOOD_WORDS = frozenset("article content main post entry story body text articlebody".split())
#: Words that tell nothing about what is inside.
PLAIN_WORDS = frozenset("box wrapper container wrap list item items bar area block section inner outer top bottom left right center column col row grid slot unit panel overlay form field label link links button btn icon icons title heading js is has the site page global primary secondary mobile desktop large small sticky fixed dark light layer group region module component id class new".split())
CLASS_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BUTTON_END = re.compile("</button", re.IGNORECASE)
#: Fitted (see ``fit_weights`` and its test): the classifier's weights, in the order of ``block_features``.
WEIGHTS = (-1.1, 0.7, -2.4, 1.5, 1.6, -1.1, 0.5, 4.2, 4.1, -2.4, -2.8, 0.3, -3.5)
#: Fitted: ties of blocks that follow each other, with the same parent or not; of nearest blocks with the same parent,
#: grandparent; the part that is left where the elements around differ.
NEXT_SAME, NEXT_OTHER, SAME_PARENT, SAME_GRANDPARENT, OTHER_PLACE = 0.6, 0.15, 0.8, 0.1, 0.02
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@dataclass(slots=True)
class Around:
    """What the elements around a block tell: an article, class names of content, elements of boilerplate, class names of
    boilerplate, class names that are mixed, and whether it isn't shown. ``soft``: what an article inside takes back."""

    article: bool = False
    good: bool = False
    outer: bool = False
    named: bool = False
    mixed: bool = False
    hidden: bool = False
    soft: bool = False


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    around: Around
    link_share: float
    parent: int
    grandparent: int
    away: bool = False  # outside of the article, on a page that has one


@dataclass(slots=True)
class _Open:
    """An open element; ``holder`` and ``cell`` are the places in the stack of the nearest holder and table cell."""

    tag: str
    number: int
    around: Around
    holder: int = 0
    cell: int = 0


def _around(tag: str, attributes: str, before: Around) -> Around:
    """``before`` with what an element adds to it."""
    outer, good, named, mixed, hidden, soft = before.outer, before.good, before.named, before.mixed, before.hidden, before.soft
    article = before.article or tag in GOOD_TAGS
    found: list[set[str]] = []
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), values[0] or values[1] or values[2]
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                found += [{w.lower() for w in CLASS_WORD.findall(token)} for token in value.split()]
            elif (name == "style" and HIDDEN.search(value)) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                hidden = True
    if tag in GOOD_TAGS and soft:
        named, soft = False, False
    if tag in OUTER_TAGS and not (tag == "header" and before.article):
        outer, soft = (True, soft) if tag != "header" else (outer, True)
        named = named or tag == "header"
    if tag not in ("html", "body"):
        for words in found:
            telling = words - PLAIN_WORDS
            bad = telling & OUTER_WORDS
            if bad and bad == telling:
                if not named and bad <= CLEARED and tag not in GOOD_TAGS:
                    soft = True
                elif not bad <= CLEARED:
                    soft = False
                named = True
            elif bad:
                mixed = True
            elif telling & GOOD_WORDS:
                good = True
    return Around(article, good, outer, named, mixed, hidden, soft)


class _Page:
    """Looks ahead in a page. Whatever isn't found once isn't looked for again, so that all looks together are linear."""

    def __init__(self, page: str):
        self.page, self.missing, self.matched = page, set(), {}

    def find(self, what: str, at: int) -> int:
        """Place of ``what`` from ``at`` on, -1 if there is none."""
        found = -1 if what in self.missing else self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: behind the next ``>`` outside of a quoted value; -1 if it doesn't."""
        page = self.page
        start = at
        while True:
            at = INSIDE.match(page, at).end()
            if at >= len(page):
                break
            if page[at] == ">":
                return at + 1
            if page[at] in "\"'":
                close = self.find(page[at], at + 1)
                at = close + 1 if close >= 0 else at + 1
            else:
                at += 1
        end = self.find(">", start)
        return end + 1 if end >= 0 else -1

    def raw_end(self, tag: str, at: int) -> int:
        """Behind the end tag of an element of raw text, or the end of the page."""
        close = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(self.page, at)
        end = self.find(">", close.end()) if close else -1
        return end + 1 if end >= 0 else len(self.page)

    def element_end(self, tag: str, at: int) -> int:
        """Behind the end tag of the element whose start tag begins at ``at``, nested ones counted; -1 if it isn't closed."""
        if tag not in self.matched:
            ends, open_ = {}, []
            for m in re.compile(f"<(/?){tag}(?=[\\s/>])", re.IGNORECASE).finditer(self.page):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    end = self.find(">", m.end())
                    ends[open_.pop()] = end + 1 if end >= 0 else len(self.page)
            self.matched[tag] = ends
        return self.matched[tag].get(at, -1)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page with text, in order, less what the page hides. Broken markup is read as far as it goes."""
    out: list[Block] = []
    stack = [_Open("", 0, Around())]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a kind are
    number = at = 0
    parts: list[str] = []
    shown = linked = 0
    in_link = unclosed = False
    end, ahead = len(page), _Page(page)

    def flush() -> None:
        nonlocal shown, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            top = stack[-1]
            if text and not top.around.hidden:
                out.append(Block(text, top.tag, top.around, linked / max(1, shown), stack[-2].number if len(stack) > 1 else 0, stack[-3].number if len(stack) > 2 else 0))
            parts.clear()
        shown = linked = 0

    def close_from(i: int) -> None:
        for element in reversed(stack[i:]):
            places[element.tag].pop()
        del stack[i:]

    def last(tag: str) -> int:
        found = places.get(tag)
        return found[-1] if found else 0

    def take(text: str) -> None:
        nonlocal shown, linked
        parts.append(text)
        n = len(text.strip())
        shown += n
        linked += n * in_link

    while at < end:
        start = ahead.find("<", at)
        if start < 0:
            take(page[at:])
            break
        if start > at:
            take(page[at:start])
        m = NAME.match(page, start)
        if not m:
            if page.startswith("<!--", start):
                close = start + 1 if page.startswith(("<!-->", "<!--->"), start) else ahead.find("-->", start + 4)
                at = end if close < 0 else page.index(">", close) + 1
            elif page.startswith(("<!", "<?", "</"), start) and (close := ahead.find(">", start)) >= 0:
                at = close + 1
            else:
                take("<")
                at = start + 1
            continue
        after = ahead.tag_end(m.end())
        if after < 0:  # no tag ends from here on
            take(page[start:])
            break
        at, closing, tag, attributes = after, bool(m[1]), m[2].lower(), page[m.end() : after - 1]
        if tag in RAW or tag in EMBEDDED:
            if not closing and not attributes.endswith("/"):
                if tag in RAW:
                    at = ahead.raw_end(tag, at)
                elif (close := ahead.element_end(tag, start)) >= 0:
                    at = close
            continue
        if tag == "a":
            in_link = not closing
        if tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            in_link = in_link and not closing
            if closing:
                i = last(tag)
                if i and not (tag in ("p", "div", "li") and stack[-1].cell > i):
                    close_from(i)
            else:
                if tag in ENDS:
                    i = max(map(last, ENDS[tag]))
                    if i and i >= stack[-1].holder:
                        close_from(i)
                elif stack[-1].tag == "p":
                    close_from(len(stack) - 1)
                if tag not in VOID:
                    number += 1
                    top, here = stack[-1], len(stack)
                    stack.append(_Open(tag, number, _around(tag, attributes, top.around), here if tag in HOLDERS else top.holder, here if tag in ("td", "th", "table") else top.cell))
                    places.setdefault(tag, []).append(here)
        elif tag == "button" and not closing:
            close = None if unclosed else BUTTON_END.search(page, at)
            unclosed = not close
            at = close.start() if close else at
    flush()
    home = [_is_home(b.around) for b in out]
    if any(home):
        for b, inside in zip(out, home, strict=True):
            b.away = not inside
    return out


def _is_home(around: Around) -> bool:
    """Whether the elements around tell of an article, and none of boilerplate."""
    return (around.article or around.good) and not (around.outer or around.named)


def block_features(block: Block) -> list[float]:
    """What the classifier sees: bias, words, share of link text, sentence end, heading, paragraph, item; the article, names of
    content (both only without boilerplate around), elements of boilerplate, names of boilerplate, mixed names around it; whether
    it's outside of the page's article."""
    words, a = block.text.count(" ") + 1, block.around
    clean = not (a.outer or a.named)
    ends = block.text[-1] in ".!?:;\"'”»…)"
    return [1.0, min(5.0, math.log1p(words)), block.link_share, ends, block.tag in HEADINGS, block.tag in ("p", "blockquote", "pre"), block.tag in ("li", "td", "th", "dt", "dd"), a.article and clean, a.good and clean, a.outer, a.named, a.mixed, block.away]


def content_logit(block: Block) -> float:
    """Logarithm of the odds that a block is content."""
    return sum(w * x for w, x in zip(WEIGHTS, block_features(block), strict=True))


def fit_weights(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic classifier over ``block_features`` by Newton steps with a ridge penalty."""
    w = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        slope = rows.T @ (p - labels) + ridge * w
        w -= np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w)), slope)
    return w


def ties(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges between blocks (i < j) that follow each other or are near in the DOM.

    They weaken with contrast: where the elements around or the shares of link text differ.
    """
    edges: dict[tuple[int, int], float] = {}
    last_parent: dict[int, int] = {}
    last_grand: dict[int, int] = {}

    def tie(i: int, j: int, weight: float) -> None:
        a, b = blocks[i], blocks[j]
        alike = (1.0 if a.around == b.around else OTHER_PLACE) * (1.0 - abs(a.link_share - b.link_share))
        edges[i, j] = edges.get((i, j), 0.0) + weight * max(0.0, alike)

    for j, b in enumerate(blocks):
        if j:
            tie(j - 1, j, NEXT_SAME if blocks[j - 1].parent == b.parent else NEXT_OTHER)
        for seen, key, w in ((last_parent, b.parent, SAME_PARENT), (last_grand, b.grandparent, SAME_GRANDPARENT)):
            if (i := seen.get(key)) is not None:
                tie(i, j, w)
            seen[key] = j
    return edges


def max_flow(capacity: list[dict[int, float]], source: int, sink: int) -> set[int]:
    """Runs Dinic's algorithm on residual capacities (changed in place); returns the source's side of the minimum cut."""
    tiny = 1e-9
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in capacity[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level)
        arcs = {u: iter(list(capacity[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                least = min(capacity[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    capacity[a][b] -= least
                    capacity[b][a] = capacity[b].get(a, 0.0) + least
                first = next(i for i, (a, b) in enumerate(zip(path, path[1:], strict=False)) if capacity[a][b] <= tiny)
                del path[first + 1 :]
                continue
            for v in arcs[u]:
                if capacity[u].get(v, 0.0) > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                level.pop(u)
                path.pop()


def minimum_cut(own: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Labels (True: content) that minimise the sum of what labels cost (a node's ``own``: cost of the label False less
    that of True) and of the edges between different labels. A tie is boilerplate."""
    n = len(own)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), w in edges.items():
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    net, label = list(own), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(net[i]) > sum(near[i].values()):
            label[i] = net[i] > 0
            for j, w in near[i].items():
                net[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    if None in label:
        open_ = [i for i in range(n) if label[i] is None]
        at = {i: k for k, i in enumerate(open_)}
        source, sink = len(open_), len(open_) + 1
        capacity: list[dict[int, float]] = [{} for _ in range(len(open_) + 2)]
        for i in open_:
            k = at[i]
            for j, w in near[i].items():
                capacity[k][at[j]] = w
            a, b = (source, k) if net[i] > 0 else (k, sink)
            capacity[a][b] = abs(net[i])
            capacity[b].setdefault(a, 0.0)
        side = max_flow(capacity, source, sink)
        for i in open_:
            label[i] = at[i] in side
    return [bool(x) for x in label]


def label_blocks(page: str) -> list[tuple[Block, bool]]:
    blocks = blocks_of(page)
    return list(zip(blocks, minimum_cut([content_logit(b) for b in blocks], ties(blocks)), strict=True))


def main_text(page: str) -> str:
    return "\n".join(b.text for b, good in label_blocks(page) if good)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_content of every row of ``pages``.

    Null or empty html gives empty text. Repeated rows come out as often as they went in; an empty table gives an empty
    result; other columns are ignored. The whole page is read, whatever its length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [label_blocks(x) for x in batch["html"]]
            texts = ["\n".join(b.text for b, good in f if good) for f in found]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts)), "n_blocks": list(map(len, found)), "n_content": [sum(g for _, g in f) for f in found]})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    found = rows.mapInPandas(run, "page_id string, url string, text string, n_chars long, n_blocks long, n_content long")
    return found.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
