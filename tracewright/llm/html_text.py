"""Operator 3: main text of web pages by minimum-cut labelling.

A page is read tag by tag into blocks, the stretches of text between block-level tags. A linear classifier of a block's place (landmark
elements, roles, class and id words) and shape (length, share of linked text, closing punctuation) gives the cost of calling it
content or boilerplate. It is a logistic regression, fitted at the driver on the pages of ``html_examples``, which are labelled by hand. Blocks that follow
each other pay for different labels, the more so the nearer they are in the tree of elements, and so do blocks of one parent
element. The minimum cut of that network is the labelling of least total cost. No word and no element decides by itself: what a block's place
says can be outweighed by its shape and by the blocks around it.

A class or id counts against a text if all its words are of what surrounds texts (``site-footer``); if only some are (``popular-science``), it counts
less. An element with most of the page's text in it has no such mark, as there has to be something else for it to surround.

Scripts, styles and other elements without readable text have no blocks. Character references are decoded, white space inside a block
becomes one space, and content blocks are joined in page order by one space.

Cases: null and empty pages, pages without text and pages of boilerplate only have an empty text. Unclosed and stray tags, quotes and
elements are passed over as browsers do, in time that grows with the length of the page only; a page without tags is one block. Pages of any length are
read whole. Repeated rows each have their row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import html_examples, mincut
from tracewright.llm.common import table, tuned

RESULT = "page_id long, url string, text string, n_chars long"

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?<![^\s/"'])(hidden)(?![^\s/])""")
_WORD = re.compile(r"[A-Za-z]+")

#: Elements whose content is no readable text.
SILENT = frozenset("script style noscript template svg math iframe object canvas video audio map head title textarea select option datalist button".split())
#: Of these, those whose content is not markup.
RAW = frozenset("script style iframe textarea title noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Opening one of these closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Opening one of these closes an open one of the same name.
NO_NESTING = frozenset("button select option textarea".split())
#: Elements and roles around what is not the main text, and around it.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form note".split())
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("article", "main"))
#: Words in class and id attributes that speak against the main text and for it, those of a text's own heading, and those that say nothing.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright "
    "discussion disqus feedback foot footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice pager pagination paywall popular popup promo promoted "
    "promotion recommended related replies reply respond reviews search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud toc toolbar topbar trending widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
HEADER_WORDS = frozenset("head header heading title".split())
PLAIN_WORDS = frozenset("area author bar block bottom box buttons col column container frame group inner item items left links list page panel right row section site slot top wrap wrapper".split())
#: What begins a class such as ``has-sidebar``, which tells of a page and not of the element.
TOLD = frozenset("has no with without".split())
#: Phrases of short blocks that are seldom main text.
PHRASES = re.compile(r"©|\(c\) \d|all rights reserved|\bcookies?\b|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign (?:in|up)|log in|read more|share (?:this|on)|advertisement|skip to|back to top", re.I)
#: An element with more than this share of the page's text in it has no mark against it: if only some words of its class speak so, and if all do.
MOST, NEARLY_ALL = 0.5, 0.8
#: Weights of edges, in units of log-odds: between neighbours that are as near as two paragraphs of one element, by what it shrinks with
#: each further step between elements, and between blocks of one parent that are not neighbours.
NEXT, FURTHER, SIBLING = 0.9, 0.3, 0.4
SCALE, RIDGE = 1000, 0.1
#: A word's letters, about, as some languages have no spaces; and what ends a sentence.
LETTERS, CLOSING = 6, ".!?…\"”»:;。！？"
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td th dt dd pre".split())
FEATURES = ("offset", "length", "linked", "closed", "phrase", "heading", "item", "near_main", "in_main", "near_aside", "near_partly", "in_aside", "hidden", "header")


class _Element:
    __slots__ = ("aside", "begin", "end", "header", "hidden", "last", "main", "name", "near", "parent", "partly")

    def __init__(self, name: str, parent: _Element | None, begin: int):
        self.name, self.parent, self.begin, self.end, self.last = name, parent, begin, -1, -1
        self.aside = self.partly = self.main = self.header = self.hidden = False
        self.near = ""


def _marked(e: _Element, attributes: str) -> None:
    """What the element itself says of the text in it."""
    aside = main = partly = header = False
    role = ""
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for token in value.split():
                    words = [w.lower() for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token))]
                    if not words or words[0] in TOLD:
                        continue
                    against = [w in ASIDE_WORDS for w in words]
                    if any(against):
                        aside |= all(a or w in PLAIN_WORDS or w in HEADER_WORDS or w in MAIN_WORDS for a, w in zip(against, words, strict=True))
                        partly = True
                    elif any(w in HEADER_WORDS for w in words):
                        header = True
                    else:
                        main |= any(w in MAIN_WORDS for w in words)
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden" or (key == "aria-hidden" and value.strip().lower() == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
                e.hidden = True
    if e.name in ("html", "body"):
        return
    e.aside = aside or e.name in ASIDE_TAGS or role in ASIDE_ROLES
    e.partly = partly and not e.aside
    e.main = not partly and not e.aside and (main or e.name in MAIN_TAGS or role in MAIN_ROLES)
    e.header = header or e.name == "header"


class _Page:
    """The blocks of a page: (text, share of linked text, innermost element, tag), and its smoothness edges."""

    def __init__(self, page: str):
        self.blocks: list[tuple[str, float, _Element, str]] = []
        self.edges: dict[tuple[int, int], float] = {}
        self.elements = [_Element("", None, 0)]
        self.stack, self.open = [self.elements[0]], Counter()
        self.parts: list[str] = []
        self.links = self.linked = self.chars = self.silent = 0
        self.low, self.torn = 1, False
        self._read(page)
        self._place()

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                i, top, depth = len(self.blocks), self.stack[-1], len(self.stack)
                if i:
                    steps = self.depth + depth - 2 * self.low
                    self.edges[i - 1, i] = NEXT * FURTHER ** max(0, steps - 2)
                # A block in a leaf element such as a paragraph belongs to what is around it.
                parent = self.stack[-2] if depth > 1 and top.name in LEAVES else top
                if 0 <= parent.last < i - 1:
                    self.edges[parent.last, i] = SIBLING
                parent.last, self.depth, self.low = i, depth, depth
                self.chars += len(text)
                self.blocks.append((text, min(1.0, self.linked / len(text)), top, top.name))
        self.linked = 0

    def _say(self, raw: str) -> None:
        if raw and not self.silent:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.links:
                self.linked += len(text)

    def _push(self, name: str, attributes: str) -> None:
        e = _Element(name, self.stack[-1], self.chars)
        _marked(e, attributes)
        self.elements.append(e)
        self.stack.append(e)
        self.open[name] += 1
        self.silent += name in SILENT

    def _pop(self) -> str:
        e = self.stack.pop()
        e.end = self.chars
        self.open[e.name] -= 1
        self.silent -= e.name in SILENT
        self.low = min(self.low, len(self.stack))
        return e.name

    def _close(self, name: str) -> None:
        if self.open[name]:
            self._flush()
            while self._pop() != name:
                pass
            self.links = 0

    def _read(self, page: str) -> None:
        at, last, lower = 0, {c: page.rfind(c) for c in "<>\"'"}, None

        def tag_end(begin: int) -> int:
            """The place of the > that ends a tag: quotes after an equals sign hide it if they are closed."""
            i = page.find(">", begin)
            if self.torn or ('"' not in (short := page[begin : i + 1]) and "'" not in short):
                return i
            i = begin
            while i < last[">"] and (m := _STOP.search(page, i)):
                if m[0] == ">":
                    return m.start()
                i = m.end()
                if page[begin : m.start()].rstrip()[-1:] == "=" if m.start() - begin < 64 else page[max(begin, m.start() - 64) : m.start()].rstrip()[-1:] == "=":
                    i = page.find(m[0], i) + 1 if last[m[0]] >= i else page.find(">", i)
            self.torn = i > last[">"] or page.find(">", i) < 0  # quotes have run to the page's end: from here on they hide nothing
            return page.find(">", begin) if self.torn else page.find(">", i)

        while at <= last["<"]:
            i = page.find("<", at)
            after = page[i + 1 : i + 2]
            if after in ("!", "?"):
                self._say(page[at:i])
                end = page.find("-->", i + 4) + 3 if page.startswith("<!--", i) else page.find(">", i) + 1
                at = end if end > i else len(page)
                if end <= i:
                    break
                continue
            m = _NAME.match(page, i + 1)
            end = tag_end(m.end()) if m else -1
            if end < 0:
                self._say(page[at : i + 1])
                at = i + 1
                if m and last[">"] < i:
                    break
                continue
            self._say(page[at:i])
            at = end + 1
            name, attributes = m[2].lower(), page[m.end() : end]
            if m[1]:
                if name == "a":
                    self.links = 0
                elif name not in INLINE:
                    self._close(name)
            elif name in RAW:
                self._flush()
                found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = (page.find(">", found.end()) + 1 or len(page)) if found else len(page)
            elif not self.silent or name in SILENT:
                if name in SILENT:
                    lower = lower if lower is not None else page.lower()
                    if name in NO_NESTING and self.open[name]:
                        self._close(name)
                    if f"</{name}" not in last:
                        last[f"</{name}"] = lower.rfind(f"</{name}")
                    if not attributes.endswith("/") and last[f"</{name}"] < at:
                        if name == "head":
                            continue
                        if name not in INLINE:
                            self._flush()
                        continue  # never closed: what follows is read
                self._opened(name, attributes)
        self._say(page[at:])
        self._flush()
        while len(self.stack) > 1:
            self._pop()
        self.elements[0].end = self.chars

    def _opened(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append(" ")
        elif name == "a":
            self.links = 1
        elif name in SILENT:
            if not attributes.endswith("/"):
                if name not in INLINE and name != "button":
                    self._flush()
                self._push(name, attributes)
        elif name not in INLINE:
            self._flush()
            if name in VOID:
                return
            top = self.stack[-1].name
            if (name in CLOSES_P and top == "p") or (name in ("li", "tr") and top == name) or (name in ("dt", "dd") and top in ("dt", "dd")) or (name in ("td", "th") and top in ("td", "th")):
                self._pop()
            if not attributes.endswith("/"):
                self._push(name, attributes)

    def _place(self) -> None:
        """What the elements above say, once it is known how much text each has. ``near`` is the innermost mark."""
        for e in self.elements[1:]:
            share, above = (e.end - e.begin) / max(1, self.chars), e.parent
            if e.aside and share > NEARLY_ALL or e.partly and share > MOST:
                e.aside = e.partly = False
            e.header = e.header and not above.main  # a text's own heading is part of it
            e.near = "aside" if e.aside else "partly" if e.partly else "main" if e.main else above.near
            e.aside, e.main, e.hidden, e.header = e.aside or above.aside, e.main or above.main, e.hidden or above.hidden, e.header or above.header


def described(text: str, linked: float, element: _Element, tag: str) -> list[float]:
    """The features of a block, as FEATURES names them."""
    return [
        1.0,
        math.log2(len(text) / LETTERS + 1),
        linked,
        float(text[-1] in CLOSING),
        float(len(text) < 30 * LETTERS and PHRASES.search(text) is not None),
        float(tag[:1] == "h" and tag[1:].isdigit()),
        float(tag == "li"),
        float(element.near == "main"),
        float(element.main),
        float(element.near == "aside"),
        float(element.near == "partly"),
        float(element.aside),
        float(element.hidden),
        float(element.header),
    ]


@functools.cache
def weights() -> tuple[float, ...]:
    """The classifier: a logistic regression with a ridge on the labelled blocks, by Newton's method."""
    rows, kept = [], []
    for page in html_examples.PAGES:
        for text, linked, element, tag in _Page(page).blocks:
            own = text.removeprefix(html_examples.MARK)
            rows.append(described(own, linked, element, tag))
            kept.append(own != text)
    # Hidden text is known to be none without examples.
    hidden = dict.fromkeys(FEATURES, 0.0) | {"offset": 1.0, "hidden": 1.0, "length": 4.0, "closed": 1.0}
    x, y = np.array([*rows, *[list(hidden.values())] * 8]), np.array([*kept, *[False] * 8], float)
    ridge = np.diag([1e-3, *[RIDGE] * (len(FEATURES) - 1)])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def labelled(page: str, by: tuple[float, ...], smooth: bool = True) -> tuple[list[str], list[bool]]:
    """The blocks of a page and whether each is main text; without ``smooth`` by the classifier alone."""
    read = _Page(page)
    keep, drop = [], []
    for block in read.blocks:
        s = sum(a * b for a, b in zip(by, described(*block), strict=True))
        keep.append(round(SCALE * (math.log1p(math.exp(-abs(s))) + max(0.0, -s))))
        drop.append(round(SCALE * (math.log1p(math.exp(-abs(s))) + max(0.0, s))))
    edges = {e: round(SCALE * w) for e, w in read.edges.items()} if smooth else {}
    return [b[0] for b in read.blocks], mincut.label(keep, drop, edges)


def main_text(page: str | None, by: tuple[float, ...] | None = None) -> str:
    if not page:
        return ""
    return " ".join(t for t, k in zip(*labelled(page, by or weights()), strict=True) if k)


def _extract(by: tuple[float, ...]):
    def extract_texts(batches):
        for batch in batches:
            texts = [main_text(x, by) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return extract_texts


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html)."""
    tuned(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract(weights()), RESULT)


def op3_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
