import html
import itertools
import math
import random
import re
import time
from html.parser import HTMLParser

import pytest

from tracewright.llm import html_examples, html_text, mincut

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def test_minimum_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 8)
        keep, drop = ([rng.randint(0, 12) for _ in range(n)] for _ in range(2))
        edges = {(a, b): rng.randint(0, 9) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(k if kept else d for k, d, kept in zip(keep, drop, x, strict=True)) + sum(w for (a, b), w in edges.items() if x[a] != x[b])  # noqa: B023, E731
        assert cost(mincut.label(keep, drop, edges)) == min(cost(x) for x in itertools.product((False, True), repeat=n))


def test_minimum_cut_of_a_long_chain():
    rng = random.Random(5)
    n = 3000
    keep, drop = ([rng.randint(0, 10) for _ in range(n)] for _ in range(2))
    edges = {(i, i + 1): 4 for i in range(n - 1)}
    best = (0, 0)
    for i in range(n):
        turn = edges.get((i - 1, i), 0)
        best = (min(best[0], best[1] + turn) + drop[i], min(best[1], best[0] + turn) + keep[i])
    x = mincut.label(keep, drop, edges)
    assert sum(k if kept else d for k, d, kept in zip(keep, drop, x, strict=True)) + sum(w for (a, b), w in edges.items() if x[a] != x[b]) == min(best)


PAGE = """<!doctype html><html><head><title>T</title><style>p > a{}</style><script>if (a<b) document.write("<p>no</p>")</script></head>
<body class="has-sidebar"><!-- <p>hidden</p> --><header class="site-header"><h2>The Daily Example</h2><nav><ul><li><a href=/>Home</a><li><a href=/x>World news of the day</a></ul></nav></header>
<div id="cookie-notice"><p>We use cookies to make this site work and to measure how it is used by our readers.</p><button>OK</button></div>
<div class="layout"><main><article><header><h1>Main &amp; title</h1></header><p>First   paragraph has
a <a href="/l">link</a>, <b>bold</b> text &#233; and &lt;tags&gt;.<p>Second one, unclosed<br>with a break.
<blockquote>A quote.</blockquote><ul><li>Point one</li><li>Point two</li></ul>
<aside class="related"><h3>Related</h3><p>Another long story that you may like to read as well, with many words.</p></aside>
<figure><img src=x alt="<p>"><figcaption>Caption text.</figcaption></figure>
<p>Released under the MIT License.</p><form><label>Name</label><input><select><option>One</select><textarea>type here</textarea></form></article></main>
<div class="sidebar"><p>Weather in the city is fine today, and will be tomorrow, says the bureau.</p></div>
<section id="comments"><article class="comment"><p>Great article, I have read it all and liked it very much indeed.</p></article></section></div>
<div class="ad-slot"><p>Buy this wonderful product now, it is cheap and good.</p></div>
<footer>&copy; 2024 Example. All rights reserved.</footer></body></html>"""


def test_page_with_everything_around_the_article():
    assert html_text.main_text(PAGE) == "Main & title First paragraph has a link, bold text é and <tags>. Second one, unclosed with a break. A quote. Point one Point two Caption text. Released under the MIT License."


LONG = "This is a sentence of the story with quite a few words in it, as stories have."
#: Pages without landmarks and telling classes, and what their main text is.
BARE = (
    (f"<div><a href=1>Home</a> <a href=2>About</a></div><div><p>{LONG}</p><p>Short one</p><p>{LONG}</p></div><div><a href=3>Privacy policy</a></div>", f"{LONG} Short one {LONG}"),
    (f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td><p>{LONG}</p><p>and then</p><p>{LONG}</p></td></tr><tr><td><a href=4>Imprint</a></td></tr></table>", f"{LONG} and then {LONG}"),
    (f"<div><p>{LONG}</p><p>A list without stops</p><p>{LONG}</p><p>one more</p><p>{LONG}</p></div><div><a href=a>Next page</a></div>", f"{LONG} A list without stops {LONG} one more {LONG}"),
)


@pytest.mark.parametrize("page, want", BARE)
def test_pages_without_landmarks_need_the_cut(page, want):
    """The classifier alone loses the short blocks; the blocks around them bring them back."""
    by = html_text.weights()
    assert html_text.main_text(page) == want
    texts, alone = html_text.labelled(page, by, smooth=False)
    assert [t for t, k in zip(texts, alone, strict=True) if k] != [t for t, k in zip(*html_text.labelled(page, by), strict=True) if k]


def test_the_cut_halves_the_errors_on_pages_left_out(monkeypatch):
    pages, wrong = html_examples.PAGES, {True: 0, False: 0}
    for i, page in enumerate(pages):
        monkeypatch.setattr(html_examples, "PAGES", pages[:i] + pages[i + 1 :])
        by = html_text.weights.__wrapped__()
        for smooth in wrong:
            wrong[smooth] += sum(t.startswith(html_examples.MARK) != k for t, k in zip(*html_text.labelled(page, by, smooth), strict=True))
    assert wrong[True] <= 8 and wrong[True] <= 0.6 * wrong[False]


def test_costs_are_in_the_range_of_the_edges():
    """No place decides by itself: each weight can be outweighed by other features and a block's edges."""
    by = dict(zip(html_text.FEATURES, html_text.weights(), strict=True))
    assert max(abs(v) for v in by.values()) < 6


@pytest.mark.parametrize("word", ["popular-science", "social-history", "legal", "search-results", "comment", "banner reviews", "feedback", "has-sidebar with-footer"])
def test_a_word_of_the_only_container_loses_no_text(word):
    page = f'<ul><li><a href="/">Start</a></li></ul><div class="{word}"><h1>Of things</h1><p>{LONG}</p><p>{LONG}</p></div>'
    assert html_text.main_text(page) == f"Of things {LONG} {LONG}"


def test_a_heading_in_an_articles_header_is_kept():
    page = f'<header class="site-header"><a href="/">Site</a></header><article><header class="post-header"><h1>Head</h1></header><p>{LONG}</p></article><footer class="post-footer">Filed under things.</footer>'
    assert html_text.main_text(page) == f"Head {LONG}"


class Tree(HTMLParser):
    """Blocks of well-formed pages by another parser: text and the path of elements."""

    def __init__(self, page):
        super().__init__()
        self.path, self.n, self.blocks, self.open = [], 0, [], []
        self.feed(page)
        self.end()

    def end(self):
        text = " ".join("".join(self.open).split())
        if text:
            self.blocks.append((text, tuple(self.path)))
        self.open = []

    def handle_starttag(self, tag, attrs):
        if tag not in html_text.INLINE:
            self.end()
            self.n += 1
            self.path.append((tag, self.n))

    def handle_endtag(self, tag):
        if tag not in html_text.INLINE:
            self.end()
            assert self.path.pop()[0] == tag

    def handle_data(self, data):
        self.open.append(data)


def test_the_whole_labelling_against_brute_force():
    """Blocks and edges by another parser, and the best of all labellings."""
    rng, by = random.Random(6), html_text.weights()
    texts = [LONG, "Short one", "And then?", "no stop here at all", "More", "It was late."]
    for _ in range(120):
        inner = "".join(f"<{t}>{rng.choice(texts)}</{t}>" for t in rng.choices(["p", "p", "h2", "div"], k=rng.randint(2, 5)))
        page = f'<div class="{rng.choice(["menu", "x", "story"])}"><p>{rng.choice(texts)}</p><div>{rng.choice(texts)}</div></div><{(o := rng.choice(["div", "article", "section"]))}>{inner}</{o}><footer><p>{rng.choice(texts)}</p></footer>'
        tree, read = Tree(page).blocks, html_text._Page(page)
        assert [t for t, _ in tree] == [b[0] for b in read.blocks]
        edges, last = {}, {}
        for i, (_, path) in enumerate(tree):
            if i:
                common = sum(1 for a, b in zip(path, tree[i - 1][1], strict=False) if a == b)
                edges[i - 1, i] = html_text.NEXT * html_text.FURTHER ** max(0, len(path) + len(tree[i - 1][1]) - 2 * common - 2)
            parent = path[:-1] if path[-1][0] in html_text.LEAVES else path
            if last.get(parent, i) < i - 1:
                edges[last[parent], i] = html_text.SIBLING
            last[parent] = i
        odds = [sum(a * b for a, b in zip(by, html_text.described(*b), strict=True)) for b in read.blocks]
        cost = lambda x: sum(math.log1p(math.exp(-s if k else s)) for s, k in zip(odds, x, strict=True)) + sum(w for (a, b), w in edges.items() if x[a] != x[b])  # noqa: B023, E731
        got = html_text.labelled(page, by)[1]
        assert cost(got) < min(map(cost, itertools.product((False, True), repeat=len(tree)))) + 0.02


BROKEN = ("<button>x ", '<p title="x>text ', "<a title='x>text \" ", "<div>x", "</p>x<div>", "<a ", "<script>", "<svg>x", "<!-- x", "<table><tr><td>a b", "<ul><li>Item", "< a", "<textarea>y", "<select><option>z", "<p a=\">\"", "&amp")


@pytest.mark.parametrize("bit", BROKEN)
def test_broken_pages_take_linear_time(bit):
    def took(n):
        page, best = bit * n, 1e9
        for _ in range(3):
            began = time.perf_counter()
            html_text.main_text(page)
            best = min(best, time.perf_counter() - began)
        return best

    took(100)
    assert took(16_000) < 4 * 2.5 * took(4000) + 0.05


def test_odd_pages(spark):
    rows = [(1, "u", None, "", ""), (2, None, "", "", ""), (3, "u", "<p>", "", ""), (4, "u", "plain words that form a text of their own, without any tag.", "", ""), (5, "u", "<nav><p>Only a menu here.</p></nav>", "", ""), (None, "u", "<article><p>Text &unknown; &#x41;&nbsp;b</p></article>", "", ""), (6, "u", "<article>" + "<p>Word after word.</p>" * 20_000, "", ""), (7, "u", "<script>x", "", ""), (8, "u", '<p a="unclosed>text <', "", ""), (4, "u", "</div></p>", "", "")]
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert [g[:2] for g in got] == [r[:2] for r in rows]
    assert all(g[3] == len(g[2]) for g in got)
    assert [g[2] for g in got[:6]] == ["", "", "", rows[3][2], "", "Text &unknown; A b"]
    assert got[6][2] == " ".join(["Word after word."] * 20_000)
    assert html_text.extract(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_driver_pages(spark, sf_dir):
    """These pages have one article each."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = html_text.op3_html_mincut(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<(?!br)[^>]*>", "", x)).replace("<br>", " ").split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == " ".join(p for p in parts if p)
