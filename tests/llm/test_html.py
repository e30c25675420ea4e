"""Blocks of pages, the labeller's gradient and its accuracy on pages that it wasn't trained on."""

import re
import time
import tracemalloc
from html.parser import HTMLParser

import numpy as np
import pytest

from tallgrass.llm import html
from tallgrass.llm.html import Labeller, blocks, extract, features, made_pages, padded, trained


def test_blocks():
    page = '<!DOCTYPE html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body><!-- <p>no</p> --><div class="siteHeader big" id=top><a href="x>y">Me&amp;nu</a></div><p>one<br>two &lt;b&gt;\n <b>three<p>four<li>x<li>y</ul><td>z &eacute;&#233;&nbsp;!</td>end'
    assert [(p, t) for p, t, _ in blocks(page)] == [
        ("body div.site.header.big.top", "Me&nu"), ("body p", "one two <b> three"), ("body p", "four"), ("body p li", "x"), ("body p li", "y"), ("body p li td", "z éé !"), ("body p li", "end"),
    ]
    assert [x[2] for x in blocks("<p><a>abcd</a>efgh</p><p>x</p>")] == [0.5, 0.0]
    assert blocks("") == [] and blocks("<script>x") == [] and blocks("a < b") == [("", "a < b", 0.0)] and blocks("x<p") == [("", "x", 0.0)]
    assert len(blocks("<div>" * 3000 + "x")) == 1 and len(blocks("<p>x</p>" * 5000)) == 5000


def test_unclosed_elements_keep_what_follows():
    """A self-closing svg, or an svg, select, object, iframe, title or template without an end tag, doesn't take the rest of the page."""
    for tag in ("<svg/>", '<svg class="x" />', "<svg><path/>", "<select>", "<object>", "<template>", "<iframe>", "<title>", "<textarea>"):
        assert [t for _, t, _ in blocks(f"<p>one</p>{tag}<p>two</p>")] == ["one", "two"], tag
    assert [t for _, t, _ in blocks("<p>one</p><template a='>'><p>no</p><template>no</template></template><p>three</p><script>no <p>x")] == ["one", "three"]
    assert [t for _, t, _ in blocks("<p>one</p><iframe>no</iframe><textarea><p>no</textarea ><p>two")] == ["one", "two"]


def test_text_within_odd_elements():
    """Quotes in unquoted values, elements that stand within the text, and elements that hold other text."""
    assert [t for _, t, _ in blocks("<p data-x=it's>Hello world</p><p>I don't</p><b>x</b>")] == ["Hello world", "I don't", "x"]
    assert [t for _, t, _ in blocks('<p title="a > b" class = \'c>\'>one</p><p title="never closed>two</p><p>three')] == ["one", "two", "three"]
    assert [t for _, t, _ in blocks("<p>a <ruby>b<rt>c</rt></ruby> <button>d</button> <picture><img src=x></picture><my-tag>e</my-tag> <svg><path/></svg>f</p>")] == ["a bc d e f"]
    assert [t for _, t, _ in blocks("<p>a</p><object data=x><p>b</p>c</object><noscript>d</noscript>")] == ["a", "b", "c", "d"]
    assert [t for _, t, _ in blocks("a<!-->b<!-- <p> -->c<!x>d<?php e ?>f")] == ["abcdf"]


def test_time_and_memory_grow_with_the_page():
    model, n = Labeller(1), 1 << 20
    for page in ("<a " * (n // 3), "<a b='" * (n // 6), "<div>" * 20_000 + "</p>" * 20_000, "<div><p>x" * 20_000, "<title>" * 20_000, "</script " * 20_000, "<script " * 20_000, "<!--" * 20_000, "<template>" * 20_000, "=" * n + "<p =" + "=" * n):
        start = time.perf_counter()
        blocks(page)
        assert time.perf_counter() - start < 5, page[:20]
    pages = [blocks("<li>x" * 20_000)] + [blocks("<p>a")] * 63
    tracemalloc.start()
    labels = model.label(pages)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    assert [len(x) for x in labels] == [20_000] + [1] * 63


def test_parts_of_a_long_page_are_labelled_as_one(monkeypatch):
    model, pages = Labeller(3), [x for x, _ in made_pages(6, 9)]
    whole = [model.forward(*padded([features(x)]))[0][:, 0] > 0.5 for x in pages]
    for places in (7, 40, 8192):
        monkeypatch.setattr(html, "PLACES", places)
        assert all((a == b).all() for a, b in zip(model.label(pages), whole, strict=True))


def test_gradient():
    model = Labeller(1)
    pages = [(features(x)[:5], y[:5]) for x, y in made_pages(3, 2)]
    x, mask = padded([p[0] for p in pages])
    y = np.zeros(mask.shape[:2], dtype=np.float32)
    for j, p in enumerate(pages):
        y[: len(p[1]), j] = p[1]
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}

    def loss():
        p = model.forward(x, mask)[0]
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask[:, :, 0]).sum() / mask.sum()

    p, both, kept, back = model.forward(x, mask)
    d = (p - y)[:, :, None] * mask / mask.sum()
    grad, d_both = {}, d @ model.w["o"].T
    model.unsweep(x, mask, "f", kept, d_both[:, :, : both.shape[2] // 2], grad)
    model.unsweep(x[::-1], mask[::-1], "b", back, d_both[::-1, :, both.shape[2] // 2 :], grad)
    for k in ("xf", "hf", "cf", "xb", "hb", "cb"):
        at = np.unravel_index(np.abs(grad[k]).argmax(), grad[k].shape)
        was = model.w[k][at]
        step = 1e-3
        model.w[k][at] = was + step
        up = loss()
        model.w[k][at] = was - step
        down = loss()
        model.w[k][at] = was
        assert grad[k][at] == pytest.approx((up - down) / (2 * step), rel=0.03, abs=1e-5), k


def test_held_out_accuracy():
    """On made pages of another seed, and on a page in the manner of the test tables."""
    held = made_pages(200, 12345)
    labels = trained().label([x for x, _ in held])
    right = sum(int((a == (y > 0)).sum()) for a, (_, y) in zip(labels, held, strict=True))
    assert right / sum(len(y) for _, y in held) > 0.97


PAGE = '<!DOCTYPE html><html lang="en"><head><title>T</title></head><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy this now, dear reader.</div><article><h1>The title of it</h1><p><b>First words of it.<br><p>Second &amp; last\n  paragraph.</p></article><footer>&copy; host &middot; All of this.</footer></body></html>'


def test_rows(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 2), (3, "v", "", 3), (1, "u", PAGE, 4), (None, "w", PAGE.replace("</body></html>", ""), 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, N_CHARS int")
    got = sorted(map(tuple, extract(pages).collect()), key=repr)
    text = "The title of it\nFirst words of it.\nSecond & last paragraph."
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (3, "v", "", 0), (None, "w", text, len(text))], key=repr)
    assert extract(pages.limit(0)).count() == 0


class Article(HTMLParser):
    """The article of a test page, read by the standard library's parser: nothing of the operator's own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag not in ("b", "em", "i", "a", "br", "strong"):
            self.parts.append("")
        elif tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        if tag not in ("b", "em", "i", "a", "strong"):
            self.parts.append("")
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts[-1] += data


def test_test_pages(spark):
    """The rows of sf0.001 are those that the standard library's parser finds in the pages' articles."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        parser = Article()
        parser.feed(r["html"])
        assert r["text"] == "\n".join(x for x in (" ".join(p.split()) for p in parser.parts) if x)


#: Pages in the manner of common publishing systems, labelled by hand: the main text has a @ before each block.
BY_HAND = [
    """<html><body class="home"><div id="page"><div id="masthead"><h1 class="site-title"><a href="/">My little blog</a></h1></div><div id="content"><div class="post hentry"><h2 class="entry-title">@How to bake bread</h2>
    <div class="entry-content"><p>@Bread needs flour, water, salt and time.</p><ul><li>@Mix it well.</li><li>@Let it rise for an hour.</li></ul><blockquote>@Never hurry a loaf.</blockquote></div></div>
    <div id="comments" class="comments-area"><h3>2 responses</h3><ol class="commentlist"><li class="comment"><p>Great recipe, thank you so much for it!</p></li><li class="comment"><p>Mine was flat.</p></li></ol></div></div>
    <div id="sidebar" class="widget-area"><div class="widget"><h3>Recent posts</h3><ul><li><a href="/a">Cakes</a></li><li><a href="/b">Pies</a></li></ul></div></div><div id="footer">Copyright 2020 My little blog</div></div></body></html>""",
    """<body><header class="site-header"><nav class="menu"><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav></header><div class="cookie-banner"><p>We use cookies to improve your visit.</p><button>Accept</button></div>
    <main><article><h1>@River floods the old town</h1><p>@The river rose two metres in a night, officials said.</p><aside class="related"><h4>Related</h4><ul><li><a href="/x">Storm warning</a></li></ul></aside><p>@Shops along the quay were closed on Tuesday.</p>
    <div class="ad">Buy two, get one free.</div><p>@The water is expected to fall by Friday.</p></article></main><footer class="site-footer"><p>&copy; The Daily</p><ul><li><a href="/imprint">Imprint</a></li></ul></footer></body>""",
    """<body><table><tr><td class="menu"><ul><li><a href="a.html">Index</a></li><li><a href="b.html">Links</a></li></ul></td><td class="content"><h2>@The history of the mill</h2><p>@The mill was built by hand in the last century.<p>@It burned down twice and was rebuilt each time.</td></tr></table></body>""",
    """<body><nav class="navbar"><ul><li><a href="/docs">Docs</a></li><li><a href="/api">API</a></li></ul></nav><div class="main-content"><h1>@Getting started</h1><p>@Install the package and import it.</p><pre>@import thing</pre><h2>@Options</h2><dl><dt>@fast</dt><dd>@Skips the checks.</dd></dl></div><div class="toc"><ul><li><a href="#o">Options</a></li></ul></div><form class="search"><label>Search</label><input name=q><button>Go</button></form></body>""",
]


def test_pages_labelled_by_hand():
    """Of all blocks of pages that no rule made, nine of ten are labelled right."""
    right = total = 0
    for page in BY_HAND:
        want = [t.startswith("@") for _, t, _ in blocks(page)]
        got = trained().label([blocks(page.replace("@", ""))])[0]
        assert len(want) == len(got) and any(want)
        right, total = right + sum(a == b for a, b in zip(got, want, strict=True)), total + len(want)
    assert right >= 0.9 * total, (right, total)
