"""Density decides where the article is: split bodies, plain elements, long and malformed pages."""

import math
import time

import pyarrow.parquet as pq
import pytest

from sparkledger.llm import html

LONG = "Some long text of an article that goes on for a good while and tells a story. " * 4
CASES = {
    "<p title=don't>Hello world</p>": "Hello world",
    '<script src="a.js"/>alert(1)</script><p>yes': "yes",
    "<p>a <math>x+y</math> b</p>": "a x+y b",
    "a < b and <3 <!--x-->c<!--> d &amp;lt; <![CDATA[x &amp; y]]> <p>z</p": "a < b and <3 c d &lt; x &amp; y z",
    f'<div><h1 class="page-header">Title</h1><p>{LONG}</p><p class="related-work">Related work.</p><div class="alert">notice</div></div>': f"Title {LONG.strip()} Related work.",
    f"<div class='x'><ul><li><a href=/>Home</a><li><a href=/b>About</a></ul></div><div>{LONG}</div><div class=ad>Buy</div><div><p>{LONG}<p>{LONG}</div>": " ".join([LONG.strip()] * 3),
    f"<div><h1>Name of it</h1></div><div><a href=1>one</a> <a href=2>two</a></div><div><p>{LONG}<p>Short end.</div>": f"Name of it {LONG.strip()} Short end.",
    "<p hidden>no</p><p>yes</p>": "yes",
}


@pytest.mark.parametrize("page", CASES)
def test_text(page):
    assert html.main_text(page) == CASES[page]


def test_the_article_is_found_without_its_tag():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        plain = page.replace("<article", "<div").replace("</article", "</div")
        assert html.main_text(plain) == html.main_text(page)


def test_densities_against_counting_by_hand():
    page = f"<div id=a><p>{LONG}<a href=x>link</a></p><p>x<br>y</p></div><div id=b><a href=1>one</a><a href=2>two</a></div>"
    root = html.parse(page)
    nodes = html.measure(root)

    def text(n, linked=False):
        own = [k for k in n.kids if isinstance(k, str)] if linked is False or linked is None else []
        return sum(len("".join(k.split())) for k in own) + sum(text(k) for k in n.kids if not isinstance(k, str))

    def links(n):
        return (text(n), 0) if n.tag == "a" else (sum(links(k)[0] for k in n.kids if not isinstance(k, str)), 0)

    def tags(n, only=None):
        return sum((k.tag not in ("br", "wbr", "hr") if only is None else k.tag == only) + tags(k, only) for k in n.kids if not isinstance(k, str))

    all_chars, all_links = text(root), links(root)[0]
    for n in nodes:
        chars, linked, t, lt = text(n), links(n)[0], max(tags(n), 1), max(tags(n, "a"), 1)
        want = 0.0
        if chars > linked:
            want = chars / t * max(0.0, math.log(chars * t / (max(linked, 1) * lt), math.e + chars * linked / (chars - linked) + all_links * chars / all_chars))
        assert n.density == pytest.approx(want)
        assert n.sum == pytest.approx(sum(k.density if not isinstance(k, str) else len("".join(k.split())) for k in n.kids))


@pytest.mark.parametrize("part", ["<a ", "<a>", "<div>", "<p><b>", "<a href='", "</b>", "<!--", "<i><p>", "<script>", "<", "<div class=comment>", "&amp;"])
def test_long_malformed_pages_take_linear_time(part):
    small, large = part * 10000, part * 80000
    t = time.perf_counter()
    html.main_text(small)
    u = time.perf_counter()
    html.main_text(large)
    assert time.perf_counter() - u < 1 + 30 * (u - t)


def test_frames(spark):
    schema = "page_id long, url string, html string"
    assert html.extract(spark.createDataFrame([], schema)).count() == 0
    long = "<p>" + "word " * 200000 + "</p>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, long), (3, None, long), (None, "u", "<p>x</p>")]
    got = html.extract(spark.createDataFrame(rows, schema).selectExpr("*", "'old' AS text", "1 AS kids")).collect()
    assert sorted((r.page_id or 0, r.text[:9], len(r.text), r.kids) for r in got) == [(0, "x", 1, 1), (1, "", 0, 1), (2, "", 0, 1), (3, "word word", 999999, 1), (3, "word word", 999999, 1)]
