import pytest

from copycensus.llm import html_text
from copycensus.llm.html_text import classify, main_text

SENTENCE = "It is the text of the page, and it is long enough to be one of those that we would all like to read. "
LONG = SENTENCE * 3


def page(inner, lang="en"):
    return f'<!DOCTYPE html><html lang="{lang}"><head><title>No</title><style>p{{}}</style></head><body>{inner}</body></html>'


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<p></p>", ""),
        (page("<article><h1>Head</h1><p>One<br>two</p></article>"), "Head One two"),
        (page("<article><p>a<b>b</b>c <i>d</i>\n\t e</article>"), "abc d e"),
        (page("<article><p>One<p>two<ul><li>three<li>four</ul></article>"), "One two three four"),
        (page("<main>&lt;b&gt; &amp; &eacute;&#233;&#xe9; &amp c &am</main>"), "<b> & ééé & c &am"),
        (page("<article><p>x &nbsp; y</p></article>"), "x y"),
        (page('<article><p>in<script>var t="</p>";</script> it</p></article>'), "in it"),
        (page("<article><p>in<!-- <p>no</p> --> it<style>b</style></article>"), "in it"),
        (page("<nav>Menu</nav><header>Top</header><article>Text</article><aside>Side</aside><footer>End</footer>"), "Text"),
        (page(f'<div class="ad">{LONG}</div><article>Text</article><div id="comments">{LONG}</div>'), "Text"),
        (page(f'<article>Text<div class="cookie-notice">{LONG}</div><form><label>Name</label></form> more</article>'), "Text more"),
        (page(f'<article>Text</article><section class="comments"><article><p>{LONG}</p></article></section>'), "Text"),
        (page(f'<div role="navigation">{LONG}</div><article>Text</article>'), "Text"),
        (page("<article><header><h1>Head</h1></header><p>Text</article>"), "Head Text"),
        (page("<article><p>a | b | c</p><p>d | e</p></article>"), "a | b | c d | e"),
        (page("<article><p>Text <a href=x>with a link</a> in the middle of it all</article>"), "Text with a link in the middle of it all"),
        (page("<article>open"), "open"),
        ("<article>cut in a ta", "cut in a ta"),
        ("<article>cut in a tag<div cla", "cut in a tag"),
        ("<article>one<!-- never closed", "one"),
        ("<article>one<script>never closed", "one"),
        ("<article>a < b and c > d</article>", "a < b and c > d"),
    ],
)
def test_main_text(html, text):
    if html and html.endswith("<div cla"):
        assert main_text(html).startswith(text)
    else:
        assert main_text(html) == text


def test_pages_without_an_article():
    html = page(
        f"<div>Top</div><div><a href=1>One</a> <a href=2>Two</a></div><h2>Head</h2><p>{LONG}</p><p>Short one.</p>"
        f"<p>{LONG}</p><p><a href=3>{LONG}</a></p><div>Contact</div>"
    )
    assert main_text(html) == " ".join(f"Head {LONG} Short one. {LONG}".split())


def test_second_pass_follows_the_neighbours():
    html = page(f"<p>Before</p><p>{LONG}</p><p>Between</p><p>{LONG}</p><p><a href=x>{LONG}</a></p><p>Between</p><p><a href=x>{LONG}</a></p>")
    assert [b.label for b in classify(html)] == ["bad", "good", "good", "good", "bad", "bad", "bad"]


@pytest.mark.parametrize("html", ['<a "' * 60_000, "<" * 200_000, "<!--" * 60_000, "<p class='" * 40_000, "<script" * 40_000,
                                  "<script>" + "</script" * 40_000, "<div>" * 60_000 + "</p></b>" * 60_000, "&" * 100_000])
def test_odd_pages_take_linear_time(html):
    main_text(html)


def test_table(spark):
    rows = [(1, "u", page("<article>One</article>")), (1, "u", page("<article>One</article>")), (None, None, None), (3, "v", "é" * 30_000)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(1, "u", "One", 3), (1, "u", "One", 3), (3, "v", main_text("é" * 30_000), len(main_text("é" * 30_000))), (None, None, "", 0)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert html_text.extract_text(pages.limit(0)).count() == 0
