"""Attributes, names and languages that earlier rules of operator 8 did not know."""

import pytest

from copycensus.llm.html_text import main_text

from .test_html_text import LONG, page

TEXT = " ".join(LONG.split())


@pytest.mark.parametrize("size", [100, 5_000, 1_000_000])
@pytest.mark.parametrize("quote", ["'", '"'])
def test_attribute_values_of_any_length(size, quote):
    value = "<b>x > y" * (size // 8)
    assert main_text(page(f"<article><p data-a={quote}{value}{quote}>Text</p></article>")) == "Text"
    assert main_text(page(f"<article><p data-a = {quote}{value}{quote} hidden>no</p>Text</article>")) == "Text"


@pytest.mark.parametrize(
    "inner, text",
    [
        ("""<script data-a="<b>">var a = "<p>";</script>Text""", "Text"),
        ("<p title=it's>One</p><p>isn't</p>", "One isn't"),
        ("<svg width=1/>One<svg><text>no</text></svg>", "One"),
        ("<script-like>One</script-like>", "One"),
        ("Let <math><mi>x</mi><annotation encoding='tex'>no</annotation></math> be", "Let x be"),
    ],
)
def test_tags(inner, text):
    assert main_text(page(f"<article>{inner}</article>")) == text


@pytest.mark.parametrize("name", ["comment-list", "comments-section", "commentlist", "share-buttons", "related-posts", "ad-container",
                                  "adContainer", "ad_slot sidebar"])
@pytest.mark.parametrize("tag", ["div", "section", "p", "ul", "figure", "td", "blockquote"])
def test_names_with_neutral_words(name, tag):
    assert main_text(page(f'<article>One <{tag} class="{name}">{LONG}</{tag}><p>two</article>')) == "One two"
    assert main_text(page(f'<p>{LONG}</p><{tag} id="{name}">{LONG}</{tag}><p>{LONG}</p>')) == f"{TEXT} {TEXT}"


@pytest.mark.parametrize("name", ["post-list", "section", "button-box", "ad-free-section", "no-ad-container"])
def test_neutral_words_alone_put_nothing_aside(name):
    assert main_text(page(f'<article>One<div class="{name}">two</div></article>')) == "One two"


@pytest.mark.parametrize(
    "inner, text",
    [
        ('<p class="advertisement">no<p>One', "One"),
        ("<p hidden>no</p>One", "One"),
        ('<figure class="ad"><img><figcaption>no</figcaption></figure>One', "One"),
        ('<div style="display: none">no</div>One', "One"),
        ('<span style="visibility:hidden">no</span><p>One', "One"),
        ('One<span hidden>no <b>no</b></span>, <a class="ad" href=x>no</a>two', "One, two"),
        ('<ul><li class="ad">no<ul><li>no</li></ul>no<li>One</ul>two', "One two"),
        ('<ul><li class="ad">no<ul><li>no</li></ul></li><li>One</li></ul>two', "One two"),
        ('<table><tr><td class="ad">no<td>One<tr><td>two</table>three', "One two three"),
        ('<blockquote class="promo"><p>no</p><blockquote>no</blockquote>no</blockquote><blockquote>One</blockquote>', "One"),
        ('<p class="ad">no<div>One</div>', "One"),
    ],
)
def test_attributes_of_any_block(inner, text):
    assert main_text(page(f"<article>{inner}</article>")) == text


def test_main_text_outside_of_small_parts():
    assert main_text(page(f'<section id="top"><p>{LONG}</p></section>')) == TEXT
    assert main_text(page(f"<header><p>{LONG}</p></header>")) == TEXT
    assert main_text(page(f"<p>{LONG}</p><article>Teaser</article><p>{LONG}</p>")).count(TEXT) == 2
    assert main_text(page(f"<p>{LONG}</p><article><p>{LONG}</p><p>{LONG}</p></article>")) == f"{TEXT} {TEXT}"
    assert main_text(page(f"<p>{LONG}</p><pre>x = f(y)\n  z = {{}}</pre><p>{LONG}</p>")) == f"{TEXT} x = f(y) z = {{}} {TEXT}"


SAMPLES = {
    "ru": "Это не тот дом, и не тот сад, но и в этом саду на траве лежит снег, и в доме том не горит свет, а на дворе не видно ни души. ",
    "it": "Il cane di mia zia corre per il prato e la gatta di casa lo guarda, ma non lo segue, e poi la sera il cane e la gatta si fanno la pace. ",
    "ko": "오늘은 날씨가 좋은 날이다. 나는 친구와 함께 공원에 가서 산책을 했다. 공원에는 사람이 많이 있었다. 우리는 의자에 앉아서 이야기를 했다. ",
    "zh": "今天的天气很好，我和我的朋友在公园里散步。公园里的人很多，我们在椅子上坐着说话，说了很多很多的话，后来我们就回家了。",
}


@pytest.mark.parametrize("lang", SAMPLES)
@pytest.mark.parametrize("said", [True, False])
def test_languages_without_a_list(lang, said):
    text = SAMPLES[lang] * 4
    html = page(f"<ul><li><a href=1>{text[:9]}</a><li><a href=2>{text[9:19]}</a></ul><p>{text}</p><p>{text}</p><div>{text[:5]}</div>",
                lang if said else "en")
    assert main_text(html) == " ".join(f"{text} {text}".split())
