"""A class, id or attribute value that only mentions an aside word loses no main text."""

import pytest

from copycensus.llm.html_text import main_text

from .test_html_text import LONG, page

TEXT = " ".join(LONG.split())


@pytest.mark.parametrize("name", ["no-sidebar", "has-sidebar", "comments-open", "margin-top", "menu-item-12 ad-free", "header_fixed"])
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_partial_words(name, attribute):
    said = f'{attribute}="{name}"'
    assert main_text(f"<html lang=en><body {said}><article><p>One</p></article></body></html>") == "One"
    assert main_text(f"<html lang=en><body {said}><p>{LONG}</p></body></html>") == TEXT
    assert main_text(page(f"<div {said}><article>One</article></div>")) == "One"
    assert main_text(page(f"<div {said}><p>{LONG}</p></div>")) == TEXT
    assert main_text(page(f"<article>One<div {said}>two</div></article>")) == "One two"


@pytest.mark.parametrize("name", ["sidebar", "comments", "ad banner", "cookie-notice", "top"])
def test_whole_names_put_no_main_part_aside(name):
    assert main_text(f'<html lang=en><body class="{name}"><p>{LONG}</p></body></html>') == TEXT
    for part in ("main", "article"):
        assert main_text(page(f'<{part} class="{name}">One</{part}>')) == "One"
        assert main_text(page(f'<div class="{name}"><p>{LONG}</p><{part}>One</{part}></div>')) == "One"
    assert main_text(page(f'<article>One</article><article class="{name}">two</article>')) == "One"
    assert main_text(page(f'<article>One</article><div class="{name}">{LONG}</div>')) == "One"
    assert main_text(page(f'<div class="{name}">{LONG}</div><p>{LONG}</p>')) == TEXT


@pytest.mark.parametrize(
    "said, stays",
    [
        ('style="overflow:hidden"', True), ("data-x='a hidden b'", True), ("title=hidden", True), ('alt="class=ad"', True),
        ('data-hidden="1"', True), ('aria-hidden="false"', True), ("hidden", False), ("HIDDEN=''", False),
        ('style="x" hidden', False), ('aria-hidden="true"', False), ('data-a=1 class="ad"', False),
    ],
)
def test_attributes_count_by_name(said, stays):
    assert main_text(page(f"<article>One<div {said}>two</div></article>")) == ("One two" if stays else "One")


@pytest.mark.parametrize("html", ["<div " + "a=" * 100_000 + ">", "<div " + "a='" * 100_000 + ">", "<div " + "a " * 100_000 + ">",
                                  "<div a" + " " * 200_000 + ">", "<div " + 'a="' * 100_000 + "x>"])
def test_odd_attributes_take_linear_time(html):
    main_text(html)
