"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by itself, from its
share of stop words, its length and its share of link text, and from where it stands: menus, page
headers and footers, side bars, notices, adverts, forms and reader comments are told by their element,
role, class or id, hidden parts by their attributes. A class or id says so if one of its words does and
all others do too or are neutral: ``comment-list`` and ``adContainer`` do, ``no-sidebar`` and ``ad-free`` do not.
It never puts the page's body or main element aside, and an article only beside another one. The second
pass gives each undecided, mostly short block the label of its nearest decided neighbours. Inside an
article the edges of the article count as decided, too, so its headings, short paragraphs and lists stay.
On a page whose articles hold more text than the good blocks outside, the latter are not main text.

Stop words are listed for four languages. On a page in another language, or with hardly any of its
language's, they are the page's own most frequent short words, and single characters in scripts that
write no spaces.

The text of a block has its character references decoded and each run of white space turned into one
space; blocks are joined by one space in page order. Nothing is cut or capped.

Defined results: null, empty and markup-only pages have an empty text. Pages and attribute values may
be of any length; a tag is scanned in linear time. Equal pages have equal texts. Unclosed elements end with
their parents, an unclosed comment, script or style at the end of the page. Repeated rows come back
repeated. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copycensus.llm.common import table

# Function words of each language.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be been but by can for from had has have he her his how if in "
    "into is it its more no not of on one or other our out she so than that the their them there they this to up was "
    "we were what when which who will with would you",
    "de": "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich "
    "im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wie wir zu zum zur",
    "fr": "au aux avec ce cette ces dans de des du elle en est et eux il ils je la le les leur lui mais ne nous on ou "
    "par pas plus pour qu que qui sa se ses son sont sur un une vous",
    "es": "al como con de del desde el ella en entre era es esta este fue ha hay la las le lo los más me mi no nos o "
    "para pero por porque que se ser si sin sobre su sus también un una uno y ya",
}
_SETS = {language: frozenset(words.split()) for language, words in STOP_WORDS.items()}
_ANY = frozenset().union(*_SETS.values())

FEW_STOP_WORDS, MANY_STOP_WORDS = 0.2, 0.3
SHORT, LONG = 70, 200
MUCH_LINK = 0.2
MUCH_LINK_IN_ARTICLE = 0.5

_ASIDE_TAGS = frozenset("nav footer aside form button select textarea dialog fieldset menu label option".split())
_SKIPPED = "script|style|title|noscript|template|iframe|object|svg|canvas|audio|video|annotation-xml|annotation|xmp"
_MAIN_TAGS = frozenset(("article", "main"))
_TRACKED = _ASIDE_TAGS | _MAIN_TAGS | frozenset("header div section ul ol dl table span a center body".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BLOCK_TAGS = _HEADINGS | frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "option select button textarea".split()
)
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu".split())
_ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notification alert popup modal overlay sidebar aside nav navbar navigation menu breadcrumb "
    "breadcrumbs footer comment comments reply replies respond discussion disqus share sharing social related "
    "recommended newsletter subscribe subscription signup login search pagination pager widget toolbar masthead topbar "
    "copyright disclaimer".split()
)
# Words that say nothing by themselves beside one of these.
_NEUTRAL_NAMES = frozenset(
    "area bar block box btn button buttons container content group holder icons inner label link links "
    "list module outer panel post posts section slot thread title unit wrap wrapper zone".split()
)
_JOINED_NAMES = frozenset("commentlist commentform commentarea adbox adsbygoogle sharebar".split())
_HEADER_NAMES = frozenset(("header", "head", "top"))
# Looked at for their attributes; kept open only where they stand aside.
_INLINE_TAGS = frozenset(("span", "a"))  # what stands aside in one is left out of its block
_SELF_ENDING = frozenset("p li td th tr dd dt".split())
_PLAIN_TAGS = frozenset("p li figure figcaption td th tr blockquote dd dt pre details address".split())

# A quote opens a value only after an equals sign, and the value ends at the next such quote.
_REST = r"""(?>[^<>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+"""
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    rf"|<svg(?=[\s/]){_REST}(?<=/)>"
    rf"|<(?P<raw>{_SKIPPED})(?=[\s/>]){_REST}>.*?(?:</(?P=raw)(?=[\s/>])[^<>]*+>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<rest>{_REST})>"
    rf"|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""")
_LANGUAGE = re.compile(r"""<html\b[^>]*\blang\s*=\s*["']?([a-z]+)""", re.I)
_NOT_LETTERS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
_WORD_OR_CHARACTER = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])[^\W\d_])+")
FEW_OF_LANGUAGE = 0.1  # a page with a smaller share of its language's stop words gets its own
OWN_WORDS, OWN_LETTERS = 50, 4

NOWHERE = (False, False, False, 0, False)
GOOD, BAD, NEAR, BRIEF = "good", "bad", "near", "short"


@dataclass
class Block:
    text: str
    link_chars: int
    heading: bool
    aside: bool
    held: bool  # in an article that a class, its own or that of an element around it, puts aside
    article: int  # 0: outside; else the number of the outermost article
    code: bool  # preformatted
    label: str = ""


def _stands_aside(name: str, rest: str, header_names: bool) -> tuple[bool, bool]:
    """The element opens a part that is no main text; its class or id says so."""
    if name in _ASIDE_TAGS or (name == "header" and header_names):
        return True, False
    if not rest or rest.isspace():
        return False, False
    named = False
    for key, value in _ATTRIBUTE.findall(rest):
        key, written = key.lower(), value.strip("\"'")
        value = written.lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True, False
        if key == "style" and _UNSEEN.search(value):
            return True, False
        if key == "role":
            if value in _ASIDE_ROLES:
                return True, False
        elif key in ("class", "id"):
            names = _ASIDE_NAMES | _HEADER_NAMES if header_names else _ASIDE_NAMES
            for one in written.split():
                words = set(filter(None, _NOT_LETTERS.split(_CAMEL.sub(" ", one).lower())))
                whole = not words.isdisjoint(_ASIDE_NAMES) and words <= _ASIDE_NAMES | _NEUTRAL_NAMES
                named = named or whole or bool(words) and words <= names or one.lower() in _JOINED_NAMES
    return False, named


def blocks(page: str, header_names: bool = True) -> list[Block]:
    """The blocks of a page in order, without labels. Outside articles, header elements and names put their
    text aside, unless ``header_names`` is false."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    # name, aside, aside by a class, held, article, within an inline element that stands aside
    stack: list[tuple[str, bool, bool, bool, int, bool]] = []
    opened: Counter[str] = Counter()
    heading, code, aside, named, held, article, mute, articles = False, False, False, False, False, 0, False, 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            if text := " ".join("".join(parts).split()):
                out.append(Block(text, linked, heading, aside or named, held, article, code))
            parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not mute:
            text = references.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())

    def end_implied(name: str) -> None:
        """A block ends an open paragraph, and an item, row or cell the one before it in the same list."""
        nonlocal aside, named, held, article, mute
        for ended in ("p", name):
            if ended in _SELF_ENDING and opened[ended]:
                k = max(k for k, entry in enumerate(stack) if entry[0] == ended)
                if not any(entry[0] in ("ul", "ol", "dl", "table") for entry in stack[k + 1 :]):
                    for entry in stack[k:]:
                        opened[entry[0]] -= 1
                    del stack[k:]
        aside, named, held, article, mute = stack[-1][1:] if stack else NOWHERE

    at = 0
    for tag in _TAG.finditer(page):
        say(page[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if not name:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
            continue
        if name in _BLOCK_TAGS:
            close()
            heading = name in _HEADINGS and not tag["end"]
            code = name == "pre" and not tag["end"]
            if not tag["end"] and (opened["p"] or opened[name] and name in _PLAIN_TAGS):
                end_implied(name)
        if name in _PLAIN_TAGS and not tag["end"]:
            # Only one that stands aside matters, and what may hold another of its name.
            if not opened[name] and not any(_stands_aside(name, tag["rest"], header_names and not article)):
                continue
        elif name not in _TRACKED and not (name in _PLAIN_TAGS and opened[name]):
            continue
        if tag["end"]:
            while opened[name]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
        else:
            if name == "a" and opened["a"]:  # a link does not hold another one
                stack = [x for x in stack if x[0] != "a"]
                opened["a"] = 0
            rest = tag["rest"]
            if rest.endswith("/") and name in ("a", "span", "div"):
                rest = rest[:-1]
            opened[name] += 1
            inside = article
            if name in _MAIN_TAGS and not article:
                articles += 1
                inside = articles
            here, by_name = _stands_aside(name, rest, header_names and not article and name not in _INLINE_TAGS)
            if name in _INLINE_TAGS:
                mute = mute or here or by_name
            elif name == "article":
                held, named = held or named or by_name, False
            elif name in ("main", "body"):
                held, named = False, False
            else:
                named = named or by_name
            stack.append((name, aside or (here and name not in _INLINE_TAGS), named, held, inside, mute))
        aside, named, held, article, mute = stack[-1][1:] if stack else NOWHERE
    say(page[at:])
    close()
    return out


def _shares(found: list[Block], page: str) -> list[float]:
    """The share of stop words in each block."""
    language = _LANGUAGE.search(page)
    stops = _SETS.get(language[1].lower()) if language else _ANY
    words = [_WORD.findall(b.text.lower()) for b in found]
    if stops is None or sum(w in stops for ws in words for w in ws) < FEW_OF_LANGUAGE * sum(map(len, words)):
        words = [_WORD_OR_CHARACTER.findall(b.text.lower()) for b in found]
        short = Counter(w for b, ws in zip(found, words, strict=True) if not b.aside for w in ws if len(w) <= OWN_LETTERS)
        often = sorted((w for w, n in short.items() if n > 1), key=lambda w: (-short[w], w))
        stops = frozenset(often[:OWN_WORDS])
    return [sum(w in stops for w in ws) / max(1, len(ws)) for ws in words]


def _first_label(block: Block, share: float, has_article: bool) -> str:
    n = len(block.text)
    if block.aside or (has_article and not block.article):
        return BAD
    links = block.link_chars / n
    if links > (MUCH_LINK_IN_ARTICLE if block.article else MUCH_LINK):
        return BAD
    if not block.article and "©" in block.text:
        return BAD
    if n < SHORT:
        return BAD if block.link_chars and not block.article else BRIEF
    if block.code:
        return BRIEF
    if share >= MANY_STOP_WORDS:
        return GOOD if n > LONG else NEAR
    if share >= FEW_STOP_WORDS or block.article:
        return NEAR
    return BAD


def _second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of their nearest decided neighbours."""

    def neighbours(order: list[int]) -> dict[int, str]:
        seen, last, article = {}, BAD, 0
        for k in order:
            if found[k].article != article:
                article = found[k].article
                last = GOOD if article else BAD
            if found[k].label in (GOOD, BAD):
                # A menu or an advert within an article says nothing on the text around it.
                if not (found[k].article and found[k].label == BAD):
                    last = found[k].label
            else:
                seen[k] = last
        return seen

    before = neighbours(list(range(len(found))))
    after = neighbours(list(range(len(found) - 1, -1, -1)))
    for k, label in before.items():
        block = found[k]
        if label == after[k]:
            # Text with some stop words is text even where its neighbours are none.
            block.label = GOOD if block.label == NEAR and block.heading is False and label == GOOD else label
        else:
            block.label = GOOD if block.label == NEAR or block.heading else BAD


def _classified(page: str, header_names: bool) -> list[Block]:
    found = blocks(page, header_names)
    if any(b.article and not b.aside and not b.held for b in found):
        for b in found:
            b.aside = b.aside or b.held
    shares = _shares(found, page)
    labels = [_first_label(b, share, False) for b, share in zip(found, shares, strict=True)]
    within = sum(len(b.text) for b in found if b.article and not b.aside)
    outside = sum(len(b.text) for b, label in zip(found, labels, strict=True) if label == GOOD and not b.article)
    has_article = within > outside
    for b, share in zip(found, shares, strict=True):
        b.label = _first_label(b, share, has_article)
    _second_pass(found)
    return found


def classify(page: str) -> list[Block]:
    """The blocks of a page with their labels, good or bad. A header that holds all text is none."""
    found = _classified(page, True)
    return found if any(b.label == GOOD for b in found) else _classified(page, False)


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(page) if b.label == GOOD) if page else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text STRING, n_chars BIGINT"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
