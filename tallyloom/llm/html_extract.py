"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Containers that name their purpose decide first: blocks of
menus, headers, footers, sidebars, forms, notices, adverts and comments are out; of containers with a doubtful name
long blocks with hardly a link go on. The first pass labels all others,
on every page, by link density, stop-word density and length, and blocks of an article or main element lean in; the
second lets short and middling blocks take the label of the nearest decided blocks, and those of an article or main
element the label of the blocks in the same element.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been but by can could did do for from had has have he her his
    how i if in into is it its just like more my no not now of on one only or other our out over she so some than
    that the their them then there these they this those to up was we were what when which who will with would you your
    aber als am auch auf aus bei bin bis da das dass dem den der des die dir doch du durch ein eine einem einen einer
    er es für haben hat ich ihr im ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von
    vor war was wenn wie wird wir zu zum zur
    au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lui mais même ne nous on ont
    ou par pas plus pour qu que qui sa se ses si son sont sur tout un une vous
    al como con del desde donde el ella en entre era es esta este esto fue ha hay la las lo los más me mi muy ni no nos
    o para pero por que se sin sobre son su sus también un una uno y ya""".split()
)
# Elements by their part in a page.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
    thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = "script|style|noscript|template|svg|iframe|select|button|textarea|label|object|canvas|title"
OUT_TAGS = frozenset("nav footer aside form menu dialog head".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
OUT_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist
    consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice
    notices notification outbrain pagination pager popup promo promotion related replies reply respond share sharing sidebar
    signup site-header skip social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar widget""".split()
)
# Those of them that also name other things ("price-share") where a word goes before them.
WEAK_NAMES = frozenset("login notice notices notification pager promo promotion related replies reply respond share sharing skip social sponsor sponsored sponsors toolbar topbar widget".split())
# What may follow the naming word of a compound; words before it that tell of a state; and elements whose names say
# nothing on all they hold.
NEUTRAL_NAMES = frozenset(
    """area author bar block body bottom box card col column container content count cta desktop first footer form frame grid group
    header holder id inner item label last layout left link links list main meta mobile module nr outer panel placeholder primary right row
    section secondary slot small space text thread title top unit view wide wrap wrapper zone""".split()
)
STATE_NAMES = frozenset("had has have hide hides is no non not show shows sans toggle with without".split())
UNNAMED_TAGS = frozenset("html body main h1 h2 h3 h4 h5 h6".split())

_SKIP = re.compile(rf"<!--.*?(?:-->|\Z)|<({SKIPPED_TAGS})\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>")
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile(r"[^a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)


@dataclass(frozen=True)
class BlockRules:
    """Bounds of the first pass: link density above which a block is out, and one in an element of a doubtful name; lengths of short and long blocks in
    characters; stop-word densities of good and middling blocks; the least share of stop words on a page whose
    language they are taken to know (elsewhere blocks are judged by links and length alone)."""

    most_links: float = 0.4
    few_links: float = 0.1
    short: int = 70
    long: int = 200
    good_stop_words: float = 0.3
    some_stop_words: float = 0.15
    known_stop_words: float = 0.05


@dataclass
class Block:
    text: str
    linked: int
    out: bool
    inside: tuple[int, ...]
    heading: bool
    suspect: bool = False


def named(name: str) -> str | None:
    """'out', 'suspect' or None: what a class or id says. Its naming word is the last that isn't neutral, as in post-comments or ad-slot-1.

    Names that begin with a state, as has-sidebar, say nothing, nor do compounds on other words, as comments-open or share-price.
    """
    parts = [x for x in _NAME.split(_HUMP.sub("-", name).lower()) if x and not x.isdigit()]
    whole = "-".join(parts)
    if whole in OUT_NAMES:
        return "out"
    if not parts or parts[0] in STATE_NAMES:
        return None
    while len(parts) > 1 and parts[-1] in NEUTRAL_NAMES and parts[-1] not in OUT_NAMES:
        parts.pop()
    if parts[-1] not in OUT_NAMES:
        return None
    if len(parts) > 1 and parts[-1] in WEAK_NAMES and not set(parts[:-1]) & OUT_NAMES:
        return "suspect"
    return "out"


def _purpose(tag: str, attributes: str, inside: bool) -> str | None:
    """'out', 'suspect', 'in' or None: what an element says about its contents."""
    if tag in OUT_TAGS or tag == "header" and not inside:
        return "out"
    if attributes:
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        role = found.get("role", "").lower()
        if role in OUT_ROLES or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")) or _BARE_HIDDEN.search(_ATTRIBUTE.sub(" ", attributes)):
            return "out"
        says = {named(name) for name in ("" if tag in UNNAMED_TAGS else f"{found.get('class', '')} {found.get('id', '')}").split()}
        if "out" in says:
            return "out"
        if "suspect" in says and tag != "article":
            return "suspect"
        if role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower():
            return "in"
    return "in" if tag in ("article", "main") else None


def blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order. Unclosed elements end with the element around them."""
    page = _SKIP.sub(" ", page)
    out: list[Block] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, tuple[int, ...], bool, bool]] = []  # tag, out, numbers of the articles around, link, suspect
    opened: Counter[str] = Counter()  # tags on the stack, so that none is looked for in vain
    state = (False, (), False, False)
    articles = 0
    heading = False
    at = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append(Block(joined, linked, state[0], state[1], heading, state[3]))
        text.clear()
        linked = 0

    def close(i: int) -> None:
        opened.subtract(x[0] for x in stack[i:])
        del stack[i:]

    for m in _TAG.finditer(page):
        if m.start() > at:
            part = page[at : m.start()]
            text.append(part)
            if state[2]:
                linked += len(" ".join(html.unescape(part).split()))
        at = m.end()
        tag = m[2].lower() if m[2] else ""
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        block = tag in BLOCK_TAGS
        if block:
            flush()
            heading = not m[1] and len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        if tag in VOID_TAGS or m[3].endswith("/"):
            continue
        if m[1]:
            for i in range(len(stack) - 1, -1, -1) if opened[tag] > 0 else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if not block and stack[i][0] in BLOCK_TAGS:
                    break
        elif block or tag == "a" or m[3]:
            if tag == "p" or tag == "li":  # a new one ends an open one
                for i in range(len(stack) - 1, -1, -1) if opened[tag] > 0 else ():
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in BLOCK_TAGS and stack[i][0] != "p":
                        break
            was = stack[-1][1:] if stack else (False, (), False, False)
            says = _purpose(tag, m[3], bool(was[1])) if block or m[3] else None
            around = was[1]
            if says == "in" and not was[0] and (not around or tag == "article"):
                articles += 1
                around = (*around, articles)
            opened[tag] += 1
            stack.append((tag, was[0] or says == "out", around, was[2] or tag == "a", was[3] or says == "suspect"))
        state = stack[-1][1:] if stack else (False, (), False, False)
    text.append(page[at:])
    flush()
    return out


def _density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def first_pass(b: Block, r: BlockRules, known: bool) -> str:
    """in, out, near (leans in) or short; known: whether the stop words are those of the page's language."""
    if b.out:
        return "out"
    if b.linked > r.most_links * len(b.text):
        return "out"
    if b.suspect and (len(b.text) <= r.long or b.linked > r.few_links * len(b.text)):
        return "out"
    if b.heading:
        return "near" if b.inside else "short"
    density = _density(b.text) if known else r.good_stop_words
    if b.inside:
        return "in" if len(b.text) >= r.short and density >= r.some_stop_words else "near"
    if len(b.text) < r.short:
        return "out" if b.linked else "short"
    if density >= r.good_stop_words:
        return "in" if len(b.text) > r.long else "near"
    return "near" if density >= r.some_stop_words else "out"


def second_pass(labels: list[str], headings: list[bool], inside: list[tuple[int, ...]]) -> list[bool]:
    """Short blocks are in between two blocks that are in, or beside a leaning one; leaning ones unless both sides are out.

    Blocks of an article are in where any block of it is, where none of it is out, or where no block of the page is in.
    """
    decided = [x if x in ("in", "out") else None for x in labels]

    def nearest(places: range) -> dict[int, tuple[str, bool]]:
        """Of each block the nearest decided label before it in that order, and whether a leaning block lies between."""
        found, label, leaning = {}, "out", False
        for i in places:
            found[i] = label, leaning
            label, leaning = (decided[i], False) if decided[i] else (label, leaning or labels[i] == "near")
        return found

    left, right = nearest(range(len(labels))), nearest(range(len(labels) - 1, -1, -1))
    some = "in" in decided
    good = {a for x, articles in zip(labels, inside, strict=True) if x == "in" for a in articles}
    poor = {articles[-1] for x, articles in zip(labels, inside, strict=True) if x == "out" and articles}
    kept = []
    for i, label in enumerate(labels):
        if decided[i]:
            kept.append(label == "in")
            continue
        if inside[i]:
            kept.append(inside[i][-1] in good or inside[i][-1] not in poor or not some)
            continue
        (before, near_before), (after, near_after) = left[i], right[i]
        if label == "near":
            kept.append("in" in (before, after) or before == after == "out" and not some)
        elif headings[i]:
            kept.append(after == "in" or near_after)
        else:
            kept.append(before == after == "in" or before == "in" and near_after or after == "in" and near_before)
    return kept


def main_text(page: str | None, r: BlockRules = BlockRules()) -> str:
    """The kept blocks of a page, joined by line feeds; empty for a null or empty page."""
    found = blocks(page or "")
    judged = " ".join(b.text for b in found if not b.out and not b.linked)
    known = not judged or _density(judged) >= r.known_stop_words
    labels = [first_pass(b, r, known) for b in found]
    kept = second_pass(labels, [b.heading for b in found], [() if b.out else b.inside for b in found])
    if not any(kept):  # nothing on the page is decided: its longest block that nothing speaks against
        best = max((i for i, x in enumerate(labels) if x != "out"), key=lambda i: len(found[i].text), default=None)
        kept = [i == best for i in range(len(found))]
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, r: BlockRules = BlockRules()) -> DataFrame:
    """pages(page_id, url, html, ...): (page_id, url, text, n_chars), a row per page.

    Pages are independent, so nothing is shuffled. Null html gives an empty text; null ids and urls stay null;
    repeated rows stay; other columns are ignored.
    """
    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), r) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
