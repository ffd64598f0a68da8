"""HTML extraction: flat text blocks, their words and link density and their neighbours', and a decision tree.

A page becomes a flat list of text blocks: block-level tags end one, inline tags do not. Each block has the
numbers of boilerplate detection by shallow text features - words, link density, both for the blocks before
and after -, where it stands (within the main element, within an element that is page furniture or hidden, or
in neither) and what the names of the elements around it hint at: a layout word (comments, site-footer), a word
that may as well be a topic (discussion, related-work), or nothing. A decision tree, grown on the small labelled table below, says which blocks are the article.

Text of scripts, styles, templates, heads and form controls never becomes a block. A form is furniture but
for one that wraps the page: its article stays. A head ends with its end tag or with what can't be in one.
Null and empty pages give an empty text; broken markup is read as far as it goes (an unended tag at the end
is dropped); very long pages are read whole, a few at a time. Equal rows are extracted alike; null ids and
urls are passed through; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session, small

# Names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "select", "button", "object", "canvas", "noframes", "annotation", "annotation-xml")
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mover munder munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose semantics""".split()
)
#: What may stand in a head; anything else begins the body.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Within a form that wraps a page: what belongs to its controls.
CONTROLS = frozenset("label legend fieldset".split())
MAIN = frozenset(("article", "main"))
FURNITURE = frozenset("nav header footer aside menu dialog fieldset".split())
#: Words in class, id or role that name page furniture, and those that name the main element.
FURNITURE_WORDS = frozenset(
    """ad ads advert advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs header footer
    masthead sidebar aside widget cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search
    share sharing social related recommended recommendations comment comments disqus respond reply replies pagination pager toolbar skip legal copyright
    complementary contentinfo toc tags byline-links discussion""".split()
)
#: Those of them that name nothing but furniture; the others may be the topic of a section.
LAYOUT_WORDS = frozenset(
    """ad ads advert sponsor sponsored promo promoted nav navbar breadcrumb breadcrumbs footer masthead sidebar aside widget popup modal newsletter share comment
    comments disqus respond pagination pager toolbar skip contentinfo byline-links""".split()
)
#: Parts of a name that say only that there is such a thing elsewhere, and those that say only that it is a box.
STATE_WORDS = frozenset("has have with without no is".split())
BOX_WORDS = frozenset("area list section wrapper wrap container box block inner item items links link buttons bar top bottom left right primary secondary".split())
MAIN_WORDS = frozenset("article content main post entry story maincontent articlebody postcontent entrycontent".split())

# A quote begins a value only after an equals sign; elsewhere it is a character like any other.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)*+)(>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_WORD = re.compile(r"[A-Za-z]+(?:-[A-Za-z]+)?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    zone: int  # 1 within the main element, -1 within page furniture, 0 in neither
    hint: int = 0  # of the names around it: -2 a layout word, -1 a furniture word that may be a topic, 0 none
    form: int = 0  # the outermost form around it, 0 for none

    @property
    def links(self) -> float:
        return self.linked / self.words if self.words else 0.0


@lru_cache(65536)
def _name(name: str) -> tuple[int, int]:
    """Zone (1 or 0) and hint of one class, id or role."""
    parts = [p for p in name.split("-") if p]
    if name in LAYOUT_WORDS:
        return 0, -2
    if name in FURNITURE_WORDS:
        return 0, -1
    if len(parts) > 1 and parts[0] in STATE_WORDS:
        return 0, 0
    core = parts
    while len(core) > 1 and core[-1] in BOX_WORDS:
        core = core[:-1]
    if len(parts) > 1 and core[-1] in LAYOUT_WORDS:  # what the name is about: site-footer, comments-area
        return 0, -2
    if FURNITURE_WORDS.intersection(parts):
        return 0, -1
    return int(bool(MAIN_WORDS.intersection((name, *parts)))), 0


def _place(tag: str, attributes: str, zone: int = 0, hint: int = 0) -> tuple[int, int]:
    """Zone and hint within an element, by those around it."""
    names, ids = [], []
    for m in _ATTRIBUTE.finditer(attributes) if len(attributes) > 2 else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value.strip() == "true") or (key == "style" and _NONE.search(value)):
            return -1, hint
        if key in ("class", "role"):
            names += value.replace("_", "-").split()
        elif key == "id" and tag not in _HEADING:  # a heading's id is its text again
            ids += value.replace("_", "-").split()
    if zone == -1 or (tag in FURNITURE and not (tag == "header" and zone == 1)):  # but for an article's own heading
        return -1, hint
    said = [_name(x) for x in names]
    anchors = [_name(x) for x in ids]
    layout = -2 in (h for _, h in said + anchors)
    if tag in MAIN:
        # a comment may be an article within another; the outermost is one whatever its names
        return 1, -2 if hint == -2 or (zone == 1 and layout) else 0
    if zone == 0 and any(z for z, _ in said + anchors):
        return 1, -2 if hint == -2 or layout else 0
    # within the main element, ids are targets of links to its sections
    own = min((h for _, h in said + (anchors if zone == 0 or layout else [])), default=0)
    return zone, min(hint, own)


def blocks_of(page: str | None) -> list[Block]:
    """The page's text blocks in order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # open elements that are not inline, with their zone and hint
    parts: list[str] = []
    linked: list[str] = []
    anchor, form, forms = False, 0, 0

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                words = len(text.split(" "))
                out.append(Block(text, words, min(words, len(html.unescape(" ".join(linked)).split())), *(stack[-1][1:] if stack else (0, 0)), form))
        parts, linked = [], []

    at = 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and (not _in_head(stack) or not text.isspace()):
            if _in_head(stack):
                stack.pop()
            parts.append(text)
            if anchor:
                linked.append(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        if not m[4]:  # the page ends within a tag
            break
        tag, ending = m[2].lower(), bool(m[1])
        if not ending and tag not in IN_HEAD and _in_head(stack):
            stack.pop()
        if tag == "a":
            anchor = not ending
            continue
        if tag in RAW and not ending:
            if tag in ("button", "select", "textarea", "iframe", "title", "noscript"):
                close()
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            zone, hint = _place(tag, m[3]) if not ending and len(m[3]) > 3 else (0, 0)
            if zone == -1 or (form and not ending and tag in CONTROLS):  # hidden; the names of inline elements are about their words
                close()
                stack.append((tag, -1, -2))
            elif ending and stack and stack[-1][0] == tag:
                close()
                stack.pop()
            continue
        close()
        if tag == "form":  # the outermost counts, and ends with it
            if not ending and not form:
                forms += 1
                form = forms
            elif ending and not any(t == "form" for t, *_ in stack[: _last(stack, "form")]):
                form = 0
        anchor = False if tag in ("p", "div", "li", "td", "body") and ending else anchor
        if tag in VOID or (m[3].endswith("/") and tag not in MAIN | FURNITURE | {"div", "p", "section"}):
            continue
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag == "body":
            stack = [x for x in stack if x[0] == "html"]
        if tag in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == tag:
            stack.pop()
        above = stack[-1][1:] if stack else (0, 0)
        stack.append((tag, *(above if tag in ("html", "body") else _place(tag, m[3], *above))))
    close()
    return _without_forms(out)


def _in_head(stack: list[tuple]) -> bool:
    return bool(stack) and len(stack) <= 2 and stack[-1][0] == "head"


def _last(stack: list[tuple], tag: str) -> int:
    return max((i for i, x in enumerate(stack) if x[0] == tag), default=0)


def _without_forms(blocks: list[Block]) -> list[Block]:
    """A form's text is furniture, unless the form wraps the page: then it holds the main element, or prose that is most of the page's text."""
    every = sum(b.words for b in blocks)
    for form in {b.form for b in blocks} - {0}:
        own = [b for b in blocks if b.form == form]
        prose = [b for b in own if b.zone >= 0 and b.words >= 20 and b.links < 0.5]
        if not any(b.zone == 1 for b in own) and not (prose and 2 * sum(b.words for b in own) > every):
            for b in own:
                b.zone = -1
    return blocks


# ---------------------------------------------------------------- the tree

#: (zone, hint, words, link density, words before, link density before, words after, link density after, article?). Fixed values.
LABELLED = (
    (1, 0, 12, 0.0, 6, 1.0, 60, 0.0, 1), (1, 0, 1, 0.0, 40, 0.0, 35, 0.0, 1), (1, 0, 80, 0.0, 30, 0.0, 50, 0.0, 1), (1, 0, 120, 0.1, 60, 0.0, 45, 0.0, 1),
    (1, 0, 3, 0.0, 9, 0.0, 0, 0.0, 1), (1, 0, 25, 0.3, 90, 0.0, 80, 0.0, 1), (1, 0, 5, 0.2, 0, 0.0, 11, 0.0, 1), (1, 0, 2, 0.0, 1, 1.0, 2, 0.0, 1),
    (1, 0, 40, 0.0, 15, 0.9, 12, 1.0, 1), (1, 0, 9, 0.0, 0, 0.0, 0, 0.0, 1), (1, 0, 6, 0.5, 70, 0.0, 60, 0.0, 1), (1, 0, 1, 1.0, 55, 0.0, 44, 0.0, 1),
    (1, 0, 300, 0.02, 1, 0.0, 2, 0.0, 1), (1, 0, 18, 0.6, 33, 0.0, 29, 0.1, 1), (1, 0, 4, 0.0, 3, 0.0, 5, 0.0, 1), (1, 0, 1, 0.0, 1, 0.0, 1, 0.0, 1),
    (1, 0, 5, 0.0, 30, 0.0, 4, 1.0, 1), (1, 0, 10, 0.0, 3, 1.0, 6, 0.9, 1), (1, 0, 20, 0.1, 10, 0.0, 3, 1.0, 1), (1, 0, 2, 0.0, 9, 0.2, 1, 1.0, 1),
    (1, 0, 8, 0.0, 1, 1.0, 1, 1.0, 1), (1, 0, 50, 0.1, 2, 1.0, 3, 1.0, 1), (1, 0, 7, 0.2, 40, 0.0, 2, 0.8, 1), (1, 0, 1, 0.0, 2, 1.0, 2, 1.0, 1),
    (1, 0, 12, 0.0, 6, 1.0, 0, 0.0, 1), (1, 0, 3, 0.0, 2, 1.0, 0, 0.0, 1), (1, 0, 40, 0.1, 3, 1.0, 0, 0.0, 1), (1, 0, 1, 0.2, 1, 0.9, 0, 0.0, 1),
    (1, 0, 2, 0.5, 3, 0.0, 1, 0.0, 1), (1, 0, 4, 0.75, 5, 0.0, 20, 0.0, 1), (1, 0, 1, 1.0, 10, 0.0, 12, 0.0, 1), (1, 0, 6, 1.0, 15, 0.0, 8, 0.0, 1),
    (1, 0, 10, 0.5, 2, 0.0, 30, 0.0, 1), (1, 0, 8, 1.0, 20, 0.0, 0, 0.0, 1), (1, 0, 3, 0.6, 4, 0.2, 6, 0.2, 1), (1, 0, 30, 0.8, 9, 0.5, 12, 0.3, 1),
    (0, 0, 2, 0.0, 20, 0.0, 17, 0.0, 1), (0, 0, 1, 0.0, 18, 0.0, 25, 0.0, 1), (0, 0, 3, 0.0, 16, 0.0, 19, 0.0, 1), (0, 0, 4, 0.0, 12, 0.0, 30, 0.0, 1),
    (1, 0, 3, 1.0, 3, 1.0, 4, 1.0, 0), (1, 0, 2, 1.0, 2, 1.0, 1, 1.0, 0), (1, 0, 5, 1.0, 4, 1.0, 6, 0.95, 0), (1, 0, 1, 1.0, 2, 0.9, 1, 1.0, 0),
    (-1, 0, 2, 1.0, 1, 1.0, 3, 1.0, 0), (-1, 0, 14, 0.0, 2, 1.0, 20, 0.0, 0), (-1, 0, 60, 0.0, 20, 0.0, 45, 0.0, 0), (-1, 0, 7, 0.3, 80, 0.0, 0, 0.0, 0),
    (-1, 0, 150, 0.0, 90, 0.0, 70, 0.0, 0), (-1, 0, 1, 0.0, 1, 1.0, 50, 0.0, 0), (-1, 0, 30, 0.1, 40, 0.0, 35, 0.0, 0), (-1, 0, 9, 0.0, 9, 0.0, 9, 0.0, 0),
    (-1, 0, 25, 0.0, 0, 0.0, 0, 0.0, 0), (-1, 0, 5, 0.6, 2, 0.5, 12, 0.2, 0), (-1, 0, 45, 0.2, 120, 0.0, 110, 0.0, 0), (-1, 0, 3, 0.0, 70, 0.0, 1, 1.0, 0),
    (0, 0, 60, 0.0, 50, 0.0, 70, 0.0, 1), (0, 0, 35, 0.05, 20, 0.0, 40, 0.0, 1), (0, 0, 100, 0.1, 3, 1.0, 2, 1.0, 1), (0, 0, 22, 0.0, 45, 0.0, 60, 0.1, 1),
    (0, 0, 18, 0.0, 2, 0.9, 55, 0.0, 1), (0, 0, 8, 0.0, 70, 0.0, 65, 0.0, 1), (0, 0, 5, 0.0, 3, 1.0, 48, 0.0, 1), (0, 0, 12, 0.1, 30, 0.0, 28, 0.0, 1),
    (0, 0, 2, 0.0, 62, 0.0, 38, 0.0, 1), (0, 0, 250, 0.02, 5, 0.0, 6, 0.5, 1), (0, 0, 16, 0.2, 80, 0.0, 22, 0.0, 1), (0, 0, 19, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 0, 3, 1.0, 2, 1.0, 4, 1.0, 0), (0, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 0, 6, 0.8, 5, 0.9, 7, 0.6, 0), (0, 0, 20, 0.7, 4, 1.0, 5, 1.0, 0),
    (0, 0, 40, 0.6, 30, 0.7, 20, 0.9, 0), (0, 0, 4, 0.0, 2, 1.0, 3, 0.7, 0), (0, 0, 2, 0.0, 3, 0.0, 1, 0.0, 0), (0, 0, 5, 0.0, 0, 0.0, 4, 1.0, 0),
    (0, 0, 6, 0.2, 3, 0.0, 0, 0.0, 0), (0, 0, 12, 0.9, 60, 0.0, 55, 0.0, 0), (0, 0, 3, 0.4, 1, 1.0, 2, 0.6, 0), (0, 0, 7, 0.0, 2, 1.0, 0, 0.0, 0),
    # prose that ends a text, before nothing or before links, and one-line furniture after it
    (0, 0, 25, 0.0, 24, 0.0, 0, 0.0, 1), (0, 0, 26, 0.0, 5, 0.0, 3, 1.0, 1), (0, 0, 30, 0.0, 40, 0.0, 2, 1.0, 1), (0, 0, 22, 0.0, 60, 0.0, 1, 1.0, 1),
    (0, 0, 40, 0.1, 30, 0.0, 0, 0.0, 1), (0, 0, 18, 0.0, 25, 0.0, 4, 0.9, 1), (0, 0, 70, 0.0, 2, 0.0, 0, 0.0, 1), (0, 0, 24, 0.1, 9, 0.0, 2, 0.0, 1),
    (0, 0, 3, 0.0, 26, 0.0, 0, 0.0, 0), (0, 0, 4, 0.0, 3, 1.0, 0, 0.0, 0), (0, 0, 6, 0.0, 4, 1.0, 0, 0.0, 0), (0, 0, 8, 0.3, 30, 0.0, 0, 0.0, 0),
    (0, 0, 5, 0.0, 24, 0.0, 23, 0.0, 1), (0, 0, 6, 0.0, 28, 0.0, 20, 0.0, 1), (0, 0, 3, 0.3, 24, 0.0, 2, 1.0, 0), (0, 0, 2, 0.0, 25, 0.0, 3, 1.0, 0),
    # short blocks with nothing beside them are the page
    (0, 0, 5, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 2, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0, 9, 0.1, 0, 0.0, 0, 0.0, 1), (0, 0, 1, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 0, 3, 1.0, 0, 0.0, 0, 0.0, 0), (0, 0, 6, 0.9, 0, 0.0, 0, 0.0, 0), (0, 0, 7, 0.0, 0, 0.0, 25, 0.0, 1), (0, 0, 4, 0.0, 0, 0.0, 12, 0.0, 1),
    # names that hint at furniture: layout words, then words that may be topics, with their counter-examples
    (0, -2, 60, 0.0, 50, 0.0, 70, 0.0, 0), (0, -2, 3, 0.0, 1, 1.0, 20, 0.0, 0), (0, -2, 25, 0.1, 40, 0.0, 2, 0.0, 0), (0, -2, 4, 1.0, 4, 1.0, 4, 1.0, 0),
    (1, -2, 60, 0.0, 50, 0.0, 70, 0.0, 0), (1, -2, 3, 0.0, 80, 0.0, 20, 0.0, 0), (1, -2, 1, 0.0, 90, 0.0, 2, 0.0, 0), (1, -2, 30, 0.0, 2, 0.0, 0, 0.0, 0),
    (1, -2, 120, 0.0, 3, 0.0, 40, 0.0, 0), (1, -2, 4, 1.0, 60, 0.0, 3, 1.0, 0), (1, -2, 12, 0.3, 30, 0.0, 9, 0.5, 0), (1, -2, 6, 0.0, 5, 0.0, 5, 0.0, 0),
    (0, -2, 150, 0.0, 20, 0.0, 90, 0.0, 0), (0, -2, 2, 0.0, 60, 0.0, 0, 0.0, 0), (0, -2, 18, 0.0, 2, 0.0, 18, 0.0, 0), (0, -2, 8, 0.2, 70, 0.0, 65, 0.0, 0),
    (1, -1, 60, 0.0, 50, 0.0, 70, 0.0, 1), (1, -1, 2, 0.0, 45, 0.0, 60, 0.0, 1), (1, -1, 1, 0.0, 70, 0.0, 35, 0.0, 1), (1, -1, 25, 0.1, 3, 0.0, 0, 0.0, 1),
    (1, -1, 9, 0.0, 2, 0.0, 12, 0.0, 1), (1, -1, 5, 0.0, 0, 0.0, 30, 0.0, 1), (1, -1, 120, 0.05, 1, 0.0, 2, 1.0, 1), (1, -1, 14, 0.2, 30, 0.0, 20, 0.1, 1),
    (1, -1, 60, 0.0, 50, 0.0, 0, 0.0, 1), (1, -1, 25, 0.0, 70, 0.0, 3, 0.0, 1), (1, -1, 8, 0.0, 40, 0.0, 2, 0.0, 1), (1, -1, 80, 0.1, 5, 0.0, 0, 0.0, 1),
    (1, -1, 3, 0.0, 60, 0.0, 0, 0.0, 1), (1, -1, 12, 0.2, 6, 0.3, 5, 0.0, 1), (1, -1, 40, 0.3, 8, 0.0, 8, 0.0, 1), (1, -1, 6, 0.0, 4, 1.0, 60, 0.0, 1),
    (1, -1, 30, 0.0, 60, 0.0, 4, 1.0, 1), (1, -1, 15, 0.0, 40, 0.0, 3, 1.0, 1),
    (0, -1, 20, 0.0, 9, 0.0, 4, 0.0, 0), (0, -1, 5, 0.3, 40, 0.0, 30, 0.0, 0), (0, -1, 12, 0.0, 0, 0.0, 0, 0.0, 0), (0, -1, 45, 0.0, 3, 1.0, 50, 0.0, 1),
    (1, -1, 4, 1.0, 60, 0.0, 5, 1.0, 0), (1, -1, 6, 0.9, 4, 1.0, 7, 1.0, 0), (1, -1, 3, 1.0, 5, 1.0, 0, 0.0, 0), (1, -1, 12, 0.8, 20, 0.0, 30, 0.0, 0),
    (1, -1, 4, 0.0, 70, 0.0, 6, 1.0, 0), (1, -1, 2, 0.0, 40, 0.0, 3, 1.0, 0), (1, -1, 5, 0.7, 90, 0.0, 40, 0.0, 0), (1, -1, 1, 1.0, 50, 0.0, 60, 0.0, 0),
    (-1, -1, 60, 0.0, 50, 0.0, 70, 0.0, 0), (-1, -1, 3, 0.0, 9, 0.0, 20, 0.0, 0), (-1, -1, 25, 0.1, 40, 0.0, 2, 0.0, 0), (-1, -1, 4, 1.0, 4, 1.0, 4, 1.0, 0),
    (0, -1, 60, 0.0, 50, 0.0, 70, 0.0, 1), (0, -1, 35, 0.05, 20, 0.0, 40, 0.0, 1), (0, -1, 100, 0.1, 30, 0.0, 50, 0.0, 1), (0, -1, 80, 0.0, 25, 0.0, 18, 0.0, 1),
    (0, -1, 3, 0.0, 1, 1.0, 3, 0.0, 0), (0, -1, 14, 0.0, 2, 1.0, 60, 0.0, 0), (0, -1, 30, 0.0, 4, 1.0, 3, 0.0, 0), (0, -1, 9, 0.0, 9, 0.0, 9, 0.0, 0),
    (0, -1, 4, 0.0, 80, 0.0, 3, 1.0, 0), (0, -1, 25, 0.6, 30, 0.0, 25, 0.6, 0), (0, -1, 7, 0.0, 70, 0.0, 0, 0.0, 0), (0, -1, 2, 1.0, 3, 1.0, 2, 1.0, 0),
    (0, -1, 60, 0.9, 50, 0.0, 70, 0.0, 0), (0, -1, 100, 1.0, 30, 0.0, 50, 0.0, 0), (1, -1, 60, 0.9, 50, 0.0, 70, 0.0, 0), (0, -1, 40, 0.8, 20, 0.5, 40, 0.8, 0),
)


def grow(rows: np.ndarray, says: np.ndarray, depth: int = 8):
    """A binary tree by Gini impurity: (feature, threshold, lower, upper) or a class."""
    if depth == 0 or len(set(says.tolist())) == 1:
        return int(says.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= t
            impure = sum(s.sum() * (1 - s.mean()) for s in (says[low], says[~low]))
            if best is None or impure < best[0] - 1e-12:
                best = (impure, f, float(t), low)
    if best is None:
        return int(says.mean() >= 0.5)
    _, f, t, low = best
    return f, t, grow(rows[low], says[low], depth - 1), grow(rows[~low], says[~low], depth - 1)


@lru_cache(1)
def tree():
    """The first splits are on the hint, so that labelled names don't move the splits of blocks without any."""
    table = np.array(LABELLED, float)
    layout, topic, none = (grow(table[table[:, 1] == h, :-1], table[table[:, 1] == h, -1]) for h in (-2, -1, 0))
    return 1, -1.5, layout, (1, -0.5, topic, none)


def _judge(node, row) -> int:
    while not isinstance(node, int):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


def features(blocks: list[Block]) -> list[tuple]:
    none = Block("", 0, 0, 0)
    around = [none, *blocks, none]
    return [(b.zone, b.hint, b.words, b.links, a.words, a.links, c.words, c.links) for a, b, c in zip(around, around[1:], around[2:], strict=False)]


#: Words below which a page without a main element says too little about its blocks.
FEW = 10


def main_text(page: str | None) -> str:
    """The article's text: its blocks in page order, joined by one space.

    Of a page without a main element, of which the tree keeps next to nothing, all that is neither furniture nor links.
    """
    blocks = blocks_of(page)
    kept = [b for b, row in zip(blocks, features(blocks), strict=True) if _judge(tree(), row)]
    if sum(b.words for b in kept) < FEW and not any(b.zone == 1 for b in blocks):
        kept = [b for b in blocks if b in kept or (b.zone == 0 and b.hint == 0 and b.links < 0.5)]
    return " ".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages(page_id, url, html)."""
    session(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in small(batches, 2):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
