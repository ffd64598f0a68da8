"""Extraction on pages whose markup differs from the labelled table: words kept and dropped, and cases that once went wrong."""

from collections import Counter

import pytest

from maskwright.llm import html_extract

A = "The ferry left the harbour before dawn, and by the time the fog lifted nobody on the quay could say which way it had turned."
B = "Old charts of the bay show a second channel behind the islands, narrow and marked with crosses, that pilots have not used for years."
C = "Asked about it, the harbour master shrugged; boats come back or they do not, she said, and the tide takes no notice of either."
D = "By evening three fishermen reported a light far out, low over the water, moving slowly to the north and then not moving at all."
SHORT = "She would not say more."

#: Page and the article's text.
PAGES = {
    "plain divs": (
        f"<body><div class='top'><a href=/>Harbour Daily</a> <a href=/n>News</a> <a href=/s>Sport</a></div><div id=text><h1>A ferry is missing</h1><p>{A}</p><p>{B}</p><p>{SHORT}</p><p>{C}</p></div>"
        "<div><ul><li><a href=1>More on boats</a><li><a href=2>More on tides</a></ul></div><div class=footer>All rights reserved</div>",
        f"A ferry is missing {A} {B} {SHORT} {C}",
    ),
    "tables": (
        f"<table><tr><td><a href=a>Home</a><br><a href=b>About</a><br><a href=c>Links</a></td><td><h2>A ferry is missing</h2><p>{A}<p>{B}<p>{D}</td></tr><tr><td colspan=2><a href=m>Mail us</a></td></tr></table>",
        f"A ferry is missing {A} {B} {D}",
    ),
    "blog with comments": (
        f"<div class=site-header><h1><a href=/>Tide notes</a></h1></div><div class=post-body><h2>Lights at sea</h2><p>{A}</p><blockquote>{D}</blockquote><p>{C}</p></div>"
        f"<div id=comments><h3>2 comments</h3><div class=comment-body><p>{B} I saw it too.</p></div><div class=comment-body><p>Nonsense, says I.</p></div><form><label>Name</label><input></form></div>",
        f"Lights at sea {A} {D} {C}",
    ),
    "form around the page": (
        f"<form method=post action=page.aspx><div class=nav-links><a href=1>One</a> <a href=2>Two</a></div><div><h1>A ferry is missing</h1><p>{A}</p><p>{C}</p></div><label for=q>Find</label><input id=q><select><option>All</select></form>",
        f"A ferry is missing {A} {C}",
    ),
    "article within a form": (f"<body><form><article><h1>Lights</h1><p>{D}</p><p>{B}</p></article><button>Save</button></form>", f"Lights {D} {B}"),
    "search form": (f"<form role=search><label>Search this site for anything you like</label><input></form><main><p>{A}</p><p>{B}</p></main>", f"{A} {B}"),
    "sections": (
        f"<main><header><h1>Currents</h1><p>{SHORT}</p></header><section><h2 id=background>Background</h2><p>{A}</p></section><section id=discussion><h2>Discussion</h2><p>{B}</p><p>{C}</p></section><aside><p>{D}</p></aside></main>",
        f"Currents {SHORT} Background {A} Discussion {B} {C}",
    ),
    "lists and listings": (
        f"<article><h1>How to look</h1><p>{A}</p><ol><li>Stand on the quay<li>Count the lamps</ol><pre>lamps = 3 <span class=comment># not four</span></pre><p>{C}</p><div class=share-buttons><a href=t>Tell others</a></div></article>",
        f"How to look {A} Stand on the quay Count the lamps lamps = 3 # not four {C}",
    ),
    "figures": (f"<article><p>{A}</p><figure><img src=x alt=no><figcaption>The quay at noon.</figcaption></figure><p>{B}</p></article>", f"{A} The quay at noon. {B}"),
    "cookie notice": (f"<div class='cookie-banner'><p>We use cookies to make the site better for you and for our partners, as you may read in the policy.</p></div><div class=entry><p>{A}</p><p>{B}</p></div>", f"{A} {B}"),
    "head not ended": (f"<html><head><meta charset=utf-8><title>No</title><p>{A}<p>{B}", f"{A} {B}"),
    "one paragraph": ("<p>Closed today.</p>", "Closed today."),
    "two short ones": ("<title>x</title><p title=don't>Closed today.<p>Back at nine.", "Closed today. Back at nine."),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert html_extract.main_text(page) == want


def test_precision_and_recall_of_words():
    hit = got = wanted = 0
    for page, want in PAGES.values():
        mine, theirs = Counter(html_extract.main_text(page).split()), Counter(want.split())
        hit, got, wanted = hit + (mine & theirs).total(), got + mine.total(), wanted + theirs.total()
    assert hit >= 0.97 * got and hit >= 0.97 * wanted, (hit / got, hit / wanted)


def test_markup_that_once_swallowed_text():
    for page, want in (
        ("<article><p title=don't>One</p><p>Two</p></article>", "One Two"), ("<article><a href=x title=it's>w</a> and more of it</article>", "w and more of it"), ("<article><p a='x>y'>q</p><p>r s</p></article>", "q r s"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be so</p></article>", "Let x=2 be so"), ("<article class='legal post'><p>One</p></article>", "One"),
        (f"<div class='post tags-news'><p>{A}</p></div>", A), ("<article><p>this <span class=comment>word</span> stays</p></article>", "this word stays"), ("<article><p a=\"b>c", ""), ("<article><p>a</p><p a='", "a"),
    ):
        assert html_extract.main_text(page) == want, page


def test_long_page_and_repeated_rows(spark):
    page = "<article>" + f"<p>{A}</p>" * 20_000 + "</article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, "x")]
    schema = "page_id long, url string, html string, text string"
    got = html_extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r.n_chars for r in got) == [0] + [20_000 * len(A) + 19_999] * 2
    assert html_extract.extract(spark.createDataFrame([], schema)).count() == 0
