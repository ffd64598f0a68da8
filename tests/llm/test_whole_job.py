"""Cases in which an operator once did less than its whole job."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from maskwright.llm import html_extract, packing, token_files
from maskwright.llm.tokens import tokenizer_file

ADDED = [
    (1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|startoftext|><|endoftext|>\n y"), (4, "<|ENDOFTEXT|> No"), (5, "<|endof"), (6, "text|>"),
    (7, ""), (8, None), (9, "<|endoftext|>" * 3 + "é don't"), (10, "no mark " * 500 + "<|endoftext|> " + "the end " * 900),
]


def _ids(file):
    model = Tokenizer.from_file(tokenizer_file(file))
    return {i: np.array(model.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for i, t in ADDED}


def test_added_tokens_in_packing(spark):
    docs = spark.createDataFrame(ADDED, "doc_id long, text string")
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        got = {}
        for r in sorted(packing.pack(docs, tokenizer_file(file)).collect(), key=lambda r: r.start):
            got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
        assert got == _ids(file)


def test_added_tokens_in_token_files(spark):
    docs = spark.createDataFrame(ADDED, "doc_id long, text string")
    for file in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        rows = token_files.write_token_files(docs, tokenizer_file(file)).read().collect()
        assert {r.doc_id: zlib.crc32(bytes(r.ids)) for r in rows} == {i: zlib.crc32(w) for i, w in _ids(file).items()}


PROSE = "<p>" + "plain words of prose about trees and rivers " * 6 + "</p>"


def test_names_do_not_veto_articles():
    whole = " ".join([html_extract.main_text(PROSE)] * 2)
    for page in (
        "<article class='post has-sidebar'>%s%s</article>", "<main class='site-main comments-open'>%s%s</main>", "<div class='with-sidebar'><article>%s%s</article></div>",
        "<article>%s<section id='discussion'>%s</section></article>", "<article>%s<div id='legal-basis'>%s</div></article>",
    ):
        assert html_extract.main_text(page.replace("%s", PROSE)) == whole, page
    one = html_extract.main_text(PROSE)
    for part, text in (("<h2 id='related-work'>Related work</h2>", "Related work"), ("<h2 id='search-trees'>Search trees</h2>", "Search trees"), ("<p title='a hidden gem'>Found a gem</p>", "Found a gem"), ("<p>A <b class='search-term'>word</b> found</p>", "A word found")):
        assert html_extract.main_text(f"<article>{PROSE}{part}{PROSE}</article>") == f"{one} {text} {one}"


def test_furniture_still_goes():
    for part in (
        "<p hidden>BAD</p>", "<p style='display: none'>BAD</p>", "<div aria-hidden=true>BAD</div>", f"<div class='comments'>BAD{PROSE}</div>", f"<div id=comments-area>BAD{PROSE}</div>",
        f"<article class='comment'>BAD{PROSE}</article>", "<div class='related-posts'><h3>BAD</h3><a href=x>BAD one</a></div>", "<div class='share-buttons'>BAD</div>", "<aside>BAD</aside>",
    ):
        assert html_extract.main_text(f"<article>{PROSE}{part}{PROSE}</article>") == " ".join([html_extract.main_text(PROSE)] * 2), part
    for part in ("<div class=cookie-notice>BAD</div>", "<div class=main-nav><a href=x>BAD</a></div>", f"<div class=site-footer>BAD{PROSE}</div>"):
        assert html_extract.main_text(f"{part}<article>{PROSE}</article>") == html_extract.main_text(PROSE), part
