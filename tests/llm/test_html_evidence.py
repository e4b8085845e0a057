"""HTML extraction by densities, containers and neighbours: the text stays where class names and the article's mark are taken out."""

import random
import re

import duckdb

from cladewise.llm import html_text
from cladewise.llm.html_text import BAD, blocks_of, classify, main_text

LONG = "This is the text of the article and it has all the words that it needs to be seen as one of them. "


def test_text_without_names_and_marks():
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    rng = random.Random(1)
    renamed = [re.sub(r'(class|id)="[^"]*"', lambda m: f'{m[1]}="{"".join(rng.choice("qxzjkv") for _ in range(6))}"', p) for p in pages]
    unmarked = [re.sub(r"<(/?)article", r"<\1div", p) for p in renamed]
    bare = [re.sub(r"<(/?)(nav|footer)\b", r"<\1div", p) for p in unmarked]
    want = [main_text(p) for p in pages]
    same = [sum(map(str.__eq__, want, map(main_text, own))) / len(pages) for own in (renamed, unmarked, bare)]
    assert same[0] >= 0.99 and same[1] >= 0.95 and same[2] >= 0.93
    assert sum(b.label == BAD for p in pages for b in classify(blocks_of(p))) > len(pages)


def test_class_words_are_no_verdict():
    only = f'<article><h1>Title</h1><div class="feedback-summary"><p>{LONG * 2}</p></div></article>'
    assert main_text(f"<body>{only}</body>") == (LONG * 2).strip() or main_text(f"<body>{only}</body>") == "Title " + (LONG * 2).strip()
    both = f'<article><p>{LONG * 2}</p><div class="comments"><p>{LONG}</p></div></article>'
    assert main_text(both) == (LONG * 2).strip()


def test_plain_containers_and_margins():
    assert main_text(f"<div>Home News Sport Weather</div><div>{LONG * 3}</div><div>Terms Privacy</div>") == (LONG * 3).strip()
    # short blocks of the article's own container and between its long ones stay
    assert main_text(f"<div><p>{LONG * 2}</p><p>Short one.</p></div><div>Terms Privacy</div>") == LONG * 2 + "Short one."
    assert main_text(f"<div>{LONG * 2}</div><div>Short one.</div><div>{LONG * 2}</div>") == LONG * 2 + "Short one. " + (LONG * 2).strip()
    # of a page without a decided block the fullest container is the text
    assert main_text("<div>Ad here</div><div><p>Plain words only.</p><p>Some more words.</p></div>") == "Plain words only. Some more words."
    assert main_text("<p>One line</p>") == "One line" and main_text("") == "" and main_text(None) == ""


def test_hidden_and_form_text_is_no_text():
    page = f'<div><p>{LONG}</p><form>Your name</form><p hidden>gone</p><p style="display: none">gone</p><p aria-hidden="true">gone</p><p>{LONG}</p></div>'
    assert main_text(page) == LONG + LONG.strip()


def test_deep_nesting_takes_time_in_proportion():
    page = "<div>" * 50_000 + LONG + "</div>" * 50_000
    assert main_text(page) == LONG.strip() and len(html_text.blocks_of(page)) == 1
