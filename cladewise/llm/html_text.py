"""Operator 8, main text of web pages by block rules in two passes.

The page is read once, as a stream of tags, and cut into blocks; what stands in navigation, forms,
comments, adverts and so on is left out on the way. The first pass decides blocks by stop-word density,
length and link density, and leaves short or doubtful ones open. In the second pass an open block takes the
label of its nearest decided neighbours. A marked article only narrows the choice: once a block inside it
is decided as text, blocks outside are not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .quality import STOP_WORDS

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "title", "audio", "video", "canvas"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose text is no text of the page at all.
NEVER_TEXT = {"form", "menu", "dialog", "button", "head", "fieldset", "datalist", "input"}
#: Hints that a block isn't of the article: elements, roles, and words of class and id attributes.
HINT_TAGS = {"nav", "footer", "aside", "header"}
HINT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "form", "toolbar"}
HINT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising advertorial adsense sponsor sponsored promo promotion promoted banner "
    "sidebar side aside rail widget widgets nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager "
    "header masthead topbar footer bottombar cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "comment comments commentlist disqus replies reply respond discussion feedback share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login register search form toolbar copyright legal disclaimer".split()
)
MAIN_TAGS, MAIN_ROLES = {"article", "main"}, {"main", "article"}
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold a block without being a container of blocks.
HOLDERS = HEADINGS | set("p li dt dd td th tr tbody thead tfoot caption pre blockquote figcaption summary address".split())
#: What keeps a new block inside an open paragraph from ending it.
HOLDS_P = ("table", "td", "th", "button", "li")
STOPS = frozenset(STOP_WORDS)
#: Words and share of stop words from which a block is text; a share of link characters above ``LINKED`` isn't.
LONG, LONG_STOPS, MIDDLE, MIDDLE_STOPS, LINKED = 25, 0.12, 12, 0.25, 0.5
GOOD, BAD, OPEN = 1, -1, 0
#: How much further away text in another container counts.
APART = 2
#: The part of the fullest container's text below which a container's text isn't decided by itself.
SMALL = 0.2


@dataclass
class Block:
    text: str
    main: bool
    heading: bool
    link_chars: int
    container: int = 0
    hints: int = 0
    label: int = OPEN


@dataclass
class _Open:
    """An open element. ``serial`` grows along the stack; ``blocks``: elements below it that aren't inline; ``gone``: ended out of order."""

    tag: str
    never: bool
    main: bool
    hint: bool
    serial: int
    blocks: int
    gone: bool = False


class _Stack:
    """Open elements with running counts, so that every tag costs a bounded number of steps besides the elements it ends."""

    def __init__(self) -> None:
        self.stack: list[_Open] = []
        self.by_tag: dict[str, list[_Open]] = {}
        self.containers: list[int] = [0]
        self.never = self.main = self.hints = self.headings = self.links = self.blocks = self.serial = 0

    def _count(self, e: _Open, by: int) -> None:
        self.never += by * e.never
        self.main += by * e.main
        self.hints += by * e.hint
        self.headings += by * (e.tag in HEADINGS)
        self.links += by * (e.tag == "a")
        self.blocks += by * (e.tag not in INLINE)

    def last(self, tag: str) -> _Open | None:
        found = self.by_tag.get(tag)
        return found[-1] if found else None

    def push(self, tag: str, never: bool, main: bool, hint: bool) -> None:
        self.serial += 1
        e = _Open(tag, never, main, hint, self.serial, self.blocks)
        self.stack.append(e)
        if tag not in INLINE and tag not in HOLDERS:
            self.containers.append(e.serial)
        self.by_tag.setdefault(tag, []).append(e)
        self._count(e, 1)

    def end(self, e: _Open) -> None:
        """End ``e`` and all inside it; an inline element that holds open blocks ends alone."""
        if e.tag in INLINE and self.blocks > e.blocks:
            self.by_tag[e.tag].pop()
            self._count(e, -1)
            e.gone = True
            return
        while True:
            top = self.stack.pop()
            if top.serial == self.containers[-1]:
                self.containers.pop()
            if not top.gone:
                self.by_tag[top.tag].pop()
                self._count(top, -1)
            if top is e:
                return

    def make_room(self, tag: str) -> None:
        """End what a new element of that tag ends: an open paragraph, or the list item beside it."""
        serial = lambda t: e.serial if (e := self.last(t)) else 0
        if tag in CLOSES_P and serial("p") > max(map(serial, HOLDS_P)):
            self.end(self.last("p"))
        if tag == "li" and serial("li") > max(serial("ul"), serial("ol")):
            self.end(self.last("li"))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if "=" in text or text.strip(" /") else {}


def _never(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NEVER_TEXT or attrs.get("aria-hidden") == "true" or "hidden" in attrs:
        return True
    return bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))


def _hint(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in HINT_TAGS and not (tag == "header" and in_main) or attrs.get("role", "").lower() in HINT_ROLES:
        return True
    words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", attrs.get("class", "") + " " + attrs.get("id", "")).lower()))
    if tag in ("body", "html", "article", "main") and not words & {"comment", "comments", "ad", "advert", "sponsored", "related"}:
        return False
    return bool(words & HINT_WORDS)


def _tag_end(page: str, at: int, lost: set[str]) -> int:
    """Where the tag ends whose attributes begin at ``at``: its '>' outside quotes, -1 if there is none. ``lost``: quotes that nothing closes any more."""
    while True:
        at = PLAIN.match(page, at).end()
        if at == len(page):
            return -1
        c = page[at]
        if c == ">":
            return at
        close = -1 if c in lost else page.find(c, at + 1)
        if close < 0:
            lost.add(c)
        at = max(at, close) + 1


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, in time that grows with the page's length. Unclosed and crossed tags are taken as browsers take them, roughly; a tag cut off at the end is no text."""
    out: list[Block] = []
    parts: list[str] = []
    open_ = _Stack()
    lost: set[str] = set()
    link = at = 0

    def flush() -> None:
        nonlocal link
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, open_.main > 0, open_.headings > 0, link, open_.containers[-1], open_.hints))
        parts.clear()
        link = 0

    def text_is(raw: str) -> None:
        nonlocal link
        if raw and not open_.never:
            raw = html.unescape(raw)
            parts.append(raw)
            if open_.links:
                link += len("".join(raw.split()))

    while at < len(page):
        here = page.find("<", at)
        if here < 0:
            text_is(page[at:])
            break
        m = NAME.match(page, here)
        if not m:
            mark = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")) if page.startswith(x[0], here)), None)
            text_is(page[at : here if mark else here + 1])
            at = here + 1
            if mark:
                end = page.find(mark[1], here + len(mark[0]))
                at = len(page) if end < 0 else end + len(mark[1])
            continue
        text_is(page[at:here])
        end = _tag_end(page, m.end(), lost)
        if end < 0:
            break
        closing, tag, attrs, at = m[1], m[2].lower(), page[m.end() : end], end + 1
        if tag not in INLINE:
            flush()
        if closing:
            if found := open_.last(tag):
                open_.end(found)
            continue
        if tag in SKIPPED:
            end = None if tag in lost else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not end:
                lost.add(tag)
            at = end.end() if end else len(page) if tag in RAW else at
            continue
        if tag in VOID or attrs.endswith("/") and tag not in CLOSES_P | {"a", "span", "div"}:
            continue
        open_.make_room(tag)
        found = _attributes(attrs)
        is_main = tag in MAIN_TAGS or found.get("role", "").lower() in MAIN_ROLES
        hint = _hint(tag, found, open_.main > 0 or is_main)
        open_.push(tag, _never(tag, found), is_main and not hint, hint)
    flush()
    return out


def _decide(b: Block, stops: frozenset[str]) -> int:
    """First pass: a block by itself."""
    words = b.text.split()
    density = sum(w.strip(".,;:!?\"'()").lower() in stops for w in words) / len(words)
    links = b.link_chars / max(1, len(b.text) - len(words) + 1)
    if links > LINKED:
        return OPEN if b.main else BAD
    if b.heading:
        return OPEN
    if len(words) >= LONG and density >= LONG_STOPS or len(words) >= MIDDLE and density >= MIDDLE_STOPS:
        return GOOD
    return BAD if len(words) >= LONG and density < LONG_STOPS / 4 and links > LINKED / 2 else OPEN


def classify(blocks: list[Block], stops: frozenset[str] = STOPS) -> list[Block]:
    """Label every block.

    First each by itself: links, stop words and length decide long blocks. Hints of elements, roles and class words turn a block down, but not where hinted
    blocks hold more text than all others. A marked article turns down blocks outside it if it has text; without a mark, a block of text whose
    container holds a SMALL part of what the fullest one does is open again, and where no block is text, the fullest containers are. Then open blocks inherit (``_inherit``).
    """
    for b in blocks:
        b.label = _decide(b, stops)
    size = lambda own: sum(len(b.text) for b in own)
    plain = [b for b in blocks if not b.hints and b.label != BAD]
    heeded = any(b.label == GOOD or b.main and not b.heading for b in plain) or size(plain) >= size(b for b in blocks if b.hints and b.label == GOOD)
    for b in blocks:
        if heeded and b.hints:
            b.label = BAD
    inside = [b for b in blocks if b.main and b.label != BAD]
    good = [b for b in inside if b.label == GOOD]
    marked = bool(good) or bool(inside) and size(inside) >= size(b for b in blocks if b.label == GOOD)
    if marked:
        for b in blocks:
            b.label = BAD if not b.main else b.label if good else b.label or GOOD
    else:
        held: dict[int, int] = {}
        for b in blocks:
            if b.label != BAD:
                held[b.container] = held.get(b.container, 0) + len(b.text)
        fullest = max(held.values(), default=0)
        for b in blocks:
            if b.label == GOOD and held[b.container] < SMALL * fullest:
                b.label = OPEN
        if not any(b.label == GOOD for b in blocks):
            for b in blocks:
                if b.label == OPEN and 3 * held[b.container] >= fullest:
                    b.label = GOOD
    _inherit(blocks, marked)
    return blocks


def _inherit(blocks: list[Block], marked: bool) -> None:
    """Second pass: open blocks take a label from the nearest decided neighbours.

    Between two of text a block is text. A heading has the label of the next one. At the margins a block in the container of its neighbour
    of text is text too; another one takes the nearer label, where a page without a marked article ends in one that isn't text, and text in another container counts
    as APART places further.
    """
    n = len(blocks)
    before, after = [-1] * n, [n] * n
    for k in range(1, n):
        before[k] = k - 1 if blocks[k - 1].label else before[k - 1]
    for k in range(n - 2, -1, -1):
        after[k] = k + 1 if blocks[k + 1].label else after[k + 1]
    decided = [b.label for b in blocks]
    for k, b in enumerate(blocks):
        if decided[k]:
            continue
        sides = [(abs(j - k), decided[j] if 0 <= j < n else BAD, j) for j in (before[k], after[k]) if not marked or 0 <= j < n]
        text = [s for s in sides if s[1] == GOOD]
        if len(text) == len(sides):
            b.label = GOOD
        elif b.heading and (not marked or after[k] < n):
            b.label = sides[-1][1]
        elif not text:
            b.label = BAD
        else:
            same = blocks[text[0][2]].container == b.container
            other = min(s[0] for s in sides if s[1] == BAD)
            b.label = GOOD if marked and text[0][0] <= other or same or text[0][0] + APART < other else BAD


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in classify(blocks_of(page or "")) if b.label == GOOD)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars. No shuffle.

    A null or empty page, and one without text outside tags, gives an empty text. Rows that repeat give
    the same row each; an empty table gives none. A very long page takes time and memory in proportion to its length.
    Columns beyond page_id, url and html are not read.
    """

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    p = pages
    rows = p.select(p["page_id"].cast("long").alias("page_id"), p["url"].alias("url"), p["html"].alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
