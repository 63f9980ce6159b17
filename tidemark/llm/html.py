"""Main text of web pages by tag-path ratios.

1. A page becomes blocks of text; each has the path of its block-level tags from the root.
2. Text length and punctuation are summed for each path and divided by the number of its blocks. Both ratios are
   smoothed along the page with a Gaussian and fused (their product). Paths whose mean fused value reaches SHARE
   of the page's length-weighted mean are content paths.
3. The smallest element that holds the blocks of content paths, widened to the article or main element around it,
   is the holder. Of its blocks those of content paths stay, so do headings and runs of at most GAP other blocks
   between two that stay. Where the page names the holder as its article or main element, paths need WEAK of the
   mean only. Blocks that tags, roles or class names give as menus, headers, footers, sidebars, notices, adverts,
   forms or reader comments, which can be as long as the article, are left out before.
4. A class name or id gives nothing away where it says what a wrapper has or lacks (has-sidebar, no-ads), or where
   its element holds the main element, the article, the h1 or most of the content paths' text. Where a name is no
   more than such words (comments), the article or h1 must come with most of that text. Where all blocks would go,
   the elements with most of that text stay.

Defined results: a null or empty page, or one without any text, gives the empty text. Character references are
decoded once; white space inside a block becomes one space; blocks are joined by one space in page order. An
unclosed comment, script or style runs to the end of the page. Repeated rows give repeated results, an empty table none.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.session import extended, share_package

#: Share of the page's weighted mean that a path's fused ratio must reach.
SHARE = 0.1
#: The same inside an article or main element.
WEAK = 0.01
#: Other blocks in a row that stay between content.
GAP = 3
SIGMA = 1.0
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
# Tags whose content is no markup, or no text of the page.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template iframe title textarea svg math".split()}
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

# HTML's own tag names.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav header footer aside form button select option label fieldset legend dialog menu head object audio video canvas".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_LISTS = frozenset("ul ol dl table select menu".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class names, ids and roles that name what is not the article.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation navigate menu menubar breadcrumb breadcrumbs "
    "sidebar aside complementary footer contentinfo masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social comment comments commentlist disqus respond replies related recommended recommendations widget pagination pager search".split()
)
#: Before such a word, what a wrapper has or lacks; not what it is.
_HAS = frozenset("has have with without no not".split())
#: Names of readers' comments, which can be longer than the article.
_REPLIES = frozenset("comment comments commentlist disqus respond replies".split())
_WHOLE = frozenset(("header", "site-header", "page-header", "siteheader", "pageheader", "banner", "site-notice"))


@dataclass
class Element:
    tag: str
    parent: "Element | None"
    path: int
    aside: bool
    depth: int
    form: "Element | None" = None
    holds_article: bool = False
    #: 1 where a class name or id has a word of _NAMES, 2 where it is no more than that
    named: int = 0
    #: elements around it, and it, that such a name marks
    marks: int = 0


@dataclass
class Block:
    text: str
    at: Element


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    elements: list[Element] = field(default_factory=list)
    paths: dict[tuple[int, str], int] = field(default_factory=dict)


def _named(part: str) -> int:
    """Whether a class name or id is a word of _NAMES (2), or has one (1) that does not follow a word of _HAS."""
    if part.lower() in _WHOLE:
        return 2
    words = _WORD.findall(_CAMEL.sub(" ", part).lower())
    if _NAMES.isdisjoint(words) or not _HAS.isdisjoint(words[:-1]):
        return 0
    return 2 if _NAMES.issuperset(words) or not _REPLIES.isdisjoint(words) else 1


def _is_aside(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether tag, role or hiding make an element aside, and how far its class names and id do."""
    if tag in _ASIDE and tag != "form":
        return True, 0
    named = 0
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, 0
        if name == "role" and any(_named(part) for part in value.split()):
            return True, 0
        if name in ("class", "id") and tag not in ("html", "body", "main", "article"):
            named = max([named, *(_named(part) for part in value.split())])
    return False, named


def markup(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, attributes) of each piece of markup, in time linear in the page; comments have no tag, a raw element is one piece.

    A tag ends at the first > outside quotes. Once a quote is never closed, tags end at the first > from there on.
    """
    last, quoted, at = page.rfind(">"), True, 0
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", "", ""
            continue
        if at > last:
            return
        found = _TAG.match(page, start)
        if not found:
            if page[at] in "!?/":
                at = page.index(">", at) + 1
                yield start, at, "", "", ""
            continue
        end = found.end()
        while quoted:
            stop = _STOP.search(page, end)
            if stop and stop[0] == ">":
                end = stop.start()
                break
            closed = page.find(stop[0], stop.end()) if stop else -1
            if closed < 0:
                quoted, end = False, found.end()
            else:
                end = closed + 1
        if not quoted:
            end = page.index(">", end)
        at = end + 1
        slash, tag = found[1], found[2].lower()
        if not slash and tag in _RAW:
            closing = _RAW[tag].search(page, at)
            at = closing.end() if closing else len(page)
        yield start, at, slash, tag, page[found.end() : end]


def parse(page: str) -> Page:
    """Blocks in page order, each with the element that holds it."""
    out = Page()
    top = Element("", None, 0, False, 0)
    opened: Counter[str] = Counter()
    held: list[str] = []
    at = 0

    def close() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.blocks.append(Block(text, top))

    def leave(to: Element) -> None:
        nonlocal top
        while top is not to:
            opened[top.tag] -= 1
            top = top.parent

    def pop_to(tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        e = top if any(opened[t] for t in tags) else None
        while e is not None and e.parent is not None and e.tag not in stop:
            if e.tag in tags:
                leave(e.parent)
                return
            e = e.parent

    for start, end, slash, tag, attrs in markup(page):
        if start > at:
            held.append(page[at:start])
        at = end
        if not slash and tag in _RAW:
            if tag not in ("svg", "math"):
                close()
            continue
        if not tag or tag in _INLINE:
            continue
        close()
        if slash:
            if opened[tag]:
                e = top
                while e.tag != tag:
                    e = e.parent
                leave(e.parent)
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            pop_to({"p"}, frozenset(("div", "article", "section", "td", "th", "li", "body", "main", "form", "blockquote", "aside", "nav", "header", "footer")))
        if tag in _SIBLINGS:
            pop_to(_SIBLINGS[tag], _LISTS)
        form = top.form
        if tag in ("article", "main", "h1"):
            f = form
            while f is not None:
                f.holds_article = True
                f = f.parent.form if f.parent else None
        path = out.paths.setdefault((top.path, tag), len(out.paths) + 1)
        aside, named = _is_aside(tag, attrs)
        new = Element(tag, top, path, top.aside or aside, top.depth + 1, form, named=named, marks=top.marks + (named > 0))
        out.elements.append(new)
        if tag == "form":
            new.form = new
        if not attrs.rstrip().endswith("/") or tag in _CLOSES_P:
            top = new
            opened[tag] += 1
    if at < len(page):
        held.append(page[at:])
    close()
    return out


def _in_form(e: Element) -> bool:
    f = e.form
    while f is not None:
        if not f.holds_article:
            return True
        f = f.parent.form if f.parent else None
    return False


def _smoothed(values: list[float]) -> list[float]:
    reach = max(1, math.ceil(2 * SIGMA))
    weights = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k in range(-reach, reach + 1):
            if 0 <= i + k < len(values):
                total += weights[k + reach] * values[i + k]
                weight += weights[k + reach]
        out.append(total / weight)
    return out


def path_ratios(blocks: list[Block]) -> dict[int, float]:
    """For each path its mean smoothed and fused ratio, as a share of the page's mean."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for b in blocks:
        p = b.at.path
        length[p] += len(b.text)
        marks[p] += len(_PUNCTUATION.findall(b.text))
        count[p] += 1
    by_text = _smoothed([length[b.at.path] / count[b.at.path] for b in blocks])
    by_marks = _smoothed([(marks[b.at.path] + 0.5) / count[b.at.path] for b in blocks])
    fused = [a * c for a, c in zip(by_text, by_marks)]
    sums = defaultdict(float)
    for b, f in zip(blocks, fused):
        sums[b.at.path] += f
    chars = sum(len(b.text) for b in blocks)
    mean = sum(f * len(b.text) for f, b in zip(fused, blocks)) / chars
    return {p: s / count[p] / mean for p, s in sums.items()}


def content_paths(blocks: list[Block]) -> set[int]:
    """Paths whose ratio reaches the threshold."""
    return {p for p, ratio in path_ratios(blocks).items() if ratio >= SHARE}


def _held(elements: list[Element], blocks: list[Block]) -> dict[int, int]:
    """Characters of blocks in each element."""
    chars = defaultdict(int)
    for b in blocks:
        chars[id(b.at)] += len(b.text)
    for e in reversed(elements):
        if chars[id(e)]:
            chars[id(e.parent)] += chars[id(e)]
    return chars


def _with_most(elements: list[Element], blocks: list[Block]) -> set[int]:
    """Elements that hold more than half of the content paths' text."""
    chosen = content_paths(blocks) if blocks else ()
    content = [b for b in blocks if b.at.path in chosen]
    half = sum(len(b.text) for b in content) / 2
    return {e for e, n in _held(elements, content).items() if n > half}


def _below(elements: list[Element], top: Callable[[Element], bool]) -> set[int]:
    """Elements for which top holds, and all in them; parents come before their children."""
    out: set[int] = set()
    for e in elements:
        if id(e.parent) in out or top(e):
            out.add(id(e))
    return out


def _judge_names(page: Page) -> None:
    """Drop the names of elements that hold the article; what the others hold is aside."""
    elements = page.elements
    if not any(e.named for e in elements):
        return
    blocks = [b for b in page.blocks if not b.at.aside and not _in_form(b.at)]
    marked = [e for e in elements if e.named and not e.aside]
    found = {t: [e for e in elements if e.tag == t and not e.aside] for t in ("main", "article", "h1")}
    kind = next((t for t in found if found[t]), None)
    best, around = None, set()
    if kind:
        chars = _held(elements, blocks)
        e = best = min(found[kind], key=lambda e: (e.marks, -chars[id(e)]))
        while e is not None:
            around.add(id(e))
            e = e.parent
    holders = [e for e in marked if id(e) in around]
    most = _with_most(elements, blocks) if any(e.named == 2 for e in holders) and kind != "main" else set()
    for e in holders:
        if kind == "main" or e.named == 1 or id(e) in most:
            e.named = 0
    if any(e.named == 1 for e in marked):
        # whole names, and what is beside the main element or the article, are not the article, however long
        out = _below(elements, lambda e: e.named == 2)
        most = _with_most(elements, [b for b in blocks if id(b.at) not in out])
        if kind in ("main", "article"):
            most &= _below(elements, lambda e: e is best)
        for e in marked:
            if e.named == 1 and id(e) in most:
                e.named = 0
    out = _below(elements, lambda e: e.named > 0)
    if all(id(b.at) in out for b in blocks):
        most = _with_most(elements, blocks)
        for e in marked:
            if id(e) in most:
                e.named = 0
    for e in elements:
        e.aside = e.aside or e.named > 0 or e.parent.aside


def main_text(page: str | None) -> str:
    if not page:
        return ""
    parsed = parse(page)
    _judge_names(parsed)
    blocks = [b for b in parsed.blocks if not b.at.aside and not _in_form(b.at)]
    if not blocks:
        return ""
    ratios = path_ratios(blocks)
    content = [b for b in blocks if ratios[b.at.path] >= SHARE]
    chars, every = _held(parsed.elements, content), sum(len(b.text) for b in content)
    # the elements that hold all content stand in each other, the smallest one last
    holder = next((e for e in reversed(parsed.elements) if chars[id(e)] == every), None)
    e = holder
    while e is not None:
        if e.tag in ("article", "main"):
            holder = e
        e = e.parent
    if holder is not None and holder.tag in ("p", *_HEADINGS):
        holder = holder.parent
    if holder is not None and holder.parent is not None:
        inside = _below(parsed.elements, lambda e: e is holder)
        blocks = [b for b in blocks if id(b.at) in inside]
    least = WEAK if holder is not None and holder.tag in ("article", "main") else SHARE
    return " ".join(b.text for b in _chosen(blocks, [ratios[b.at.path] >= least for b in blocks]))


def _chosen(blocks: list[Block], good: list[bool]) -> Iterator[Block]:
    """Good blocks, headings, and runs of at most GAP others between good ones."""
    waiting: list[Block] = []
    begun = False
    for b, fine in zip(blocks, good):
        if fine:
            yield from waiting if begun and len(waiting) <= GAP else (w for w in waiting if w.at.tag in _HEADINGS)
            yield b
            waiting, begun = [], True
        else:
            waiting.append(b)
    yield from (w for w in waiting if w.at.tag in _HEADINGS)


def extract(pages: DataFrame, keep: list[str], markup: str = "html") -> DataFrame:
    """keep, text and n_chars for each row; a map without a shuffle."""
    share_package(pages.sparkSession)
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(markup).alias("__html"))
    schema = extended(source.schema.fields[:-1], "text string, n_chars bigint")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            texts = [main_text(column[i].as_py()) for i in range(batch.num_rows)]
            arrays = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=names)

    return source.mapInArrow(run, schema)
