"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line's weight is the length of its text outside links; lines
in menus, headers, footers, side bars, notices, adverts, forms and reader comments (by element, role or class) weigh
nothing and never count as text. Weights are summed over sliding windows of WINDOW lines. A run of text surges where a
sum reaches SURGE and dives where the sums fall to DIVE; it begins with the unlinked lines and headings right before its
surge. All runs together are the main text, so that a list of links divides an article but ends none. Where a page names its
article or main element, that bounds the runs, and its lines weigh ARTICLE times as much.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.llm.common import fresh, text_slices

WINDOW, SURGE, DIVE, ARTICLE = 3, 80, 0, 4

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_CLOSE: dict[str, re.Pattern] = {}
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes", "noembed", "svg", "math", "object", "canvas", "audio", "video"}
_DROP = {"nav", "footer", "aside", "form", "head", "button", "select", "dialog", "menu", "fieldset", "label", "datalist", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
_BOILER = re.compile(
    r"(?:^|[\s_-])(?!(?:has|with|no|without)-)(?:ads?|adv|advert\w*|adslot|adbox|sponsor\w*|promo\w*|banner\w*|cookies?\w*|consent|notices?|gdpr|newsletters?|subscri\w*|signup|side-?bars?|navs?|navbar|navigation|menus?|breadcrumbs?"
    r"|footers?|site-?header|page-?header|masthead|topbar|comments?|commentlist|respond|replies|reply|disqus|related\w*|recommend\w*|shar(?:e|ing)|social|widgets?|popups?|modal|overlay|login|search\w*|pagination|pager|toolbar|skip|legal|copyright|toc|metabar|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
_REMARKS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|respond|replies|reply|disqus)(?:$|[\s_-])", re.I)
_HAS = re.compile(r"\b(?:has|with|no|without)-[\w-]+", re.I)
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BODY = re.compile(r"articlebody", re.I)


@dataclass
class Line:
    text: str
    linked: int  # characters of it inside links
    dropped: bool
    article: int  # number of the article or main element around it; 0: none
    heading: bool


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /") else {}


def _pieces(page: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(kind, name, attributes, text, end) in order: text, plain text, open and close. Each character is looked at a bounded
    number of times: a mark that has no end ends the search for such marks.

    A quoted value may hold ">". Where a tag's quotes leave it without an end, tags end at the first ">" from there on.
    """
    at, n, quotes = 0, len(page), True
    while at < n:
        i = page.find("<", at)
        if i < 0:
            yield "text", "", "", page[at:], n
            return
        if i > at:
            yield "text", "", "", page[at:i], i
        mark = page[i + 1 : i + 2]
        if mark in ("!", "?"):
            if page.startswith("<!--", i):
                j = page.find("-->", i + 2)
                at = n if j < 0 else j + 3
            elif page.startswith("<![CDATA[", i) and (j := page.find("]]>", i + 9)) >= 0:
                yield "plain", "", "", page[i + 9 : j], j + 3
                at = j + 3
            else:
                j = page.find(">", i)
                at = n if j < 0 else j + 1
            continue
        m = _TAG.match(page, i) if quotes else None
        if m is not None:
            name, rest, end, closes = m[2], m[3], m.end(), m[1]
        else:
            head = _NAME.match(page, i)
            if head is None:  # no tag: the character itself
                yield "text", "", "", "<", i + 1
                at = i + 1
                continue
            quotes = False
            j = page.find(">", i)
            if j < 0:
                yield "text", "", "", page[i:], n
                return
            name, rest, end, closes = page[i + 1 + len(head[1]) : min(head.end(), j)], page[min(head.end(), j) : j], j + 1, head[1]
        yield "close" if closes else "open", name.lower(), rest, "", end
        tag = name.lower()
        if not closes and tag in _RAW and not (rest.endswith("/") and tag in ("svg", "math")):
            found = _CLOSE.setdefault(tag, re.compile(rf"</{re.escape(tag)}\s*+>", re.I)).search(page, end)
            end = found.end() if found else n
        at = end


@dataclass(slots=True)
class State:
    dropped: bool
    article: int
    link: bool
    fixed: bool  # within an element that is never main text


def lines(page: str) -> list[Line]:
    """The page's blocks in order. Elements left open end with the element around them."""
    out: list[Line] = []
    stack: list[tuple[str, State]] = []
    opened: dict[str, int] = {}
    pieces: list[str] = []
    linked = articles = 0
    outside = state = State(False, 0, False, False)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            out.append(Line(text, min(linked, len(text)), state.dropped, state.article, any(t in _HEADINGS for t, _ in stack[-4:])))
        pieces.clear()
        linked = 0

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    for kind, tag, rest, raw, _ in _pieces(page):
        if raw:
            text = raw if kind == "plain" else unescape(raw)
            pieces.append(text)
            if state.link:
                linked += len(text.strip())
            continue
        if tag not in _INLINE:
            flush()
        if kind == "close":
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag in _RAW or tag in _VOID:
            continue
        else:
            own = _attributes(rest)
            marks = _HAS.sub(" ", f"{own.get('class', '')} {own.get('id', '')}")
            dropped, article, role, name = state.dropped, state.article, own.get("role", "").lower(), own.get("itemprop", "")
            if tag in ("article", "main") or role == "main" or _BODY.search(name):
                dropped = state.fixed or _REMARKS.search(marks) is not None or (dropped and article > 0)
                if not dropped and not article:
                    articles += 1
                    article = articles
            elif tag not in ("html", "body"):
                dropped = dropped or tag in _DROP or role in _ROLES or (tag == "header" and not article) or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower() or _BOILER.search(marks) is not None
            if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                pop()
            stack.append((tag, State(dropped, article, state.link or tag == "a", state.fixed or tag in _DROP)))
            opened[tag] = opened.get(tag, 0) + 1
        state = stack[-1][1] if stack else outside
    flush()
    return out


def runs(found: list[Line]) -> list[Line]:
    """The lines of all runs between surge and dive."""
    weight = [(len(x.text) - x.linked) * (ARTICLE if x.article else 1) for x in found]
    sums = [sum(weight[i : i + WINDOW]) for i in range(len(found))]
    out: list[Line] = []
    i = done = 0
    while i < len(found):
        if sums[i] < SURGE or not weight[i]:
            i += 1
            continue
        start = i
        while start > done and (weight[start - 1] or found[start - 1].heading):
            start -= 1
        while i < len(found) and sums[i] > DIVE:
            i += 1
        out += found[start:i]
        done = i
    return out


def main_lines(all_lines: list[Line]) -> list[Line]:
    """The lines of the runs within the article or main element, else of the page's. Where nothing surges: lines with text
    outside links, of the element, else of the page."""
    own = [x for x in all_lines if not x.dropped]
    bounded = [x for x in own if x.article]
    for found in (bounded, own):
        if out := runs(found) or [x for x in found if len(x.text) > x.linked]:
            return out
    return bounded


def main_text(page: str) -> str:
    return " ".join(x.text for x in main_lines(lines(page)))


def extract(pages: DataFrame, column: str = "html") -> tuple[DataFrame, str]:
    """pages without the html column, with the main text, and the name of that column: text, or _text if pages has one.

    Character references are decoded, white space within a block becomes one space, blocks are joined in order by one.
    Null or empty html, and pages without any text, give an empty text. Rows are independent: repeats and ties give equal
    texts, an empty table gives an empty one.
    """
    (name,) = fresh(pages, "text")
    keep = [c for c in pages.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column):
            made = [main_text(x) for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(made, pa.string())], names=[*keep, name])

    rows = pages.withColumn(column, F.col(column).cast("string"))
    return rows.mapInArrow(run, T.StructType([*[pages.schema[c] for c in keep], T.StructField(name, T.StringType())])), name
