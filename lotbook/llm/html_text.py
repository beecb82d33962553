"""Main text of web pages by tag-path ratios.

Text is summed per path from the root of the page to the block that holds it. Each path
has a ratio of text to its number of blocks, fused with its punctuation; ratios are
smoothed over paths in the order of the page, weighed by what the path's elements say
about themselves (menus, adverts, the article), and paths above a share of the best are
content. An article element that holds one of them is content but for its boilerplate. A page is handled by itself in one narrow pass.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A path is content from this share of the page's best score on.
LEAST_SHARE = 0.2
# What a path's elements make of its ratio.
ARTICLE, NEUTRAL, BESIDE_ARTICLE, BOILERPLATE = 1.0, 1.0, 0.1, 0.01

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")

# Elements of plain characters: only their own closing tag is read in them.
RAW = {
    tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
    for tag in "script style title textarea iframe".split()
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page.
SILENT = frozenset(
    "noscript template object svg math canvas audio video map select datalist button".split()
)
# Silent elements that end with an element around them, as HTML ends a button or a datalist,
# and the opening tags that end them. HTML keeps what follows an unclosed one inside; no
# part of a page's frame stands there, so it ends them too.
_FRAME = frozenset("body article main section nav aside header footer form table".split())
_TABLE_PARTS = frozenset("caption tbody tfoot thead tr td th".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SILENT_ENDS = {
    "button": _FRAME | {"button"},
    "select": _FRAME | _TABLE_PARTS | _HEADINGS | {"select", "input", "textarea", "p", "ul", "ol", "dl"},
    "datalist": _FRAME | _TABLE_PARTS | _HEADINGS | {"datalist", "input", "textarea", "p", "ul", "ol", "dl"},
}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr br img input".split()
)
ARTICLE_TAGS = frozenset(["article", "main"])
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
BOILERPLATE_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe "
    "subscription paywall signup login sidebar aside nav navbar navigation menu breadcrumb "
    "breadcrumbs pagination pager share sharing social footer masthead topbar toolbar widget "
    "comment comments commentlist disqus respond replies reply related recommended "
    "recommendations search form contentinfo complementary".split()
)
# "has-sidebar" describes what is inside; "post-header" holds a title.
LAYOUT_HINTS = frozenset("has with no without layout wrapper".split())
HEADING_HINTS = frozenset("article post entry content story text page title".split())
# An opening tag ends these open elements, up to the nearest of the second set.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table "
    "ul".split()
)
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


@dataclass
class Path:
    """Totals of one root-to-block path of a page."""

    weight: float
    # Tag and path of the article element around it.
    article: tuple[str, str] | None
    chars: int = 0
    linked: int = 0
    marks: int = 0
    nodes: int = 0
    score: float = 0.0
    kept: bool = False


@dataclass
class _Open:
    tag: str
    path: str
    article: tuple[str, str] | None
    boilerplate: bool


@dataclass
class Page:
    """Blocks of a page in order, each a path and its text, and the totals of the paths."""

    blocks: list[tuple[str, str]] = field(default_factory=list)
    paths: dict[str, Path] = field(default_factory=dict)


def _describe(tag: str, attributes: str) -> tuple[str, bool]:
    """Label of an element in a path and whether its names mark it as boilerplate."""
    names = []
    if attributes and "=" in attributes:
        for _, a, b, c in _ATTRIBUTE.findall(attributes):
            names += (a or b or c).split()
    hints = {h.lower() for name in names for h in _HINT.findall(name)}
    marked = tag in BOILERPLATE_TAGS
    if tag not in ("html", "body", "main") and not hints & LAYOUT_HINTS:
        marked = marked or bool(hints & BOILERPLATE_HINTS)
        marked = marked or ("header" in hints and not hints & HEADING_HINTS)
    return ".".join([tag, *names]), marked


def read_page(source: str) -> Page:
    """Split markup into blocks. Unclosed and misplaced tags end where HTML ends them."""
    page = Page()
    stack = [_Open("", "", None, False)]
    pieces: list[str] = []
    linked = links = 0
    at, silent, depth = 0, "", 0
    inside: list[str] = []

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            own = next(e for e in reversed(stack) if e.tag not in INLINE)
            page.blocks.append((own.path, text))
            path = page.paths.get(own.path)
            if path is None:
                weight = BOILERPLATE if own.boilerplate else ARTICLE if own.article else NEUTRAL
                path = page.paths[own.path] = Path(weight, own.article)
            path.chars += len(text)
            path.linked += min(linked, len(text))
            path.marks += len(_PUNCTUATION.findall(text))
            path.nodes += 1
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if links:
            linked += len(text)

    def close(to: int) -> None:
        nonlocal links
        for element in stack[to:]:
            links -= element.tag == "a"
        del stack[to:]

    def ends_silence(tag: str, ending: bool) -> bool:
        """Whether a tag ends the silent element before its own closing tag does."""
        if tag == silent and ending:
            return False
        if not ending:
            if tag not in VOID:
                inside.append(tag)
            return tag in _SILENT_ENDS[silent]
        if tag in inside:
            while inside.pop() != tag:
                pass
            return False
        return tag not in INLINE and tag != "p" and any(e.tag == tag for e in stack)

    while token := _TOKEN.search(source, at):
        if not silent and token.start() > at:
            add(source[at : token.start()])
        at = token.end()
        tag = token[2] or token[5]
        if tag is None:
            continue
        tag, ending = tag.lower(), bool(token[1] or token[4])
        attributes = token[3] or token[6] or ""
        if silent in _SILENT_ENDS and ends_silence(tag, ending):
            silent = ""
        if tag in RAW:
            if not ending and not attributes.endswith("/"):
                end = RAW[tag].search(source, at)
                at = end.end() if end else len(source)
            continue
        if silent:
            # Only the same element ends silence.
            if tag == silent:
                depth += -1 if ending else 1
                silent = silent if depth else ""
            continue
        if tag in SILENT:
            if not ending and not attributes.endswith("/"):
                silent, depth = tag, 1
                inside.clear()
            continue
        if tag == "head":
            # Its tags may be left out, and all it can hold is silent or void.
            continue
        if tag in VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                flush()
            continue
        block = tag not in INLINE
        if block:
            flush()
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if not block and stack[i].tag not in INLINE:
                    break
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in _ENDS:
            ends, limits = _ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in limits:
                    break
                if stack[i].tag in ends:
                    close(i)
                    break
        above = stack[-1]
        if block:
            label, marked = _describe(tag, attributes)
            # An article's own header belongs to it.
            marked = marked and not (label.startswith("header") and above.article)
            boilerplate = above.boilerplate or marked
            base = next(e for e in reversed(stack) if e.tag not in INLINE)
            path = f"{base.path}/{label}"
            article = (tag, path) if tag in ARTICLE_TAGS else above.article
            stack.append(_Open(tag, path, article, boilerplate))
        else:
            links += tag == "a"
            stack.append(_Open(tag, above.path, above.article, above.boilerplate))
    if not silent:
        add(source[at:])
    flush()
    return page


def score_paths(paths: dict[str, Path], least_share: float = LEAST_SHARE) -> None:
    """Fused, smoothed and weighed ratio of each path, and whether it is content."""
    if not paths:
        return
    own = list(paths.values())
    raw = np.array(
        [
            math.log1p(p.chars / p.nodes)
            * (1 + min(1.0, p.marks / p.nodes / 10))
            * (1 - 0.9 * p.linked / p.chars)
            for p in own
        ]
    )
    padded = np.r_[raw[:1], raw, raw[-1:]]
    smooth = 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]
    has_article = any(p.article and p.weight > BOILERPLATE for p in own)
    for p, value in zip(own, smooth, strict=True):
        beside = has_article and not p.article
        p.score = float(value) * (min(p.weight, BESIDE_ARTICLE) if beside else p.weight)
    best = max((p.score for p in own if p.weight > BOILERPLATE), default=0.0)
    for p in own:
        p.kept = p.weight > BOILERPLATE and p.score >= least_share * best
    chosen = {p.article for p in own if p.kept and p.article}
    # A main element around a chosen article is the page's frame: its ratios decide.
    around = {path[: at.start()] for _, path in chosen for at in re.finditer("/", path)}
    whole = {a for a in chosen if a[0] == "article" or a[1] not in around}
    for p in own:
        p.kept = p.kept or (p.weight > BOILERPLATE and p.article in whole)


def main_text(source: str | None, least_share: float = LEAST_SHARE) -> tuple[str, int, int]:
    """Content blocks joined by line feeds, and how many paths of how many were content."""
    if not isinstance(source, str) or not source:
        return "", 0, 0
    page = read_page(source)
    score_paths(page.paths, least_share)
    text = "\n".join(t for path, t in page.blocks if page.paths[path].kept)
    return text, sum(p.kept for p in page.paths.values()), len(page.paths)


def extract_pages(pages: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """All columns of ``pages`` and the struct ``_main`` (text, n_chars, paths kept and seen).

    A null, empty or markup-only page has an empty text. Very long pages are read whole,
    repeated rows give the same text, and no other column is read.
    """

    @F.pandas_udf("text string, n_chars long, kept_paths int, paths int")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [main_text(source, least_share) for source in batch]
            yield pd.DataFrame(
                {
                    "text": [r[0] for r in rows],
                    "n_chars": [len(r[0]) for r in rows],
                    "kept_paths": [r[1] for r in rows],
                    "paths": [r[2] for r in rows],
                }
            )

    return pages.withColumn("_main", extract(F.col("html")))
