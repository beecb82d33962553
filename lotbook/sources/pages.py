"""Saved web pages, and the one step that leaves the JVM: markup to element rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = (
    "page_id bigint, seq int, parent int, kind string, block int, row int, cell int, "
    "classes string, via string, box int, content int, text string, extra string, tail string"
)
# Kind of the one row of a page that cannot be read.
ERROR = "error"
_COLUMNS = [part.split()[0] for part in ELEMENTS.split(", ")]
_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
_ARROW_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, ELEMENTS.split(", "))])

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
_PLAIN = {"span", "strong", "p", "a", "h1", "h4", "h5", "li"}
_BOXES = {"ibox", "ibox-content", "ibox-heading", "col-6", "col"}
_SILENT = {"script", "style"}

# A plain tag with the text behind it: quoted values without references. Where a page holds
# nothing else, the standard parser's events can be told from these matches.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][a-zA-Z0-9]*)"
    r"((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9]*=(?:\"[^\"&<>]*\"|'[^'&<>]*'))*)[ \t\n\r\f]*(/?)>([^<]*)"
)
_VALUE = re.compile(r"([a-zA-Z][-a-zA-Z0-9]*)=(?:\"([^\"]*)\"|'([^']*)')")
# Elements whose content the standard parser reads in another way.
_RAW = {
    "script", "style", "textarea", "title", "plaintext", "xmp", "iframe", "noembed", "noframes",
    "noscript", "svg", "math",
}


def _plain_tags(markup: str) -> list[tuple] | None:
    """Matches of ``_TAG`` that make up the whole markup behind its leading text, else None."""
    at = markup.find("<")
    tags = []
    for found in _TAG.finditer(markup, max(at, 0)):
        tag = found.groups()
        closing, name, values, empty, _ = tag
        if found.start() != at or name.lower() in _RAW or (closing and (values or empty)):
            return None
        at = found.end()
        tags.append(tag)
    return tags if at in (-1, len(markup)) else None


class _Elements(HTMLParser):
    """Collects the elements the extraction rules look at, with their text.

    One pass over the page. An end tag closes up to its most recent open tag, and
    whatever is open at the end counts as closed there.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.done: list[dict] = []
        self.seq = self.tables = self.lists = 0
        self.after_strong: dict | None = None

    def nearest(self, test) -> dict | None:
        return next((n for n in reversed(self.open) if test(n)), None)

    def handle_starttag(self, tag, attrs):
        classes = (dict(attrs).get("class") or "").split() if attrs else []
        up = self.open[-1] if self.open else None
        self.seq += 1
        node = dict(
            tag=tag, seq=self.seq, parent=up["seq"] if up else 0, classes=classes,
            kind=None, block=-1, row=-1, cell=-1, via="", strings=[], tail="", extra=None, counts={},
        )
        # Enclosing boxes are inherited: what encloses the parent, or the parent itself.
        for name, mark in (("box", "ibox"), ("content", "ibox-content")):
            inside = up is not None and mark in up["classes"]
            node[name] = up["seq"] if inside else up[name] if up else -1
        self.place(node, up)
        if up is not None:
            strong = up.pop("last_strong", None)
            if strong is not None:
                node["names"] = strong
            if tag == "strong":
                up["last_strong"] = node
        self.after_strong = None
        if tag in _VOID:
            self.end(node)
        else:
            self.open.append(node)

    def place(self, node, up):
        tag = node["tag"]
        if tag == "table":
            self.tables += 1
            node["block"] = self.tables
        elif tag == "dl":
            self.lists += 1
            node["block"] = self.lists
        elif tag == "tr" and up is not None:
            table = up if up["tag"] == "table" else self.nearest(lambda n: n["tag"] == "table")
            if table is not None and up["tag"] in ("table", "tbody", "thead", "tfoot"):
                node.update(kind="tr", block=table["block"], via=up["tag"])
                node["row"] = self.count(table, up["tag"])
        elif tag in ("td", "th") and up is not None and up["kind"] == "tr":
            node.update(kind=tag, block=up["block"], row=up["row"], via=up["via"])
            node["cell"] = self.count(up, "cells")
        elif tag in ("dt", "dd"):
            owner = self.nearest(lambda n: n["tag"] == "dl")
            node.update(kind=tag, block=owner["block"] if owner else -1)
            if owner is not None:
                node["cell"] = self.count(owner, tag)
        elif tag in _PLAIN or tag == "hr" or (tag == "div" and _BOXES & set(node["classes"])):
            node["kind"] = tag

    @staticmethod
    def count(owner, what):
        owner["counts"][what] = owner["counts"].get(what, -1) + 1
        return owner["counts"][what]

    def handle_endtag(self, tag):
        here = self.open and self.open[-1]["tag"] == tag
        if here or any(n["tag"] == tag for n in self.open):
            while True:
                node = self.open.pop()
                self.end(node)
                if node["tag"] == tag:
                    break
            self.after_strong = node if tag == "strong" else None

    def handle_data(self, data):
        if self.open and self.open[-1]["tag"] in _SILENT:
            return
        text = data.strip()
        if self.after_strong is not None:
            self.after_strong["tail"] = text
            self.after_strong = None
        if text:
            for node in self.open:
                if node["kind"] or "names" in node:
                    node["strings"].append(text)

    def end(self, node):
        node["text"] = " ".join(node["strings"])
        if "names" in node:
            node["names"]["extra"] = node["text"]
        if node["kind"] == "a":
            dd = self.nearest(lambda n: n["kind"] == "dd")
            if dd is not None and dd["extra"] is None:
                dd["extra"] = node["text"]
        if node["kind"]:
            self.done.append(node)

    def feed_plain(self, markup: str, tags: list[tuple]) -> None:
        """The events that ``feed`` and ``close`` would give for plain markup."""
        lead = markup[: markup.find("<")] if tags else markup
        if lead:
            self.handle_data(unescape(lead))
        for closing, name, values, empty, text in tags:
            name = name.lower()
            if closing:
                self.handle_endtag(name)
            else:
                attrs = [(n.lower(), a or b) for n, a, b in _VALUE.findall(values)] if values else []
                self.handle_starttag(name, attrs)
                if empty:
                    self.handle_endtag(name)
            if text:
                self.handle_data(unescape(text) if "&" in text else text)

    def finish(self, markup: str) -> list[dict]:
        tags = _plain_tags(markup)
        if tags is not None:
            self.feed_plain(markup, tags)
        else:
            self.feed(markup)
            self.close()
        while self.open:
            self.end(self.open.pop())
        return self.done


# Pages whose rows are handed on together.
_PAGES_AT_ONCE = 200


def _element_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for pages in batches:
        for first in range(0, len(pages), _PAGES_AT_ONCE):
            part, rows = pages.slice(first, _PAGES_AT_ONCE), []
            for page_id, markup in zip(part["page_id"].to_pylist(), part["html"].to_pylist()):
                try:
                    found = _Elements().finish(markup or "")
                except (AssertionError, ValueError) as error:
                    # The parser gives up on some markup: that page is one error row.
                    rows.append(_error_row(page_id, error))
                    continue
                for n in found:
                    rows.append(
                        (
                            page_id, n["seq"], n["parent"], n["kind"], n["block"], n["row"],
                            n["cell"], " ".join(n["classes"]), n["via"], n["box"], n["content"],
                            n["text"], n["extra"], n["tail"],
                        )
                    )
            columns = zip(*rows) if rows else [[] for _ in _COLUMNS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ARROW_SCHEMA)], schema=_ARROW_SCHEMA
            )


def _error_row(page_id, error: Exception) -> tuple:
    values = {"page_id": page_id, "seq": 0, "kind": ERROR, "text": str(error) or "unreadable"}
    return tuple(values.get(name) for name in _COLUMNS)


def page_errors(elements: DataFrame) -> DataFrame:
    """``page_id, error`` of the pages that could not be read."""
    return elements.where(F.col("kind") == ERROR).select("page_id", F.col("text").alias("error"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, html`` from a page table."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def page_elements(pages: DataFrame) -> DataFrame:
    """Element rows of whole pages.

    Rule sets read these rows many times, each time other kinds. Write them first
    (``write_elements``) or checkpoint them, so that pages are parsed once.
    """
    return pages.select("page_id", "html").mapInArrow(_element_rows, ELEMENTS)


def write_elements(elements: DataFrame, path: str) -> None:
    """Element rows by kind: a rule set's scan is pruned to the kinds it asks for."""
    elements.write.mode("overwrite").partitionBy("kind").parquet(path)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ELEMENTS).option("basePath", path).parquet(path)
