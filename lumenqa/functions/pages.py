"""Pages to Markdown: a tokenizer that goes over a page once."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: characters that are kept of a title.
TITLE = 256
_SILENT = {"script", "style", "template", "noscript", "head"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tr", "ul", *(f"h{i}" for i in range(1, 7))}
_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Reader(HTMLParser):
    """Keeps counters of what is open, so an end tag costs no search."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.line: list[str] = []
        self.silent = self.depth = self.pre = 0
        self.lists: list[list] = []
        self.links: list[str | None] = []
        self.prefix = ""
        self.cells = 0

    def _end_line(self) -> None:
        text = "".join(self.line)
        if not self.pre:
            text = " ".join(text.split())
        if text.strip():
            self.out.append(self.prefix + (text if self.pre else text.strip()))
            self.prefix = ""
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        if self.silent:
            return
        if tag in _BLOCKS or tag == "br":
            self._end_line()
        if tag[0] == "h" and tag[1:].isdigit() and tag in _BLOCKS:
            self.prefix = "#" * int(tag[1:]) + " "
        elif tag in ("ul", "ol"):
            self.lists.append([tag == "ol", 0])
        elif tag == "li":
            self.lists[-1:] = [[self.lists[-1][0], self.lists[-1][1] + 1]] if self.lists else []
            ordered, n = self.lists[-1] if self.lists else (False, 0)
            self.prefix = "  " * max(0, len(self.lists) - 1) + (f"{n}. " if ordered else "- ")
        elif tag == "blockquote":
            self.prefix = "> "
        elif tag == "pre":
            self.pre += 1
        elif tag == "tr":
            self.cells = 0
        elif tag in ("td", "th"):
            self.line.append("| " if not self.cells else " | ")
            self.cells += 1
        elif tag == "a":
            href = dict(attrs).get("href")
            self.links.append(href)
            if href:
                self.line.append("[")
        elif tag == "img" and (alt := dict(attrs).get("alt")):
            self.line.append(f"![{alt}]({dict(attrs).get('src') or ''})")
        elif tag in _MARKS:
            self.line.append(_MARKS[tag])

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
            return
        if self.silent:
            return
        if tag == "a" and self.links:
            if href := self.links.pop():
                self.line.append(f"]({href})")
        elif tag in _MARKS:
            self.line.append(_MARKS[tag])
        elif tag == "tr" and self.cells:
            self.line.append(" |")
            self.cells = 0
        if tag in _BLOCKS:
            self._end_line()
            self.prefix = ""
        if tag == "pre":
            self.pre = max(0, self.pre - 1)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()

    def handle_data(self, data):
        if not self.silent:
            self.line.append(data)


def markdown(html: str | None) -> str:
    """Headings, lists, links, quotes, tables and emphasis of a page as Markdown, one block a line; scripts, styles and the head are gone. Empty for null."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader._end_line()
    return "\n\n".join(reader.out)


@F.pandas_udf(T.StringType())
def page_markdown(html: pd.Series) -> pd.Series:
    return html.map(markdown)


def page_title(html: Column) -> Column:
    """The first title element with its tags, cut to TITLE characters; empty where there is none."""
    return F.substring(F.coalesce(F.regexp_extract(html, r"(?is)<title\b[^>]{0,1000}>.*?</title>", 0), F.lit("")), 1, TITLE)
