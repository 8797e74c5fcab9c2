"""Page texts of HTML: breaks from CSS, hidden content left out, a line for each table row, unclosed tags tolerated."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SKIP = {"script", "style", "head", "noscript", "template", "ix:header"}
BLOCK = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "tr", "blockquote", "br", "hr", "header", "footer", "main", "nav", "pre"}


class _Pages(HTMLParser):
    """line: what the line being read holds so far; cells: those of the table row being read, None outside of rows; stack:
    the tags that are open, with whether they are hidden and whether a page ends after them."""

    def __init__(self, **options) -> None:
        self.line, self.cells = [], None
        self.stack, self.pages = [], [[]]
        super().__init__(**options)

    def _end_line(self) -> None:
        text = re.sub(r"[ \t\r\n\f\xa0]+", " ", "".join(self.line).replace("​", "")).strip()
        text = re.sub(r"\$ (?=[0-9(])", "$", text)
        self.line = []
        if self.cells is not None:
            if text:
                self.cells.append(text)
        elif text:
            self.pages[-1].append(text)

    def _break(self) -> None:
        self._end_line()
        if self.pages[-1]:
            self.pages.append([])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        style = re.sub(r"\s", "", (dict(attrs).get("style") or "").lower())
        hidden = tag in SKIP or "display:none" in style or (bool(self.stack) and self.stack[-1][1])
        after = "page-break-after:always" in style or "break-after:page" in style
        if not hidden and ("page-break-before:always" in style or "break-before:page" in style):
            self._break()
        if tag == "tr":
            self._end_line()
            self.cells = []
        elif tag in ("td", "th") or (tag in BLOCK and self.cells is None):
            self._end_line()
        if tag in VOID:
            if after and not hidden:
                self._break()
            return
        self.stack.append((tag, hidden, after))

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == tag), None)
        if at is None:
            return
        closed, self.stack = self.stack[at:], self.stack[:at]
        if tag in ("td", "th") or (tag in BLOCK and tag != "tr" and self.cells is None):
            self._end_line()
        if tag == "tr" and self.cells is not None:
            self._end_line()
            row, self.cells = re.sub(r"\$ (?=[0-9(])", "$", " ".join(self.cells)), None
            if row:
                self.pages[-1].append(row)
        if any(after and not hidden for _, hidden, after in closed):
            self._break()

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][1]):
            self.line.append(data)


def html_pages(html: str | None) -> list[str]:
    parser = _Pages(convert_charrefs=True)
    parser.feed(html or "")
    parser.close()
    parser._end_line()
    return ["\n".join(p) for p in parser.pages if p]


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, page (from 1) and text of (page_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, t) for i, h in zip(b["page_id"], b["html"], strict=True) for k, t in enumerate(html_pages(h), 1)]
            yield pd.DataFrame(rows, columns=["page_id", "page", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, page int, text string")


FACTS = ("EntityRegistrantName", "DocumentType", "DocumentFiscalYearFocus", "TradingSymbol")
ENTITIES = (("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def xbrl_facts(page: Column) -> Column:
    """The cover facts of an inline filing, by name: tags stripped, common entities decoded, white space as one blank."""

    def fact(name: str) -> Column:
        text = F.regexp_replace(F.regexp_extract(page, rf'(?s)<ix:\w+[^>]*name="dei:{name}"[^>]*>(.*?)</ix:', 1), "<[^>]*>", " ")
        for entity, sign in ENTITIES:
            text = F.replace(text, F.lit(entity), F.lit(sign))
        return F.trim(F.regexp_replace(text, r"\s+", " "))

    return F.map_from_arrays(F.array(*map(F.lit, FACTS)), F.array(*map(fact, FACTS)))
