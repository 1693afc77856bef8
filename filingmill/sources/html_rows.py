"""Result tables of search pages: rows with a link to a PDF."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text


class _Tables(HTMLParser):
    """Tables as rows of (text, first link) cells, with their classes; tables inside cells stand alone."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list]] = []
        self.open: list[int] = []
        self.cells: list[dict | None] = []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag == "table":
            self.tables.append((given.get("class") or "", []))
            self.open.append(len(self.tables) - 1)
            self.cells.append(None)
        elif self.open and tag == "tr":
            self.tables[self.open[-1]][1].append([])
            self.cells[-1] = None
        elif self.open and tag in ("td", "th"):
            rows = self.tables[self.open[-1]][1] or [[]]
            self.cells[-1] = {"text": "", "href": None, "link": ""}
            rows[-1].append(self.cells[-1])
        elif self.open and tag == "a" and self.cells[-1] is not None and self.cells[-1]["href"] is None:
            self.cells[-1]["href"] = given.get("href")

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
            self.cells.pop()
        elif tag in ("td", "th") and self.cells:
            self.cells[-1] = None

    def handle_data(self, data):
        if self.cells and self.cells[-1] is not None:
            self.cells[-1]["text"] += data


def result_rows(page: str, table_class: str) -> list[tuple[str, str, str]]:
    """(time, title, link) of the rows with three cells and a PDF link: of the first table of the class, else the first with such a link."""
    found = _Tables()
    found.feed(page or "")
    is_pdf = lambda c: c["href"] and c["href"].lower().split("?")[0].endswith(".pdf")
    named = [rows for cls, rows in found.tables if table_class in cls.split()]
    linked = [rows for _, rows in found.tables if any(is_pdf(c) for r in rows for c in r)]
    out = []
    for row in (named or linked or [[]])[0]:
        links = [c for c in row if is_pdf(c)]
        if len(row) >= 3 and links:
            out.append((" ".join(row[0]["text"].split()), " ".join(links[0]["text"].split()), links[0]["href"]))
    return out


def search_results(pages: DataFrame, base: str, table_class: str = "table") -> DataFrame:
    """pages (stock_code, html) -> (stock_code, release_time, title, pdf_url, language, year)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(code, *row) for code, page in zip(batch["stock_code"], batch["html"], strict=True) for row in result_rows(page, table_class)]
            yield pd.DataFrame(rows, columns=["stock_code", "release_time", "title", "href"])

    rows = pages.select("stock_code", "html").mapInPandas(parse, "stock_code string, release_time string, title string, href string")
    url = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace("href", "^/", "")))
    return rows.select("stock_code", "release_time", "title", url.alias("pdf_url"), text.title_language(F.col("title"), url).alias("language"), dates.title_year(F.col("title"), url, F.col("release_time")).alias("year"))


def links(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with `links`: the addresses of its anchors in order, by a pattern alone."""
    return pages.withColumn("links", F.regexp_extract_all(column, F.lit(r'<a href="([^"]*)"'), F.lit(1)))
