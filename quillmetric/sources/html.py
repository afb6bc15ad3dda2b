"""Stored HTML pages to typed rows: title, language, headings, links, label/value pairs, visible text size.

The parser is the standard library's, run over Arrow batches; each page is one row of work.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = ("page_id bigint, url string, title string, lang string, headings array<string>, links array<string>, "
        "pairs map<string,string>, text_chars bigint")
SKIPPED = {"script", "style", "template", "noscript"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# label tags of definition lists, tried in this order: the first source that gives a value wins
LABEL_VALUE = {"dt": "dd", "th": "td"}


class PageReader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title, self.lang = "", ""
        self.headings: list[str] = []
        self.links: list[str] = []
        self.pairs: dict[str, dict[str, str]] = {k: {} for k in LABEL_VALUE}
        self.chars = 0
        self._open: list[tuple[str, list[str]]] = []
        self._skip = 0
        self._label: dict[str, str] = {}

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        if tag in SKIPPED:
            self._skip += 1
        elif tag == "html":
            self.lang = self.lang or (values.get("lang") or "")
        elif tag == "a" and values.get("href"):
            self.links.append(values["href"])
        if tag == "title" or tag in HEADINGS or tag in LABEL_VALUE or tag in LABEL_VALUE.values():
            self._open.append((tag, []))

    def handle_data(self, data: str) -> None:
        if self._skip:
            return
        if not any(tag == "title" for tag, _ in self._open):
            self.chars += len(data.strip())
        for _, parts in self._open:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self._skip = max(0, self._skip - 1)
            return
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                text = " ".join("".join(self._open.pop(i)[1]).split())
                self._close(tag, text)
                return

    def _close(self, tag: str, text: str) -> None:
        if tag == "title":
            self.title = self.title or text
        elif tag in HEADINGS:
            if text:
                self.headings.append(text)
        elif tag in LABEL_VALUE:
            self._label[tag] = text.lower().rstrip(":").strip()
        else:
            for label, value in LABEL_VALUE.items():
                if value == tag and self._label.get(label):
                    self.pairs[label].setdefault(self._label.pop(label), text)


def read_page(html: str) -> tuple:
    reader = PageReader()
    reader.feed(html or "")
    reader.close()
    pairs: dict[str, str] = {}
    for source in LABEL_VALUE:
        for label, value in reader.pairs[source].items():
            if label and label not in pairs:
                pairs[label] = value
    links = list(dict.fromkeys(reader.links))
    return reader.title, reader.lang, reader.headings, links, pairs, reader.chars


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [read_page(h) for h in frame["html"]]
        out = pd.DataFrame(rows, columns=["title", "lang", "headings", "links", "pairs", "text_chars"])
        out.insert(0, "page_id", frame["page_id"].to_numpy())
        out.insert(1, "url", frame["url"].to_numpy())
        yield out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html to typed page rows; repeated links of a page count once."""
    return pages.select("page_id", "url", "html").mapInPandas(_batches, PAGE)


def merged_pairs(preferred: Column, fallback: Column) -> Column:
    """Label/value pairs where the preferred source wins."""
    return F.map_concat(F.map_filter(fallback, lambda k, _v: ~F.map_contains_key(preferred, k)), preferred)


def host_summary(extracted: DataFrame, host: Column) -> DataFrame:
    return extracted.groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.size("links")).alias("links"),
        F.sum(F.size("headings")).alias("headings"), F.sum("text_chars").alias("text_chars"))
