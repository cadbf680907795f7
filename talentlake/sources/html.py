"""Captured web pages: fields by pattern on the JVM, labelled values by a small parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = {"p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "section", "article", "br", "dt", "dd"}


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def headings(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"))
    return F.transform(found, lambda h: F.trim(F.regexp_replace(h, r"<[^>]+>", "")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="([^"]*)"'))


def page_count(title: Column, per_page: int = 51) -> Column:
    """Pages of a search from the total in its title, rounded up."""
    total = F.regexp_replace(F.regexp_extract(title, r"([0-9][0-9.,]*)", 1), "[.,]", "").try_cast("int")
    return F.ceil(total / per_page).cast("int")


class _Blocks(HTMLParser):
    """Text lines of a page."""

    def __init__(self) -> None:
        super().__init__()
        self.lines, self.now, self.skip = [], [], 0

    def _end(self) -> None:
        line = re.sub(r"\s+", " ", "".join(self.now)).strip()
        if line:
            self.lines.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in BLOCKS:
            self._end()

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag in BLOCKS:
            self._end()

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)

    def close(self):
        super().close()
        self._end()


def labelled(lines: list[str], labels: dict[str, list[str]]) -> dict[str, str]:
    """The value of each field: what follows its label and a colon on a line, or the line after a label that stands alone."""
    out: dict[str, str] = {}
    for i, line in enumerate(lines):
        key = line.lower().rstrip(" :")
        for field, names in labels.items():
            if field in out:
                continue
            if key in names and i + 1 < len(lines):
                out[field] = lines[i + 1]
            elif name := next((n for n in names if line.lower().startswith(n + ":")), None):
                out[field] = line[len(name) + 1 :].strip()
    return out


def blocks_under(lines: list[str], titles: dict[str, list[str]]) -> dict[str, str]:
    """The lines below each title up to the next one, repeats dropped; the first title of a field counts."""
    out: dict[str, list[str]] = {}
    now = None
    for line in lines:
        field = next((f for f, names in titles.items() if line.lower().rstrip(" :") in names), None)
        if field is not None:
            now = field if field not in out else None
            if now is not None:
                out[now] = []
        elif now is not None and line not in out[now]:
            out[now].append(line)
    return {f: "\n".join(ls) for f, ls in out.items() if ls}


def extract_fields(pages: DataFrame, key: str, labels: dict[str, list[str]], titles: dict[str, list[str]], html: str = "html") -> DataFrame:
    """key, fields (map): labelled values and description blocks of each page; labels and titles are lower case."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for page in frame[html]:
                parser = _Blocks()
                parser.feed(page or "")
                parser.close()
                found.append(labelled(parser.lines, labels) | blocks_under(parser.lines, titles))
            yield pd.DataFrame({key: frame[key], "fields": found})

    kind = dict(pages.dtypes)[key]
    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, fields map<string,string>")
