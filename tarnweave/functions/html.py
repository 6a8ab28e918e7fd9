"""What a page holds: title, texts, links and assets, from the standard-library parser.

Arrow batches go through one parse per page. Deviations from a full HTML5 tree: no elements
are moved out of tables, and formatting elements aren't reopened; texts, links and assets don't
depend on either.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnweave.functions.url import join

_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")


def squash(text: str) -> str:
    return _WHITE.sub(" ", text).strip(" ")


class Page(HTMLParser):
    """One pass over a page that keeps what the extractors need."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.all_text: list[str] = []
        self.body_text: list[str] = []
        self.title_text: list[str] | None = None
        self.anchors: list[list] = []
        self.assets: list[tuple[str, str, str | None]] = []
        self._title = self._body = False
        self._anchor: list | None = None
        self._head = False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given: dict = {}
        for k, v in attrs:
            given.setdefault(k, v if v is not None else "")
        if tag == "body":
            self._body, self._head = True, False
        elif tag == "head":
            self._head = True
        elif tag == "title" and self.title_text is None:
            self.title_text, self._title = [], True
        elif tag == "a":
            self._anchor = None
            if "href" in given:
                self._anchor = [given["href"], []]
                self.anchors.append(self._anchor)
        elif tag == "img" and "src" in given:
            self.assets.append((given["src"], "image", given["alt"].strip() if "alt" in given else None))
        elif tag == "script" and "src" in given:
            self.assets.append((given["src"], "script", None))
        elif tag == "link" and given.get("rel") == "stylesheet" and "href" in given:
            self.assets.append((given["href"], "stylesheet", None))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self._title = False
        elif tag == "a":
            self._anchor = None
        elif tag == "head":
            self._head = False

    def handle_data(self, data: str) -> None:
        self.all_text.append(data)
        if self._title:
            self.title_text.append(data)
        elif self._body:
            self.body_text.append(data)
        if self._anchor is not None:
            self._anchor[1].append(data)

    def title(self) -> str | None:
        return squash_ends("".join(self.title_text or [])) or None

    def text(self, whole: bool = False) -> str:
        parts = self.all_text if whole or not self._body else self.body_text
        return squash(" ".join(parts))


def squash_ends(text: str) -> str:
    return _WHITE.sub(lambda m: m.group() if 0 < m.start() and m.end() < len(text) else "", text)


def links_of(page: Page, base: str | None) -> list[tuple[str, str | None]]:
    """http(s) links with the text of their first occurrence, each URL once, in document order."""
    seen: dict[str, str | None] = {}
    for href, text in page.anchors:
        url = join(base, href)
        if url and url.startswith(("http:", "https:")) and url not in seen:
            seen[url] = squash_ends("".join(text)) or None
    return list(seen.items())


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _series(values: list) -> pd.Series:
    return pd.Series(values, dtype="object")


@F.pandas_udf(T.StringType())
def title(html: pd.Series) -> pd.Series:
    return _series([Page(h).title() if h is not None else None for h in html])


@F.pandas_udf(T.StringType())
def body_text(html: pd.Series) -> pd.Series:
    return _series([Page(h).text() if h is not None else None for h in html])


@F.pandas_udf(T.StringType())
def document_text(html: pd.Series) -> pd.Series:
    return _series([Page(h).text(True) or None if h is not None else None for h in html])


@F.pandas_udf(T.ArrayType(T.StringType()))
def page_links(html: pd.Series, base: pd.Series) -> pd.Series:
    return _series([[u for u, _ in links_of(Page(h), b)] if h is not None else [] for h, b in zip(html, base, strict=True)])


@F.pandas_udf(T.ArrayType(_strings("url", "anchor_text")))
def page_anchors(html: pd.Series, base: pd.Series) -> pd.Series:
    return _series([[{"url": u, "anchor_text": t} for u, t in links_of(Page(h), b)] if h is not None else [] for h, b in zip(html, base, strict=True)])


@F.pandas_udf(T.ArrayType(_strings("asset_url", "asset_type", "alt_text")))
def page_assets(html: pd.Series, base: pd.Series) -> pd.Series:
    """Images, then scripts, then stylesheets, each in document order."""
    out = []
    for h, b in zip(html, base, strict=True):
        found = Page(h).assets if h is not None else []
        order = sorted(found, key=lambda a: ("image", "script", "stylesheet").index(a[1]))
        out.append([{"asset_url": u, "asset_type": kind, "alt_text": alt} for src, kind, alt in order if (u := join(b, src))])
    return _series(out)


_EXTRACT = T.StructType([*_strings("title", "text").fields, T.StructField("links", T.ArrayType(T.StringType()))])


@F.pandas_udf(_EXTRACT)
def extract(html: pd.Series, base: pd.Series) -> pd.DataFrame:
    """Title, body text and links in one parse."""
    rows = []
    for h, b in zip(html, base, strict=True):
        page = Page(h or "")
        rows.append((page.title(), page.text(), [u for u, _ in links_of(page, b)]))
    return pd.DataFrame(rows, columns=["title", "text", "links"])


def parsed(html: Column, base: Column) -> Column:
    return extract(html, base)
