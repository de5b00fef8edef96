"""HTML functions. Titles, links and hidden blocks are native; the readable text needs a parser and is an Arrow UDF."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import vocab

HIDDEN = ("script", "style", "noscript", "template")


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def description(html: Column) -> Column:
    """The page's own summary, Open Graph first, at most 500 characters."""
    found = [F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]+{key}["\'][^>]+content=["\']([^"\']*)', 1), F.lit("")) for key in ('property=["\']og:description', 'name=["\']description')]
    return F.substring(F.coalesce(*found, F.lit("")), 1, 500)


def visible(html: Column) -> Column:
    """The HTML without blocks that are never shown."""
    for tag in HIDDEN:
        html = F.regexp_replace(html, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    return html


def links(html: Column) -> Column:
    """Link targets without fragments, distinct, in order."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a[^>]+href="([^"#]*)'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def absolute(link: Column, base: Column) -> Column:
    """A link as an address: what starts with a scheme as it is, ``//`` with the base's scheme, ``/`` at its host, ``?`` at its path, others in its folder. Empty for other schemes than http."""
    scheme, origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, "^(.*/)[^/]*$", 1)).otherwise("/")
    joined = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(F.startswith(link, F.lit("?")), F.concat(origin, path, link)).otherwise(F.concat(origin, folder, link))
    )
    for _ in range(4):  # a few steps up
        joined = F.regexp_replace(F.regexp_replace(joined, r"/\./", "/"), r"(?<![:/])/(?!\.\./)[^/?#]+/\.\./", "/")
    return F.when(joined.rlike("(?i)^https?://"), joined).otherwise("")


def resolved_links(html: Column, base: Column) -> Column:
    """Distinct addresses that a page links to, in order."""
    return F.array_distinct(F.filter(F.transform(links(html), lambda x: absolute(x, base)), lambda x: x != ""))


def stripped(html: Column) -> Column:
    """The text of the visible HTML with tags out and white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(visible(html), r"(?s)<[^>]*>", " "), r"\s+", " "))


class _Reader(HTMLParser):
    """Text outside page chrome. Elements are closed as browsers do: the end of one ends all that are open inside it.

    Chrome are certain tags (but not the header of an article), certain roles, and divisions whose attributes hint at it; inside an
    article or main part only the tags are. ``header`` of a page, unclosed, thus ends with the element around it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.hidden, self.found = [], None, []

    def _is_chrome(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        content = {"article", "main"} & set(self.open)
        if tag in vocab.CHROME_TAGS or tag in HIDDEN:
            return tag != "header" or "article" not in content
        if content:
            return False
        words = " ".join(w or "" for pair in attrs for w in pair)
        return dict(attrs).get("role") in vocab.CHROME_ROLES or (tag == "div" and re.search(vocab.CHROME_HINT, words) is not None)

    def handle_starttag(self, tag, attrs):
        if tag not in vocab.VOID_TAGS:
            if self.hidden is None and self._is_chrome(tag, attrs):
                self.hidden = len(self.open)
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag not in vocab.VOID_TAGS:
            # An end that nothing open answers to ends everything.
            at = len(self.open) - 1 - self.open[::-1].index(tag) if tag in self.open else 0
            del self.open[at:]
            if self.hidden is not None and len(self.open) <= self.hidden:
                self.hidden = None

    def handle_data(self, data):
        if self.hidden is None and data.strip():
            self.found.append(" ".join(data.split()))


def read_html(html: str | None) -> str:
    reader = _Reader()
    reader.feed(html or "")
    return "\n".join(reader.found)


def readable(html: Column) -> Column:
    """A page's text without navigation, header, footer and scripts."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(read_html)

    return read(html)
