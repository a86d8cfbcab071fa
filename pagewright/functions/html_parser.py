"""Full HTML parsing where the regular expressions will not do: a vectorised UDF over the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.params import IMPORTANT_TAGS

_HIDDEN = frozenset(("script", "style", "template"))
PARSED = "text string, links array<string>, important array<struct<rank:tinyint,text:string>>"


class _Page(HTMLParser):
    def __init__(self, base: str, separator: str):
        super().__init__(convert_charrefs=True)
        self.base, self.separator = base, separator
        self.text: list[str] = []
        self.links: dict[str, None] = {}
        self.open: list[str] = []
        self.important: dict[str, list[str]] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _HIDDEN or tag in IMPORTANT_TAGS:
            self.open.append(tag)
        if tag == "a":
            target = dict(attrs).get("href")
            if target is not None:
                try:
                    self.links.setdefault(urldefrag(urljoin(self.base, target)).url)
                except ValueError:
                    pass
        self.text.append(self.separator)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            del self.open[len(self.open) - 1 - self.open[::-1].index(tag) :]
        self.text.append(self.separator)

    def handle_data(self, data: str) -> None:
        if any(t in _HIDDEN for t in self.open):
            return
        self.text.append(data)
        for tag in self.open:
            self.important.setdefault(tag, []).append(data)


def parse(page: str | None, base: str | None, separator: str = "") -> tuple[str, list[str], list[tuple[int, str]]]:
    """Text, resolved links without fragment, and the text under each important tag of one page."""
    reader = _Page(base or "", separator)
    reader.feed(page or "")
    reader.close()
    ranked = [(k, " ".join(reader.important[t])) for k, t in enumerate(IMPORTANT_TAGS, 1) if t in reader.important]
    text = "".join(reader.text)
    return (re.sub(r" {2,}", " ", text) if separator else text), list(reader.links), ranked


def parsed(page: Column, base: Column, separator: str = "") -> Column:
    """The result of :func:`parse` as a struct of :data:`PARSED`."""

    @F.pandas_udf(PARSED)
    def run(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
        rows = [parse(p, b, separator) for p, b in zip(pages, bases, strict=True)]
        return pd.DataFrame(
            {"text": [r[0] for r in rows], "links": [r[1] for r in rows], "important": [[{"rank": k, "text": t} for k, t in r[2]] for r in rows]}
        )

    return run(page, base)
