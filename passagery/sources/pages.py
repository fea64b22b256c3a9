"""HTML pages -> Markdown sections."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "nav", "aside", "footer"}
_BLOCKS = {"p", "li", "pre", "dd", "dt", "td", "blockquote"}


def tidy(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("¶", " ")).strip()


class _Events(HTMLParser):
    """Headings and blocks of the main part of a page, in order."""

    def __init__(self, relaxed: bool):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[int, str]] = []  # (heading level or 0, text)
        self.inside = [relaxed]
        self.skipped = 0
        self.level = 0
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _SKIP:
            self.skipped += 1
        elif tag in ("main", "div"):
            self.inside.append(self.inside[-1] or tag == "main" or a.get("role") == "main")
        elif self.inside[-1] and not self.skipped and (tag in _BLOCKS or re.fullmatch("h[1-6]", tag)):
            self._close()
            self.level = int(tag[1]) if tag[0] == "h" else 0
            self.text = []

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif tag in ("main", "div") and len(self.inside) > 1:
            self._close()
            self.inside.pop()
        elif tag in _BLOCKS or re.fullmatch("h[1-6]", tag):
            self._close()

    def handle_data(self, data):
        if self.text is not None and not self.skipped:
            self.text.append(data)

    def _close(self):
        if self.text is not None and (t := tidy("".join(self.text))):
            self.events.append((self.level, t))
        self.text = None


def events(page: str) -> list[tuple[int, str]]:
    """(heading level or 0, text); pages without a main part are read whole."""
    relaxed = not re.search(r"<main\b|role\s*=\s*[\"']?main", page, re.I)
    p = _Events(relaxed)
    p.feed(page)
    p.close()
    p._close()
    return p.events


def markdown(page: str, least_body: int = 40, least_block: int = 20, group: int = 4) -> str:
    """Sections as Markdown; sections with shorter bodies are dropped; with fewer than two the longer blocks are grouped instead."""
    title, found, body = "", [], []
    head = (1, "")
    for level, text in [*events(page), (1, "")]:
        if not level:
            body.append(text)
            continue
        whole = "\n\n".join(body)
        if head[1] and len(whole) >= least_body:
            found.append(f"{'#' * head[0]} {head[1]}\n\n{whole}")
        title = title or head[1]
        head, body = (level, text), []
    if len(found) >= 2:
        return "\n\n".join(found)
    blocks = [t for level, t in events(page) if not level and len(t) >= least_block]
    parts = ["\n\n".join(blocks[i : i + group]) for i in range(0, len(blocks), group)]
    return "\n\n".join(f"## {title or 'Section'} {n + 1}\n\n{p}" for n, p in enumerate(parts))


def page_sections(pages: DataFrame, key: str, page: str) -> DataFrame:
    """(key, markdown) of every page; null pages are left out, pages without text give an empty string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["k"]].assign(markdown=[markdown(h) for h in pdf["h"]])

    kind = dict(pages.dtypes)[key]
    own = pages.select(F.col(key).alias("k"), F.col(page).alias("h")).where("h IS NOT NULL")
    return own.mapInPandas(run, f"k {kind}, markdown string").withColumnRenamed("k", key)
