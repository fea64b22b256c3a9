"""Problem 2: oversized texts cut into pieces at their strongest natural boundaries.

Every place where a text may be cut has a strength (heading over paragraph over line over sentence
over word). A sparse table over the places answers which is the strongest in any range in constant
time, the rightmost among equals; each piece ends at the strongest place of its permissible length
window, and the next begins the overlap before it. Work is per document, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagery.llm.skew import small_or_salted_join
from passagery.runtime import cut_lineage

HEADING, PARAGRAPH, LINE, SENTENCE, WORD = 5, 4, 3, 2, 1

_CODE = re.compile(
    r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)|<pre\b.*?(?:</pre>|\Z)|\\begin\{(?:verbatim|lstlisting)\}.*?(?:\\end\{|\Z)", re.S | re.M | re.I
)
_HEADINGS = re.compile(
    r"^(?P<md>#{1,6})[ \t]+(?P<mdt>[^\n]*?)[ \t#]*\r?$"
    r"|^(?P<wiki>={2,6})[ \t]*(?P<wikit>[^=\n][^\n]*?)[ \t]*(?P=wiki)[ \t]*\r?$"
    r"|<h(?P<html>[1-6])\b[^>]*>(?P<htmlt>.*?)</h(?P=html)>"
    r"|^\\(?P<tex>part|chapter|section|subsection|subsubsection|paragraph)\*?\{(?P<text>[^\n]*)\}",
    re.M | re.I,
)
_TEX_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_BREAKS = re.compile(r"\n[ \t\r]*\n\s*|\n[ \t]*|(?<=[.!?])[ \t]+|[ \t ]+")


def headings(text: str) -> list[tuple[int, int, str]]:
    """(start, level, title) of the headings outside code."""
    blocked = [m.span() for m in _CODE.finditer(text)]
    out, k = [], 0
    for m in _HEADINGS.finditer(text):
        while k < len(blocked) and blocked[k][1] <= m.start():
            k += 1
        if k < len(blocked) and blocked[k][0] <= m.start():
            continue
        if m["md"]:
            out.append((m.start(), len(m["md"]), m["mdt"].strip()))
        elif m["wiki"]:
            out.append((m.start(), len(m["wiki"]) - 1, m["wikit"].strip()))
        elif m["html"]:
            out.append((m.start(), int(m["html"]), re.sub(r"<[^>]*>", "", m["htmlt"]).strip()))
        else:
            out.append((m.start(), _TEX_LEVEL[m["tex"].lower()], m["text"].strip()))
    return out


def boundaries(text: str, heads: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(places, strengths): where the text may be cut before a character, ascending."""
    place: dict[int, int] = {}
    for m in _BREAKS.finditer(text):
        s = m.group()
        nl = s.count("\n")
        if nl:
            kind = PARAGRAPH if nl > 1 else LINE
        else:
            kind = SENTENCE if m.start() and text[m.start() - 1] in ".!?" else WORD
        place[m.end()] = kind
    for at, _, _ in heads:
        place[at] = HEADING
    at = np.array(sorted(place), np.int64)
    return at, np.array([place[i] for i in at], np.int64)


class RangeMaximum:
    """Sparse table: index of the greatest value in any range, the rightmost among equals."""

    def __init__(self, values: np.ndarray, longest: int):
        n = len(values)
        key = values * (n + 1) + np.arange(n)  # equal values: the right one is greater
        self.levels = [key]
        width = 1
        while 2 * width <= min(n, max(longest, 1)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[: len(last) - width], last[width:]))
            width *= 2
        self.n = n

    def query(self, lo: int, hi: int) -> int:
        """Index of the maximum in [lo, hi), which must not be empty."""
        k = min((hi - lo).bit_length() - 1, len(self.levels) - 1)
        row, width = self.levels[k], 1 << k
        best = row[lo]
        for at in range(lo + width, hi - width + 1, width):
            best = max(best, row[at])
        return int(max(best, row[hi - width])) % (self.n + 1)


def split(text: str, size: int, overlap: int, fill: float = 0.5) -> list[tuple[int, int, str]]:
    """(start, end, heading path) of the pieces of text without its outer white space.

    No piece is longer than size characters. Each but the last ends at the strongest boundary that
    makes it at least fill * size (and more than the overlap) long; where there is none, at the
    strongest of a shorter piece that is longer than the overlap, and only where that is missing too, at
    size. The next begins overlap characters before that end. A text that fits is one piece; an empty
    one none.
    """
    lead = len(text) - len(text.lstrip())
    body = text.strip()
    if not body:
        return []
    heads = headings(body)
    overlap = max(0, min(overlap, size - 1))
    paths: list[tuple[int, str]] = []
    stack: list[tuple[int, str]] = []
    for at, level, title in heads:
        stack = [h for h in stack if h[0] < level] + [(level, title)]
        paths.append((at, " > ".join(t for _, t in stack)))
    starts = [p[0] for p in paths]

    def path(at: int) -> str:
        k = int(np.searchsorted(starts, at, side="right")) - 1
        return paths[k][1] if k >= 0 else ""

    if len(body) <= size:
        return [(lead, lead + len(body), path(0))]
    at, strength = boundaries(body, heads)
    table = RangeMaximum(strength, size) if len(at) else None
    least = max(overlap + 1, int(np.ceil(size * fill)))
    out, start = [], 0
    while len(body) - start > size:
        cut = start + size
        if table is not None:
            hi = int(np.searchsorted(at, start + size, side="right"))
            for shortest in (least, overlap + 1):
                lo = int(np.searchsorted(at, start + shortest))
                if lo < hi:
                    cut = int(at[table.query(lo, hi)])
                    break
        out.append((lead + start, lead + cut, path(start)))
        start = cut - overlap
    out.append((lead + start, lead + len(body), path(start)))
    return out


SCHEMA = "document_id string, piece_no int, start int, end int, heading_path string, content string"


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lo in range(0, len(pdf), 1024):
            out = []
            part = pdf.iloc[lo : lo + 1024]
            for key, text, size, overlap in zip(part["document_id"], part["content"], part["size"], part["overlap"]):
                if size < 1:  # no limit is known: the document stays whole
                    size, overlap = len(text) + 1, 0
                for n, (a, b, path) in enumerate(split(text, int(size), int(overlap))):
                    out.append((key, n, a, b, path, text[a:b]))
            yield pd.DataFrame(out, columns=["document_id", "piece_no", "start", "end", "heading_path", "content"])


def _once(own: DataFrame) -> DataFrame:
    """own without repeated rows; only rows whose hash comes again are shuffled with their text."""
    keyed = own.withColumn("h", F.xxhash64(*own.columns))
    again = cut_lineage(keyed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    single = small_or_salted_join(keyed, again, ["h"], F.col("document_id"), "left_anti")
    repeated = small_or_salted_join(keyed, again, ["h"], F.col("document_id"), "left_semi")
    return single.drop("h").unionByName(repeated.drop("h").distinct())


def split_documents(docs: DataFrame, configs: DataFrame, default_config: str = "phase3-base", once: bool = False) -> DataFrame:
    """(document_id, piece_no, start, end, heading_path, content): the pieces of every document row.

    content is the document's text from start to end, counted in characters. A null configuration
    means default_config; an unknown one, or one whose chunk_size is null or below 1, sets no limit.
    A null overlap is 0, and one of at least chunk_size is cut to chunk_size - 1. Null contents give
    no piece. A row that comes again with the same id, content and configuration gives equal pieces, or
    with once is cut once.
    """
    limits = configs.where("config_name IS NOT NULL").groupBy("config_name").agg(
        F.max(F.struct("chunk_size", "chunk_overlap")).alias("c")
    )
    own = docs.select(
        F.col("id").cast("string").alias("document_id"), F.col("content"),
        F.coalesce(F.col("config_name"), F.lit(default_config)).alias("config_name"),
    ).where("content IS NOT NULL")
    if once:
        own = _once(own)
    sized = own.join(limits, "config_name", "left").select(
        "document_id", "content", F.coalesce("c.chunk_size", F.lit(0)).alias("size"), F.coalesce("c.chunk_overlap", F.lit(0)).alias("overlap")
    )
    return sized.mapInPandas(_split_batches, SCHEMA)


def oversized(docs: DataFrame, configs: DataFrame) -> DataFrame:
    """(document_id): documents that had to be cut."""
    return split_documents(docs, configs).where("piece_no = 1").select("document_id").distinct()
