"""Source-addressable chunks: character, paragraph, heading, section and heading-context strategies.

The packing loops carry state from piece to piece, so they run in Python over Arrow batches, one
document at a time; offsets are characters of the document.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagery.functions.text import heading_slug

SEPARATORS = ("\n\n", "\n", " ", "")
HEADING = r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*$"


@dataclass(frozen=True)
class Piece:
    text: str
    start: int | None
    end: int | None
    heading_path: str


def character_split(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Greedy packing of the parts between the coarsest separator that occurs, finer ones for what stays too long.

    The running length counts one separator before each part, and once more after an overlap is kept,
    so a chunk may pass size by a separator, and by up to the overlap where one is kept; those are
    split again while separators remain.
    """
    if not text:
        return []
    at = next((k for k, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep = separators[at]
    finer = separators[at + 1 :] if sep and sep in text else ()
    parts = [p for p in text.split(sep) if p] if sep else list(text)
    gap = len(sep)
    packed: list[str] = []
    held: deque[str] = deque()
    joined = counted = 0  # length of the held parts joined; length as counted for the limit
    for part in parts:
        if counted and counted + len(part) > size:
            packed.append(sep.join(held))
            while held and joined > overlap:
                joined -= len(held.popleft()) + (gap if held else 0)
            counted = joined + gap if held else 0
        joined += len(part) + (gap if held else 0)
        held.append(part)
        counted += len(part) + (gap if counted else 0)
    if held:
        packed.append(sep.join(held))
    out: list[str] = []
    for piece in packed:
        out += character_split(piece, size, overlap, finer) if finer and len(piece) > size else [piece]
    return out


def headings(text: str) -> list[tuple[int, int, str]]:
    """(start, level, title) of the Markdown headings."""
    return [(m.start(), len(m.group(1)), m.group(2).strip()) for m in re.finditer(HEADING, text)]


def path_at(heads: list[tuple[int, int, str]], position: int) -> str:
    """Titles of the headings that enclose a position, the heading at the position included."""
    stack: list[tuple[int, str]] = []
    for start, level, title in heads:
        if start > position:
            break
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
    return " > ".join(t for _, t in stack)


def locate(text: str, pieces: list[str], repair: bool) -> list[tuple[int | None, int | None]]:
    """Where each piece stands: searched from just behind the start of the one before, then from the front.

    Without repair a piece that isn't a part of the text has no place (None). With it, its first line
    that isn't blank is searched, and the interval is kept inside the text.
    """
    out: list[tuple[int | None, int | None]] = []
    cursor = 0
    for piece in pieces:
        start = text.find(piece, cursor)
        if start < 0:
            start = text.find(piece)
        if start < 0 and repair:
            line = next((x for x in piece.splitlines() if x.strip()), "")
            start = max(0, text.find(line, cursor) if line and text.find(line, cursor) >= 0 else text.find(line))
        if start < 0:
            out.append((None, None))
            continue
        end = min(len(text), start + max(1, len(piece)))
        out.append((start, end))
        cursor = max(start + 1, end - 1) if repair else start + 1
    return out


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Intervals from a visible character to the next blank line or the end."""
    out, at = [], 0
    stop = re.compile(r"\n\s*\n")
    visible = re.compile(r"\S")
    while m := visible.search(text, at):
        # a paragraph holds at least its first character, whatever follows
        s = stop.search(text, m.start() + 1)
        end = s.start() if s else len(text)
        out.append((m.start(), end))
        at = end
    return out


def pack(text: str, ranges: list[tuple[int, int]], target: int, overlap_items: int) -> list[Piece]:
    """Neighbouring intervals joined while they span at most target; the next chunk begins overlap_items before the end."""
    heads, out, i = headings(text), [], 0
    while i < len(ranges):
        start, j = ranges[i][0], i + 1
        while j < len(ranges) and ranges[j - 1][1] - start < target and ranges[j][1] - start <= target:
            j += 1
        end = ranges[j - 1][1]
        out.append(Piece(text[start:end], start, end, path_at(heads, start)))
        i = max(i + 1, j - overlap_items)
    return out


def sections(text: str, deepest: int) -> list[tuple[int, int]]:
    """Intervals between headings down to a level, with a preamble that isn't blank; without headings the whole text."""
    cuts = [s for s, level, _ in headings(text) if level <= deepest]
    edges = ([0] if not cuts or cuts[0] > 0 else []) + cuts + [len(text)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if text[a:b].strip()]


def _cut_sections(text: str, deepest: int, target: int) -> list[Piece]:
    heads, out = headings(text), []
    for a, b in sections(text, deepest):
        own = text[a:b]
        parts = [own] if len(own) <= target else character_split(own, target, min(120, max(0, target // 5)))
        places = [(0, len(own))] if len(own) <= target else locate(own, parts, True)
        out += [Piece(p, a + s, a + e, path_at(heads, a + s)) for p, (s, e) in zip(parts, places)]
    return out


def heading_context(text: str, target: int, overlap_items: int = 1) -> list[Piece]:
    """Paragraph chunks with their heading path and the paragraphs beside their first one in front; the interval stays."""
    ranges, out = paragraphs(text), []
    for p in pack(text, ranges, target, overlap_items):
        k = next(i for i, (a, b) in enumerate(ranges) if a <= p.start < b)
        near = [text[slice(*ranges[i])] for i in (k - 1, k + 1) if 0 <= i < len(ranges)]
        front = (p.heading_path + "\n" if p.heading_path else "") + "\n\n".join(near)
        out.append(Piece(f"{front}\n\n{p.text}".strip(), p.start, p.end, p.heading_path))
    return out


def character(text: str, size: int, overlap: int, repair: bool = True) -> list[Piece]:
    parts, heads = character_split(text, size, overlap), headings(text)
    return [Piece(p, s, e, path_at(heads, s) if s is not None else "") for p, (s, e) in zip(parts, locate(text, parts, repair))]


STRATEGIES: dict[str, Callable[[str, int, int], list[Piece]]] = {
    "character": lambda t, size, overlap: character(t, size, overlap),
    "paragraph": lambda t, size, overlap: pack(t, paragraphs(t), size, 1),
    "heading": lambda t, size, overlap: _cut_sections(t, 6, size),
    "section": lambda t, size, overlap: _cut_sections(t, 2, size),
    "heading_context": lambda t, size, overlap: heading_context(t, size),
}


def chunks_of(text: str, strategy: str, size: int, overlap: int = 0) -> list[Piece]:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}")
    return STRATEGIES[strategy](text, size, overlap)


SCHEMA = "document_id string, chunk_id string, chunk_index int, source_char_start int, source_char_end int, heading_path string, content string"


def chunk_documents(docs: DataFrame, strategy: str, size: int, overlap: int = 0, key: str = "id", name: str = "file_name", text: str = "content") -> DataFrame:
    """One row per chunk; chunk_id is `<name>::<index>`. Null texts give no chunk."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, file, body in zip(pdf["d"], pdf["f"], pdf["t"]):
                for n, p in enumerate(chunks_of(body, strategy, size, overlap)):
                    out.append((doc, f"{file}::{n}", n, p.start, p.end, p.heading_path, p.text))
            frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in SCHEMA.split(", ")])
            yield frame.astype({"source_char_start": "Int32", "source_char_end": "Int32"})

    own = docs.select(F.col(key).alias("d"), F.col(name).alias("f"), F.col(text).alias("t")).where("t IS NOT NULL")
    return own.mapInPandas(cut, SCHEMA)


def heading_spans(docs: DataFrame, key: str = "file_name", text: str = "content") -> DataFrame:
    """(document_id, span_id, heading, heading_level, span_start, span_end): each heading up to the next one.

    Repeated slugs of a document get -2, -3 and so on in order. key must be unique among docs.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, body in zip(pdf["d"], pdf["t"]):
                heads = headings(body)
                for k, (start, level, title) in enumerate(heads):
                    out.append((doc, title, level, start, heads[k + 1][0] if k + 1 < len(heads) else len(body)))
            yield pd.DataFrame(out, columns=["document_id", "heading", "heading_level", "span_start", "span_end"])

    own = docs.select(F.col(key).alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    spans = own.mapInPandas(scan, "document_id string, heading string, heading_level int, span_start int, span_end int")
    spans = spans.withColumn("slug", heading_slug(F.col("heading")))
    n = F.row_number().over(Window.partitionBy("document_id", "slug").orderBy("span_start"))
    suffix = F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(F.lit(""))
    return spans.withColumn("n", n).select(
        "document_id", F.concat("document_id", F.lit("#"), "slug", suffix).alias("span_id"), "heading", "heading_level", "span_start", "span_end"
    )
