"""Evaluation cases of varying shape -> normalised label rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = "case string, kind string, label string, doc string, start int, end int, gain double, ordinal int"


def _number(x: object) -> float | None:
    try:
        return None if isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return None


def _key(x: object) -> str:
    return str(x).replace("\\", "/").strip().lower()


def labels_of(case: dict) -> list[tuple]:
    """(kind, label, doc, start, end, gain) of a case: chunk labels from maps or lists, spans, sources.

    Gains that aren't numbers drop a label of `relevance` and count 1 in `expected_chunk_ids`; gains
    of 0 or less drop any label; the last of equal labels counts.
    """
    chunks: dict[str, float] = {}

    def put(label: object, gain: float | None) -> None:
        if label is not None and str(label).strip():
            chunks.pop(_key(label), None)
            if gain is not None and gain > 0:
                chunks[_key(label)] = gain

    rel = case.get("relevance")
    if isinstance(rel, dict):
        for k, v in rel.items():
            put(k, _number(v))
    elif isinstance(rel, list):
        for x in rel:
            if isinstance(x, dict):
                put(x.get("chunk_id") or x.get("id"), _number(x.get("gain", x.get("relevance", 1.0))))
            else:
                put(x, 1.0)
    expected = case.get("expected_chunk_ids")
    if not chunks and isinstance(expected, dict):
        for k, v in expected.items():
            n = _number(v)
            put(k, 1.0 if n is None else n)
    elif not chunks and isinstance(expected, list):
        for x in expected:
            put(x, 1.0)
    out: list[tuple] = [("chunk", k, None, None, None, g) for k, g in chunks.items()]
    for s in case.get("relevance_spans") or []:
        if not isinstance(s, dict):
            continue
        a, b, g = _number(s.get("start")), _number(s.get("end")), _number(s.get("gain", 1.0))
        if s.get("document_id") and s.get("span_id") and a is not None and b is not None and 0 <= a < b and g and g > 0:
            out.append(("span", str(s["span_id"]), _key(s["document_id"]), int(a), int(b), g))
    sources = case.get("expected_sources") or case.get("expected_source") or []
    for s in [sources] if isinstance(sources, str) else sources:
        if s and _key(s):
            out.append(("source", _key(s), _key(s), None, None, 1.0))
    return out


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for line in pdf["value"]:
            try:
                case = json.loads(line)
            except json.JSONDecodeError:
                continue
            name = str(case.get("id") or case.get("question") or "")
            out += [(name, *row, n) for n, row in enumerate(labels_of(case))]
        frame = pd.DataFrame(out, columns=[c.split(" ")[0] for c in LABELS.split(", ")])
        yield frame.astype({"start": "Int32", "end": "Int32", "ordinal": "int32"})


def labels(lines: DataFrame) -> DataFrame:
    """Label rows of the JSON lines in the column value; lines that aren't JSON give none."""
    return lines.where(F.col("value").isNotNull() & (F.trim("value") != "")).mapInPandas(_batches, LABELS)
