"""Problem 6: garbled text from wrong character encoding, repaired by round trips.

Text is encoded again in a candidate legacy encoding and strictly decoded as the encoding that was
meant; the step is repeated for nested layers and kept only while a garbling cost drops. The work is
per document (Arrow batches, no shuffle), so it scales with the input and has no hot groups.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

#: Encodings in which UTF-8 bytes are commonly misread.
UTF8_READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp437", "cp850", "cp852", "mac_roman", "cp1251")
#: (misread as, meant): one-byte encodings taken for one another.
ONE_BYTE = (
    ("cp1252", "iso8859-2"), ("cp1252", "cp1250"), ("latin-1", "cp1250"), ("latin-1", "iso8859-2"),
    ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp852", "cp1250"), ("cp852", "cp1252"), ("cp437", "cp1250"),
    ("cp1250", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1250", "cp852"), ("cp1252", "cp852"),
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("cp1251", "cp1250"),
)

#: Letters beyond ASCII that English, Polish, German and the languages they borrow from use.
LETTERS = frozenset("ąćęłńóśźżäöüßàâæçéèêëîïôœùûáíúñãõåøýčěřšůž")
#: Signs that stand in good text.
SIGNS = frozenset("“”„’‘‚«»…–—°€£¥§µ≤≥→←≠×÷±²³¹¼½¾¿¡¶·•™®©‰†‡ªº¢¤¦¬ ")
#: Signs that good text may have between two letters.
JOINERS = frozenset("’‘–—…·­ ×→’")
_OPEN, _CLOSE = "\"“„‘'`«", "\"”“’'`»‘"
_QUOTED = re.compile(f"(?<![^\\s(*_>])[{_OPEN}][^\x00-\x7f]+?[{_CLOSE}](?![^\\s.,;:!?)*_<])")
_NON_ASCII = re.compile(r"[^\x00-\x7f]")
_HIGH_RUN = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=None)
def _to_bytes(encoding: str) -> dict[int, int]:
    """Code point -> byte for the upper half; bytes without a character stand for themselves (C1)."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(encoding))] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):
        table.setdefault(b, b)
    return table


@lru_cache(maxsize=None)
def _one_byte_map(read_as: str, meant: str) -> dict[int, str]:
    out = {}
    for cp, b in _to_bytes(read_as).items():
        try:
            out[cp] = bytes([b]).decode(meant)
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=100_000)
def _kind(ch: str) -> str:
    """a: ASCII letter, l: expected letter, L: other Latin letter, n: other letter, s: sign, x: odd sign, c: control."""
    o = ord(ch)
    if o < 128:
        return "a" if ch.isalpha() else "."
    if o == 0xFFFD or 0x80 <= o < 0xA0:
        return "c"
    if ch.lower() in LETTERS:
        return "l"
    if ch in SIGNS:
        return "s"
    if ch.isalpha():
        return "L" if "LATIN" in unicodedata.name(ch, "") else "n"
    return "x"


def garbling_cost(text: str) -> float:
    """How garbled text looks: 0 for ASCII, about 1 for each ordinary letter or sign, more for what
    good text rarely has (controls, signs or other scripts inside words, capitals after small letters)."""
    cost = 0.0
    for m in _NON_ASCII.finditer(text):
        i, ch = m.start(), m.group()
        k = _kind(ch)
        before, after = text[i - 1 : i], text[i + 1 : i + 2]
        left = bool(before) and before.isalpha()
        right = bool(after) and after.isalpha()
        if k == "c":
            cost += 4
        elif k == "l":
            cost += 2.5 if left and before.islower() and ch.isupper() else 1
        elif k == "L":
            cost += 2.5
        elif k == "n":
            near = [_kind(c) for c, there in ((before, left), (after, right)) if there]
            cost += 3 if any(x in "alL" for x in near) else 1 if near else 2.5
        elif k == "s":
            inside = left and right and ch not in JOINERS
            starts = right and not left and ch in "³¹²¼½¾¶¬±¦"
            cost += 3 if inside else 2 if starts else 1
        else:
            cost += 3
    return cost


def _hard(text: str) -> int:
    """Signs of garbling that good text hardly has: controls, and signs or other scripts inside words."""
    n = 0
    for m in _NON_ASCII.finditer(text):
        i, ch = m.start(), m.group()
        k = _kind(ch)
        if k == "c":
            n += 1
        elif k in "sxn" and ch not in JOINERS:
            before, after = text[i - 1 : i], text[i + 1 : i + 2]
            if before.isalpha() and after.isalpha() and (k != "n" or _kind(before) in "alL" or _kind(after) in "alL"):
                n += 1
    return n


@lru_cache(maxsize=200_000)
def _utf8_run(run: str, encoding: str) -> str:
    """One run of upper-half characters, decoded as UTF-8 where that is strictly possible and cheaper."""
    table = _to_bytes(encoding)
    out, part, raw = [], [], bytearray()

    def flush() -> None:
        if not part:
            return
        old = "".join(part)
        try:
            new = bytes(raw).decode("utf-8")
        except UnicodeDecodeError:
            new = _decode_inside(old, bytes(raw))
        out.append(new if new != old and garbling_cost(new) < garbling_cost(old) else old)
        part.clear()
        raw.clear()

    for ch in run:
        b = table.get(ord(ch))
        if b is None:
            flush()
            out.append(ch)
        else:
            part.append(ch)
            raw.append(b)
    flush()
    return "".join(out)


def _utf8_runs(text: str, encoding: str) -> str:
    # only short runs are kept, so that a text without ASCII doesn't fill the memory
    return _HIGH_RUN.sub(lambda m: (_utf8_run if len(m.group()) <= 32 else _utf8_run.__wrapped__)(m.group(), encoding), text)


_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _decode_inside(chars: str, raw: bytes) -> str:
    """Decode the valid sequences of raw and keep the characters of the rest."""
    out, at = [], 0
    for m in _SEQUENCE.finditer(raw):
        try:
            new = m.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [chars[at : m.start()], new]
        at = m.end()
    return "".join([*out, chars[at:]])


def _one_byte(text: str, read_as: str, meant: str) -> str:
    """text with each word mapped, if all its upper-half characters can be."""
    table = _one_byte_map(read_as, meant)

    def fix(m: re.Match) -> str:
        word = m.group()
        return word.translate(table) if all(ord(c) in table for c in word if c > "\x7f") else word

    return re.sub(r"\S*[^\x00-\x7f\s]\S*", fix, text)


def _mask_quoted(line: str) -> tuple[str, list[str]]:
    """A garbled sequence that stands alone between quotes is an example, and is left as it is."""
    kept: list[str] = []

    def take(m: re.Match) -> str:
        inner = m.group()[1:-1]
        if len(inner) > 1 or inner == "�":
            kept.append(inner)
            return m.group()[0] + "\x00" + m.group()[-1]
        return m.group()

    return _QUOTED.sub(take, line), kept


def _unmask(line: str, kept: list[str]) -> str:
    for k in kept:
        line = line.replace("\x00", k, 1)
    return line


def repair(text: str | None) -> tuple[str | None, bool, str]:
    """(text restored as far as possible, was it garbled, the encodings gone through).

    Null and ASCII texts come back as they are. What is lost (U+FFFD) can't be restored, but counts
    as garbled, unless it stands alone between quotes.
    """
    if text is None or text.isascii():
        return text, False, ""
    lines = text.split("\n")
    found, steps = False, []
    out: list[str] = []
    masks: list[list[str]] = []
    pairs: dict[tuple[str, str], int] = {}
    for line in lines:
        if line.isascii():
            out.append(line)
            masks.append([])
            continue
        line, kept = _mask_quoted(line.replace("\x00", ""))
        while not line.isascii():  # a layer is undone only where the cost drops, so this ends
            cost = garbling_cost(line)
            best, how = cost, ""
            new = line
            most = 0
            for enc in UTF8_READ_AS:  # the encoding that explains most characters, then the cheapest text
                t = _utf8_runs(line, enc)
                gone = len(line) - len(t)
                if gone and (c := garbling_cost(t)) < cost and (gone > most or gone == most and c < best):
                    most, best, new, how = gone, c, t, f"{enc}>utf-8"
            hard = _hard(line)
            if hard and not how:
                for pair in ONE_BYTE:
                    t = _one_byte(line, *pair)
                    if t == line or _hard(t) >= hard:
                        continue
                    if (c := garbling_cost(t)) < best - 0.5:
                        best, new, how = c, t, f"{pair[0]}>{pair[1]}"
                if how:
                    pairs[tuple(how.split(">"))] = pairs.get(tuple(how.split(">")), 0) + 1
            if not how:
                break
            found = True
            if how not in steps:
                steps.append(how)
            line = new
        if "�" in line or re.search("[\x80-\x84\x86-\x9f]", line):
            found = True
        out.append(line)
        masks.append(kept)
    if pairs:  # lines without hard signs of their own follow the rest of the document
        pair = max(pairs, key=pairs.get)
        for i, line in enumerate(out):
            if line == lines[i] and not line.isascii():
                t = _one_byte(line, *pair)
                if garbling_cost(t) <= garbling_cost(line):
                    out[i] = t
    out = [_unmask(x, k) for x, k in zip(out, masks)]
    return ("\n".join(out) if found else text), found, ",".join(steps)


REPAIR_SCHEMA = "document_id string, restored string, repairable boolean, encodings string"


def _repair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, text in zip(pdf["document_id"], pdf["content"]):
            restored, garbled, how = repair(text)
            if garbled:
                rows.append((key, restored, "�" not in restored and bool(how), how))
        yield pd.DataFrame(rows, columns=["document_id", "restored", "repairable", "encodings"])


def garbled_documents(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(document_id, restored, repairable, encodings): one row for every garbled input row.

    Rows with null text are never garbled; rows with equal keys are judged each by itself.
    """
    picked = df.select(df[key].cast("string").alias("document_id"), df[text].alias("content"))
    return picked.mapInPandas(_repair_batches, REPAIR_SCHEMA)
