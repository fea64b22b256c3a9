"""Problem 3: markup residue (HTML, Markdown, wiki, LaTeX) turned into clean text, by site style trees.

Every record is parsed into a DOM: containers (sections, lists, tables, HTML blocks) with their
children, down to headings, list items, table rows, code, formulas and paragraphs; every node knows the
presentation it was written in, and so the kinds of markup. The DOMs of one host (the first part of the
file name) are merged into a style tree of paths: how varied the children of a container are over the
pages, and how varied the content of a leaf, give their importance by entropy; a container takes its
own and that of its children. Branches that look alike on most pages of the host carry little and are
removed from each page; what stays is written out with headings, lists, tables, code and formulas still
shown as such.

Records are parsed once. Only hashes of nodes are shuffled for the tree, with counts combined before the
shuffle; joins are salted, so a hot host or a sentence that all pages share is spread.
"""

from __future__ import annotations

import html
import html.entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagery.llm.skew import salted_join, small_or_salted_join
from passagery.runtime import cut_lineage

KINDS = ("html", "markdown", "wiki", "latex")

#: Names of HTML elements.
TAGS = (
    "a|abbr|address|article|aside|b|big|blockquote|body|br|button|caption|center|cite|code|col|colgroup|dd|del|details|dfn|div|dl|dt|em|"
    "fieldset|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|legend|li|link|main|mark|meta|"
    "nav|noscript|ol|option|p|picture|pre|q|s|samp|script|section|select|small|source|span|strike|strong|style|sub|summary|sup|svg|table|"
    "tbody|td|textarea|tfoot|th|thead|time|title|tr|tt|u|ul|var|video|wbr"
)
_ATTR = r"(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+))?)*"
_TAG = re.compile(rf"<(/?)({TAGS})({_ATTR})\s*/?>", re.I)
_COMMENT = re.compile(r"<!--.*?-->|<!doctype[^>]*>|<\?xml[^>]*\?>|<!\[CDATA\[|\]\]>", re.S | re.I)
_DEAD = re.compile(rf"<(script|style|head|noscript)\b{_ATTR}\s*>.*?</\1\s*>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")

_CODE = re.compile(
    r"^[ \t>]*(?P<f>`{3,}|~{3,})(?P<fi>[^\n`]*)\n(?P<ft>.*?)(?:^[ \t>]*(?P=f)[`~]*[ \t]*$|\Z)"
    r"|<pre\b[^<>]*>(?P<ht>.*?)(?:</pre\s*>|\Z)"
    r"|\\begin\{(?P<v>verbatim|lstlisting|minted)\*?\}(?P<vt>.*?)(?:\\end\{(?P=v)\*?\}|\Z)"
    r"|<(?P<w>nowiki|syntaxhighlight|source)\b[^<>]*>(?P<wt>.*?)</(?P=w)\s*>",
    re.S | re.M | re.I,
)
_DISPLAY = re.compile(
    r"\$\$(?P<a>(?:[^\n]|\n(?!\s*\n))+?)\$\$|\\\[(?P<b>(?:[^\n]|\n(?!\s*\n))+?)\\\]"
    r"|\\begin\{(?P<e>equation|align|gather|multline|displaymath|eqnarray)\*?\}(?P<c>.+?)\\end\{(?P=e)\*?\}",
    re.S,
)
_INLINE_CODE = re.compile(r"(?<!`)(`+)(?!`)([^`\n]+?)(?<!`)\1(?!`)")

_MARKDOWN = re.compile(
    r"^[ \t>]*#{1,6}[ \t]+\S"
    r"|^[ \t]*>[ \t]+\S"
    r"|^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]"
    r"|^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*$"
    r"|(?<![\w*\\])\*\*(?=[^\s*).,;:])[^*\n]*?[^\s*(]\*\*(?![\w*])"
    r"|(?<![\w*\\/.])\*(?=[^\s*).,;:])(?:[^*\n]*[^\s*(])?\*(?![\w*.])"
    r"|(?<!~)~~(?=\S)[^~\n]+?(?<=\S)~~(?!~)"
    r"|!?\[[^\[\]\n]+\]\((?:[^()\s]+|<[^<>\n]+>)(?:\s+\"[^\"\n]*\")?\)"
    r"|^\[[^\]\n]+\]:[ \t]+\S+|\[\^[\w-]+\]",
    re.M,
)
_WIKI = re.compile(
    r"^[ \t]*(={2,6})[ \t]*[^=\s\n](?:[^\n]*?[^=\s\n])?[ \t]*\1[ \t]*$"
    r"|\[\[(?![\s,])(?![\d\s,.\"'-]+\]\])[^\[\]\n]*?[^\s\[\]]\]\]"
    r"|'{2,5}(?=[^\s'])[^'\n]+(?:'[^'\n]+)*?'{2,5}"
    r"|\{\{(?=[A-Za-z#!:])[^{}\n]*\}\}"
    r"|^[ \t]*\{\|[^\n]*$|^[ \t]*\|\}[ \t]*$"
    r"|__(?:TOC|NOTOC|NOEDITSECTION|FORCETOC)__|<(?:ref|references)\b[^<>]*/?>|\[https?://\S+ [^\]\n]+\]",
    re.M,
)
_LATEX = re.compile(
    r"(?<![\w:\\/.])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|~\\(?:cite|ref)\b|^[ \t]*\\(?:item|maketitle|newpage|noindent|tableofcontents|par)\b|(?<=\w)\\_(?=\w)",
    re.M,
)


def _has_entity(text: str) -> bool:
    return any(m.group(1) is None or f"{m.group(1)};" in html.entities.html5 for m in _ENTITY.finditer(text))


CONTAINERS = frozenset("root section list table block".split())


@dataclass
class Node:
    """A node of the DOM: its element, the presentation it was written in, its parent, its source and the kinds of markup in that."""

    element: str
    style: str
    parent: int
    raw: str = ""
    kinds: frozenset[str] = frozenset()
    text: str | None = None


@dataclass
class Dom:
    """The nodes in the order of the text; the first is the root, and every parent stands before its children."""

    nodes: list[Node] = field(default_factory=lambda: [Node("root", "root", -1)])
    masks: _Masks | None = None
    latex: bool = False

    @property
    def kinds(self) -> set[str]:
        return {k for n in self.nodes for k in n.kinds}

    def clean(self) -> list[Node]:
        """The nodes with their clean text, which is made once."""
        for n in self.nodes:
            if n.text is None:
                if n.element in ("code", "math"):
                    n.text = n.raw
                elif n.element in CONTAINERS:
                    n.text = ""
                else:
                    own = self.masks.inline(_inline(n.raw.replace("\x06", ""), self.latex)).strip()
                    n.text = own if n.element == "p" else re.sub(r"\s*\n\s*", " ", own)
        return self.nodes


class _Masks:
    """Code and formulas taken out of the text, so that nothing in them is read as markup; each with its kind of markup."""

    def __init__(self) -> None:
        self.kept: list[tuple[str, str, str]] = []

    def put(self, what: str, text: str, block: bool, kind: str) -> str:
        self.kept.append((what, text, kind))
        mark = f"\x02{len(self.kept) - 1}\x02"
        return f"\n{mark}\n" if block else mark

    def inline(self, text: str) -> str:
        return _MARK.sub(lambda m: self.show(int(m.group(1))), text) if self.kept else text

    def show(self, k: int) -> str:
        what, text, _ = self.kept[k]
        return f"${text}$" if what == "math" else text


_MARK = re.compile("\x02(\\d+)\x02")


def _mask(text: str) -> tuple[str, _Masks]:
    masks = _Masks()

    def code(m: re.Match) -> str:
        if m["f"]:
            kind, body = "markdown", m["ft"]
        elif m["ht"] is not None:
            kind, body = "html", html.unescape(_TAG.sub("", m["ht"]))
        elif m["v"]:
            kind, body = "latex", m["vt"]
        else:
            kind, body = "wiki", m["wt"]
        return masks.put("code", body.strip("\n"), True, kind)

    text = _CODE.sub(code, text)
    text = _INLINE_CODE.sub(lambda m: masks.put("tick", m.group(2).strip(), False, "markdown"), text)
    text = _DISPLAY.sub(lambda m: masks.put("math", (m["a"] or m["b"] or m["c"]).strip(), True, "latex"), text)
    if "$" in text or "\\(" in text:
        text = "\n".join(_inline_math(line, lambda own: masks.put("math", own.strip(), False, "latex")) for line in text.split("\n"))
    return text, masks


def _inline_math(line: str, put: Callable[[str], str]) -> str:
    """line with its $...$ and \\(...\\) formulas put away; amounts of money, in which no sign of mathematics stands, stay."""
    out, last, at = [], 0, line.find("\\(")
    while at >= 0 and (end := line.find("\\)", at + 3)) >= 0:
        out += [line[last:at], put(line[at + 2 : end])]
        last = end + 2
        at = line.find("\\(", last)
    line = "".join([*out, line[last:]])
    at = [m.start() for m in re.finditer(r"\$", line)]
    out, last, k = [], 0, 0
    while k + 1 < len(at):
        a, b = at[k], at[k + 1]
        own = line[a + 1 : b]
        before, after = line[a - 1 : a], line[b + 1 : b + 2]
        fits = own and not own[0].isspace() and not own[-1].isspace() and own[-1] != "\\"
        if fits and re.search(r"[\\^{]", own) and not re.match(r"[\\\w]", before) and not re.match(r"\w", after):
            out += [line[last:a], put(own)]
            last = b + 1
            k += 2
        else:
            k += 1
    return "".join([*out, line[last:]])


_BLOCKS = re.compile(r"^(?:p|div|section|article|main|table|ul|ol|dl|blockquote|details|summary|figure|form|header|footer|nav|aside|body|html)$")
_CLASS = re.compile(r"\b(?:class|role)\s*=\s*[\"']?([\w-]+)", re.I)


def _tag_marks(m: re.Match) -> str:
    """Marks in place of a tag: \\x04 opens an element of a style, \\x05 closes a block, \\x06 tells that a tag stood here."""
    close, tag, attrs = m.group(1), m.group(2).lower(), m.group(3) or ""
    c = _CLASS.search(attrs)
    style = tag + (f".{c.group(1)}" if c else "")
    if _LEAF.fullmatch(tag):
        return "\x06\n" if close else f"\n\x04{style}\x04"
    if tag in ("td", "th"):
        return "\x06 | " if close else "\x06"
    if tag in ("br", "hr"):
        return "\x06\n"
    if _BLOCKS.match(tag):
        if tag == "p":
            return "\x06\n\n" if close else f"\n\n\x04{style}\x04"
        return f"\n\n\x05{tag}\x05\n" if close else f"\n\n\x04{style}\x04\n"
    if tag == "img" and (alt := re.search(r"alt\s*=\s*[\"']([^\"']*)", attrs)):
        return "\x06" + alt.group(1)
    return "\x06"


_LEAF = re.compile(r"h[1-6]|li|tr|dt|dd")


def _inline(text: str, latex: bool) -> str:
    """Text of a block without inline markup."""
    text = re.sub(r"!?\[([^\[\]\n]*)\]\((?:[^()\s]+|<[^<>\n]+>)(?:\s+\"[^\"\n]*\")?\)", r"\1", text)
    while True:  # every round that changes the text makes it shorter
        new = re.sub(r"\[\[(?![\s,])(?:[^\[\]|\n]*\|)?([^\[\]|\n]*?[^\s\[\]])\]\]", r"\1", text)
        new = re.sub(r"\{\{[A-Za-z#!:][^{}|\n]*(?:\|([^{}\n]*))?\}\}", lambda m: m.group(1) if m.group(1) and not m.group(1).isdigit() else "", new)
        new = re.sub(r"(?<![\w*\\])\*\*(?=[^\s*).,;:])([^*\n]*?[^\s*(])\*\*(?![\w*])", r"\1", new)
        new = re.sub(r"(?<![\w*\\/.])\*(?=[^\s*).,;:])((?:[^*\n]*[^\s*(])?)\*(?![\w*.])", r"\1", new)
        new = re.sub(r"(?<!~)~~(?=\S)([^~\n]+?)(?<=\S)~~(?!~)", r"\1", new)
        new = re.sub(r"'{2,5}(?=[^\s'])([^'\n]+(?:'[^'\n]+)*?)'{2,5}", r"\1", new)
        if latex:
            new = re.sub(r"~?\\(?:cite|ref|label|pageref|index|footnotemark)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", new)
            new = re.sub(r"(?<![\w:/.])\\(?!begin|end)[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"\1", new)
        if new == text:
            break
        text = new
    if latex:
        text = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?", "", text)
        text = re.sub(r"\\([_&%#${}])", r"\1", text)
    text = re.sub(r"<(?:ref|references)\b[^<>]*/?>|</ref>|__(?:TOC|NOTOC|NOEDITSECTION|FORCETOC)__|\[\^[\w-]+\]", "", text)
    return html.unescape(text) if "&" in text else text


_HEAD = re.compile(r"^[ \t>]*(#{1,6})[ \t]+(.*?)[ \t#]*$|^[ \t]*(={2,6})[ \t]*([^=\s\n].*?)[ \t]*\3[ \t]*$")
_TEX_HEAD = re.compile(r"^[ \t]*\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{(.*)\}[ \t]*$")
_TEX_LEVEL = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_LIST = re.compile(r"^([ \t]*)(?:[-*+]|\d{1,3}[.)]|\\item(?:\[[^\]]*\])?)[ \t]+(?:\[[ xX]\][ \t]+)?(.*)$")
_SEPARATOR = re.compile(r"^[ \t]*\|?(?:[ \t]*:?-{3,}:?[ \t]*\|)+(?:[ \t]*:?-{3,}:?)?[ \t]*$")
_RULE = re.compile(r"^[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*$")


class _Builder:
    """Puts nodes under their parents: open HTML blocks, sections by heading level, lists and tables."""

    def __init__(self, dom: Dom, present: tuple[tuple[str, re.Pattern], ...], entities: bool):
        self.dom, self.present, self.entities = dom, present, entities
        self.open: list[tuple[int, str, int]] = [(0, "root", 0)]  # (node, tag or "section", level)
        self.tags: Counter[str] = Counter()  # how many blocks of each tag are open
        self.group: int | None = None

    def kinds(self, raw: str) -> frozenset[str]:
        out = {k for k, pattern in self.present if pattern.search(raw)}
        if "\x06" in raw or self.entities and "&" in raw and _has_entity(raw):
            out.add("html")
        if "\x02" in raw:
            out.update(self.dom.masks.kept[int(k)][2] for k in _MARK.findall(raw))
        return frozenset(out)

    def add(self, element: str, style: str, raw: str, kinds: frozenset[str] | None = None, parent: int | None = None) -> int:
        self.dom.nodes.append(Node(element, style, self.open[-1][0] if parent is None else parent, raw, self.kinds(raw) if kinds is None else kinds))
        return len(self.dom.nodes) - 1

    def note(self, kinds: frozenset[str]) -> None:
        """Markup that belongs to no leaf is that of the innermost container."""
        if kinds:
            node = self.dom.nodes[self.open[-1][0]]
            node.kinds |= kinds

    def heading(self, level: int, style: str, raw: str, kinds: frozenset[str]) -> None:
        self.group = None
        while self.open[-1][1] == "section" and self.open[-1][2] >= level:
            self.open.pop()
        self.open.append((self.add("section", f"s{level}", "", frozenset()), "section", level))
        self.add(f"h{level}", style, raw, kinds)

    def item(self, element: str, style: str, raw: str, kinds: frozenset[str]) -> None:
        kind = "list" if element == "li" else "table"
        if self.group is None or self.dom.nodes[self.group].element != kind:
            self.group = self.add(kind, kind, "", frozenset())
        self.add(element, style, raw, kinds, self.group)

    def leaf(self, element: str, style: str, raw: str, kinds: frozenset[str]) -> None:
        self.group = None
        self.add(element, style, raw, kinds)

    def block(self, style: str) -> None:
        self.group = None
        tag = style.partition(".")[0]
        self.open.append((self.add("block", style, "", frozenset(("html",))), tag, 0))
        self.tags[tag] += 1

    def close(self, tag: str) -> None:
        self.group = None
        if self.tags[tag]:
            while (gone := self.open.pop()[1]) != tag:
                self.tags[gone] -= 1
            self.tags[tag] -= 1
        else:
            self.note(frozenset(("html",)))


def parse(text: str | None) -> Dom:
    """The DOM of a record. Null and empty texts have a root without children and no markup."""
    dom = Dom()
    if not text or not text.strip():
        return dom
    text = re.sub("[\x02\x04-\x06]", "", text).replace("\r\n", "\n").replace("\r", "\n")
    text, dom.masks = _mask(text)
    if "<" in text:
        text = _TAG.sub(_tag_marks, _COMMENT.sub("\x06 ", _DEAD.sub("\x06 ", text)))
    # a pattern that the whole text lacks need not be sought in each node
    present = tuple((k, p) for k, p in (("markdown", _MARKDOWN), ("wiki", _WIKI), ("latex", _LATEX)) if p.search(text))
    masked = {m[2] for m in dom.masks.kept}
    own = {k for k, _ in present} | masked
    dom.latex, wiki, markdown = "latex" in own, "wiki" in own, "markdown" in own
    tree = _Builder(dom, present, "&" in text)
    para: list[str] = []
    para_style, in_table = "p", False
    html_mark = frozenset(("html",))

    def flush() -> None:
        nonlocal para_style
        if para:
            raw = "\n".join(para)
            shown = [re.sub(r"^[ \t]*>[ \t]?", "", x) for x in para] if markdown else para
            tree.leaf("p", para_style, "\n".join(shown), tree.kinds(raw) | (html_mark if para_style != "p" else frozenset()))
            para.clear()
        para_style = "p"

    def item(element: str, style: str, raw: str, kinds: frozenset[str]) -> None:
        if raw.strip(" \t\x06"):
            flush()
            (tree.heading(int(element[1]), style, raw, kinds) if element[0] == "h" else tree.item(element, style, raw, kinds))
        else:
            tree.note(kinds)

    for line in text.split("\n"):
        mark = ""
        if "\x05" in line:
            flush()
            for tag in re.findall("\x05([^\x05]*)\x05", line):
                tree.close(tag)
            line = re.sub("\x05[^\x05]*\x05", "", line)
        if "\x04" in line:
            marks = re.findall("\x04([^\x04]*)\x04", line)
            line = re.sub("\x04[^\x04]*\x04", "", line)
            leaves = [m for m in marks if _LEAF.match(m) and _LEAF.fullmatch(m.partition(".")[0]) or m.partition(".")[0] == "p"]
            for m in marks:
                if m not in leaves:
                    flush()
                    tree.block(m)
            mark = next((m for m in leaves if m.partition(".")[0] != "p"), leaves[-1] if leaves else "")
        bare = line.strip(" \t\x06") if "\x06" in line else line.strip()
        tag = mark.partition(".")[0]
        shown = html_mark if mark else frozenset()
        if (m := _MARK.fullmatch(bare)) and dom.masks.kept[int(m.group(1))][0] != "tick":
            what, body, kind = dom.masks.kept[int(m.group(1))]
            flush()
            tree.leaf(what, what, body, shown | {kind} | (html_mark if "\x06" in line else frozenset()))
        elif _HX.fullmatch(tag):
            item(tag, mark, line, shown | tree.kinds(line))
        elif tag == "tr":
            item("row", mark, re.sub(r"(?:\s*\|\s*)+$", "", line.replace("\x06", "")), shown | tree.kinds(line))
        elif tag in ("li", "dt", "dd"):
            item("li", mark, line, shown | tree.kinds(line))
        elif not bare:
            flush()
            tree.group = None
            tree.note(shown | (html_mark if "\x06" in line else frozenset()))
        elif m := _HEAD.match(line):
            level = len(m.group(1) or m.group(3))
            item(f"h{level}", "md" if m.group(1) else "wiki", m.group(2) if m.group(1) else m.group(4), tree.kinds(line))
        elif m := _TEX_HEAD.match(line):
            item(f"h{_TEX_LEVEL[m.group(1)]}", "tex", m.group(2), tree.kinds(line))
        elif _SEPARATOR.match(line) or _RULE.match(line):
            flush()
            tree.note(tree.kinds(line))
        elif wiki and (bare.startswith("{|") or bare.startswith("|}") or bare.startswith("|-")):
            flush()
            tree.note(tree.kinds(line))
            in_table = not bare.startswith("|}")
        elif in_table and bare[0] in "|!":
            item("row", "wikitable", re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", " | ", bare[1:]), tree.kinds(line))
        elif bare.startswith("|") and bare.endswith("|") and bare.count("|") > 2:
            item("row", "table", " | ".join(c.strip() for c in bare.strip("|").split("|")), tree.kinds(line))
        elif m := _LIST.match(line):
            item("li", "list", m.group(2), tree.kinds(line))
        elif dom.latex and _TEX_LINE.fullmatch(bare):
            flush()
            tree.note(tree.kinds(line))
        else:
            if mark:
                flush()
                para_style = mark
            para.append(line)
    flush()
    return dom


_HX = re.compile(r"h[1-6]")
_TEX_LINE = re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?|\\(?:maketitle|newpage|noindent|tableofcontents|par)")


def render(nodes: list[tuple[str, str]]) -> str:
    """Clean text of (element, text) leaves: "#" before headings, "-" before list items, "|" between cells, fences around code, "$$" around formulas."""
    out: list[str] = []
    last = ""
    for element, text in nodes:
        if not text and element != "code":
            continue
        if element[0] == "h":
            s = "#" * int(element[1]) + " " + text
        elif element == "li":
            s = "- " + text
        elif element == "code":
            s = "```\n" + text + "\n```"
        elif element == "math":
            s = "$$" + text + "$$"
        else:
            s = text
        tight = element in ("li", "row") and last == element
        out.append(("\n" if tight else "\n\n" if out else "") + s)
        last = element
    return "".join(out)


def records(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(source_table, record_key, host, text): contents of documents and headings of spans; the host is the first folder."""
    def of(df: DataFrame, name: str, key: str, path: str, text: str) -> DataFrame:
        folder = F.lower(F.element_at(F.split(F.coalesce(F.replace(F.col(path), F.lit("\\"), F.lit("/")), F.lit("")), "/"), 1))
        return df.select(F.lit(name).alias("source_table"), F.col(key).cast("string").alias("record_key"), folder.alias("host"), F.col(text).alias("text"))

    both = of(docs, "documents_in", "id", "file_name", "content").unionByName(of(spans, "spans", "span_id", "document_id", "heading"))
    return both.where("record_key IS NOT NULL AND text IS NOT NULL")


def markup_kinds(rows: DataFrame) -> DataFrame:
    """(source_table, record_key, markup): one row for each kind of markup among the nodes of a record's DOM."""

    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(s, k, m) for s, k, t in zip(pdf["source_table"], pdf["record_key"], pdf["text"]) for m in sorted(parse(t).kinds)]
            yield pd.DataFrame(out, columns=["source_table", "record_key", "markup"])

    return rows.select("source_table", "record_key", "text").mapInPandas(kinds, "source_table string, record_key string, markup string").distinct()


def clean_text(text: str | None) -> str:
    """The clean text of one record by itself, without a style tree."""
    return render([(n.element, n.text) for n in parse(text).clean() if n.element not in CONTAINERS])


_NODE = "n:int,parent:int,element:string,text:string,path:long,look:long,first:boolean,first_text:boolean,h:long"
TREE = f"source_table string, record_key string, host string, nodes array<struct<{_NODE}>>"


def _hash(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def tree_rows(dom: Dom) -> list[tuple]:
    """The nodes of a page as the style tree sees them.

    path is the way from the root, by element and style; look, of a container, the order of its
    children, runs of one kind taken as one; first and first_text tell the first node of the page on
    its path, and the first with its text there, so that counts of nodes are counts of pages.
    """
    nodes = dom.clean()
    children: list[list[str]] = [[] for _ in nodes]
    paths: list[str] = []
    for n in nodes:
        name = f"{n.element}.{n.style}"
        paths.append(name if n.parent < 0 else f"{paths[n.parent]}/{name}" if len(paths[n.parent]) < 400 else f"{_hash(paths[n.parent])}/{name}")
        if n.parent >= 0 and (not children[n.parent] or children[n.parent][-1] != name):
            children[n.parent].append(name)
    seen: set[int] = set()
    seen_text: set[tuple[int, int]] = set()
    out = []
    for i, n in enumerate(nodes):
        path = _hash(paths[i])
        h = _hash(" ".join(n.text.lower().split())) if n.element in JUDGED else 0
        out.append((i, n.parent, n.element, n.text, path, _hash(" ".join(children[i])), path not in seen, (path, h) not in seen_text, h))
        seen.add(path)
        seen_text.add((path, h))
    return out


#: Leaves that may be boilerplate; headings, code and formulas never are.
JUDGED = frozenset(("p", "li", "row"))


def site_trees(rows: DataFrame) -> DataFrame:
    """(source_table, record_key, host, nodes): every record parsed, for the style tree and for writing."""

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split(":")[0] for x in _NODE.split(",")]
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                nodes = [[dict(zip(names, r)) for r in tree_rows(parse(t))] for t in part["text"]]
                yield part[["source_table", "record_key", "host"]].assign(nodes=nodes)

    return rows.select("source_table", "record_key", "host", "text").mapInPandas(trees, TREE)


def container_importance(nodes: DataFrame, min_pages: int) -> DataFrame:
    """(host, path, own, looks): how varied the children of each container are over its pages, by entropy to the base of their number.

    Containers on fewer than min_pages pages are not judged and don't come out.
    """
    look = nodes.where(F.col("element").isin(*sorted(CONTAINERS)) & F.col("first")).groupBy("host", "path", "look").agg(F.count("*").alias("p"))
    total = look.groupBy("host", "path").agg(F.sum("p").alias("m"), F.sum(F.col("p") * F.log("p")).alias("plogp"), F.count("*").alias("looks"))
    varied = (F.log("m") - F.col("plogp") / F.col("m")) / F.log("m")
    return total.where(F.col("m") >= min_pages).select("host", "path", varied.alias("own"), F.col("looks").cast("int").alias("looks"))


def leaf_importance(nodes: DataFrame, min_pages: int) -> DataFrame:
    """(host, path, h, content): 1 - log f / log m for a text met on f of the m pages that have its path; under min_pages it isn't judged."""
    leaves = nodes.where(F.col("element").isin(*sorted(JUDGED)) & F.col("first_text"))
    text = leaves.groupBy("host", "path", "h").agg(F.count("*").alias("f"), F.count_if("first").alias("one"))
    pages = text.groupBy("host", "path").agg(F.sum("one").alias("m"))
    often = text.where(F.col("f") >= min_pages).select("host", "path", "h", "f")
    judged = salted_join(often, pages.where(F.col("m") >= min_pages), ["host", "path"], F.col("h"))
    return judged.select("host", "path", "h", (1 - F.log("f") / F.log("m")).alias("content"))


def pruned(nodes: list[dict], own: dict[int, tuple[float, int]], content: dict[int, float], damping: float, least: float) -> list[tuple[str, str]]:
    """The leaves of a page that stay.

    A leaf has its content's importance; a container with k looks has (1 - damping^k) of its own and
    damping^k of the mean of its children's. Branches below least go, unless they hold a heading, code
    or a formula; what isn't judged has importance 1.
    """
    n = len(nodes)
    imp, fixed = [1.0] * n, [x["element"] not in JUDGED and x["element"] not in CONTAINERS for x in nodes]
    total, many = [0.0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if nodes[i]["element"] in CONTAINERS:
            a, k = own.get(i, (1.0, 1))
            inner = total[i] / many[i] if many[i] else 1.0
            imp[i] = (1 - damping**k) * a + damping**k * inner
        else:
            imp[i] = content.get(i, 1.0)
        up = nodes[i]["parent"]
        if up >= 0:
            total[up] += imp[i]
            many[up] += 1
            fixed[up] = fixed[up] or fixed[i]
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[nodes[i]["parent"]] or imp[i] < least and not fixed[i]
    return [(x["element"], x["text"]) for i, x in enumerate(nodes) if not gone[i] and x["element"] not in CONTAINERS]


def clean_records(rows: DataFrame, damping: float = 0.9, least: float = 0.2, min_pages: int = 10) -> DataFrame:
    """(source_table, record_key, clean): the clean text of every record, without unimportant branches.

    Records that come again with equal key and text give one row; an empty text stays empty. Hosts and
    texts on fewer than min_pages pages are never judged.
    """
    # equal records are dropped by hash, so their texts aren't shuffled
    keyed = rows.withColumn("h", F.xxhash64("source_table", "record_key", "host", "text"))
    trees = cut_lineage(site_trees(keyed.dropDuplicates(["h"])).withColumn("record", F.monotonically_increasing_id()))
    nodes = trees.select("record", "host", F.explode("nodes").alias("x")).select("record", "host", "x.n", "x.element", "x.path", "x.look", "x.first", "x.first_text", "x.h")
    low = small_or_salted_join(
        nodes.where(F.col("element").isin(*sorted(JUDGED))), leaf_importance(nodes, min_pages), ["host", "path", "h"], F.col("record")
    ).select("record", F.struct("n", F.col("content").alias("v"), F.lit(0).alias("k")).alias("x"))
    own = small_or_salted_join(
        nodes.where(F.col("element").isin(*sorted(CONTAINERS))), container_importance(nodes, min_pages), ["host", "path"], F.col("record")
    ).select("record", F.struct("n", F.col("own").alias("v"), F.col("looks").alias("k")).alias("x"))
    judged = low.unionByName(own).groupBy("record").agg(F.collect_list("x").alias("judged"))  # nodes of one page

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = []
            for nodes, judged in zip(pdf["nodes"], pdf["judged"]):
                known = [] if judged is None else judged
                own = {x["n"]: (x["v"], x["k"]) for x in known if x["k"] > 0}
                text.append(render(pruned(list(nodes), own, {x["n"]: x["v"] for x in known if x["k"] == 0}, damping, least)))
            yield pdf[["source_table", "record_key"]].assign(clean=text)

    joined = trees.join(judged, "record", "left").select("source_table", "record_key", "nodes", "judged")
    return joined.mapInPandas(write, "source_table string, record_key string, clean string")
