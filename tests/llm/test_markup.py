import pytest

from passagery.llm.markup import clean_records, clean_text, markup_kinds, parse, records, tree_rows


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("# Title\n\n**bold** and [a](b.md)", {"markdown"}),
        ("<p>One &amp; two</p>", {"html"}), ("caf&eacute;", {"html"}), ("a <!-- note --> b", {"html"}), ("Two<br/>lines", {"html"}),
        ("== Head ==\n\n'''bold''' [[page|shown]]", {"wiki"}), ("{{stub|2024}}", {"wiki"}), ("{|\n! a\n|-\n| b\n|}", {"wiki"}),
        ("\\section{A}\n\\textbf{b} $k_{1}$", {"latex"}), ("\\[n \\leq 2^{k}\\]", {"latex"}),
        ("| a | b |\n|---|---:|\n| 1 | 2 |", {"markdown"}), ("- [ ] to do", {"markdown"}),
        ("## <em>Batch</em> '''x'''", {"markdown", "html", "wiki"}),
        ("```html\n<b>x</b> [[y]] \\textbf{z}\n```", {"markdown"}), ("<pre><code># no **md**</code></pre>", {"html"}),
        ("\\begin{verbatim}\n# no\n<b>no</b>\n\\end{verbatim}", {"latex"}),
        # signs used literally
        ("a < b and c > d, x <= y", set()), ("from $5 to $7 and then to $12.", set()), ("in $ per seat of max_log_count", set()),
        ("The pattern *.log matches 3 * 4 files.", set()), ("if [[ -f lock ]] with [ -d lock ]", set()), ("C:\\section\\items\\new", set()),
        ("marks (*) and (**) are. marks (*) and (**) are.", set()), ("List<String> and Map<K, V>", set()), ("AT&T and R&D; 5 %", set()),
        ("C# and F# use issue #42", set()), ("[optional] flags and {placeholder}", set()), ("_private_name_ and __init__", set()),
        ("Score == 1 means, != 0 none", set()), ("<ops desk> before 10 ~ 12", set()), ('{\n  "a": {"b": 1}}', set()), ("", set()), (None, set()),
    ],
)
def test_kinds(text, kinds):
    assert parse(text).kinds == kinds


def test_structure_stays():
    md = "# Head\n\nSome **bold** text.\n\n- one\n- [ ] two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```sh\nls *\n```\n\n$$x^{2}$$"
    assert clean_text(md) == "# Head\n\nSome bold text.\n\n- one\n- two\n\na | b\n1 | 2\n\n```\nls *\n```\n\n$$x^{2}$$"
    page = "<h2 id='a'>Head</h2><ul><li>one</li><li><b>two</b></li></ul><table><tr><td>1</td><td>2</td></tr></table><script>x</script>"
    assert clean_text(page) == "## Head\n\n- one\n- two\n\n1 | 2"
    tex = "\\section{Head}\n\n\\begin{itemize}\n\\item a\\_b \\emph{x \\textbf{y}}\n\\end{itemize}\nThe $k_{1}$ one.~\\cite{z}"
    assert clean_text(tex) == "# Head\n\n- a_b x y\n\nThe $k_{1}$ one."
    wiki = "== Head ==\n\n* a\n{| class=\"t\"\n! k !! v\n|-\n| 1 || 2\n|}\n'''b''' [[x|shown]] {{note|kept}}"
    assert clean_text(wiki) == "## Head\n\n- a\n\nk | v\n1 | 2\n\nb shown kept"


def test_very_long_lines_end():
    assert parse("$" + '{"a": "b"} ' * 100_000).kinds == set()
    assert parse("[" * 50_000 + "'" * 3001 + "*" * 5000).kinds <= {"wiki"}
    deep = "<div>" * 20_000 + "x" + "</table>" * 20_000 + "</div>" * 20_000 + "y"
    assert clean_text(deep) == "x\n\ny" and len(tree_rows(parse(deep))) == 20_003


def test_style_tree_drops_what_all_pages_share(spark):
    nav = "<div class='nav'>All pages of this site</div>"
    docs = [(str(i), f"host/p{i}.html", f"{nav}<h1>Same title</h1><p>Own words of page {i} here.</p>") for i in range(30)]
    docs += [("other", "small/p.html", nav), ("null", "host/n.html", None), ("null-path", None, "plain"), ("0", docs[0][1], docs[0][2])]
    d = spark.createDataFrame([(*r, "h", 1) for r in docs], "id string, file_name string, content string, host string, n int")
    s = spark.createDataFrame([("d", "s1", "**Bold**", "k"), ("d", None, "x", "k"), (None, "s2", None, "k")], "document_id string, span_id string, heading string, h string")
    rows = records(d, s)
    clean = {(r["source_table"], r["record_key"]): r["clean"] for r in clean_records(rows).collect()}
    assert clean["documents_in", "7"] == "# Same title\n\nOwn words of page 7 here."
    assert clean["documents_in", "other"] == "All pages of this site"
    assert clean["documents_in", "null-path"] == "plain" and clean["spans", "s1"] == "Bold" and len(clean) == 33
    kinds = {tuple(r) for r in markup_kinds(rows).collect()}
    assert ("spans", "s1", "markdown") in kinds and ("documents_in", "3", "html") in kinds and len(kinds) == 32
    assert markup_kinds(rows.limit(0)).count() == 0 and clean_records(rows.limit(0)).count() == 0


def test_long_formulas_and_deep_nesting():
    assert parse("The \\(" + "x + y + " * 700 + "z\\) holds.").kinds == {"latex"}
    assert parse("the \\( open " * 20_000).kinds == set()
    nested = "\\emph{" * 12 + "core" + "}" * 12
    assert clean_text(f"\\section{{A}}\n\n{nested}") == "# A\n\ncore"


def test_tree_has_parents_and_kinds_come_from_nodes():
    dom = parse("<div class='nav'><ul><li>one</li><li>two</li></ul></div>\n\n# Head\n\ntext with **bold**\n\n## Sub\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nplain &amp; $k_{1}$")

    def way(i):
        return (way(dom.nodes[i].parent) if dom.nodes[i].parent > 0 else []) + [dom.nodes[i].element]

    ways = {dom.nodes[i].raw.strip("\x06 "): way(i) for i in range(len(dom.nodes)) if dom.nodes[i].raw}
    assert ways["one"] == ["block", "block", "list", "li"] and ways["a | b"] == ["section", "section", "table", "row"]
    assert ways["text with **bold**"] == ["section", "p"] and all(n.parent < i for i, n in enumerate(dom.nodes))
    kinds = {n.raw.strip("\x06 "): n.kinds for n in dom.nodes if n.raw}
    assert kinds["one"] == {"html"} and kinds["text with **bold**"] == {"markdown"} and kinds["1 | 2"] == set()
    assert next(k for r, k in kinds.items() if r.startswith("plain")) == {"html", "latex"}
    assert dom.kinds == {"html", "markdown", "latex"}


def test_a_whole_branch_of_boilerplate_goes(spark):
    """A navigation block goes as one branch, with the one link that only one page has in it; a varied block of the same host stays."""
    pages = []
    for i in range(40):
        nav = "<div class='nav'><ul><li>Home</li><li>Guides</li><li>Status</li>" + ("<li>Now here</li>" if i == 3 else "") + "</ul></div>"
        own = f"<div class='main'><h1>Page {i}</h1><ul><li>step {i}</li><li>Home</li></ul><p>Text {i} of its own.</p></div>"
        pages.append((f"d{i}", f"host/p{i}.html", nav + own))
    docs = spark.createDataFrame(pages, "id string, file_name string, content string")
    spans = spark.createDataFrame([], "document_id string, span_id string, heading string")
    clean = {r["record_key"]: r["clean"] for r in clean_records(records(docs, spans)).collect()}
    assert clean["d5"] == "# Page 5\n\n- step 5\n\nText 5 of its own."
    assert clean["d3"] == "# Page 3\n\n- step 3\n\nText 3 of its own."
