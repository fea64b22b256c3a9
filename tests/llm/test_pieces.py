import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from passagery.llm.pieces import RangeMaximum, oversized, split, split_documents


@given(st.lists(st.integers(1, 5), min_size=1, max_size=60), st.data())
def test_range_maximum(values, data):
    lo = data.draw(st.integers(0, len(values) - 1))
    hi = data.draw(st.integers(lo + 1, len(values)))
    table = RangeMaximum(np.array(values, np.int64), data.draw(st.integers(1, 80)))
    best = max(values[lo:hi])
    assert table.query(lo, hi) == max(i for i in range(lo, hi) if values[i] == best)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#=ł\t", max_size=300), st.integers(1, 60), st.integers(0, 80))
def test_pieces_cover_the_text(text, size, overlap):
    got = split(text, size, overlap)
    body = text.strip()
    if not body:
        assert got == []
        return
    lead = len(text) - len(text.lstrip())
    assert got[0][0] == lead and got[-1][1] == lead + len(body)
    assert all(0 < b - a <= size for a, b, _ in got)
    for (_, end, _), (start, _, _) in zip(got, got[1:]):
        assert end - start == min(overlap, size - 1)
    assert (len(got) > 1) == (len(body) > size)


def test_cuts_at_the_strongest_boundary():
    text = "# One\n\n" + "word " * 12 + "\n\nNext paragraph here. " + "more " * 10 + "\n## Two\nline\n" + "tail " * 20
    got = split(text, 120, 10)
    assert any(text[end:].startswith("## Two") for _, end, _ in got)
    assert got[0][2] == "One" and got[-1][2] == "One > Two"


def test_a_word_stays_whole_where_a_shorter_piece_ends_before_it():
    text = "ab " + "x" * 30 + " tail of words that goes on"
    assert [text[a:b] for a, b, _ in split(text, 32, 0)][0] == "ab "


def test_heading_in_code_is_no_heading():
    text = "# A\n\n```\n# not one\n```\n\n" + "x " * 100
    assert {p for _, _, p in split(text, 60, 0)} == {"A"}


def test_documents(spark):
    schema = "id string, content string, config_name string, size int, overlap int, c string"
    docs = spark.createDataFrame(
        [
            ("null", None, "s", 1, 1, "x"), ("empty", "  \n ", "s", 1, 1, "x"), ("fits", " abcde ", "s", 1, 1, "x"), ("long", "abcdef", "s", 1, 1, "x"),
            ("long", "abcdef", "s", 1, 1, "x"), ("default", "a " * 40, None, 1, 1, "x"), ("unknown", "a " * 4000, "nope", 1, 1, "x"),
            ("nolimit", "abc", "n", 1, 1, "x"), ("codepoints", "😀😀😀😀😀", "s", 1, 1, "x"), ("huge", "word. " * 200_000, "big", 1, 1, "x"),
        ],
        schema,
    )
    configs = spark.createDataFrame(
        [("s", 5, 9), ("phase3-base", 50, 10), ("n", None, None), (None, 1, 1), ("big", 5000, None)], "config_name string, chunk_size int, chunk_overlap int"
    )
    got = split_documents(docs, configs)
    assert {r["document_id"] for r in oversized(docs, configs).collect()} == {"long", "default", "huge"}
    by = {}
    for r in got.distinct().collect():
        by.setdefault(r["document_id"], []).append(r)
    once = split_documents(docs, configs, once=True).collect()
    assert len(once) == len(set(once)) == sum(map(len, by.values()))
    assert "null" not in by and "empty" not in by
    assert [(r["start"], r["end"]) for r in by["fits"]] == [(1, 6)]
    assert len(by["unknown"]) == len(by["nolimit"]) == len(by["codepoints"]) == 1
    assert len(by["huge"]) > 200
    assert oversized(docs.limit(0), configs).count() == 0 and oversized(docs, configs.limit(0)).count() == 0
