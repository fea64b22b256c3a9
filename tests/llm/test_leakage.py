import random

from passagery.llm import leakage
from passagery.llm.leakage import LeakIndex, lcs_length, leaked_items, plain_words

rng = random.Random(11)
WORDS = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]


def passage(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def longest_run(a, b):
    best, last = 0, {}
    for x in a:
        cur = {}
        for j, y in enumerate(b):
            if x == y:
                cur[j] = last.get(j - 1, 0) + 1
                best = max(best, cur[j])
        last = cur
    return best


def test_lcs():
    for _ in range(50):
        a, b = [rng.choice("abc") for _ in range(12)], [rng.choice("abc") for _ in range(15)]
        t = [[0] * 16 for _ in range(13)]
        for i in range(12):
            for j in range(15):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(a, b) == t[12][15]


def test_words_without_markup_and_breaks():
    text = "<p>The **key-\nring** of [a](b.md) &amp; [[relay_x|page]],\n\\textbf{done}\n> “Quoted”</p> exam\xadple"
    assert plain_words(text) == ["the", "keyring", "of", "a", "relayx", "done", "quoted", "example"]
    assert plain_words("") == []


def test_no_leak_is_missed(spark):
    """Against brute force over every document and item."""
    items = [(i, passage(rng.randint(48, 110))) for i in range(60)]
    docs = []
    for d in range(150):
        own = items[rng.randrange(60)][1].split()
        kind = d % 6
        k = rng.randrange(len(own) - 30)
        if kind == 0:
            inside = own[k : k + 20]
        elif kind == 1:
            inside = own[k : k + 19]
        elif kind == 2:
            inside = [w if rng.random() > 0.12 else "other" for w in own]
        elif kind == 3:
            inside = [x for w in own for x in ([w, "extra"] if rng.random() < 0.15 else [w])]
        elif kind == 4:
            inside = rng.sample(own, len(own))
        else:
            inside = []
        docs.append((d, passage(rng.randint(0, 80)) + " zz " + " ".join(inside) + " yy " + passage(rng.randint(0, 200))))
    ix = LeakIndex(items)
    want = set()
    for d, t in docs:
        words = plain_words(t)
        for i, (key, x) in enumerate(items):
            own = plain_words(x)
            width = int(1.5 * len(own)) + 1
            share = max(lcs_length(own, words[s : s + width]) for s in range(max(1, len(words) - len(own) // 2))) / len(own)
            if longest_run(words, own) >= 20 or share >= 0.75:
                want.add((d, key))
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, has_run string")
    held = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in leaked_items(frame, held).collect()}
    assert got == want and len(want) > 60 and len(ix.keys) == 60
    parts = {(r["doc_id"], r["item_id"]) for r in leaked_items(frame, held, max_items=25).collect()}  # several indexes
    assert parts == want
    known, leakage.CELLS = leakage.CELLS, 8  # passages a few at a time
    try:
        runs, wholes = ix.candidates([plain_words(t) for _, t in docs])
    finally:
        leakage.CELLS = known
    assert (runs, wholes) == ix.candidates([plain_words(t) for _, t in docs])


def test_stock_sentences_and_odd_rows(spark):
    stock = " ".join(WORDS[i] for i in range(30)) + "."
    items = [(i, passage(50).capitalize() + ". " + stock) for i in range(5)] + [(9, None), (None, "x"), (10, ""), (11, "too short")]
    held = spark.createDataFrame(items, "item_id long, text string")
    whole = items[2][1]
    docs = spark.createDataFrame([(1, stock * 3), (2, whole), (2, whole), (3, None), (None, whole), (4, ""), (5, passage(100_000) + " " + whole.upper())], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, held).collect()} == {(2, 2), (5, 2)}
    assert {(r["doc_id"], r["item_id"]) for r in leaked_items(docs, held, max_items=4).collect()} == {(2, 2), (5, 2)}
    assert leaked_items(docs.limit(0), held).count() == 0 and leaked_items(docs, held.limit(0)).count() == 0
