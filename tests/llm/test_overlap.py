import random

import numpy as np
import pytest

from passagery.llm.overlap import FullTextIndex, WaveletMatrix, canonical, may_be_name, merged_lengths, one_slip, overlap_report, overlaps, same_sense, tokens


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(5)
    for n, most in ((1, 2), (63, 3), (64, 2), (65, 40), (1000, 300)):
        x = rng.integers(0, most, n)
        m = WaveletMatrix(x)
        assert (m.at(np.arange(n)) == x).all()
        s, i = rng.integers(0, most, 300), rng.integers(0, n + 1, 300)
        assert m.rank(s, i).tolist() == [int((x[:b] == a).sum()) for a, b in zip(s, i)]


def test_backward_search_equals_brute_force():
    rng = random.Random(3)
    texts = [([rng.choice("abcd") for _ in range(rng.randint(0, 6))], [rng.choice("efgh") for _ in range(rng.randint(0, 6))]) for _ in range(40)]
    index = FullTextIndex(texts)
    for _ in range(200):
        p = [rng.choice("abcde") for _ in range(rng.randint(1, 4))]
        lo, hi = (int(x[0]) for x in index.find([np.array([index.ids.get(t, -1) for t in p])]))
        at = [k for k, (a, b) in enumerate(texts) for s in (a, b) for i in range(len(s)) if s[i : i + len(p)] == p]
        assert max(hi - lo, 0) == len(at) and (set(index.owners(lo, hi)) if hi > lo else set()) == set(at)
    lo, hi = index.find([index.encode(a, []) for a, _ in texts])
    for (a, _), x, y in zip(texts, lo, hi):
        assert set(index.owners(x, y)) == {k for k, (b, _) in enumerate(texts) if a == b}


def test_maximal_matches_cover_the_shared_tokens():
    rng = random.Random(4)
    texts = [(sorted(rng.sample("abcdef", rng.randint(0, 4))), sorted(rng.sample("ghijklmn", rng.randint(0, 7)))) for _ in range(50)]
    index = FullTextIndex(texts)
    asked = [(sorted(rng.sample("abcdef", 3)), sorted(rng.sample("ghijklmnxyz", 5))) for _ in range(60)]
    owners = np.array([rng.randrange(50) for _ in asked])
    k, start, end = index.maximal_matches([index.encode(*q) for q in asked], owners)
    got = merged_lengths(len(asked), k, start, end) - 2
    want = [len({*q[0]} & {*texts[o][0]}) + len({*q[1]} & {*texts[o][1]}) for q, o in zip(asked, owners)]
    assert got.tolist() == want
    assert FullTextIndex([]).find([np.array([1])])[0].tolist() == FullTextIndex([]).find([np.array([1])])[1].tolist()


def split(text):
    got = tokens(text)
    names = {t for t, name in got if name}
    return names, {t for t, _ in got} - names


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("What is the upper limit of X_ONE in relay-x?", "  In relay-x, what is teh uper limit of x_one", True),
        ("What is the upper limit of X_ONE in relay-x?", "What is the lower limit of X_ONE in relay-x?", False),
        ("What is the upper limit of X_ONE in relay-x?", "What is the lowr limit of X_ONE in relay-x?", False),
        ("What is the upper limit of X_ONE in relay-x?", "What is the upper limit of X_TWO in relay-x?", False),
        ("What is the upper limit of X_ONE in relay-x?", "What is the upper limit of X_ONE in relay-y?", False),
        ("What happens if a-b stays above 9 percent?", "What happens if a-b stays above 90 percent?", False),
        ("Hi team, what happens if a-b stays above 9 percent? Thanks!", "WHAT HAPPENS IF A-B STAYS ABOVE 9 PERCENT", True),
        ("Which error does a-b return when c.d is enabled?", "Which errro does a-b return when c.d is disabled?", False),
        ("Does a-b retry c.d when it stops?", "Does a-b not retry c.d when it stops?", False),
        ("Which error does a-b return when c.d is enabled?", "Which error does a-b give when c.d is enabled?", True),
    ],
)
def test_same_question(a, b, same):
    (na, wa), (nb, wb) = split(a), split(b)
    assert (na == nb and same_sense(len(na), wa, wb, frozenset(), 0.7)) == same


def test_unknown_words_part_questions():
    x, y = {"when", "does", "zorblatter", "stop"}, {"when", "does", "zorblatten", "stop"}
    assert same_sense(2, x, y, frozenset(), 0.7) and not same_sense(2, x, y, {"zorblatter", "zorblatten"}, 0.7)
    assert same_sense(2, x, y, {"zorblatten"}, 0.7) and not same_sense(2, x, y - {"zorblatten"}, {"zorblatter"}, 0.7)


def test_tokens_of_odd_texts():
    assert tokens("") == [] and tokens("?!…") == []
    assert canonical(set(), set()) == ("", "") and canonical({"b", "a"}, {"of", "limit", "a"}) == ("a b", "limit of")
    assert one_slip("teh", "the") and one_slip("uper", "upper") and not one_slip("12", "123") and not one_slip("a", "b")


def test_pairs_and_report(spark):
    base = "Which error does relay-x return when KEY_{} is enabled without an owner?"
    rows = [(i, "train", "m", base.format(i)) for i in range(40)]
    rows += [(100 + i, "dev" if i % 2 else "test", None if i == 3 else "m", base.format(i).replace("Which", "Please tell me: which")) for i in range(5)]
    rows += [rows[0], (200, "dev", "m", None), (201, None, "m", base.format(1)), (None, "dev", "m", base.format(1)), (202, "dev", "m", ""), (203, "train", "m", base.format(0))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "case_no long, split_name string, ground_truth_origin string, question string, hard string, split string")
    want = {(i, 100 + i) for i in range(5)} | {(203, 100)}
    for shard, block in ((20_000, 50_000), (10, 15)):  # one shard, and shards cut into parts and blocks
        got = [(r["train_case"], r["eval_case"]) for r in overlaps(df, shard_rows=shard, block_rows=block).collect()]
        assert set(got) == want and len(got) == len(want)
    rep = {(r["split_name"], r["ground_truth_origin"]): (r["cases"], r["overlapping"], r["pairs"]) for r in overlap_report(df).collect()}
    assert rep["dev", None] == (1, 1, 1) and rep["test", "m"] == (3, 3, 4) and rep["dev", "m"] == (3, 1, 1)
    assert overlaps(df.limit(0)).count() == 0 and overlaps(df.where("split_name = 'train'")).count() == 0


@pytest.mark.parametrize(
    "train, held",
    [
        ("how often does anchor-auditor need to refresh mirrordonikoluku before the nightly export? Thanks!", "How often does anchor-auditor need to refresh MirrorDonikoluku before the nightly export?"),
        ("How often on Mondays does anchor-auditor need to refresh mirrordonikoluku before the nightly export?", "How often on Mondays does anchor-auditor need to refresh MirrorDonikoluku before the nightly export?"),
        ("what does relay-x write to key_1 overnight at the branch office", "What does relay-x write to KEY_1 overnight at the branch office?"),
        ("which time-out does relay-x use for key_1 of the branch office", "Which timeout does relay-x use for KEY_1 of the branch office?"),
    ],
)
def test_both_sides_are_split_alike(spark, train, held):
    other = held.replace("MirrorDonikoluku", "MirrorDonikolaku").replace("KEY_1", "KEY_2")
    rows = [(1, "train", "m", train), (2, "dev", "m", held), (3, "test", "m", other)]
    df = spark.createDataFrame(rows, "case_no long, split_name string, ground_truth_origin string, question string")
    assert [(r["train_case"], r["eval_case"]) for r in overlaps(df).collect()] == [(1, 2)]


@pytest.mark.parametrize("rows", [0, 3000])
def test_verdict_does_not_depend_on_the_size_of_the_table(spark, rows):
    """A word that few or many other questions use: the pair is found either way."""
    schema = "case_no long, split_name string, ground_truth_origin string, question string"
    more = [(10 + i, "train", "m", f"What is the throughput of Relay-{i}k{i} at night?") for i in range(rows)]
    pair = [(1, "train", "m", "What is the throughput of Relay-X?"), (2, "dev", "m", "what is the throughput of relay-x?")]
    got = overlaps(spark.createDataFrame(pair + more, schema)).collect()
    assert [(r["train_case"], r["eval_case"]) for r in got] == [(1, 2)]


def test_hot_group_of_equal_names_equals_brute_force(spark):
    """A third of all questions name the same service; narrowing by counts loses no pair."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("lag", "pump", "store", "queue", "mirror", "ticket") for b in ("ing", "er", "age", "let", "wise")]
    asked = [" ".join(["relay-x", *rng.sample(words, rng.randint(4, 8))]) for _ in range(300)]
    asked += [" ".join([*reversed(q.split()[:-1]), "often"]) for q in asked[:80]]
    rows = [(i, "train" if i % 3 else "dev", "m", q) for i, q in enumerate(asked)]
    df = spark.createDataFrame(rows, "case_no long, split_name string, ground_truth_origin string, question string")
    unknown = {w for q in asked for w, n in tokens(q) if not n and may_be_name(w)}  # no question has capitals
    want = set()
    for i, s, _, q in rows:
        for j, t, _, p in rows:
            if s == "train" and t == "dev":
                x, y = {w for w, n in tokens(q) if not n}, {w for w, n in tokens(p) if not n}
                if 2 * (len(x & y) + 1) >= 0.5 * (len(x) + len(y) + 2) and same_sense(1, x, y, unknown, 0.7):
                    want.add((i, j))
    assert want and {(r["train_case"], r["eval_case"]) for r in overlaps(df, shard_rows=500).collect()} == want
