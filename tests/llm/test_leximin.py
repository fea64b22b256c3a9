import math
import random

from passagery.llm.leximin import leximin_first, leximin_ranking

SCHEMA = "q string, k string, a double, b double, c double, t long, g string, i string, v double"
S = ["a", "b", "c"]


def brute(rows):
    latest = {}
    for q, k, *s, t in rows:
        if q is None or k is None:
            continue
        s = [None if x is None or math.isnan(x) else x for x in s]
        order = (t is not None, t or 0, [(x is not None, x or 0) for x in s])
        if (q, k) not in latest or order > latest[q, k][0]:
            latest[q, k] = (order, s)
    out = {}
    for q in {q for q, _ in latest}:
        own = {k: s for (p, k), (_, s) in latest.items() if p == q}
        vec = {}
        for k, s in own.items():
            v = []
            for d in range(3):
                if s[d] is None:
                    v.append(0.0)
                else:
                    lower = sum(o[d] is None or o[d] < s[d] for o in own.values())
                    same = sum(o[d] == s[d] for o in own.values())
                    v.append((lower + (same + 1) / 2) / len(own))
            vec[k] = sorted(v)
        for n, k in enumerate(sorted(own, key=lambda k: ([-x for x in vec[k]], k))):
            out[q, k] = n + 1
    return out


def frame(spark, rows):
    # extra columns carry the names the operator uses inside
    return spark.createDataFrame([(*r, "x", "y", 1.0) for r in rows], SCHEMA)


def test_ranking_equals_brute_force(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, float("nan"), 0.0, -1e9, 1e-12, rng.gauss(0, 1), float(rng.randint(-3, 3)), 1e300])
    rows = [(rng.choice(["q1", "q2", "q3", None]), rng.choice(["a", "b", "c", "d", "e", "f", "h", None]), value(), value(), value(), rng.choice([None, 1, 2, 3])) for _ in range(150)]
    rows += rows[:20]
    want = brute(rows)
    for big in (20_000, 40, 1):  # groups ranked whole, some of each, and all as big groups
        got = [(r["q"], r["k"], r["position"]) for r in leximin_ranking(frame(spark, rows), "q", "k", S, ["t"], big_group=big).collect()]
        assert len(got) == len(want) and {(q, k): n for q, k, n in got} == want
        first = [(r["q"], r["k"]) for r in leximin_first(frame(spark, rows), "q", "k", S, ["t"], big_group=big).collect()]
        assert len(first) == 3 and set(first) == {k for k, n in want.items() if n == 1}


def test_weak_score_is_not_masked(spark):
    rows = [("q", "spiky", 1e9, 0.1, 0.1, 1), ("q", "even", 5.0, 0.5, 0.5, 1), ("q", "low", 0.0, 0.2, 0.2, 1)]
    assert leximin_first(frame(spark, rows), "q", "k", S, ["t"]).collect()[0]["k"] == "even"


def test_ties_missing_and_empty(spark):
    rows = [("q", "b", None, None, None, None), ("q", "a", float("nan"), None, None, None)]
    for big in (20_000, 1):
        got = leximin_ranking(frame(spark, rows), "q", "k", S, ["t"], big_group=big).orderBy("position").collect()
        assert [(r["k"], r["position"], r["v2"]) for r in got] == [("a", 1, 0.0), ("b", 2, 0.0)]
    assert leximin_ranking(frame(spark, []), "q", "k", S, ["t"]).count() == 0
    assert leximin_first(frame(spark, []), "q", "k", S, ["t"]).count() == 0


def test_hot_group_with_one_value_and_near_equal_values(spark):
    rng = random.Random(6)
    rows = [("hot", f"k{i:04d}", 0.5 if i % 3 else None, 0.99 + rng.random() * 1e-4, float(i % 5), 1) for i in range(400)]
    rows += [("cold", f"k{i}", rng.random(), rng.random(), rng.random(), 1) for i in range(9)]
    got = {(r["q"], r["k"]): r["position"] for r in leximin_ranking(frame(spark, rows), "q", "k", S, ["t"], big_group=100).collect()}
    assert got == brute(rows)
