import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagery.config import CorpusConfig, FieldConfig, RetrievalConfig
from passagery.functions import text as T
from passagery.operators import blocked, dense, feedback, fusion, indexed, lexical, rerank
from passagery.plans import pipeline

W = lambda c: T.word_tokens(F.col(c))


def brute_bm25(query, docs, k1=1.5, b=0.75):
    df = Counter(t for d in docs.values() for t in set(d))
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    low = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: low if x < 0 else x for t, x in raw.items()}
    return {k: sum(idf[t] * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t in query if t in d) for k, d in docs.items()}


def test_bm25_equals_brute_force(spark):
    docs = {"a": "alpha beta beta gamma", "b": "alpha delta", "c": "alpha alpha epsilon zeta eta", "d": "", "e": "beta zeta"}
    c = spark.createDataFrame(list(docs.items()) + [("n", None)], "key string, content string")
    q = spark.createDataFrame([("q1", "beta zeta beta"), ("q2", "nothing"), ("q3", None), ("q4", "alpha")], "qid string, text string")
    got = {(r["qid"], r["key"]): r["score"] for r in lexical.bm25_topk(q, "qid", W("text"), c, "key", W("content"), 10).collect()}
    want = brute_bm25("beta zeta beta".split(), {k: v.split() for k, v in docs.items()} | {"n": []})
    assert {k for q_, k in got if q_ == "q1"} == {k for k, s in want.items() if s > 0}
    assert all(abs(got["q1", k] - s) < 1e-9 for k, s in want.items() if s > 0)
    assert not any(q_ in ("q2", "q3") for q_, _ in got)
    assert lexical.bm25_topk(q, "qid", W("text"), c.limit(0), "key", W("content"), 3).count() == 0


def test_bm25_limit(spark):
    c = spark.createDataFrame([(f"t{i}", "dependency injection explained") for i in range(3)] + [(f"d{i}", f"filler text number {i}") for i in range(10)], "key string, content string")
    q = spark.createDataFrame([("q", "dependency injection")], "qid string, text string")
    assert lexical.bm25_topk(q, "qid", W("text"), c, "key", W("content"), 2).count() == 2


def lists(spark, rows):
    return spark.createDataFrame(rows, "qid string, stream string, key string, score double, rank int")


def test_minmax(spark):
    s = lists(spark, [("q", "a", k, v, i) for i, (k, v) in enumerate([("x", 10.0), ("y", 0.0), ("z", 5.0)])] + [("q", "b", "x", 3.0, 1), ("q", "b", "y", 3.0, 2)])
    got = {(r["stream"], r["key"]): r["norm"] for r in fusion.minmax(s).collect()}
    assert got == {("a", "x"): 1.0, ("a", "y"): 0.0, ("a", "z"): 0.5, ("b", "x"): 1.0, ("b", "y"): 1.0}
    turned = {(r["stream"], r["key"]): r["norm"] for r in fusion.minmax(s, invert=F.col("stream") == "a").collect()}
    assert turned["a", "x"] == 0.0 and turned["b", "x"] == 1.0


def test_fusion(spark):
    s = fusion.minmax(lists(spark, [("q", "dense", "a", 0.9, 1), ("q", "dense", "b", 0.5, 2), ("q", "sparse", "b", 7.0, 1), ("q", "sparse", "c", 1.0, 2)]))
    w = F.when(F.col("stream") == "dense", 0.7).otherwise(0.3)
    first = lambda how: fusion.order_fused(fusion.fuse(s, how, w), 1).collect()[0]
    assert first("rrf")["key"] == "b" and first("weighted_linear")["key"] == "a"
    with pytest.raises(ValueError):
        fusion.fuse(s, "sum", w)
    both = fusion.minmax(lists(spark, [("q", "dense", "a", 0.9, 1), ("q", "dense", "b", 0.1, 2), ("q", "sparse", "a", 9.0, 1), ("q", "sparse", "b", 1.0, 2)]))
    assert abs(fusion.order_fused(fusion.fuse(both, "weighted_linear", w), 1).collect()[0]["score"] - 1.0) < 1e-12


def test_variants(spark):
    rows = [("q", "original", "a", 2.0, 1), ("q", "original", "b", 1.0, 2), ("q", "rewrite", "b", 2.0, 1), ("q", "rewrite", "c", 1.0, 2), ("solo", "original", "z", 5.5, 1)]
    v = spark.createDataFrame(rows, "qid string, variant string, key string, score double, rank int")
    out = lexical.top_k(fusion.fuse_variants(v, "weighted_rrf", {"original": 1.0, "rewrite": 0.7}), 5).orderBy("qid", "rank").collect()
    assert [r["key"] for r in out if r["qid"] == "q"] == ["b", "a", "c"] and [r["score"] for r in out if r["qid"] == "solo"] == [5.5]


def test_confidence_and_agreement(spark):
    s = lists(spark, [("q", "d", "a", 0.9, 1), ("q", "d", "b", 0.5, 2), ("q", "s", "a", 4.0, 1), ("one", "d", "a", 1.0, 1)])
    fused = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2), ("one", "a", 1.0, 1)], "qid string, key string, score double, rank int")
    got = {r["qid"]: r["confidence"] for r in fusion.confidence(fused, s, "d", "s").collect()}
    assert got == {"q": 0.75, "one": 0.25}
    a = {r["qid"]: (r["agreement"], r["margin"]) for r in fusion.stream_agreement(s).collect()}
    assert a["q"] == (1.0, round((0.4 / 0.9 + 1.0) / 2, 4))


def test_boosts(spark):
    df = spark.createDataFrame([("retry", "no match", 0.4, "x.md"), ("retry", "retry here", 0.4, "x.md")], "text string, content string, score double, file_name string")
    assert [round(r["score"], 6) for r in feedback.overlap_boost(df).collect()] == [0.4, 0.6]
    g = spark.createDataFrame([("What is CI?", "CI runs tests", 0.5, "docs/Glossary.md"), ("What is CI?", "ci", 0.5, "a.md"), ("What is CI?", "cirrus", 0.5, "a.md")], df.schema)
    assert [r["score"] for r in feedback.intent_boost(g).collect()] == [2.5, 0.65, 0.5]


def test_feedback_terms(spark):
    r = spark.createDataFrame([("q", 1, "Use API-Retry-After for retry"), ("q", 2, "retry budget budget limits"), ("e", 1, None)], "qid string, rank int, content string")
    got = {x["qid"]: x["terms"] for x in feedback.terms(r, T.feedback_tokens(F.col("content")), True, 2, 4).collect()}
    assert got["q"][0] == "API-Retry-After" and len(got["q"]) == 4 and "e" not in got


def test_diversity(spark):
    r = spark.createDataFrame([("q", 1, "a", 1.0, "retry budget window"), ("q", 2, "b", 0.9, "retry budget window"), ("q", 3, "c", 0.8, "token rotation policy"), ("s", 1, "x", 1.0, "alone")], "qid string, rank int, key string, score double, content string")
    got = rerank.diversify(r, 2, 0.5).orderBy("qid", "place").collect()
    assert [(x["qid"], x["key"]) for x in got] == [("q", "a"), ("q", "c"), ("s", "x")]
    assert rerank.diversify(r.limit(0), 2).count() == 0


def test_rerank_pool(spark):
    r = spark.createDataFrame([("q", i, f"k{i}", "t", "x" * i) for i in range(1, 8)], "qid string, rank int, key string, text string, content string")
    out = rerank.rerank(r, lambda q, p: p.str.len(), 4, 2).orderBy("place").collect()
    assert [x["key"] for x in out] == ["k4", "k3"]


def test_pairwise_ranker(spark):
    rows = [(q, f"{q}{i}", float(x), float(y), float(g)) for q in ("a", "b", "c") for i, (x, y, g) in enumerate([(5, 1, 2), (4, 3, 1), (1, 2, 0), (0, 5, 0)])]
    df = spark.createDataFrame(rows, "qid string, key string, x double, y double, gain double")
    p = {r["key"]: r["prediction"] for r in rerank.PairwiseRanker(("x", "y")).fit(df).predict(df).collect()}
    assert p["a0"] > p["a1"] > p["a2"] and p["a0"] > p["a3"]
    with pytest.raises(ValueError):
        rerank.PairwiseRanker(("x",)).fit(df.where("qid = 'a'"))
    with pytest.raises(RuntimeError):
        rerank.PairwiseRanker(("x",)).predict(df)


def test_nearest_neighbours(spark):
    base = spark.createDataFrame([(i, [math.cos(i / 7), math.sin(i / 7)], "z") for i in range(30)] + [(99, None, "z")], "id long, v array<double>, key string")
    got = dense.top_k(base.where("id IN (3, 10)"), base, "id", "v", 3).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["key"]) for r in got] == [(3, 3), (3, 2), (3, 4), (10, 10), (10, 9), (10, 11)]
    split = dense.top_k(base.where("id IN (3, 10)"), base, "id", "v", 3, max_queries=1).orderBy("qid", "rank").collect()
    assert [tuple(r) for r in split] == [tuple(r) for r in got]
    assert dense.top_k(base.limit(0), base, "id", "v", 3).count() == 0


def world(spark):
    c = spark.createDataFrame(
        [("a", "Retries wait for the retry window", "Guide > Retries", "guide.md"), ("b", "Keys are stored with prefix atk_ in the vault", "Guide > API key storage", "guide.md"),
         ("c", "Cursors page through the list", "Paging", "paging.md")], "key string, content string, heading_path string, file_name string")
    q = spark.createDataFrame([("q1", "API key storage atk_"), ("q2", "how do cursors page"), ("q3", None)], "qid string, text string")
    d = spark.createDataFrame([("q1", "b", 0.9, 1), ("q1", "a", 0.5, 2), ("q2", "a", 0.7, 1), ("q2", "c", 0.6, 2)], "qid string, key string, score double, rank int")
    return q, c, d


def test_profiles(spark):
    q, c, d = world(spark)
    first = lambda df: {r["qid"]: r["key"] for r in df.where("rank = 1").collect()}
    assert first(pipeline.retrieve(q, c, None, RetrievalConfig(feedback=True, diversity=True, overlap_weight=0.2)))["q2"] == "c"
    assert first(pipeline.retrieve(q, c, d))["q1"] == "b"
    assert first(pipeline.retrieve(q, c, d, RetrievalConfig(rewrite_policy="always"), lambda df: df.withColumn("text", F.lit("cursors list"))))["q2"] is not None
    assert first(pipeline.retrieve_fields(q, c, {"qwen": d}, FieldConfig(cascade=True)))["q1"] == "b"
    assert first(pipeline.retrieve_corpus(q, c, d))["q1"] == "b"
    assert first(pipeline.retrieve_corpus(q, c, d, CorpusConfig(fusion="weighted_rrf")))["q1"] == "b"


@pytest.mark.parametrize(
    "make",
    [
        lambda: RetrievalConfig(top_k=0), lambda: RetrievalConfig(fusion="x"), lambda: RetrievalConfig(dense_weight=-1), lambda: RetrievalConfig(diversity_balance=2),
        lambda: RetrievalConfig(rewrite_policy="sometimes"), lambda: RetrievalConfig(top_k=5, ltr_depth=3), lambda: FieldConfig(candidate_depth=1), lambda: FieldConfig(b=2),
        lambda: CorpusConfig(fusion="rrf"), lambda: CorpusConfig(chunk_size=10, chunk_overlap=10), lambda: CorpusConfig(dense_weight=0, sparse_weight=0),
    ],
)
def test_settings_are_checked(make):
    with pytest.raises(ValueError):
        make()


def test_depth():
    assert RetrievalConfig().depth == 20 and RetrievalConfig(top_k=5, candidate_depth=None).depth == 30 and RetrievalConfig(ltr_depth=50).depth == 50


class Backwards:
    def predict(self, rows):
        return rows.withColumn("prediction", -F.col("sparse_score"))


def test_every_stage_takes_part(spark):
    c = spark.createDataFrame([("a", "cursor cursor cursor list", "A", "a.md"), ("b", "cursor page of the API with words", "B", "b.md"), ("c", "vault prefix", "C", "c.md"), ("d", "other words", "D", "d.md")] + [(f"f{i}", f"filler{i}", "F", "f.md") for i in range(6)],
                              "key string, content string, heading_path string, file_name string")
    q = spark.createDataFrame([("q", "API cursor")], "qid string, text string")
    keys = lambda **x: [r["key"] for r in pipeline.retrieve(q, c, None, RetrievalConfig(**x.pop("config", {})), **x).orderBy("rank").collect()]
    plain = keys()
    two = lambda df: df.withColumn("text", F.explode(F.array(F.lit("vault"), F.lit("other"))))
    assert set(plain) == {"a", "b"}
    assert set(keys(config={"expansion_policy": "always", "top_k": 4}, expander=two)) == {"a", "b", "c", "d"}
    assert keys(ranker=Backwards()) == plain[::-1]
    assert keys(config={"rerank_pool": 20, "top_k": 1}, reranker=lambda t, p: -p.str.len()) == ["a"] and keys(config={"rerank_pool": 20, "top_k": 1}, reranker=lambda t, p: p.str.len()) == ["b"]
    score = lambda on: {r["key"]: r["score"] for r in pipeline.retrieve(q, c, None, RetrievalConfig(adaptive_routing=on, fusion="rrf")).collect()}
    assert round(score(True)["b"] - score(False)["b"], 6) == 0.15 and score(True)["a"] == score(False)["a"]
    for x in ({"expansion_policy": "always"}, {"rewrite_policy": "always"}, {"rerank_pool": 20}, {"ltr_depth": 20}):
        with pytest.raises(ValueError):
            pipeline.retrieve(q, c, None, RetrievalConfig(**x))


def test_field_feedback(spark):
    q, c, d = world(spark)
    score = lambda **x: {(r["qid"], r["key"]): round(r["score"], 9) for r in pipeline.retrieve_fields(q, c, {"qwen": d}, FieldConfig(feedback_threshold=1.0, **x)).collect()}
    without, with_it = score(), score(feedback=True)
    assert with_it != without and with_it["q1", "b"] > without["q1", "b"] and score(feedback=True, feedback_weight=0.0)["q1", "b"] == without["q1", "b"]


def test_pruned_search_equals_brute_force():
    """Batches after the first are pruned; the best are the same, ties included."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    weight = {w: 0.05 if i < 10 else 1.0 + i / 7 for i, w in enumerate(words)}
    docs = [rng.choice(words[:10], 20).tolist() + rng.choice(words, rng.integers(0, 6)).tolist() for _ in range(900)]
    rows = [(f"q{q}", "t", w, weight[w]) for q in range(30) for w in {*rng.choice(words[:10], 4).tolist(), *rng.choice(words[10:], 3).tolist()}]
    terms = pd.DataFrame(rows, columns=["qid", "field", "term", "w"])
    avgdl = float(np.mean([len(d) for d in docs]))
    block = blocked.Block(terms, ["t"], {"t": avgdl})
    keys = np.array([f"k{i:04d}" for i in range(900)], object)
    top, pruned = blocked._Best(30, 5), 0
    for lo in range(0, 900, 100):
        counted = block.counts("t", docs[lo : lo + 100])
        some = block.promising("t", counted, 100, 1.2, 0.75, top.least)
        if some is None:
            s, _ = block.scores("t", counted, 100, 1.2, 0.75)
            top.add(s, s > 0, keys[lo : lo + 100])
        else:
            pruned += 1
            q, d, s = some
            top.add_cells(q[s > 0], s[s > 0], keys[lo + d[s > 0]])
    every, _ = block.scores("t", block.counts("t", docs), 900, 1.2, 0.75)
    got = {(r.q, r.key): round(r.score, 7) for r in top.rows.itertuples()}
    want = {}
    for q in range(30):
        order = sorted(range(900), key=lambda d: (-round(every[q, d], 9), keys[d]))[:5]
        want |= {(q, keys[d]): round(every[q, d], 7) for d in order if every[q, d] > 0}
    assert pruned >= 5 and got == want


def passages_and_bags(fields, passages=700, bags=60, seed=5):
    """Random passages with many ties, bags of common and rare words, and all scores by plain counting."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(40)]
    draw = lambda: rng.choice(words[:6], rng.integers(0, 4)).tolist() + rng.choice(words, rng.integers(0, 3)).tolist()
    docs = [[draw() for _ in fields] for _ in range(passages)]
    keys = [f"k{i:04d}" for i in rng.permutation(passages)]
    rows = [(f"b{q:03d}", f, w, float(1 + words.index(w) // 6)) for q in range(bags) for f in fields for w in sorted({*rng.choice(words[:8], 2).tolist(), *rng.choice(words, 2).tolist()})]
    terms = pd.DataFrame(rows, columns=["bag", "field", "term", "w"])
    avgdl = {f: float(np.mean([len(d[i]) for d in docs])) for i, f in enumerate(fields)}
    score = {}
    for bag, f, w, weight in rows:
        i = fields.index(f)
        for key, d in zip(keys, docs):
            if tf := d[i].count(w):
                score[bag, key] = score.get((bag, key), 0.0) + weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d[i]) / avgdl[f]))
    return docs, keys, terms, avgdl, score


def best_of(score, k):
    own = {}
    for (bag, key), s in score.items():
        own.setdefault(bag, []).append((-round(s, 9), key))
    return {bag: [(key, -s) for s, key in sorted(rows)[:k]] for bag, rows in own.items()}


@pytest.mark.parametrize("fields", [["t"], ["title", "body"]])
@pytest.mark.parametrize("k", [1, 5, 40])
def test_indexed_search_equals_brute_force(fields, k, monkeypatch):
    docs, keys, terms, avgdl, score = passages_and_bags(fields)
    monkeypatch.setattr(indexed, "SEGMENTS", (50, 200))
    asked, batches = indexed.Asked(terms, fields, avgdl), []
    for lo in range(0, len(docs), 90):
        own = [pa.array(keys[lo : lo + 90])] + [pa.array([d[i] for d in docs[lo : lo + 90]], pa.list_(pa.string())) for i in range(len(fields))]
        batches.append(pa.RecordBatch.from_arrays(own, names=["key", *(f"t{i}" for i in range(len(fields)))]))
    top, sizes = indexed.Top(len(asked.names), k), []
    for segment in indexed._segments(asked, iter(batches), 1.2, 0.75):
        sizes.append(segment.size)
        indexed.search(asked, segment, top)
    assert sizes == [50, 200, 200, 200, 50]
    got = {}
    for q, r, key in sorted(zip(top.q.tolist(), (-top.r).tolist(), top.key.tolist())):
        got.setdefault(asked.names[q], []).append((key, -r))
    want = best_of(score, k)
    assert {b: [key for key, _ in x] for b, x in got.items()} == {b: [key for key, _ in x] for b, x in want.items()}
    assert all(abs(a - b) < 2e-9 for bag in want for (_, a), (_, b) in zip(got[bag], want[bag]))


def test_equal_bags_are_searched_once(spark):
    terms = spark.createDataFrame([(q, "t", w, 0.1 + len(w)) for q in range(100) for w in ("cursor", "page", *(["vault"] if q % 2 else []))], "qid long, field string, term string, w double")
    asked = indexed.bags(terms)
    rows = pd.concat(list(indexed.blocks(asked, 3)))
    assert asked.count() == 100 and sorted(rows.groupby("bag")["w"].sum().round(9)) == [10.2, 15.3] and rows["bag"].nunique() == 2
    assert not len(next(indexed.blocks(asked.limit(0))))
