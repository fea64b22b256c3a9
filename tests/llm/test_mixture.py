import numpy as np
import pandas as pd

from passagery.llm.mixture import Mixer, block_uses, quotas, shard_uses, split_tree

TARGETS = "source string, target_share double, max_repeats int, tokens int, b int"


def test_tree_draws_exact_quotas():
    counts = np.array([70, 20, 9, 0])
    leaves = split_tree(counts, 8, np.random.default_rng(1))
    assert (leaves.sum(axis=0) == counts).all() and leaves.sum(axis=1).max() - leaves.sum(axis=1).min() <= 3


def test_quotas_and_uses():
    blocks = pd.DataFrame({"source": ["a"] * 4 + ["b"] * 2, "b": [0, 1, 2, 3, 0, 1], "tokens": [100, 100, 100, 100, 50, 50]})
    targets = pd.DataFrame({"source": ["a", "b", "none"], "target_share": [0.5, 0.45, 0.05], "max_repeats": [1, 2, 5]})
    plan = quotas(blocks, targets).set_index("source")
    assert plan["wanted"].round(6).to_dict() == {"a": 250.0, "b": 225.0, "none": 25.0}
    uses, lack = block_uses(blocks, plan.reset_index(), 3)
    assert {k: round(v, 6) for k, v in lack.items()} == {"a": 0.0, "b": 25.0, "none": 25.0}
    size = {("a", i): 100 for i in range(4)} | {("b", i): 50 for i in range(2)}
    given = uses.groupby("source").apply(lambda x: sum(size[x.name, b] * p for b, p in zip(x["b"], x["part"])), include_groups=False).to_dict()
    assert abs(given["a"] - 250) < 1 and abs(given["b"] - 200) < 1
    assert uses.groupby(["source", "b"])["pass_no"].nunique().max() <= 2
    placed = shard_uses(uses, 3, 3)
    assert len(placed) == len(uses) and placed["shard"].between(0, 2).all()


def test_mixture(spark):
    rows = [(i, "word " * (5 + i % 7), ["A ", "a", " b", "C"][i % 4], "x", 1) for i in range(400)]
    rows += [(1000, None, "a", "x", 1), (1001, "", "b", "x", 1), (1002, "w", None, "x", 1), (None, "w w", "c", "x", 1), (1003, "w", "elsewhere", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, s string, tokens int")
    targets = spark.createDataFrame([("a", 0.45, 1, 0, 0), ("b", 0.35, 1, 0, 0), ("c", 0.15, 3, 0, 0), ("d", 0.05, 2, 0, 0), (None, 0.1, 1, 0, 0)], TARGETS)
    report = {r["source"]: r for r in Mixer(docs, targets).report().collect()}
    assert {s for s, r in report.items() if r["short"]} == {"b", "d"}
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    mixed = Mixer(docs, targets, blocks=16, shards=4).mixture().toPandas()
    got = mixed.groupby("source")["tokens"].sum()
    for s in ("a", "b", "c"):
        assert abs(got[s] - report[s]["given"]) <= 20 and abs(got[s] - min(report[s]["wanted"], 3 * report[s]["tokens"])) <= 20 or s == "b"
    whole = Mixer(docs, targets)
    drawn = whole.mixture().groupBy("source").sum("tokens").toPandas().set_index("source")["sum(tokens)"]  # the report is of what is drawn
    again = {r["source"]: r for r in whole.report().collect()}
    assert all(again[s]["given"] == drawn[s] and abs(again[s]["actual_share"] - drawn[s] / drawn.sum()) < 1e-12 for s in drawn.index)
    assert mixed[mixed["source"] != "c"].groupby("doc_id").size().max() == 1
    assert set(mixed["shard"]) == {0, 1, 2, 3}
    assert Mixer(docs.limit(0), targets).report().where("short").count() == 0  # nothing is wanted of an empty mixture
    assert Mixer(docs.limit(0), targets).mixture().count() == 0 and Mixer(docs, targets.limit(0)).report().count() == 0
