import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passagery import __main__ as cli
from passagery.config import CorpusConfig, FieldConfig, flat, from_flat
from passagery.functions import signals
from passagery.functions import text as T
from passagery.operators import analytics, answers, ensemble, evaluation, protocol, rerank
from passagery.plans import grids
from passagery.sources import catalog, loaders


def test_messages_and_history():
    assert answers.message_text(None) == "" and answers.message_text({"text": "a"}) == "a" and answers.message_text(["a", {"text": "b"}, None, 3]) == "a b 3"
    got = answers.normalise_history([("hi", "hello"), {"role": "system", "content": "x"}, {"role": "user", "content": [{"text": "q"}]}, {"role": "assistant", "content": ""}])
    assert got == [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "hello"}, {"role": "user", "content": "q"}] and answers.normalise_history(None) == []


def test_answers(spark):
    q = spark.createDataFrame([("a", "Why?"), ("b", "What?"), ("c", None)], "qid string, text string")
    r = spark.createDataFrame([("a", 2, "two", "f.md", 1, 0.5), ("a", 1, "one", None, None, 0.9), ("c", 1, None, "g.md", 0, 0.1)], "qid string, rank int, content string, file_name string, chunk_index int, score double")
    h = spark.createDataFrame([("a", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(7)] + [("a", 9, "system", "x")], "qid string, place int, role string, content string")

    def model(prompt, said):
        if "g.md" in prompt:
            raise RuntimeError("down")
        return json.dumps([m["content"] for m in said]) + prompt[prompt.index("--- Source") :][:40]

    got = {x["qid"]: x for x in answers.answer(q, r, model, h).collect()}
    assert got["b"]["final_answer"] == answers.NOTHING and got["b"]["retrieved_sources"] == []
    assert got["c"]["final_answer"] == "Error generating answer: down"
    assert got["a"]["final_answer"].startswith('["m3", "m4", "m5", "m6"]--- Source [1]: Unknown Source ---\none')
    assert [s["source_id"] for s in got["a"]["retrieved_sources"]] == [1, 2]
    assert answers.contexts(r).where("qid = 'a'").first()["context"].startswith("--- Source [1]: Unknown Source (Chunk ?) ---\none\n\n--- Source [2]: f.md (Chunk 1) ---")
    assert answers.answer(q.limit(0), r, model).count() == 0


def test_ensemble(spark):
    hits = spark.createDataFrame([("q", "s", "a", "k1", 0.5), ("q", "s", "b", "k1", 0.9), ("q", "s", "a", "k2", 0.9), ("q", "s", "a", "k3", 0.1)], "qid string, stream string, mode string, key string, score double")
    assert [(r["key"], r["rank"]) for r in ensemble.best_over_modes(hits, 2).orderBy("rank").collect()] == [("k1", 1), ("k2", 2)]
    modes = spark.createDataFrame([("what is KEY_A",), ("why",)], "t string").select(ensemble.instruction_modes(F.col("t"), "routed").alias("r"), ensemble.instruction_modes(F.col("t"), "ensemble").alias("e"))
    assert [r["r"] for r in modes.collect()] == [["precision"], ["ambiguity"]] and modes.first()["e"] == list(ensemble.ENSEMBLE)

    def broken():
        raise protocol.Unavailable("no weights")

    index = ensemble.StreamIndex({"x": broken, "y": lambda: lambda q, k: hits})
    assert index.errors == {"x": "no weights"} and set(index.search(hits, {"x": 1.0, "y": 0.5, "z": 1.0}, 3)) == {"y"}
    found = spark.createDataFrame([("q", "k1", 1.0)], "qid string, key string, score double")
    same, status = ensemble.hypothetical(hits, None, lambda q: found, found)
    more, done = ensemble.hypothetical(hits, lambda q: q, lambda q: found, found)
    assert (status, same.first()["score"], done, more.first()["score"]) == ("blocked", 1.0, "applied", 1.25)


def test_hits_are_resolved_by_place_then_text(spark):
    rec = spark.createDataFrame([("r1", "f", 0, "one"), ("r2", "f", 1, "two"), ("r0", "g", 0, "two")], "key string, file_name string, chunk_index int, content string")
    hits = spark.createDataFrame([("f", 1, "changed", 0.25), (None, None, "two", 0.5), ("f", 9, "none", 0.1)], "file_name string, chunk_index int, content string, distance double")
    assert sorted((r["key"], r["score"]) for r in ensemble.resolve_hits(hits, rec).collect()) == [("r0", 0.5), ("r2", 0.75)]


def test_router(spark):
    rows = [(str(i), "compare the difference across pages" if i % 2 else "explain why the concept holds", "context" if i % 2 else "semantic", i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "case string, text string, mode string, fold int")
    cv = ensemble.cross_validated_modes(df)
    assert cv.count() == 30 and cv.where("routed = mode").count() == 30
    assert ensemble.InstructionRouter().fit(df.where("mode = 'context'")).route(df.select("text")).where("mode = 'context'").count() == 30
    with pytest.raises(RuntimeError):
        ensemble.InstructionRouter().route(df)
    scored = spark.createDataFrame([("c", "generic", 0.5, 0.5), ("c", "semantic", 0.5, 0.5), ("d", "semantic", 0.6, 0.1), ("d", "generic", 0.5, 0.9)], "case string, mode string, ndcg double, mrr double")
    assert dict(map(tuple, ensemble.best_instruction(scored).collect())) == {"c": "generic", "d": "semantic"}


def test_reasons_and_lists(spark):
    q = spark.createDataFrame([("what does it do",), ("which KEY_ONE is set",), ("list",), ("how do services share one queue at night",)], "t string")
    got = [r[0] for r in q.select(signals.decision(F.col("t"), signals.gate(F.col("t")))["reasons"]).collect()]
    assert got == [["underspecified natural-language signal"], ["precision-preserving query"], ["short or non-question query"], ["long semantic question"]]
    one = spark.createDataFrame([("3; 5,x,5.9,-1",), ("",), (None,)], "t string")
    assert [r[0] for r in one.select(T.parse_numbers(F.col("t"), "int", 1, None, (7,))).collect()] == [[3, 5], [7], [7]]
    assert [r[0] for r in spark.createDataFrame([("0.7, 2, .5",)], "t string").select(T.parse_numbers(F.col("t"), "double", 0, 1)).collect()] == [[0.7, 0.5]]
    assert [r[0] for r in spark.createDataFrame([("on; ON,maybe",), ("x",)], "t string").select(T.parse_flags(F.col("t"))).collect()] == [[True], [False, True]]


def test_gains_by_kind_of_label(spark):
    res = spark.createDataFrame(
        [(c, r, ["kb/a.md", "/srv/kb/a.md"], ["kb/a.md", "/srv/kb/a.md"], [f"a::{r}"], r * 10, r * 10 + 10) for c in ("span", "chunk", "source", "none") for r in (1, 2)],
        "case string, rank int, docs array<string>, sources array<string>, aliases array<string>, start int, end int",
    )
    spans = spark.createDataFrame([("span", "s1", "a.md", 25, 40, 2.0), ("span", "s0", "a.md", 20, 21, 1.0), ("span", "x", "b.md", 0, 99, 3.0)], "case string, label string, doc string, start int, end int, gain double")
    chunks = spark.createDataFrame([("chunk", "a::1", 1.0, 0), ("span", "a::1", 9.0, 0)], "case string, label string, gain double, ordinal int")
    sources = spark.createDataFrame([("source", "a.md"), ("chunk", "a.md")], "case string, source string")
    got = sorted(map(tuple, evaluation.gains(res, spans, chunks, sources).collect()))
    assert got == [("chunk", 1, "chunk", "a::1", 1.0), ("source", 1, "source", "source", 1.0), ("source", 2, "source", "source", 1.0), ("span", 2, "span", "s0", 2.0)]
    cases = res.select("case").distinct()
    m = {r["case"]: r for r in evaluation.evaluate(cases, res, spans, chunks, sources, 2).collect()}
    assert len(m) == 4 and (m["source"]["recall"], m["source"]["ndcg"], m["none"]["recall"], m["chunk"]["mrr"], m["span"]["mrr"]) == (1.0, 1.0, 0.0, 1.0, 0.5)
    assert abs(m["span"]["recall"] - 2 / 3) < 1e-9
    r = evaluation.routing_summary(spark.createDataFrame([(True, None, False, True, 0.5, 2), (None, True, False, False, None, None)], "rewrite_applied boolean, expansion_applied boolean, prf_applied boolean, confidence_triggered boolean, confidence_score double, query_variant_count int")).first()
    assert (r["rewrite_count"], r["expansion_rate_percent"], r["average_confidence"], r["average_query_variant_count"]) == (1, 50.0, 0.5, 1.5)
    lat = evaluation.latency_summary(spark.createDataFrame([(float(i), i == 1) for i in range(1, 11)], "ms double, up boolean"), "ms", "up").first()
    assert (lat["mean_ms"], lat["p95_ms"], lat["escalation_rate_percent"]) == (5.5, 10.0, 10.0)


def test_ranker_validation(spark):
    rows = [(f"q{i}", f"k{j}", 2.0 if j == 0 else 0.0, float(3 - j) + (i % 2) * 0.1, 1.0, i % 3) for i in range(9) for j in range(4)]
    df = spark.createDataFrame(rows, "qid string, key string, gain double, dense_score double, sparse_score double, fold int")
    cv = rerank.cross_validate(df, lambda: rerank.PairwiseRanker(("dense_score", "sparse_score")), 2)
    assert cv.count() == 9 and rerank.mean_metrics(cv).first()["ndcg"] == 1.0
    pool = rerank.native_pool(
        spark.createDataFrame([("q", "a", 1)], "qid string, key string, rank int"), spark.createDataFrame([("q", "b", 1), ("q", "a", 2)], "qid string, key string, rank int"),
        spark.createDataFrame([("q", "c"), ("z", "d")], "qid string, key string"), lambda p: p.withColumn("score", F.when(F.col("key") == "b", 2.0).otherwise(1.0)),
    )
    assert sorted((r["qid"], r["key"], r["rank"]) for r in pool.collect()) == [("q", "a", 2), ("q", "b", 1), ("z", "d", 1)]


def test_protocol_runs():
    def run(spec):
        if spec["n"] == 2:
            raise protocol.InvalidChunkMapping("lost")
        if spec["n"] == 3:
            raise rerank.BackendUnavailable("weights")
        if spec["n"] == 4:
            raise KeyError("x")
        return {"ndcg": 0.1 * spec["n"], "mrr": 0.2, "recall": 0.3} if spec["n"] < 6 else {}

    specs = protocol.unique_specs([(f"s{n}", {"n": n}) for n in (1, 2, 3, 4, 5, 6)] + [("s1", {"n": 1})])
    done = protocol.run_specs(specs, run, lambda s: "no service" if s["n"] == 6 else None)
    assert [r["status"] for r in done] == ["ok", "invalid_label_mapping", "unavailable", "error", "ok", "blocked"] and set(r["status"] for r in done) == set(protocol.STATUSES)
    assert protocol.select_best(done)["name"] == "s5" and protocol.dev_then_test(specs, run, run, "s1")["selected"] == "s5"
    assert protocol.ranker_helps({"ndcg": 0.5, "mrr": 0.5}, {"ndcg": 0.6, "mrr": 0.5}) and not protocol.ranker_helps({"ndcg": 0.5, "mrr": 0.5}, {"ndcg": 0.6, "mrr": 0.4})
    with pytest.raises(ValueError):
        protocol.unique_specs([("a", {"n": 1}), ("a", {"n": 2})])


def test_grid_cases_and_frozen_split(spark, tmp_path):
    with pytest.raises(ValueError):
        protocol.grid(spark, 3, a=[1, 2], b=[1, 2])
    cases = spark.createDataFrame([(f"c{i}", "a" if i % 2 else "b", f"Q {i}") for i in range(20)], "id string, category string, question string")
    one = protocol.freeze_split(cases, str(tmp_path / "s"), "id", "category", 8)
    two = protocol.freeze_split(cases, str(tmp_path / "s"), "id", "category", 8)
    assert one["dev"].count() == 8 and sorted(r["id"] for r in two["dev"].collect()) == sorted(r["id"] for r in one["dev"].collect())
    with pytest.raises(protocol.FrozenSplitError):
        protocol.freeze_split(cases.withColumn("question", F.lit("x")), str(tmp_path / "s"), "id", "category", 8)
    spans = spark.createDataFrame([("d#a", "d", 0, 5), ("d#b", "d", 5, 9), ("d#c", "d", 9, 12)], "span_id string, document_id string, span_start int, span_end int")
    targets = spark.createDataFrame([("x", "Q?", "k", "d#a", 1.0), ("x", "Q?", "k", "d#b", 3.0)], "case string, question string, category string, span_id string, gain double")
    built = protocol.build_cases(targets, spans)
    assert [s["span_id"] for s in built.first()["labels"]] == ["d#b", "d#a"] and protocol.case_faults(built, spans, 1).count() == 0
    assert {r["fault"] for r in protocol.case_faults(built.unionByName(built), spans.limit(1), 1).collect()} == {"doubled id", "doubled question", "uneven category", "unknown span"}
    with pytest.raises(protocol.InvalidChunkMapping):
        protocol.build_cases(targets, spans.limit(1))
    assert [tuple(r) for r in protocol.adjacent_pairs(spans, "document_id", "span_start", "span_id").collect()] == [("d", "d#a", "d#b")]
    assert protocol.strided(10, 3, 8) == [8, 5, 2] and len(protocol.catalog_hash(spans.withColumn("heading", F.lit("h")))) == 64
    n = protocol.numbered(cases, "id").orderBy("n").collect()
    assert [r["n"] for r in n] == list(range(20))


def test_catalog_and_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("k1", "alpha beta"), ("k2", "beta gamma"), ("k3", None)], "key string, content string")
    catalog.open_or_build(spark, str(tmp_path / "cat"), docs, model="m", size=3)
    found = catalog.find_index(spark, str(tmp_path / "cat"), size=3)
    assert found.part("chunks").count() == 3 and catalog.find_index(spark, str(tmp_path / "cat"), size=4) is None
    more = spark.createDataFrame([("k3", "again"), ("k4", "beta delta")], "key string, content string")
    assert found.add_chunks(more).count() == 4
    assert {r["term"]: r["df"] for r in found.part("terms").collect()}["beta"] == 3 and found.part("corpus_stats").first()["n_docs"] == 4
    v = lambda *r: spark.createDataFrame(list(r), "chunk_key string, model string, representation string, embedding array<double>")
    found.put_vectors(v(("k1", "m", "raw", [1.0, 0.0]), ("k2", "m", "raw", [0.0, 1.0])))
    assert {r["chunk_key"]: r["embedding"] for r in found.put_vectors(v(("k1", "m", "raw", [0.5, 0.5]))).collect()} == {"k1": [0.5, 0.5], "k2": [0.0, 1.0]}
    assert found.dimensions([1.0, 2.0]) == (2, 2)
    with pytest.raises(catalog.IncompatibleIndexError):
        found.dimensions([1.0])
    texts = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "text string")
    assert found.encode(texts, "len", lambda t: t.map(lambda x: [float(len(x))])).count() == 2
    assert found.encode(texts, "len", lambda t: pd.Series([1 / 0] * len(t))).count() == 2  # all known: the encoder isn't called
    assert catalog.corpus_fingerprint(docs, "key", "content") == catalog.corpus_fingerprint(docs.orderBy(F.desc("key")), "key", "content") != catalog.corpus_fingerprint(docs.limit(2), "key", "content")
    loaders.write_results(spark.createDataFrame([("a|b", [1], None), ("c", [], 2)], "x string, y array<int>, z int"), str(tmp_path), "r")
    assert [r[0] for r in spark.read.text(str(tmp_path / "r.md")).collect()] == ["| x | y | z |", "|---|---|---|", "| a\\|b | [1] |  |", "| c | [] | 2 |"]
    assert spark.read.json(str(tmp_path / "r.jsonl")).count() == 2 and spark.read.option("header", True).csv(str(tmp_path / "r.csv")).columns == ["x", "y", "z"]
    kept = catalog.CachedSearch(lambda q, k: q.withColumn("rank", F.lit(1)), spark.createDataFrame([("q",), ("p",)], "qid string"), 3)
    assert kept.query(spark.createDataFrame([("q",)], "qid string"), 2).count() == 1
    with pytest.raises(ValueError):
        kept.query(kept.lists, 4)
    trials = spark.createDataFrame([(f"t{i:02d}", i % 4) for i in range(20)], "name string, score int")
    assert [r["name"] for r in analytics.top_trials(trials, "score", "name", 3).collect()] == ["t03", "t07", "t11"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# Retry\n\nThe retry budget is five.\n\n# Token\n\nTokens rotate daily.\n\n# Queue\n\nQueues drain at night.\n\n# Page\n\nPages link here.")
    (tmp_path / "in" / "b.json").write_text("{broken")
    cli.main(["ingest", str(tmp_path / "in"), str(tmp_path / "ix"), "--strategy", "heading", "--size", "200"])
    cli.main(["search", str(tmp_path / "ix"), "retry budget"])
    case = {"id": "c", "question": "retry budget", "relevance_spans": [{"document_id": "a.md", "span_id": "a.md#retry", "start": 0, "end": 20}]}
    (tmp_path / "cases.jsonl").write_text(json.dumps(case) + "\n")
    cli.main(["evaluate", str(tmp_path / "ix"), str(tmp_path / "cases.jsonl")])
    out = capsys.readouterr().out
    assert "not read: b.json" in out and "1. a.md::0" in out and "ndcg" in out


def test_grids_and_gated_rankers():
    assert len(grids.default_grid()) == 23 and len(grids.wording_grid()) == 8 and len(grids.field_grid()) == 4 and len(grids.corpus_grid()) == 19
    try:
        import xgboost.spark  # noqa: F401
    except ImportError:
        with pytest.raises(rerank.BackendUnavailable):
            rerank.LambdaRanker()


def test_settings_by_name():
    assert from_flat(CorpusConfig, flat(CorpusConfig(k1=1.5))) == CorpusConfig(k1=1.5) and from_flat(FieldConfig, {"top_k": 7}).top_k == 7
    with pytest.raises(ValueError):
        from_flat(CorpusConfig, {"k2": 1})
    with pytest.raises(ValueError):
        from_flat(CorpusConfig, {"top_k": 0})


def test_tsne_keeps_neighbours(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in np.eye(3)[i % 3] + rng.normal(0, 0.05, 3)]) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, None)], "id long, v array<double>")
    y = {r["id"]: np.array([r["x"], r["y"]]) for r in analytics.tsne(df, "id", "v").collect()}
    near = [min((j for j in y if j != i), key=lambda j: float(((y[i] - y[j]) ** 2).sum())) for i in y]
    assert len(y) == 60 and sum(i % 3 == j % 3 for i, j in zip(y, near)) >= 57
    assert analytics.tsne(df.limit(2), "id", "v").count() == 2 and analytics.tsne(df.limit(0), "id", "v").count() == 0
    with pytest.raises(ValueError):
        analytics.tsne(df, "id", "v", most=10)
