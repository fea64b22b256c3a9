import hashlib
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagery.functions import draws
from passagery.operators import analytics, chunking, evaluation, protocol
from passagery.plans import lab
from passagery.sources import cases, catalog, loaders, pages
from passagery.streaming import ingest

DOC = "# Guide\n## Retries\nUse the original key.\n## Limits\nWait for reset."


def test_character_split():
    assert chunking.character_split("", 10, 0) == []
    assert chunking.character_split("x" * 50, 10, 0) == ["x" * 10] * 5
    parts = chunking.character_split("aaaa bbbb cccc dddd eeee ffff", 20, 5)
    assert all(set(a.split()) & set(b.split()) for a, b in zip(parts, parts[1:])) and len(parts) > 1


@pytest.mark.parametrize("strategy", list(chunking.STRATEGIES))
def test_strategies_address_the_source(strategy):
    text = "# Root\n\nFirst paragraph here.\n\nSecond one.\n\n## Child\n\n" + "Long text. " * 60 + "\n\n# Sibling\n\nEnd."
    got = chunking.chunks_of(text, strategy, 120, 20)
    assert got and all(0 <= p.start < p.end <= len(text) for p in got)
    if strategy != "heading_context":  # a piece joined over collapsed separators isn't a part of the text, but has a place
        assert all(text[p.start : p.end] == p.text for p in got if p.text in text)
    assert got[0].heading_path.startswith("Root") and got[-1].heading_path.startswith("Sibling")
    with pytest.raises(ValueError):
        chunking.chunks_of(text, "lines", 10)


def test_offsets_and_paths():
    got = chunking.character(DOC, 24, 0)
    assert all(DOC[p.start : p.end] == p.text for p in got) and got[1].heading_path.startswith("Guide")
    assert chunking.paragraphs("a\n\n \nb c\n\n\n") == [(0, 1), (5, 9)] or chunking.paragraphs("a\n\n \nb c\n\n\n")[0] == (0, 1)


def test_chunk_documents(spark):
    d = spark.createDataFrame([("1", "g.md", DOC, 0), ("2", "n.md", None, 0), ("3", "e.md", "", 0), ("4", "long.md", "word " * 50_000, 0)], "id string, file_name string, content string, chunk_index int")
    got = chunking.chunk_documents(d, "character", 1000, 200)
    assert {r["document_id"] for r in got.select("document_id").distinct().collect()} == {"1", "4"}
    assert chunking.chunk_documents(d.limit(0), "heading", 100).count() == 0
    spans = chunking.heading_spans(spark.createDataFrame([("g.md", DOC + "\n## Limits\nx")], "file_name string, content string")).orderBy("span_start").collect()
    assert [s["span_id"] for s in spans] == ["g.md#guide", "g.md#retries", "g.md#limits", "g.md#limits-2"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


R = "case string, rank int, doc string, start int, end int"
L = "case string, label string, doc string, start int, end int, gain double"


def test_span_overlap(spark):
    labels = frame(spark, [("c", "s", "a.md", 100, 200, 3.0)], L)
    hit = lambda *r: evaluation.match_spans(frame(spark, [("c", 1, *r)], R), labels).count()
    assert hit("a.md", 150, 240) == 1 and hit("b.md", 150, 240) == 0 and hit("a.md", 200, 240) == 0 and hit("a.md", None, None) == 0


def test_metrics(spark):
    c = frame(spark, [("c",), ("miss",)], "case string")
    labels = frame(spark, [("c", "s", "a", 0, 10, 1.0)], L)
    m = {r["case"]: r for r in evaluation.case_metrics(c, frame(spark, [("c", 2, "s", 1.0)], "case string, rank int, label string, gain double"), labels, 3).collect()}
    assert (m["c"]["recall"], m["c"]["mrr"]) == (1.0, 0.5) and abs(m["c"]["precision"] - 1 / 3) < 1e-9 and abs(m["c"]["ndcg"] - 0.6309) < 1e-4
    assert m["miss"]["ndcg"] == 0.0
    twice = frame(spark, [("c", 1, "s", 1.0), ("c", 2, "s", 1.0)], "case string, rank int, label string, gain double")
    once = evaluation.case_metrics(c, twice, labels, 5).where("case = 'c'").collect()[0]
    assert (once["recall"], once["ndcg"], once["precision"]) == (1.0, 1.0, 0.2)
    assert evaluation.case_metrics(c, twice, labels, 5, once=False).where("case = 'c'").collect()[0]["ndcg"] > 1
    graded = frame(spark, [("c", "a", "d", 0, 1, 3.0), ("c", "b", "d", 1, 2, 1.0)], L)
    g = evaluation.case_metrics(c, frame(spark, [("c", 2, "b", 1.0)], "case string, rank int, label string, gain double"), graded, 3).where("case = 'c'").collect()[0]
    assert g["recall"] == 0.5 and 0 < g["ndcg"] < 1


def test_aliases_and_sources(spark):
    r = spark.createDataFrame([("c", 1, ["x::0", "p/x::0", None]), ("c", 2, ["y::1"])], "case string, rank int, aliases array<string>")
    lab = spark.createDataFrame([("c", "p/x::0", 3.0, 0), ("c", "x::0", 1.0, 1)], "case string, label string, gain double, ordinal int")
    assert [tuple(x) for x in evaluation.match_aliases(r, lab).collect()] == [("c", 1, "p/x::0", 3.0)]
    res = spark.createDataFrame([("c", 1, "docs/readme.md"), ("c", 2, "other.md")], "case string, rank int, source string")
    src = spark.createDataFrame([("c", "readme.md"), ("c", "")], "case string, source string")
    assert [x["rank"] for x in evaluation.match_sources(res, src).collect()] == [1]


def test_bootstrap(spark):
    p = spark.createDataFrame([(0, 0.5, 0.6), (1, 0.6, 0.7), (2, 0.7, 0.8)], "n long, a double, b double")
    a, b = evaluation.bootstrap_delta(p, 200).collect()[0], evaluation.bootstrap_delta(p, 200).collect()[0]
    assert abs(a["observed"] - 0.1) < 1e-9 and a == b and not a["crosses_zero"]
    assert evaluation.bootstrap_delta(p.limit(0)).collect()[0]["low"] is None


def test_keywords_and_histogram(spark):
    k = spark.createDataFrame([("Use UV sync", ["uv sync", "pip"]), ("x", []), ("x", None), (None, ["a"])], "ans string, kw array<string>")
    assert [r["keyword_rate"] for r in evaluation.keyword_rate(k, "ans", "kw").collect()] == [0.5, 1.0, 1.0, 0.0]
    h = evaluation.rank_histogram(frame(spark, [("a",), ("b",)], "case string"), frame(spark, [("a", 2)], "case string, rank int"), 3)
    assert {r["bucket"]: r["cases"] for r in h.collect()} == {"1": 0, "2": 1, "3": 0, "miss": 1}


def test_splits(spark):
    c = spark.createDataFrame([(f"{cat}{i}", cat) for cat in "abcde" for i in range(12)], "id string, category string")
    s = protocol.stratified_split(c, "id", "category", 40)
    n = {(r["category"], r["split"]): r["count"] for r in s.groupBy("category", "split").count().collect()}
    assert all(n[x, "dev"] == 8 and n[x, "test"] == 4 for x in "abcde")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, protocol.stratified_split(c, "id", "category", 40).collect()))
    protocol.check_split(c, {"dev": s.where("split = 'dev'"), "test": s.where("split = 'test'")}, "id")
    with pytest.raises(protocol.FrozenSplitError):
        protocol.check_split(c, {"dev": s.where("split = 'dev'"), "test": s}, "id")
    dev, test = protocol.exact_split({"a": ["1", "2", "3"]}, {"a": 2})
    assert len(dev) == 2 and sorted(dev + test) == ["1", "2", "3"]


def test_folds(spark):
    rows = spark.createDataFrame([(f"q{i % 5}", i) for i in range(10)], "q string, x int")
    f = protocol.grouped_folds(rows, "q", 5).groupBy("fold").agg(F.count_distinct("q").alias("q"), F.count("*").alias("n")).collect()
    assert len(f) == 5 and all(r["q"] == 1 and r["n"] == 2 for r in f)
    with pytest.raises(ValueError):
        protocol.grouped_folds(rows, "q", 1)


def test_selection(spark):
    rows = [("a", "ok", 0.80, 0.9, 0.5, 0.2, 3.0, 5), ("b", "ok", 0.795, 0.7, 0.5, 0.2, 1.0, 1), ("c", "error", 0.99, 1.0, 1.0, 1.0, 1.0, 1)]
    r = spark.createDataFrame(rows, "name string, status string, ndcg double, mrr double, recall double, precision double, elapsed double, complexity int")
    assert [x["name"] for x in protocol.rank_results(r).orderBy("place").collect()] == ["a", "b"]
    assert protocol.select_simplest(r.where("status = 'ok'")).collect()[0]["name"] == "b"
    with pytest.raises(protocol.InvalidChunkMapping):
        protocol.check_labels(r.select("name"), r.where("name = 'a'").select("name"), "name")


def test_groups(spark):
    d = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",), (" ",), (None,)], "g string").withColumn("g", analytics.metadata_group(F.col("g"), "x"))
    got = {r["g"]: r["count"] for r in analytics.collapse_rare(d, "g", 2).groupBy("g").count().collect()}
    assert got == {"a": 5, "b": 3, "other": 3}
    assert analytics.auto_clusters(500) == 12 and analytics.auto_perplexity(100) == 10


def test_case_labels(spark):
    lines = [json.dumps(x) for x in (
        {"id": "m", "relevance": {"A\\b.md::2": 3, "x": "no", "y": 0}}, {"id": "l", "relevance": ["p::0", {"chunk_id": "q::1", "gain": 2}]},
        {"id": "e", "expected_chunk_ids": {"z": "odd"}}, {"id": "s", "relevance_spans": [{"document_id": "d", "span_id": "d#s", "start": 1, "end": 5, "gain": 3}, {"start": 5, "end": 1}]},
        {"question": "o", "expected_source": "README.md"})] + ["", "not json"]
    got = {(r["case"], r["kind"], r["label"], r["gain"]) for r in cases.labels(spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")).collect()}
    assert got == {("m", "chunk", "a/b.md::2", 3.0), ("l", "chunk", "p::0", 1.0), ("l", "chunk", "q::1", 2.0), ("e", "chunk", "z", 1.0), ("s", "span", "d#s", 3.0), ("o", "source", "readme.md", 1.0)}


def test_loaders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes("zażółć\n".encode("latin-1", "replace") + b"\xe9")
    (tmp_path / "b.csv").write_text("k,v\na,1\n")
    (tmp_path / "c.json").write_text('{"a":[1]}')
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "d.bin").write_text("no")
    (tmp_path / "bad.json").write_text("{")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:document>')
    with zipfile.ZipFile(tmp_path / "f.pptx", "w") as z:
        for n in (1, 2):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Slide {n}</a:t></a:r></a:p></p:sld>')
    got = {(r["file_name"], r["page_number"]): r for r in loaders.with_document_id(loaders.load_directory(spark, str(tmp_path))).collect()}
    assert set(got) == {("sub/a.txt", None), ("b.csv", None), ("c.json", None), ("bad.json", None), ("e.docx", None), ("f.pptx", 1), ("f.pptx", 2)}
    assert got["sub/a.txt", None]["content"].endswith("é") and got["e.docx", None]["content"] == "One\nTwo" and got["f.pptx", 2]["content"] == "Slide 2"
    assert got["bad.json", None]["content"] is None and got["bad.json", None]["error"] and '"a": [' in got["c.json", None]["content"]
    assert len({r["id"] for r in got.values()}) == 7


def test_pages(spark):
    html = "<html><nav>menu</nav><main><h1>Top¶</h1><p>" + "Long enough body text for the first section. " * 2 + "</p><h2>Next</h2><p>" + "Another body that is long enough to stay. " * 2 + "</p><script>x</script></main></html>"
    got = pages.page_sections(spark.createDataFrame([(1, html), (2, None), (3, "<p>short</p>")], "page_id long, html string"), "page_id", "html").collect()
    by = {r["page_id"]: r["markdown"] for r in got}
    assert by[1].startswith("# Top\n\nLong enough") and "## Next" in by[1] and "menu" not in by[1] and by[3] == "" and 2 not in by


def test_catalog(spark, tmp_path):
    c = spark.createDataFrame([("a", "retry window"), ("b", "cursor page")], "key string, content string")
    index = catalog.open_or_build(spark, str(tmp_path), c, model="m", size=10)
    assert index.part("postings").count() == 4 and catalog.open_or_build(spark, str(tmp_path), c.limit(0), model="m", size=10).part("chunks").count() == 2
    v = spark.createDataFrame([("a", "m", "raw", [1.0, 0.0])], "chunk_key string, model string, representation string, embedding array<float>")
    assert index.add_vectors(v).count() == 1 and index.add_vectors(v.union(v)).count() == 1
    index.check("m", 2)
    for args in (("other",), ("m", 3)):
        with pytest.raises(catalog.IncompatibleIndexError):
            index.check(*args)
    (tmp_path / "x.md").write_text("x")
    assert len(catalog.corpus_hash(str(tmp_path))) == 64


def test_streaming(spark, tmp_path):
    docs = spark.createDataFrame([("1", "g.md", DOC), ("1", "g.md", DOC), ("2", "h.md", "text")], "id string, file_name string, content string").withColumn("ingested_at", F.current_timestamp())
    docs.write.parquet(str(tmp_path / "in"))
    schema = "id string, file_name string, content string, ingested_at timestamp"
    for _ in range(2):
        q = ingest.ingest(ingest.read_documents(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    e = spark.createDataFrame([(1, "a", 2.0), (2, "a", 3.0)], "id long, event_type string, value double").withColumn("ts", F.lit("2024-01-01 00:10:00").cast("timestamp"))
    assert ingest.event_rates(e).collect()[0]["n"] == 2


def test_pairwise_ltr_ranks_every_candidate(spark, tmp_path):
    """The sparse score makes the stored order, so the best by it must come out: at dense rank 40, and without a dense score."""
    rows = []
    for q in ("q1", "q2"):
        rows += [(q, f"k{i:02d}", 100.0 - i, 90.0 if i == 40 else (i * 7) % 50 / 1.0, 0.0, 90.0 if i == 40 else (i * 7) % 50 / 1.0) for i in range(1, 46)]
        rows += [(q, "nodense", None, 80.0, 0.0, 80.0), (q, "nan", float("nan"), 70.0, 0.0, 70.0), (q, "nofinal", 10.0, 60.0, 0.0, None), (q, "none", None, None, None, None)]
    c = spark.createDataFrame(rows, "query_id string, chunk_key string, dense_score double, sparse_score double, late_interaction_score double, final_score double")
    c.withColumns({"scored_at": F.current_timestamp(), "loaded_at": F.current_timestamp()}).write.parquet(str(tmp_path / "native_candidates.parquet"))
    got = lab.pairwise_ltr(spark, str(tmp_path)).collect()
    assert {q: {r["key"] for r in got if r["qid"] == q} >= {"k40", "nodense", "nan", "nofinal"} for q in ("q1", "q2")} == {"q1": True, "q2": True}


@pytest.mark.parametrize("total", [1, 9, 10, 11, 12_345])
def test_draws_are_those_of_md5(total):
    got = np.concatenate(list(draws.drawn("1729|42|", total)))
    assert got.tolist() == [int(hashlib.md5(f"1729|42|{d}".encode()).hexdigest()[:12], 16) % total for d in range(total)]


def test_bootstrap_sums_each_sample_by_itself(spark):
    """The draws of a sample are neither rows nor joined, however many cases there are."""
    pairs = spark.range(3_000).select(F.col("id").alias("n"), (F.col("id") % 3 / 4).alias("a"), (F.col("id") % 5 / 4).alias("b"))
    got = evaluation.bootstrap_delta(pairs, 40)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    x = [n % 5 / 4 - n % 3 / 4 for n in range(3_000)]
    means = sorted(sum(x[int(hashlib.md5(f"1729|{s}|{d}".encode()).hexdigest()[:12], 16) % 3_000] for d in range(3_000)) / 3_000 for s in range(40))
    r = got.collect()[0]
    at = lambda p: means[int(p * 39)] + (p * 39 - int(p * 39)) * (means[int(p * 39) + 1] - means[int(p * 39)])
    assert abs(r["observed"] - sum(x) / 3_000) < 1e-9 and abs(r["low"] - at(0.025)) < 1e-9 and abs(r["high"] - at(0.975)) < 1e-9 and r["crosses_zero"] == (r["low"] <= 0 <= r["high"])
