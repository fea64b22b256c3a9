"""Registered queries of the evaluation laboratory: chunking, feedback, metrics, splits, sweeps, analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagery.config import CorpusConfig, FieldConfig, RetrievalConfig
from passagery.functions import signals, text, vectors
from passagery.operators import analytics, answers, chunking, ensemble, evaluation, feedback, fusion, lexical, protocol, rerank
from passagery.plans import pipeline
from passagery.plans.queries import _word, asked, corpus, latest_candidates, r6, register, stream_weight, streams
from passagery.runtime import cut_lineage, is_file, scratch, table
from passagery.sources import cases as case_labels
from passagery.sources import catalog, loaders
from passagery.streaming import ingest

K = 5


# -- chunking -----------------------------------------------------------------------------------


def latest_documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per file and page: the latest ingestion, ties by id."""
    d = table(spark, root, "documents_in")
    w = Window.partitionBy("file_name", F.coalesce("page_number", F.lit(0))).orderBy(F.col("ingested_at").desc_nulls_last(), "id")
    return d.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@register
def heading_spans(spark: SparkSession, root: str) -> DataFrame:
    markdown = latest_documents(spark, root).where("extension = '.md'")
    return chunking.heading_spans(markdown)


def _cut(spark: SparkSession, root: str, strategy: str, size: int, overlap: int = 0) -> DataFrame:
    """Pieces of the latest documents beside the documents' texts."""
    docs = latest_documents(spark, root)
    return chunking.chunk_documents(docs, strategy, size, overlap).join(docs.select(F.col("id").alias("document_id"), F.col("content").alias("whole")), "document_id")


def _within(pieces: DataFrame, size: int) -> DataFrame:
    """(document_id, fits, inside): are a document's chunks no longer than size, and their intervals inside its text?"""
    length = F.col("source_char_end") - F.col("source_char_start")
    inside = (F.col("source_char_start") >= 0) & (length > 0) & (F.col("source_char_end") <= F.length("whole"))
    return pieces.groupBy("document_id").agg(F.bool_and(length <= size).alias("fits"), F.bool_and(F.coalesce(inside, F.lit(False))).alias("inside"))


def _extent(pieces: DataFrame, exact: Callable[[Column], Column]) -> DataFrame:
    """(document_id, first, last, exact): the interval that a document's chunks cover, and whether each holds its interval's text."""
    own = F.substring(F.col("whole"), F.col("source_char_start") + 1, F.col("source_char_end") - F.col("source_char_start"))
    return pieces.groupBy("document_id").agg(
        F.min("source_char_start").cast("long").alias("first"), F.max("source_char_end").cast("long").alias("last"), F.bool_and(exact(own)).alias("exact")
    )


@register
def char_chunks(spark: SparkSession, root: str) -> DataFrame:
    return _within(_cut(spark, root, "character", 1000, 200), 1000)


@register
def heading_chunks(spark: SparkSession, root: str) -> DataFrame:
    return _within(_cut(spark, root, "heading", 800), 800)


@register
def section_chunks(spark: SparkSession, root: str) -> DataFrame:
    return _within(_cut(spark, root, "section", 1000), 1000)


@register
def paragraph_chunks(spark: SparkSession, root: str) -> DataFrame:
    return _extent(_cut(spark, root, "paragraph", 800), lambda own: F.col("content") == own)


@register
def heading_context_chunks(spark: SparkSession, root: str) -> DataFrame:
    """The interval's text is the end of a chunk, behind its context."""
    return _extent(_cut(spark, root, "heading_context", 800), lambda own: F.endswith(F.col("content"), F.regexp_replace(own, r"(?U)\s+$", "")))


# -- feedback -----------------------------------------------------------------------------------


def _results(spark: SparkSession, root: str, k: int = 10) -> DataFrame:
    """(qid, rank, key, score, text, content, file_name, heading_path) of BM25 over the chunks."""
    q, c = asked(spark, root), cut_lineage(corpus(spark, root).select("key", "content", "file_name", "heading_path"))  # read three times
    top = lexical.bm25_topk(q, "qid", _word("text"), c, "key", _word("content"), k)
    return top.join(q.select("qid", "text"), "qid").join(c.select("key", "content", "file_name", "heading_path"), "key")


@register
def prf_terms(spark: SparkSession, root: str) -> DataFrame:
    found = feedback.terms(_results(spark, root, 2), text.feedback_tokens(F.col("content")), True, 2)
    return found.select("qid", F.array_join("terms", " ").alias("terms"))


@register
def field_feedback_terms(spark: SparkSession, root: str) -> DataFrame:
    tokens = text.identifier_tokens(F.col("content"), ngrams=False)
    found = feedback.terms(_results(spark, root, 2), tokens, False, 2, 6)
    return found.select("qid", F.array_join("terms", " ").alias("terms"))


@register
def expanded_queries(spark: SparkSession, root: str) -> DataFrame:
    found = feedback.terms(_results(spark, root, 1), text.feedback_tokens(F.col("content")), True, 1)
    return feedback.expand(asked(spark, root), found).select("qid", "expanded")


@register
def lexical_overlap_boost(spark: SparkSession, root: str) -> DataFrame:
    return feedback.overlap_boost(_results(spark, root)).select("qid", "key", r6("score").alias("score"))


@register
def intent_boost(spark: SparkSession, root: str) -> DataFrame:
    return feedback.intent_boost(_results(spark, root)).select("qid", "key", r6("score").alias("score"))


@register
def context_format(spark: SparkSession, root: str) -> DataFrame:
    c = answers.contexts(_results(spark, root, 3).join(corpus(spark, root).select("key", "chunk_index"), "key"))
    return c.select("qid", F.sha2("context", 256).alias("context_hash"))


@register
def answer_sources(spark: SparkSession, root: str) -> DataFrame:
    """Answers of a stand-in that repeats the length of its prompt, for all queries, with their sources."""
    found = answers.answer(asked(spark, root).select("qid", "text"), _results(spark, root, 3).join(corpus(spark, root).select("key", "chunk_index"), "key"), lambda p, said: str(len(p)))
    return found.select("qid", F.size("retrieved_sources").cast("long").alias("sources"), F.col("retrieved_sources")[0]["file_name"].alias("first_source"))


@register
def ensemble_modes(spark: SparkSession, root: str) -> DataFrame:
    """Which streams stand for instructions: of each candidate the greatest scaled score over the stored streams."""
    s = fusion.minmax(streams(spark, root, "dense", "sparse", "late")).select("qid", F.lit("all").alias("stream"), F.col("stream").alias("mode"), "key", F.round("norm", 9).alias("score"))
    return ensemble.best_over_modes(s, 10).select("qid", "key", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@register
def resolved_hits(spark: SparkSession, root: str) -> DataFrame:
    """Hits that lost their index are found again by their text: every chunk once, each third without its index."""
    c = corpus(spark, root).select("key", "file_name", F.concat_ws("@", "chunk_index", F.coalesce("page_number", F.lit(0))).alias("chunk_index"), "content")
    hits = c.select("file_name", F.when(F.length("content") % 3 == 0, F.lit("lost")).otherwise(F.col("chunk_index")).alias("chunk_index"), "content", F.lit(0.25).alias("distance"))
    return ensemble.resolve_hits(hits, c).groupBy("key").agg(F.count("*").alias("hits"), F.max("score").alias("score"))


# -- profiles -----------------------------------------------------------------------------------


def _asked_once(spark: SparkSession, root: str) -> DataFrame:
    return asked(spark, root).select("qid", "text")


def _ranked_rows(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("long").alias("rank"), "key", r6("score").alias("score"))


@register
def profile_default(spark: SparkSession, root: str) -> DataFrame:
    """The default profile, with BM25 alone, as no encoder is at hand."""
    config = RetrievalConfig(top_k=K, dense_weight=0.0, sparse_weight=1.0, overlap_weight=0.2)
    return _ranked_rows(pipeline.retrieve(_asked_once(spark, root), corpus(spark, root), None, config))


@register
def profile_fields(spark: SparkSession, root: str) -> DataFrame:
    """The field profile, with field BM25 alone and the hierarchy bonus."""
    config = FieldConfig(weights={"bm25": 1.0}, router=False)
    return _ranked_rows(pipeline.retrieve_fields(_asked_once(spark, root), corpus(spark, root), None, config))


@register
def profile_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The whole-corpus profile, with technical tokens and BM25 alone."""
    config = CorpusConfig(dense_weight=0.0, sparse_weight=1.0, technical_tokens=True)
    return _ranked_rows(pipeline.retrieve_corpus(_asked_once(spark, root), corpus(spark, root), None, config))


# -- sources ------------------------------------------------------------------------------------


@register
def case_label_rows(spark: SparkSession, root: str) -> DataFrame:
    """The span and source labels of all cases, written as JSON lines and read back."""
    one = _places(spark, root).select("label", "doc", "start", "end")
    lab = table(spark, root, "case_labels").where("case_no IS NOT NULL AND kind = 'span' AND label_id IS NOT NULL").groupBy("case_no", F.col("label_id").alias("label")).agg(
        F.max(F.coalesce("gain", F.lit(1.0))).alias("gain")
    )
    spans = lab.join(one, "label").where("doc <> ''").groupBy("case_no").agg(
        F.collect_list(F.struct(F.col("label").alias("span_id"), F.col("doc").alias("document_id"), "start", "end", "gain")).alias("relevance_spans")  # one case's
    )
    folder = scratch(spark, "cases")
    loaders.write_jsonl(spans.select(F.col("case_no").cast("string").alias("id"), "relevance_spans"), folder, sorted_keys=True)
    return case_labels.labels(spark.read.text(folder)).select("case", "kind", "label", "doc", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "gain")


@register
def documents_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """All documents written as lines of JSON and read back."""
    folder = scratch(spark, "documents")
    loaders.write_jsonl(table(spark, root, "documents_in").select("id", "file_name", "page_number", "content"), folder)
    back = loaders.read_jsonl(spark, folder, "id string, file_name string, page_number int, content string")
    return back.groupBy("id").agg(F.count("*").alias("n"), F.min(F.sha2("content", 256)).alias("content_hash"), F.max("page_number").cast("long").alias("page"))


@register
def catalog_terms(spark: SparkSession, root: str) -> DataFrame:
    """Document frequencies of an index that was written, found again by its manifest and opened."""
    folder = scratch(spark, "catalog")
    catalog.open_or_build(spark, folder, corpus(spark, root), model="none", chunking="given")
    return catalog.find_index(spark, folder, chunking="given").part("terms").select("term", F.col("df").cast("long").alias("df"), r6("idf").alias("idf"))


@register
def cached_search(spark: SparkSession, root: str) -> DataFrame:
    """Lists kept ten deep and asked for the first three."""
    q, c = asked(spark, root), corpus(spark, root)
    kept = catalog.CachedSearch(lambda own, k: lexical.bm25_topk(own, "qid", _word("text"), c, "key", _word("content"), k), q, 10)
    return _ranked_rows(kept.query(q, 3))


@register
def streamed_events(spark: SparkSession, root: str) -> DataFrame:
    """Events of each hour and type, counted by a stream that reads all there is."""
    reader = spark.readStream.schema(table(spark, root, "events").schema)
    one = is_file(spark, f"{root}/events.parquet")  # a stream reads folders
    read = reader.option("pathGlobFilter", "events.parquet").parquet(root) if one else reader.parquet(f"{root}/events.parquet")
    events = read.withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch(spark, "events")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    ingest.event_rates(events, late="3650 days").writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", scratch(spark, "state")).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", r6("total").alias("total"))


# -- ranking ------------------------------------------------------------------------------------


@register
def mmr_select(spark: SparkSession, root: str) -> DataFrame:
    return rerank.diversify(_results(spark, root, 20), 5, 0.7).select("qid", F.col("place").cast("long").alias("place"), "key", r6("score").alias("score"))


@register
def ltr_features(spark: SparkSession, root: str) -> DataFrame:
    r = _results(spark, root).withColumns({"bm25_score": F.col("score"), "bm25_rank": F.col("rank"), "sparse_score": F.col("score"), "sparse_rank": F.col("rank"), "stream_count": F.lit(1)})
    f = rerank.features(r)
    return f.select("qid", "key", *(r6(c).alias(c) for c in rerank.FEATURES))


@register
def pairwise_ltr(spark: SparkSession, root: str) -> DataFrame:
    """A pairwise ranker learnt from the stored final order, applied to all candidates of each query.

    A missing score and its rank count 0. Candidates without a final score have no label: they are
    ranked, but nothing is learnt from them.
    """
    s = fusion.component_trace(streams(spark, root, "dense", "sparse", "late"), ["dense", "sparse", "late"])
    gold = streams(spark, root, "final").select("qid", "key", F.when(F.col("rank") <= 3, 2.0).when(F.col("rank") <= 10, 1.0).otherwise(0.0).alias("gain"))
    every = latest_candidates(spark, root).select("qid", "key")
    rows = cut_lineage(every.join(s, ["qid", "key"], "left").join(gold, ["qid", "key"], "left"))
    rows = rows.withColumnsRenamed({"late_score": "late_interaction_score", "late_rank": "late_interaction_rank"})
    columns = ("dense_score", "dense_rank", "sparse_score", "sparse_rank", "late_interaction_score", "late_interaction_rank", "stream_count")
    ranker = rerank.PairwiseRanker(columns).fit(rows.where("gain IS NOT NULL"))
    return lexical.top_k(ranker.predict(rows).withColumn("score", F.col("prediction")), K, positive=False).select("qid", "rank", "key", r6("score").alias("score"))


@register
def rank_agreement(spark: SparkSession, root: str) -> DataFrame:
    """Mean overlap of the best ten of two streams, as sets."""
    s = streams(spark, root).where("rank <= 10").groupBy("qid", "stream").agg(F.collect_set("key").alias("keys"))  # at most 10
    a, b = s.where("stream = 'dense'"), s.where("stream = 'sparse'").select("qid", F.col("keys").alias("other"))
    return a.join(b, "qid").select("qid", r6(vectors.jaccard(F.col("keys"), F.col("other"))).alias("overlap"))


# -- evaluation ---------------------------------------------------------------------------------


def eval_cases(spark: SparkSession, root: str) -> DataFrame:
    """(case, split, category, q): the dev and test cases, and each heading as a known item to be found, each once."""
    c = table(spark, root, "benchmark_cases").where("split_name IN ('dev', 'test') AND case_no IS NOT NULL AND question IS NOT NULL")
    c = c.select(F.concat(F.lit("c"), "case_no").alias("case"), F.col("split_name").alias("split"), "category", F.col("question").alias("q"))
    s = table(spark, root, "spans").where("span_id IS NOT NULL AND heading IS NOT NULL")
    return c.unionByName(s.select(F.concat(F.lit("s"), "span_id").alias("case"), F.lit("known").alias("split"), F.lit("known_item").alias("category"), F.col("heading").alias("q"))).distinct()


def eval_results(spark: SparkSession, root: str, k: int = K) -> DataFrame:
    """(case, rank, key, id, docs, sources, aliases, start, end): BM25 over the chunks for each evaluation case."""
    c = corpus(spark, root)
    top = lexical.bm25_topk(eval_cases(spark, root), "case", _word("q"), c, "key", _word("content"), k)
    name = [F.col("chunk_id"), F.col("file_name"), F.col("file_path"), F.col("chunk_index")]
    paths = F.array(text.normalise_source(F.col("file_name")), text.normalise_source(F.col("file_path")))
    places = c.select(
        "key", evaluation.canonical_id(*name).alias("id"), evaluation.chunk_aliases(*name).alias("aliases"), paths.alias("docs"),
        F.col("source_char_start").alias("start"), F.col("source_char_end").alias("end"),
    )
    return top.join(places, "key").select(F.col("qid").alias("case"), "rank", "key", "id", "docs", F.col("docs").alias("sources"), F.col("docs")[0].alias("source"), "aliases", "start", "end")


def _places(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "spans").select(
        F.col("span_id").alias("label"), text.normalise_source(F.col("document_id")).alias("doc"), F.col("span_start").alias("start"), F.col("span_end").alias("end"),
        "heading_level", "heading",
    )


def span_labels(spark: SparkSession, root: str) -> DataFrame:
    """(case, label, doc, start, end, gain): labelled spans, a null gain counting 1, and the known items of the two upper levels."""
    s = _places(spark, root)
    lab = table(spark, root, "case_labels").where("kind = 'span' AND label_id IS NOT NULL").select(
        F.concat(F.lit("c"), "case_no").alias("case"), F.col("label_id").alias("label"), F.coalesce("gain", F.lit(1.0)).alias("gain")
    )
    shown = ("case", "label", "doc", "start", "end", "gain")
    graded = lab.groupBy("case", "label").agg(F.max("gain").alias("gain")).join(s, "label").select(*shown)
    known = s.where("heading_level <= 2 AND label IS NOT NULL AND heading IS NOT NULL").select(F.concat(F.lit("s"), "label").alias("case"), *shown[1:5], F.lit(1.0).alias("gain"))
    return graded.unionByName(known)


def chunk_labels(spark: SparkSession, root: str) -> DataFrame:
    """(case, label, gain, ordinal): the known items of the lower levels, labelled with the chunks that hold their heading."""
    s = _places(spark, root).where("heading_level > 2 AND label IS NOT NULL AND heading IS NOT NULL").alias("s")
    c = corpus(spark, root).select(text.normalise_source(F.col("file_name")).alias("doc"), "chunk_index", "source_char_start", "source_char_end").alias("c")
    held = (F.col("c.doc") == F.col("s.doc")) & (F.col("c.source_char_start") <= F.col("s.start")) & (F.col("s.start") < F.col("c.source_char_end"))
    label = F.concat(F.col("c.doc"), F.lit("::"), F.col("c.chunk_index").cast("string"))
    return s.join(c, held).select(F.concat(F.lit("s"), "s.label").alias("case"), label.alias("label"), F.lit(1.0).alias("gain"), F.col("c.chunk_index").alias("ordinal")).distinct()


def source_labels(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "case_labels").select(F.concat(F.lit("c"), "case_no").alias("case"), text.normalise_source(F.col("document_id")).alias("source"))
    return s.where("source <> '' AND case IS NOT NULL").distinct()


def _judged(spark: SparkSession, root: str, k: int = K) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    """(cases, results, labels of the three kinds) with the results written once."""
    return eval_cases(spark, root), cut_lineage(eval_results(spark, root, k)), (span_labels(spark, root), chunk_labels(spark, root), source_labels(spark, root))


def _metrics(spark: SparkSession, root: str, once: bool = True) -> tuple[DataFrame, DataFrame]:
    cases, results, labels = _judged(spark, root)
    return cases, evaluation.evaluate(cases, results, *labels, K, once)


def _shown_metrics(m: DataFrame) -> DataFrame:
    return m.select("case", *(r6(c).alias(c) for c in evaluation.METRICS))


@register
def span_overlap_matches(spark: SparkSession, root: str) -> DataFrame:
    m = evaluation.match_spans(eval_results(spark, root), span_labels(spark, root))
    return m.select("case", F.col("rank").cast("long").alias("rank"), "label", "gain")


@register
def case_metrics(spark: SparkSession, root: str) -> DataFrame:
    return _shown_metrics(_metrics(spark, root)[1])


@register
def case_metrics_repeated(spark: SparkSession, root: str) -> DataFrame:
    return _shown_metrics(_metrics(spark, root, False)[1])


@register
def metrics_by_category(spark: SparkSession, root: str) -> DataFrame:
    cases, m = _metrics(spark, root)
    return evaluation.grouped_metrics(m.join(cases, "case"), "category", "split")


@register
def case_details(spark: SparkSession, root: str) -> DataFrame:
    cases, results, labels = _judged(spark, root)
    earned = evaluation.gains(results, *labels)
    named = labels[0].select("case", "label").unionByName(labels[1].join(labels[0].select("case"), "case", "left_anti").select("case", "label"))
    d = evaluation.case_details(cases, results, earned, evaluation.evaluate(cases, results, *labels, K), named, K)
    return d.withColumn("first_relevant_rank", F.col("first_relevant_rank").cast("long"))


@register
def hit_counts(spark: SparkSession, root: str) -> DataFrame:
    return evaluation.hit_counts(case_details(spark, root))


@register
def result_gains(spark: SparkSession, root: str) -> DataFrame:
    _, results, labels = _judged(spark, root)
    return evaluation.gains(results, *labels).select("case", F.col("rank").cast("long").alias("rank"), "kind", "label", "gain")


@register
def failure_analysis(spark: SparkSession, root: str) -> DataFrame:
    """Span-labelled cases whose first match isn't first among five: where the first twenty have their labels."""
    cases, results, labels = _judged(spark, root, 20)
    labelled = cases.join(labels[0].select("case"), "case", "left_semi")
    met = evaluation.match_spans(results, labels[0])
    f = evaluation.failures(labelled, met.where(F.col("rank") <= K), labels[0], met.withColumn("stream", F.lit("bm25")), results)
    return f.withColumn("first_rank", F.col("first_rank").cast("long"))


@register
def source_matches(spark: SparkSession, root: str) -> DataFrame:
    m = evaluation.match_sources(eval_results(spark, root), source_labels(spark, root))
    return m.groupBy("case").agg(F.min("rank").cast("long").alias("first_rank"), F.count("*").alias("hits"))


@register
def alias_matches(spark: SparkSession, root: str) -> DataFrame:
    """Results that carry a labelled chunk under one of their names."""
    m = evaluation.match_aliases(eval_results(spark, root), chunk_labels(spark, root))
    return m.select("case", F.col("rank").cast("long").alias("rank"), "label", "gain")


@register
def rank_histogram(spark: SparkSession, root: str) -> DataFrame:
    cases, results, labels = _judged(spark, root)
    return evaluation.rank_histogram(cases, evaluation.gains(results, *labels), K)


@register
def fold_stats(spark: SparkSession, root: str) -> DataFrame:
    """Mean and deviation over five folds, and the percentile, of every metric."""
    cases, m = _metrics(spark, root)
    own = cut_lineage(m.join(protocol.grouped_folds(cases, "case", 5).select("case", "fold"), "case"))
    out = None
    for name in evaluation.METRICS:
        s = evaluation.fold_summary(own, "fold", name).select(F.lit(name).alias("metric"), r6("mean").alias("mean"), r6("deviation").alias("deviation"), r6("p95").alias("p95"))
        out = s if out is None else out.unionByName(s)
    return out


@register
def keyword_rates(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "benchmark_cases").select("case_no", "question", "expected_keywords").groupBy("case_no").agg(
        F.max("question").alias("question"), F.max(F.coalesce("expected_keywords", F.array().cast("array<string>"))).alias("kw")
    )
    return evaluation.keyword_rate(c, "question", "kw").select("case_no", r6("keyword_rate").alias("keyword_rate"))


@register
def bootstrap_comparison(spark: SparkSession, root: str) -> DataFrame:
    """Paired bootstrap of the reciprocal rank of all known items and cases between five and two results."""
    cases, results, labels = _judged(spark, root)
    a = evaluation.evaluate(cases, results, *labels, 2).select("case", F.col("mrr").alias("a"))
    b = evaluation.evaluate(cases, results, *labels, K).select("case", F.col("mrr").alias("b"))
    return evaluation.bootstrap_delta(cut_lineage(protocol.numbered(a.join(b, "case"), "case"))).select(
        r6("observed").alias("observed"), r6("low").alias("low"), r6("high").alias("high"), "crosses_zero"
    )


# -- protocol -----------------------------------------------------------------------------------


def _one_case(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "benchmark_cases").where("case_no IS NOT NULL").groupBy("case_no").agg(
        F.max("category").alias("category"), F.max("split_name").alias("split_name")
    )


@register
def largest_remainder(spark: SparkSession, root: str) -> DataFrame:
    n = _one_case(spark, root).groupBy("category").agg(F.count("*").alias("n"))
    return protocol.allocate(n, 100)


@register
def stratified_split(spark: SparkSession, root: str) -> DataFrame:
    return protocol.stratified_split(_one_case(spark, root), "case_no", "category", 200).select("case_no", "category", "split")


@register
def grouped_folds(spark: SparkSession, root: str) -> DataFrame:
    return protocol.grouped_folds(_one_case(spark, root), "case_no", 5).select("case_no", F.col("fold").cast("long").alias("fold"))


@register
def label_anti_join(spark: SparkSession, root: str) -> DataFrame:
    """Labels whose document has no chunk."""
    c = corpus(spark, root).select(text.normalise_source(F.col("file_name")).alias("source"))
    return source_labels(spark, root).join(c, "source", "left_anti").groupBy("source").agg(F.count("*").alias("labels"))


@register
def section_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Sections of each document in pairs that don't overlap, for cases with two relevant sections."""
    return protocol.adjacent_pairs(table(spark, root, "spans"), "document_id", "span_start", "span_id")


@register
def picked_sections(spark: SparkSession, root: str) -> DataFrame:
    """Twenty-five sections in strides of seven through all sections, in the order of document and place."""
    s = table(spark, root, "spans").select("document_id", "span_id", "span_start")
    docs = s.groupBy("document_id").agg(F.count("*").alias("held")).withColumn("cell", F.substring("document_id", 1, 2))
    cells = docs.groupBy("cell").agg(F.sum("held").alias("inside"))
    upto = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("cell_first", upto("inside", Window.orderBy("cell")))  # one row for each first two letters
    docs = docs.withColumn("doc_first", upto("held", Window.partitionBy("cell").orderBy("document_id"))).join(cells, "cell")
    own = F.row_number().over(Window.partitionBy("document_id").orderBy("span_start", "span_id")) - 1
    placed = s.withColumn("own", own).join(docs, "document_id").withColumn("place", F.col("cell_first") + F.col("doc_first") + F.col("own"))
    picks = [(n, p) for n, p in enumerate(protocol.strided(s.count(), 25, 3))]
    return spark.createDataFrame(picks, "pick long, place long").join(placed, "place").select("pick", "span_id")


@register
def built_cases(spark: SparkSession, root: str) -> DataFrame:
    """The graded span labels as built cases: how many labels each has, and the best one."""
    c = table(spark, root, "benchmark_cases").where("case_no IS NOT NULL").groupBy("case_no").agg(F.max("question").alias("question"), F.max("category").alias("category"))
    lab = table(spark, root, "case_labels").where("kind = 'span' AND label_id IS NOT NULL").groupBy("case_no", F.col("label_id").alias("span_id")).agg(F.max(F.coalesce("gain", F.lit(1.0))).alias("gain"))
    targets = lab.join(c, "case_no").withColumnRenamed("case_no", "case")
    built = protocol.build_cases(targets, table(spark, root, "spans"))
    return built.select("case", F.size("labels").cast("long").alias("labels"), F.col("labels")[0]["span_id"].alias("best"))


@register
def case_faults(spark: SparkSession, root: str) -> DataFrame:
    """What a check of the cases finds: doubled ids and questions, cases without labels, labels without a span."""
    lab = table(spark, root, "case_labels").where("kind = 'span' AND label_id IS NOT NULL").groupBy("case_no").agg(F.collect_set(F.struct(F.col("label_id").alias("span_id"))).alias("labels"))
    c = table(spark, root, "benchmark_cases").where("case_no IS NOT NULL").select("case_no", "question", "category").join(lab, "case_no", "left").withColumnRenamed("case_no", "case")
    found = protocol.case_faults(c, table(spark, root, "spans"))
    return found.select("fault", F.sha2(F.coalesce("name", F.lit("")), 256).alias("name_hash"))


@register
def set_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Documents of chunks and of spans: in both, or in one only; and the questions that training and evaluation cases share."""
    a = table(spark, root, "chunks").select(text.normalise_source(F.col("file_name")).alias("d")).distinct()
    b = table(spark, root, "spans").select(text.normalise_source(F.col("document_id")).alias("d")).distinct()
    count = lambda df, name: df.agg(F.count("*").alias("documents")).select(F.lit(name).alias("part"), "documents")
    q = table(spark, root, "benchmark_cases").where("question IS NOT NULL").select("split_name", text.normalise_question(F.col("question")).alias("d"))
    shared = q.where("split_name = 'train'").select("d").intersect(q.where("split_name IN ('dev', 'test')").select("d"))
    parts = (count(a.exceptAll(b), "chunks only"), count(b.exceptAll(a), "spans only"), count(shared, "shared questions"))
    out = count(a.intersect(b), "both")
    for p in parts:
        out = out.unionByName(p)
    return out


@register
def category_counts(spark: SparkSession, root: str) -> DataFrame:
    return _one_case(spark, root).groupBy("split_name", "category").agg(F.count("*").alias("cases"))


@register
def corpus_stats(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").agg(F.count_distinct("file_name").alias("documents"), F.count("*").alias("chunks"), F.count_distinct("content").alias("texts"))


@register
def sweep_composite(spark: SparkSession, root: str) -> DataFrame:
    """Weights of the two streams swept over the stored candidates against the stored final order."""
    s = fusion.minmax(streams(spark, root))
    gold = streams(spark, root, "final").where("rank = 1").select("qid", F.col("key").alias("best"))
    g = protocol.grid(spark, dense_weight=[0.3, 0.5, 0.7, 0.9], top_k=[3, 5])
    w = F.when(F.col("stream") == "dense", F.col("dense_weight")).otherwise(1 - F.col("dense_weight"))
    fused = s.crossJoin(F.broadcast(g.select("dense_weight").distinct())).groupBy("dense_weight", "qid", "key").agg(F.sum(w * F.col("norm")).alias("score"))
    top = lexical.top_k(fused, 5, ("dense_weight", "qid"), positive=False).join(gold, "qid").where("key = best").select("dense_weight", "qid", "rank")
    every = gold.select("qid").crossJoin(F.broadcast(g)).join(top, ["dense_weight", "qid"], "left")
    hit = F.when(F.col("rank") <= F.col("top_k"), 1.0).otherwise(0.0)
    out = every.groupBy("dense_weight", "top_k").agg(F.avg(hit).alias("recall"), F.avg(F.when(F.col("rank") <= F.col("top_k"), 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))
    return out.select("dense_weight", F.col("top_k").cast("long").alias("top_k"), F.round("recall", 4).alias("recall"), F.round("mrr", 4).alias("mrr"))


@register
def sweep_heatmap(spark: SparkSession, root: str) -> DataFrame:
    s = sweep_composite(spark, root).withColumn("w", F.format_string("w%d", (F.col("dense_weight") * 10).cast("int")))
    return analytics.heatmap(s, "top_k", "w", "mrr", ["w3", "w5", "w7", "w9"])


@register
def window_last_four(spark: SparkSession, root: str) -> DataFrame:
    """The last four events of each user, as a chat history keeps its last four messages."""
    e = table(spark, root, "events")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return e.withColumn("n", F.row_number().over(w)).where("n <= 4").select("user_id", F.col("n").cast("long").alias("n"), "event_id", "event_type")


# -- analytics ----------------------------------------------------------------------------------


@register
def rare_group_collapse(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select(F.lower(analytics.metadata_group(F.col("source"), "source")).alias("source"))
    return analytics.collapse_rare(d, "source", 5).groupBy("source").agg(F.count("*").alias("n"))


@register
def group_distribution(spark: SparkSession, root: str) -> DataFrame:
    return analytics.distribution(table(spark, root, "documents_in").withColumn("g", analytics.metadata_group(F.col("extension"), "extension")), "g")


@register
def folder_distribution(spark: SparkSession, root: str) -> DataFrame:
    folder = analytics.metadata_group(analytics.parent_folder(F.col("file_path")), "folder")
    return analytics.distribution(table(spark, root, "documents_in").withColumn("g", folder), "g")


@register
def seeded_sample(spark: SparkSession, root: str) -> DataFrame:
    return analytics.sample(table(spark, root, "documents"), "doc_id", 100).select("doc_id")


@register
def kmeans_clusters(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    return analytics.clusters(e, "embedding", analytics.auto_clusters(e.count())).groupBy("cluster").agg(F.count("*").alias("n"))


@register
def cluster_terms(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").where("text IS NOT NULL").withColumn("cluster", F.coalesce("lang", F.lit("none")))
    return analytics.cluster_terms(d, "text")


@register
def pca_projection(spark: SparkSession, root: str) -> DataFrame:
    return analytics.project(table(spark, root, "embeddings"), "embedding").select("vec_id", "projected")


@register
def instruction_mix(spark: SparkSession, root: str) -> DataFrame:
    q = asked(spark, root).select(signals.corpus_instruction(F.col("text")).alias("mode"), "weight")
    return q.groupBy("mode").agg(F.count("*").alias("n"), r6(F.avg("weight")).alias("mean_weight"))


@register
def stream_weights(spark: SparkSession, root: str) -> DataFrame:
    """Total weight that each stream's hits carry in the fusion."""
    s = streams(spark, root)
    return s.groupBy("stream").agg(F.count("*").alias("hits"), r6(F.sum(stream_weight() / (60 + F.col("rank")))).alias("mass"))
