"""The registered queries of the retrieval engine. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagery.functions import signals, text, vectors
from passagery.operators import evaluation, fusion, lexical, rerank
from passagery.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    """Rounded so that the order of summation doesn't show."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


# -- shared relations ---------------------------------------------------------------------------


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """One row per chunk: chunk_id repeats across the pages of a file, so the page is part of the key; the latest ingestion counts."""
    c = table(spark, root, "chunks").withColumn("key", F.concat("chunk_id", F.lit("@"), F.coalesce("page_number", F.lit(0)).cast("string")))
    w = Window.partitionBy("key").orderBy(F.col("ingested_at").desc_nulls_last(), "content", "document_id")
    return c.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def asked(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "queries").select(
        F.concat("query_id", F.lit("/"), "query_variant").alias("qid"), "query_id", F.col("query_variant").alias("variant"), "text", "weight"
    )


def latest_candidates(spark: SparkSession, root: str) -> DataFrame:
    """(qid, key, dense, sparse, late, final): a candidate scored anew counts once, with its latest scores; NaN is null."""
    c = table(spark, root, "native_candidates").where("query_id IS NOT NULL AND chunk_key IS NOT NULL")
    num = lambda x: F.when(~F.isnan(x), F.col(x))
    picked = F.max(
        F.struct(
            "scored_at", "loaded_at", num("dense_score").alias("dense"), num("sparse_score").alias("sparse"),
            num("late_interaction_score").alias("late"), num("final_score").alias("final"),
        )
    ).alias("m")
    return c.groupBy(F.col("query_id").alias("qid"), F.col("chunk_key").alias("key")).agg(picked).select(
        "qid", "key", "m.dense", "m.sparse", "m.late", "m.final"
    )


def streams(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """(qid, stream, key, score, rank) of the stored score streams; missing scores are no hits."""
    names = names or ("dense", "sparse")
    entries = F.explode(F.array(*(F.struct(F.lit(n).alias("stream"), F.col(n).alias("score")) for n in names)))
    long = latest_candidates(spark, root).select("qid", "key", entries.alias("e")).select("qid", "key", "e.stream", "e.score")
    return fusion.ranked(long.where("score IS NOT NULL"))


WEIGHTS = {"dense": 0.7, "sparse": 0.3}


def stream_weight(weights: dict[str, float] | None = None) -> Column:
    return F.coalesce(*(F.when(F.col("stream") == s, F.lit(float(w))) for s, w in (weights or WEIGHTS).items()), F.lit(0.0))


# -- text ---------------------------------------------------------------------------------------


@register
def tokenize_stats(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").withColumn("t", text.word_tokens(F.col("text")))
    return d.groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum(F.size("t")).cast("long").alias("tokens"), F.max(F.size("t")).cast("long").alias("longest"),
        F.sum(F.size(F.array_distinct("t"))).cast("long").alias("distinct_tokens"),
    )


@register
def doc_frequency(spark: SparkSession, root: str) -> DataFrame:
    posts = lexical.postings(table(spark, root, "documents"), "doc_id", text.word_tokens(F.col("text")))
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


@register
def identifier_bigrams(spark: SparkSession, root: str) -> DataFrame:
    t = asked(spark, root).select(F.explode(text.identifier_tokens(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


@register
def technical_terms(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "benchmark_cases").select(F.explode(text.technical_tokens(F.col("question"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


@register
def overlap_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    t = asked(spark, root).select(F.explode(text.overlap_tokens(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


@register
def ltr_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    t = asked(spark, root).select(F.explode(text.ltr_tokens(F.col("text"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n"))


@register
def heading_slugs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "spans").select(text.heading_slug(F.col("heading")).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


@register
def label_sources(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "case_labels").select(text.normalise_source(F.col("document_id")).alias("source"))
    return s.groupBy("source").agg(F.count("*").alias("labels"))


@register
def question_forms(spark: SparkSession, root: str) -> DataFrame:
    q = table(spark, root, "benchmark_cases").select("case_no", text.normalise_question(F.col("question")).alias("q"))
    return q.groupBy("q").agg(F.count_distinct("case_no").alias("cases"), F.min("case_no").alias("first_case")).select(
        F.sha2("q", 256).alias("question_hash"), "cases", "first_case"
    )


@register
def display_titles(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", text.truncate(F.col("text")).alias("shown"))


# -- lexical ------------------------------------------------------------------------------------


def _word(c: str) -> Column:
    return text.word_tokens(F.col(c))


@register
def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    out = lexical.bm25_topk(asked(spark, root), "qid", _word("text"), corpus(spark, root), "key", _word("content"))
    return out.select("qid", F.col("rank").cast("long").alias("rank"), "key", r6("score").alias("score"))


@register
def bm25_k1b_sweep(spark: SparkSession, root: str) -> DataFrame:
    q, c = asked(spark, root), corpus(spark, root)
    grid = [(k1, b) for k1 in (0.9, 1.2, 1.5) for b in (0.3, 0.75)]
    top = lexical.bm25_grid(q, "qid", _word("text"), c, "key", _word("content"), grid, 1)
    return top.select("qid", "k1", "b", "key", r6("score").alias("score"))


def _fields(c: DataFrame) -> DataFrame:
    title = F.coalesce(F.element_at(F.split(F.coalesce("heading_path", F.lit("")), " > "), 1), F.lit(""))
    each = F.array(
        F.struct(F.lit("title").alias("field"), title.alias("text")),
        F.struct(F.lit("heading").alias("field"), F.coalesce("heading_path", F.lit("")).alias("text")),
        F.struct(F.lit("body").alias("field"), F.col("content").alias("text")),
    )
    return c.select("key", F.explode(each).alias("f")).select("key", "f.field", "f.text")


@register
def field_bm25(spark: SparkSession, root: str) -> DataFrame:
    q = asked(spark, root)
    tok = text.identifier_tokens(F.col("text"))
    out = lexical.field_bm25(q, "qid", tok, _fields(corpus(spark, root)), tok, {"title": 3.0, "heading": 2.0, "body": 1.0})
    return out.select("qid", F.col("rank").cast("long").alias("rank"), "key", r6("score").alias("score"))


@register
def corpus_bm25_stats(spark: SparkSession, root: str) -> DataFrame:
    c = corpus(spark, root)
    posts, stats = lexical.postings(c, "key", _word("content")), lexical.corpus_stats(c, _word("content"))
    return lexical.term_idf(posts, stats).select("term", F.col("df").cast("long").alias("df"), r6("idf").alias("idf"))


@register
def corpus_profile_bm25(spark: SparkSession, root: str) -> DataFrame:
    """Whole-corpus profile: scores min-max scaled over all chunks (those without a hit score 0), the best 5 shown."""
    q, c = asked(spark, root), corpus(spark, root)
    tok = lambda x: text.technical_tokens(F.col(x))
    top = lexical.corpus_scaled(q, "qid", tok("text"), c, "key", tok("content"), 5)
    return top.select("qid", F.col("rank").cast("long").alias("rank"), "key", r6("norm").alias("norm"))


# -- fusion -------------------------------------------------------------------------------------


@register
def minmax_normalise(spark: SparkSession, root: str) -> DataFrame:
    n = fusion.minmax(streams(spark, root))
    return n.select("qid", "stream", "key", F.col("rank").cast("long").alias("rank"), r6("norm").alias("norm"))


def _fused(spark: SparkSession, root: str, strategy: str, k: int = 10) -> DataFrame:
    s = fusion.minmax(streams(spark, root))
    return fusion.order_fused(fusion.fuse(s, strategy, stream_weight()), k)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("qid", F.col("rank").cast("long").alias("rank"), "key", r6("score").alias("score"))


@register
def fuse_weighted_linear(spark: SparkSession, root: str) -> DataFrame:
    return _shown(_fused(spark, root, "weighted_linear"))


@register
def fuse_rrf(spark: SparkSession, root: str) -> DataFrame:
    return _shown(_fused(spark, root, "rrf"))


@register
def fuse_weighted_rrf(spark: SparkSession, root: str) -> DataFrame:
    return _shown(_fused(spark, root, "weighted_rrf"))


VARIANT_WEIGHTS = {"original": 1.0, "rewrite": 0.7, "expansion": 0.5, "prf": 0.35}


def _variants_fused(spark: SparkSession, root: str, strategy: str) -> DataFrame:
    lists = lexical.bm25_topk(asked(spark, root), "qid", _word("text"), corpus(spark, root), "key", _word("content"), 10)
    lists = lists.select(
        F.substring_index("qid", "/", 1).alias("qid"), F.substring_index("qid", "/", -1).alias("variant"), "key", "score", "rank"
    )
    return _shown(lexical.top_k(fusion.fuse_variants(lists, strategy, VARIANT_WEIGHTS), 5))


@register
def fuse_variants(spark: SparkSession, root: str) -> DataFrame:
    """BM25 lists of a query's variants fused by weighted reciprocal ranks."""
    return _variants_fused(spark, root, "weighted_rrf")


@register
def fuse_variants_rrf(spark: SparkSession, root: str) -> DataFrame:
    return _variants_fused(spark, root, "rrf")


@register
def fuse_variants_linear(spark: SparkSession, root: str) -> DataFrame:
    return _variants_fused(spark, root, "weighted_linear")


@register
def hierarchy_bonus(spark: SparkSession, root: str) -> DataFrame:
    """The fused ranking after its sections' bonus; the section of a candidate is its file and heading path.

    A candidate's key may stand on several pages; the heading path is that of the first.
    """
    f = fusion.fuse(fusion.minmax(streams(spark, root)), "weighted_linear", stream_weight())
    paths = corpus(spark, root).groupBy(F.col("chunk_id").alias("key")).agg(F.min(F.struct(F.coalesce("page_number", F.lit(0)).alias("p"), F.coalesce("heading_path", F.lit("")).alias("h"))).alias("m"))
    f = f.join(paths.select("key", "m.h"), "key", "left")
    f = f.withColumn("section", F.concat_ws("\x01", F.substring_index("key", "::", 1), F.coalesce("h", F.lit("")))).drop("h")
    return _shown(lexical.top_k(fusion.hierarchy_bonus(f), 5))


@register
def component_trace(spark: SparkSession, root: str) -> DataFrame:
    t = fusion.component_trace(streams(spark, root, "dense", "sparse", "late"), ["dense", "sparse", "late"])
    ranks = [F.col(f"{n}_rank").cast("long").alias(f"{n}_rank") for n in ("dense", "sparse", "late")]
    scores = [r6(f"{n}_score").alias(f"{n}_score") for n in ("dense", "sparse", "late")]
    final = streams(spark, root, "final").select("qid", "key", F.col("rank").cast("long").alias("final_rank"))
    return t.join(final, ["qid", "key"], "left").select("qid", "key", *ranks, *scores, "final_rank", "stream_count")


@register
def native_rerank(spark: SparkSession, root: str) -> DataFrame:
    """Three signals, each min-max scaled over the pool, weighted 0.4 / 0.3 / 0.3; ties by dense rank."""
    s = fusion.minmax(streams(spark, root, "dense", "sparse", "late"))
    w = stream_weight({"dense": 0.4, "sparse": 0.3, "late": 0.3})
    f = s.groupBy("qid", "key").agg(
        F.sum(w * F.col("norm")).alias("score"), F.max(F.when(F.col("stream") == "dense", F.col("rank"))).alias("dense_rank")
    )
    o = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), F.col("dense_rank").asc_nulls_last(), "key")
    return _shown(f.withColumn("rank", F.row_number().over(o)).where("rank <= 10"))


@register
def native_pool(spark: SparkSession, root: str) -> DataFrame:
    """The best ten of dense and of sparse together, once each, in the order of the late-interaction score."""
    s = streams(spark, root).where("rank <= 10")
    late = latest_candidates(spark, root).select("qid", "key", F.col("late").alias("score"))
    pool = rerank.native_pool(
        s.where("stream = 'dense'"), s.where("stream = 'sparse'"), late.select("qid", "key"), lambda p: p.join(late, ["qid", "key"], "left")
    )
    return pool.select("qid", F.col("rank").cast("long").alias("rank"), "key", r6("score").alias("score"))


@register
def routing_summary(spark: SparkSession, root: str) -> DataFrame:
    """How often the queries have rewrites, expansions and feedback variants, and how sure their stored streams are."""
    q = table(spark, root, "queries").groupBy(F.col("query_id").alias("qid")).agg(
        *(F.coalesce(F.bool_or(F.col("query_variant") == v), F.lit(False)).alias(f"{n}_applied") for v, n in (("rewrite", "rewrite"), ("expansion", "expansion"), ("prf", "prf"))),
        F.count("*").alias("query_variant_count"),
    )
    sure = confidence(spark, root).select("qid", F.col("confidence").alias("confidence_score"))
    d = q.join(sure, "qid", "left").withColumn("confidence_triggered", F.col("confidence_score") < 0.5)
    return evaluation.routing_summary(d)


@register
def latency_summary(spark: SparkSession, root: str) -> DataFrame:
    """Mean and nearest-rank percentile over the values of all events, with the share of one type."""
    e = table(spark, root, "events").select("value", (F.col("event_type") == "purchase").alias("bought"))
    return evaluation.latency_summary(e, "value", "bought")


@register
def confidence(spark: SparkSession, root: str) -> DataFrame:
    return fusion.confidence(_fused(spark, root, "weighted_linear", 2), streams(spark, root), "dense", "sparse")


@register
def stream_agreement(spark: SparkSession, root: str) -> DataFrame:
    return fusion.stream_agreement(streams(spark, root, "dense", "sparse", "late"))


@register
def cascade_depth(spark: SparkSession, root: str) -> DataFrame:
    s = streams(spark, root, "dense", "sparse", "late")
    cut = fusion.cascade(s, fusion.stream_agreement(s), 20, 50)
    return cut.groupBy("qid").agg(F.max("escalated").alias("escalated"), F.count("*").alias("rows"))


@register
def additive_feedback(spark: SparkSession, root: str) -> DataFrame:
    s = streams(spark, root)
    f = fusion.add_feedback(s.where("stream = 'dense' AND rank <= 20"), s.where("stream = 'sparse' AND rank <= 20"))
    return f.select("qid", "key", r6("score").alias("score"), F.col("feedback_rank").cast("long").alias("feedback_rank"))


# -- signals ------------------------------------------------------------------------------------


@register
def query_signals(spark: SparkSession, root: str) -> DataFrame:
    q = asked(spark, root).withColumn("s", signals.gate(F.col("text")))
    size = lambda n: F.size(F.col("s")[n]).cast("long").alias(n)
    return q.select(
        "qid", F.col("s.token_count").cast("long").alias("token_count"), size("acronyms"), size("quoted_terms"), size("numeric_codes"),
        size("identifiers"), F.array_join("s.precision_markers", "|").alias("precision_markers"),
        F.array_join("s.ambiguity_markers", "|").alias("ambiguity_markers"),
    )


@register
def query_decisions(spark: SparkSession, root: str) -> DataFrame:
    q = asked(spark, root).withColumn("s", signals.gate(F.col("text")))
    q = q.withColumn("d", signals.decision(F.col("text"), F.col("s")))
    return q.select("qid", F.array_join("d.protected", "|").alias("protected"), F.col("d.should_route").alias("should_route"), F.array_join("d.reasons", "|").alias("reasons"))


@register
def adaptive_weights(spark: SparkSession, root: str) -> DataFrame:
    q = asked(spark, root).withColumn("w", signals.adaptive_weights(F.col("text"), F.lit(0.7), F.lit(0.3)))
    return q.select("qid", F.col("w.dense").alias("dense_weight"), F.col("w.sparse").alias("sparse_weight"))


@register
def instruction_modes(spark: SparkSession, root: str) -> DataFrame:
    asked_for = (("benchmark_cases", "question"), ("spans", "heading"), ("documents", "title"))
    c = None
    for name, column in asked_for:
        one = table(spark, root, name).select(F.col(column).alias("question"))
        c = one if c is None else c.unionByName(one)
    c = c.distinct()
    c = c.select(signals.field_instruction(F.col("question")).alias("field_mode"), signals.corpus_instruction(F.col("question")).alias("corpus_mode"))
    return c.groupBy("field_mode", "corpus_mode").agg(F.count("*").alias("questions"))


@register
def policies(spark: SparkSession, root: str) -> DataFrame:
    """Which queries each policy would rewrite."""
    q = asked(spark, root).withColumn("s", signals.gate(F.col("text")))
    q = q.withColumn("d", signals.decision(F.col("text"), F.col("s")))
    each = F.explode(F.array(*map(F.lit, ("never", "selective", "always"))))
    q = q.select("qid", F.col("d.should_rewrite").alias("may"), each.alias("policy")).withColumn("does", signals.policy(F.col("policy"), F.col("may")))
    return q.groupBy("policy").agg(F.count_if("does").alias("rewritten"), F.count("*").alias("queries"))


@register
def section_topics(spark: SparkSession, root: str) -> DataFrame:
    """Topic of each heading, with the time that reading its section of so many characters would take."""
    s = table(spark, root, "spans").where("heading IS NOT NULL")
    size = F.col("span_end") - F.col("span_start")
    return s.select("span_id", text.topic(F.lit(None).cast("string"), F.col("heading")).alias("topic"), text.duration(size * 7).alias("took"))


@register
def encoder_texts(spark: SparkSession, root: str) -> DataFrame:
    """What encoders of three kinds are given for each query."""
    q = asked(spark, root).select("qid", "text", F.explode(F.array(*map(F.lit, ("e5-base", "Qwen3-Embedding", "other")))).alias("model"))
    return q.select("qid", "model", text.passage_prefix(F.col("text"), F.col("model"), True, "find it").alias("given"))


# -- vectors ------------------------------------------------------------------------------------


@register
def cosine_topk(spark: SparkSession, root: str) -> DataFrame:
    from passagery.operators import dense

    e = table(spark, root, "embeddings")
    top = dense.top_k(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 5)
    return top.select("qid", F.col("rank").cast("long").alias("rank"), "key", F.round("score", 5).alias("score"))


@register
def label_cohesion(spark: SparkSession, root: str) -> DataFrame:
    """Length of the mean vector of each label: near 1 where its vectors point one way."""
    e = table(spark, root, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return m.groupBy("label").agg(r6(F.sqrt(F.sum(F.col("m") * F.col("m")))).alias("length"), F.max("n").alias("vectors"))


@register
def vector_norms(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    return e.select("vec_id", F.size("embedding").cast("long").alias("dims"), r6(vectors.norm(F.col("embedding"))).alias("length"))
