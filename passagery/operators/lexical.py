"""BM25: postings, corpus statistics and scoring of many queries at once.

Scores follow Okapi BM25 with idf = ln(N - n + 0.5) - ln(n + 0.5); a negative idf becomes a quarter of
the mean idf of all terms. A query term that is repeated counts each time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagery.operators import blocked, indexed
from passagery.runtime import cut_lineage


def postings(corpus: DataFrame, key: str, tokens: Column, extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra..., term, tf, dl): one row for each term of a passage; dl is its number of tokens."""
    own = corpus.select(F.col(key).alias("key"), *extra, tokens.alias("toks"))
    own = own.select("key", *extra, F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    return own.groupBy("key", *extra, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_stats(corpus: DataFrame, tokens: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n_docs, avgdl) over all passages, empty ones too."""
    sizes = corpus.select(*by, F.size(tokens).alias("dl"))
    return sizes.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_idf(posts: DataFrame, stats: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., term, df, idf) of postings."""
    return _idf(posts.groupBy(*by, "term").agg(F.count("*").alias("df")), stats, by)


def _idf(df: DataFrame, stats: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Document frequencies turned into idf, negatives replaced."""
    # one row of statistics for each value of by
    raw = (df.join(stats, list(by)) if by else df.crossJoin(stats)).withColumn(
        "raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    )
    mean = raw.groupBy(*by).agg(F.avg("raw").alias("mean_raw"))
    both = raw.join(mean, list(by)) if by else raw.crossJoin(mean)
    return both.select(*by, "term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean_raw")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(qid, term, qtf) with repetitions counted."""
    own = queries.select(F.col(key).alias("qid"), F.explode(tokens).alias("term"))
    return own.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(
    terms: DataFrame, posts: DataFrame, idf: DataFrame, stats: DataFrame, k1: Column, b: Column, by: tuple[str, ...] = (),
    params: tuple[str, ...] = (),
) -> DataFrame:
    """(qid, by..., params..., key, score) of every passage that shares a term with a query.

    The query side meets the term table first, so the postings are read once for all queries; k1 and
    b may be columns of terms (params), which scores several settings in one plan.
    """
    weighted = terms.join(idf, "term")
    joined = weighted.join(posts, ["term", *by])
    joined = joined.join(stats, list(by)) if by else joined.crossJoin(stats)
    part = (
        F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1)
        / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    )
    return joined.groupBy("qid", *by, *params, "key").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("qid",), positive: bool = True) -> DataFrame:
    """The k best rows of each group: by score, rounded to 9 digits so that order doesn't hang on summation, then key."""
    w = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "key")
    out = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.where("score > 0") if positive else out


def term_weights(corpus: DataFrame, tokens: Column, stats: DataFrame) -> DataFrame:
    """(term, df, idf) without postings: distinct terms of each passage, counted before the shuffle."""
    terms = corpus.select(F.explode(F.array_distinct(tokens)).alias("term"))
    return _idf(terms.groupBy("term").agg(F.count("*").alias("df")), stats, ())


def _search(queries: DataFrame, qkey: str, qtokens: Column, corpus: DataFrame, key: str, tokens: Column, settings: list[tuple[float, float]], k: int) -> DataFrame:
    own = cut_lineage(corpus.select(F.col(key).alias("key"), tokens.alias("t0")).where("key IS NOT NULL"))  # tokens are made once
    stats = corpus_stats(own, F.col("t0"))
    idf = term_weights(own, F.col("t0"), stats)
    terms = query_terms(queries, qkey, qtokens).join(idf, "term").select("qid", F.lit("t").alias("field"), "term", (F.col("qtf") * F.col("idf")).alias("w"))
    terms = cut_lineage(terms)
    mean = stats.collect()[0]["avgdl"] or 0.0
    out = None
    for rows in blocked.query_blocks(terms):
        part = blocked.best(blocked.Block(rows, ["t"], {"t": mean}), own, settings, k)
        out = part if out is None else out.unionByName(part)
    return out


def bm25_topk(
    queries: DataFrame, qkey: str, qtokens: Column, corpus: DataFrame, key: str, tokens: Column, k: int = 5, k1: float = 1.5, b: float = 0.75
) -> DataFrame:
    """(qid, rank, key, score): the default profile. Queries or corpora without tokens give no rows."""
    own = cut_lineage(corpus.select(F.col(key).alias("key"), tokens.alias("t0")).where("key IS NOT NULL"))  # tokens are made once
    stats = corpus_stats(own, F.col("t0"))
    idf = term_weights(own, F.col("t0"), stats)
    terms = query_terms(queries, qkey, qtokens).join(idf, "term").select("qid", F.lit("t").alias("field"), "term", (F.col("qtf") * F.col("idf")).alias("w"))
    asked = cut_lineage(indexed.bags(terms))
    one = stats.collect()[0]
    mean, out = {"t": one["avgdl"] or 0.0}, None
    for rows in indexed.blocks(asked):
        part = _best_of(rows, ["t"], mean, own, one["n_docs"], k1, b, k)
        out = part if out is None else out.unionByName(part)
    found = top_k(out, k, ("bag",))
    return asked.select("qid", "bag").join(found, "bag").select("qid", "key", "score", "rank")


def _best_of(rows: pd.DataFrame, fields: list[str], mean: dict[str, float], held: DataFrame, passages: int, k1: float, b: float, k: int) -> DataFrame:
    """(bag, key, score): each task's best k for bags (bag, field, term, w) of tables (key, t0, ...)."""
    if (rows["w"] <= 0).any():  # a corpus of a few words in most passages: nothing can be left out
        return blocked.best(blocked.Block(rows.rename(columns={"bag": "qid"}), fields, mean), held, [(k1, b)], k).select(F.col("qid").alias("bag"), "key", "score")
    asked = indexed.Asked(rows, fields, mean)
    return _named(indexed.best(asked, held, passages, k1, b, k), asked.names).select("bag", "key", "score")


def _named(found: DataFrame, names: list[str]) -> DataFrame:
    """found with the bags at the places b."""
    at = found.sparkSession.createDataFrame(pd.DataFrame({"b": np.arange(len(names)), "bag": np.array(names, object)}), "b long, bag string")  # a block's
    return found.join(at, "b")


def bm25_grid(
    queries: DataFrame, qkey: str, qtokens: Column, corpus: DataFrame, key: str, tokens: Column, settings: list[tuple[float, float]], k: int = 5
) -> DataFrame:
    """(qid, k1, b, rank, key, score): several settings of k1 and b in one pass over the corpus."""
    found = top_k(_search(queries, qkey, qtokens, corpus, key, tokens, settings, k), k, ("qid", "setting"))
    at = lambda n: F.element_at(F.array(*(F.lit(float(s[n])) for s in settings)), F.col("setting") + 1)
    return found.select("qid", at(0).alias("k1"), at(1).alias("b"), "rank", "key", "score")


def corpus_scaled(
    queries: DataFrame, qkey: str, qtokens: Column, corpus: DataFrame, key: str, tokens: Column, k: int, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """(qid, rank, key, score, norm): the best k, with norm min-max scaled over the whole corpus, where passages without a hit score 0."""
    own = cut_lineage(corpus.select(F.col(key).alias("key"), tokens.alias("t0")).where("key IS NOT NULL"))  # tokens are made once
    stats = corpus_stats(own, F.col("t0"))
    idf = term_weights(own, F.col("t0"), stats)
    terms = query_terms(queries, qkey, qtokens).join(idf, "term").select("qid", F.lit("t").alias("field"), "term", (F.col("qtf") * F.col("idf")).alias("w"))
    terms = cut_lineage(terms)
    one = stats.collect()[0]
    tops, ranges = None, None
    for rows in blocked.query_blocks(terms):
        block = blocked.Block(rows, ["t"], {"t": one["avgdl"] or 0.0})
        t, r = blocked.best(block, own, [(k1, b)], k, False), blocked.spans(block, own, k1, b)
        tops, ranges = (t, r) if tops is None else (tops.unionByName(t), ranges.unionByName(r))
    lo = F.when(F.col("hit") < one["n_docs"], F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
    norm = F.when(F.col("hi") > lo, (F.col("score") - lo) / (F.col("hi") - lo)).otherwise(F.lit(1.0))
    return top_k(tops, k, positive=False).join(ranges, "qid").select("qid", "rank", "key", "score", norm.alias("norm"))


def field_bm25(
    queries: DataFrame, qkey: str, qtokens: Column, fields: DataFrame, tokens: Column, weights: dict[str, float], k: int = 5, k1: float = 1.2, b: float = 0.75
) -> DataFrame:
    """(qid, rank, key, score): min-max per field over the whole corpus, weighted sum, best k above 0.

    fields: (key, field, text), each field an index of its own. Two passes over the corpus: one for
    the range of each field's scores, one for the sums. Passages that a field doesn't match score 0
    there, so no product of queries and passages is needed. Where all passages score alike each gets
    the field's whole weight, which orders nothing and is left out.
    """
    names = list(weights)
    none = F.array().cast("array<string>")
    long = fields.select("key", "field", tokens.alias("t")).where(F.col("field").isin(*names) & F.col("key").isNotNull())
    by_key = long.groupBy("key").agg(*(F.max(F.when(F.col("field") == n, F.col("t"))).alias(f"t{i}") for i, n in enumerate(names)))
    held = cut_lineage(by_key)  # tokens are made once
    long = held.select("key", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"t{i}").alias("t")) for i, n in enumerate(names)))).alias("f"))
    long = long.select("key", "f.field", "f.t").where("t IS NOT NULL")
    stats = corpus_stats(long, F.col("t"), ("field",))
    terms_of = long.select("field", F.explode(F.array_distinct("t")).alias("term"))
    idf = _idf(terms_of.groupBy("field", "term").agg(F.count("*").alias("df")), stats, ("field",))
    terms = cut_lineage(query_terms(queries, qkey, qtokens).join(idf, "term").select("qid", "field", "term", (F.col("qtf") * F.col("idf")).alias("w")))
    wide = held.select("key", *(F.coalesce(f"t{i}", none).alias(f"t{i}") for i in range(len(names))))
    per = {r["field"]: r for r in stats.collect()}  # one row a field
    mean = {n: (per[n]["avgdl"] or 0.0) if n in per else 0.0 for n in names}
    out = None
    for rows in blocked.query_blocks(terms):
        block = blocked.Block(rows, names, mean)
        scale = blocked.spans(block, wide, k1, b).toPandas()  # at most a row for each query of the block and field
        if len(scale):
            missing = scale["hit"] < scale["field"].map(lambda n: per[n]["n_docs"])
            scale["lo"] = np.where(missing, np.minimum(scale["lo"], 0.0), scale["lo"])
            scale["hi"] = np.where(missing, np.maximum(scale["hi"], 0.0), scale["hi"])
        part = blocked.best_scaled(block, wide, scale, weights, k1, b, k)
        out = part if out is None else out.unionByName(part)
    return top_k(out, k)
