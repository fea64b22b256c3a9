"""Labels joined to results, and ranking metrics per case, category and fold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagery.functions import draws
from passagery.functions.text import normalise_source

METRICS = ("recall", "precision", "mrr", "ndcg")


def canonical_id(chunk_id: Column, file_name: Column, file_path: Column, index: Column) -> Column:
    """The id by which a result is known: its own, else file::index, else the file; in the form of sources."""
    source = normalise_source(F.coalesce(F.nullif(file_name, F.lit("")), file_path))
    made = F.when((source != "") & index.isNotNull(), F.concat(source, F.lit("::"), index.cast("string"))).otherwise(source)
    own = normalise_source(chunk_id)
    return F.when(own != "", own).otherwise(made)


def chunk_aliases(chunk_id: Column, file_name: Column, file_path: Column, index: Column) -> Column:
    """The up to three ids by which a label may know a result: its own, file name and path with the index."""
    own = normalise_source(chunk_id)
    made = [F.when((normalise_source(c) != "") & index.isNotNull(), F.concat(normalise_source(c), F.lit("::"), index.cast("string"))) for c in (file_name, file_path)]
    return F.array_distinct(F.array_compact(F.array(F.when(own != "", own), *made)))


def path_suffixes(c: Column) -> Column:
    """a/b/c -> [a/b/c, b/c, c]; nothing for an empty path."""
    parts = F.split(c, "/")
    made = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return F.when(c != "", made).otherwise(F.array().cast("array<string>"))


def _named(results: DataFrame, one: str, many: str) -> DataFrame:
    """results with an array column `many` of the names of their file; a column `one` will do for a single name."""
    return results if many in results.columns else results.withColumn(many, F.array(one))


def match_spans(results: DataFrame, labels: DataFrame) -> DataFrame:
    """(case, rank, label, gain): results whose interval overlaps a labelled span of the same document.

    results: (case, rank, docs, start, end), docs being the file's name and path, or doc for one of them;
    labels: (case, label, doc, start, end, gain). A file is the label's if its name or path is, or ends
    in it after a slash. The join is an equi join on case and path suffix; the interval test narrows it.
    Missing offsets match nothing.
    """
    own = _named(results, "doc", "docs")
    r = own.select("case", "rank", "start", "end", F.explode(F.array_distinct(F.flatten(F.transform(F.array_compact("docs"), path_suffixes)))).alias("doc")).alias("r")
    s = labels.where("doc <> ''").alias("l")
    overlap = F.greatest("r.start", "l.start") < F.least("r.end", "l.end")
    whole = F.col("r.start").isNotNull() & F.col("r.end").isNotNull() & F.col("l.start").isNotNull() & F.col("l.end").isNotNull()
    same = (F.col("r.case") == F.col("l.case")) & (F.col("r.doc") == F.col("l.doc"))
    return r.join(s, same & whole & overlap).select("r.case", "r.rank", "l.label", "l.gain").distinct()


def match_aliases(results: DataFrame, labels: DataFrame, aliases: str = "aliases") -> DataFrame:
    """(case, rank, label, gain): results that carry a labelled chunk id under any alias; the first label by ordinal wins."""
    r = results.select("case", "rank", F.explode(F.array_distinct(F.array_compact(aliases))).alias("label"))
    w = Window.partitionBy("case", "rank").orderBy("ordinal", "label")
    return r.join(labels, ["case", "label"]).withColumn("n", F.row_number().over(w)).where("n = 1").select("case", "rank", "label", "gain")


def match_sources(results: DataFrame, labels: DataFrame) -> DataFrame:
    """(case, rank): results of which a name contains an expected source (or ends in it), or has its base name.

    results: (case, rank, sources), the file's name and path, or source for one of them. Keyed by case,
    so the substring test runs only within a case's own labels.
    """
    r = _named(results, "source", "sources").select("case", "rank", F.explode(F.array_distinct(F.array_compact("sources"))).alias("source")).alias("r")
    s = labels.alias("l")
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    hit = F.contains(F.col("r.source"), F.col("l.source")) | (base(F.col("r.source")) == base(F.col("l.source"))) & (base(F.col("l.source")) != "")
    return r.join(s, (F.col("r.case") == F.col("l.case")) & (F.col("l.source") != "") & hit).select("r.case", "r.rank").distinct()


def gains(results: DataFrame, spans: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(case, rank, kind, label, gain): what each result earns, by the case's best kind of labels.

    A case with span labels is judged by them alone, else by its chunk labels, else by its sources, where
    a hit counts 1. Of several spans the first by name is named and the greatest gain counts. results
    carry docs, aliases and sources.
    """
    spanned = spans.select("case").distinct()
    chunked = chunks.select("case").distinct().join(spanned, "case", "left_anti")
    by_span = match_spans(results, spans).groupBy("case", "rank").agg(F.min("label").alias("label"), F.max("gain").alias("gain"))
    by_chunk = match_aliases(results.join(chunked, "case", "left_semi"), chunks)
    rest = results.join(spanned, "case", "left_anti").join(chunked, "case", "left_anti")
    by_source = match_sources(rest, sources).select("case", "rank", F.lit("source").alias("label"), F.lit(1.0).alias("gain"))
    parts = [x.select("case", "rank", F.lit(k).alias("kind"), "label", "gain") for k, x in (("span", by_span), ("chunk", by_chunk), ("source", by_source))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def source_metrics(cases: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """(case, recall, precision, mrr, ndcg) of cases that know only their sources: recall is 1 with any hit, and the ideal order has the hits found."""
    top = matches.where(F.col("rank") <= k).select("case", "rank").distinct()
    per = top.groupBy("case").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("hits").cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cases.select("case").distinct().join(per, "case", "left").select(
        "case", F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("recall"), zero(F.col("hits") / F.lit(float(k))).alias("precision"),
        zero(1.0 / F.col("first")).alias("mrr"), zero(F.when(F.col("hits") > 0, F.col("dcg") / ideal)).alias("ndcg"),
    )


def evaluate(
    cases: DataFrame, results: DataFrame, spans: DataFrame, chunks: DataFrame, sources: DataFrame, k: int, once: bool = False
) -> DataFrame:
    """(case, recall, precision, mrr, ndcg) of every case by its best kind of labels: spans, else chunks, else sources."""
    spanned = spans.select("case").distinct()
    chunked = chunks.select("case").distinct().join(spanned, "case", "left_anti")
    every = cases.select("case").distinct()
    rest = every.join(spanned, "case", "left_anti").join(chunked, "case", "left_anti")
    own = chunks.join(chunked, "case", "left_semi").select("case", "label", "gain")
    labels = spans.select("case", "label", "gain").unionByName(own)
    met = match_spans(results, spans).unionByName(match_aliases(results.join(chunked, "case", "left_semi"), chunks))
    known = case_metrics(every.join(rest, "case", "left_anti"), met, labels, k, once)
    return known.unionByName(source_metrics(rest, match_sources(results.join(rest, "case", "left_semi"), sources), k))


def ideal_dcg(labels: DataFrame, k: int) -> DataFrame:
    """(case, idcg, relevant): the best possible discounted gain of a case's distinct labels."""
    one = labels.groupBy("case", "label").agg(F.max("gain").alias("gain"))
    w = Window.partitionBy("case").orderBy(F.col("gain").desc(), "label")
    ranked = one.withColumn("r", F.row_number().over(w))
    term = F.when(F.col("r") <= k, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("r") + 1.0)).otherwise(0.0)
    return ranked.groupBy("case").agg(F.sum(term).alias("idcg"), F.count("*").alias("relevant"))


def case_metrics(cases: DataFrame, matches: DataFrame, labels: DataFrame, k: int, once: bool = True) -> DataFrame:
    """(case, recall, precision, mrr, ndcg) for every case; what isn't found counts 0.

    once: a label earns gain only at the first rank that meets it, so nDCG stays within 1; otherwise
    each result earns the greatest gain of the labels it meets.
    """
    top = matches.where(F.col("rank") <= k)
    if once:
        top = top.groupBy("case", "label").agg(F.min("rank").alias("rank"), F.max("gain").alias("gain"))
    per_rank = top.groupBy("case", "rank").agg(F.max("gain").alias("gain"))
    dcg = per_rank.groupBy("case").agg(
        F.sum((F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("hits")
    )
    found = top.groupBy("case").agg(F.count_distinct("label").alias("found"))
    joined = cases.select("case").distinct().join(ideal_dcg(labels, k), "case", "left").join(dcg, "case", "left").join(found, "case", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "case", zero(F.col("found") / F.col("relevant")).alias("recall"), zero(F.col("hits") / F.lit(float(k))).alias("precision"),
        zero(1.0 / F.col("first")).alias("mrr"), zero(F.try_divide("dcg", "idcg")).alias("ndcg"),
    )


def grouped_metrics(metrics: DataFrame, *groups: str, digits: int = 4) -> DataFrame:
    """Means over all cases and over each group column, in one pass by grouping sets; `level` tells which."""
    named = metrics.select(*(F.coalesce(F.col(g).cast("string"), F.lit("uncategorized")).alias(g) for g in groups), *METRICS)
    sets = ", ".join(["()", *(f"({g})" for g in groups)])
    level = "CASE " + " ".join(f"WHEN grouping({g}) = 0 THEN '{g}'" for g in groups) + " ELSE 'all' END"
    name = "coalesce(" + ", ".join(groups) + ", 'all')"
    means = ", ".join(f"round(avg({m}), {digits}) AS {m}" for m in METRICS)
    return metrics.sparkSession.sql(
        f"SELECT {level} AS level, {name} AS name, {means}, count(*) AS cases FROM {{rows}} GROUP BY GROUPING SETS ({sets})", rows=named
    )


def case_details(cases: DataFrame, results: DataFrame, earned: DataFrame, metrics: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """One trace row a case: what was asked, what is relevant, what came back and what it earned.

    cases: (case, category, q), results: (case, rank, id, source), earned as of gains, labels: (case, label).
    """
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce(c, F.lit("")).alias("v")))), lambda s: s["v"]), " | ")
    got = results.where(F.col("rank") <= k).groupBy("case").agg(listed("id").alias("retrieved_chunk_ids"), listed("source").alias("retrieved_sources"))  # at most k
    first = earned.where((F.col("rank") <= k) & (F.col("gain") > 0)).groupBy("case").agg(F.min("rank").alias("first_relevant_rank"))
    want = labels.groupBy("case").agg(F.array_join(F.array_sort(F.collect_set("label")), " | ").alias("relevant_chunk_ids"))  # one case's labels
    one = cases.select("case", F.coalesce("category", F.lit("uncategorized")).alias("category"), F.col("q").alias("question"))
    out = one.join(want, "case", "left").join(got, "case", "left").join(first, "case", "left").join(metrics, "case")
    return out.select(
        "case", "category", "question", *(F.coalesce(c, F.lit("")).alias(c) for c in ("relevant_chunk_ids", "retrieved_chunk_ids", "retrieved_sources")),
        F.col("first_relevant_rank").isNotNull().alias("source_hit"), "first_relevant_rank", *(F.round(m, 4).alias(m) for m in METRICS),
    )


def hit_counts(details: DataFrame) -> DataFrame:
    """(hits, misses) of case details."""
    return details.agg(F.count_if("source_hit").alias("hits"), F.count_if(~F.col("source_hit")).alias("misses"))


def routing_summary(details: DataFrame) -> DataFrame:
    """One row: how often queries were rewritten, expanded, fed back and escalated; null flags count as false, null confidences don't count."""
    n = F.count("*")
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    share = lambda c: F.coalesce(F.round(F.try_divide(100.0 * flag(c), n), 4), F.lit(0.0))
    return details.agg(
        n.alias("cases"), flag("rewrite_applied").alias("rewrite_count"), share("rewrite_applied").alias("rewrite_rate_percent"),
        flag("expansion_applied").alias("expansion_count"), share("expansion_applied").alias("expansion_rate_percent"),
        flag("prf_applied").alias("prf_count"), share("prf_applied").alias("prf_rate_percent"),
        flag("confidence_triggered").alias("confidence_trigger_count"), F.coalesce(F.round(F.avg("confidence_score"), 4), F.lit(0.0)).alias("average_confidence"),
        F.coalesce(F.round(F.avg(F.coalesce("query_variant_count", F.lit(1))), 4), F.lit(0.0)).alias("average_query_variant_count"),
    )


def latency_summary(details: DataFrame, latency: str, escalated: str) -> DataFrame:
    """(mean_ms, p95_ms, escalation_rate_percent); the percentile is the nearest rank."""
    return details.agg(
        F.coalesce(F.round(F.avg(latency), 3), F.lit(0.0)).alias("mean_ms"),
        F.coalesce(F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {latency})"), 3), F.lit(0.0)).alias("p95_ms"),
        F.coalesce(F.round(100.0 * F.avg(F.coalesce(escalated, F.lit(False)).cast("double")), 4), F.lit(0.0)).alias("escalation_rate_percent"),
    )


def failures(cases: DataFrame, matches: DataFrame, labels: DataFrame, stream_matches: DataFrame, results: DataFrame, shown: int = 5) -> DataFrame:
    """(case, first_rank, label, streams, top): the labels of cases whose first match isn't at rank 1.

    streams tells at which rank each stream has the label, top the keys of the best results.
    matches: (case, rank, label), stream_matches: (case, stream, rank, label), results: (case, rank, key).
    """
    first = cases.select("case").distinct().join(matches.groupBy("case").agg(F.min("rank").alias("first_rank")), "case", "left")
    bad = first.where("first_rank IS NULL OR first_rank > 1")
    per = stream_matches.groupBy("case", "label", "stream").agg(F.min("rank").alias("rank"))
    streams = per.groupBy("case", "label").agg(F.array_sort(F.collect_list(F.concat_ws("@", "stream", F.col("rank").cast("string")))).alias("s"))  # one a stream
    best = results.where(F.col("rank") <= shown).groupBy("case").agg(F.array_sort(F.collect_list(F.struct("rank", "key"))).alias("t"))
    out = bad.join(labels.select("case", "label").distinct(), "case").join(streams, ["case", "label"], "left").join(best, "case", "left")
    joined = lambda c: F.coalesce(F.array_join(c, " | "), F.lit(""))
    return out.select("case", "first_rank", "label", joined(F.col("s")).alias("streams"), joined(F.transform("t", lambda x: x["key"])).alias("top"))


def fold_summary(metrics: DataFrame, fold: str, metric: str = "ndcg") -> DataFrame:
    """(mean, deviation, p95): mean and population deviation of the folds' means, and the 95th percentile of the cases, interpolated."""
    per = metrics.groupBy(fold).agg(F.avg(metric).alias("m"))
    spread = per.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("deviation"))
    return spread.crossJoin(metrics.agg(F.percentile(metric, F.lit(0.95)).alias("p95")))  # one row each


def rank_histogram(cases: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """(bucket, cases): cases by the rank of their first match, ranks without cases as 0, misses as `miss`."""
    first = matches.where(F.col("rank") <= k).groupBy("case").agg(F.min("rank").alias("first"))
    have = cases.select("case").distinct().join(first, "case", "left").groupBy(F.coalesce(F.col("first").cast("string"), F.lit("miss")).alias("bucket")).agg(
        F.count("*").alias("cases")
    )
    buckets = cases.sparkSession.range(1, k + 2).select(F.when(F.col("id") <= k, F.col("id").cast("string")).otherwise("miss").alias("bucket"))
    return buckets.join(have, "bucket", "left").select("bucket", F.coalesce("cases", F.lit(0)).alias("cases"))


def keyword_rate(df: DataFrame, answer: str, keywords: str) -> DataFrame:
    """df with keyword_rate: the share of its keywords that the answer contains in any case; 1 without keywords."""
    kw = F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: k.isNotNull())
    low = F.lower(F.coalesce(answer, F.lit("")))
    hit = F.size(F.filter(kw, lambda k: F.contains(low, F.lower(k))))
    return df.withColumn("keyword_rate", F.when(F.size(kw) > 0, hit / F.size(kw)).otherwise(F.lit(1.0)))


def bootstrap_delta(pairs: DataFrame, samples: int = 5000, seed: int = 1729) -> DataFrame:
    """(observed, low, high, crosses_zero) of the mean of b - a by resampling; pairs: (n, a, b) with n from 0 without gaps.

    Each sample draws as many cases as there are, with an MD5 hash of (seed, sample, draw) in place of a
    generator, so the result doesn't depend on partitions. A task hashes its samples' draws in arrays and hands
    on a mean a sample; the differences of all cases, a number each, are shipped to the tasks.
    """
    spark = pairs.sparkSession
    own = pairs.select("n", (F.col("b") - F.col("a")).alias("x")).toPandas().sort_values("n")  # one number a case
    x = own["x"].to_numpy(float)
    observed = pairs.agg(F.avg(F.col("b") - F.col("a")).alias("observed"))
    if not len(x):
        return observed.select("observed", *(F.lit(None).cast("double").alias(c) for c in ("low", "high")), F.lit(None).cast("boolean").alias("crosses_zero"))
    values, code = np.unique(x, return_inverse=True)
    shared = spark.sparkContext.broadcast((values, code.astype(np.int32)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, code = shared.value
        for pdf in batches:
            for s in pdf["s"].tolist():
                counts = np.zeros(len(values), np.int64)
                for n in draws.drawn(f"{seed}|{s}|", len(code)):
                    counts += np.bincount(code[n], minlength=len(values))
                yield pd.DataFrame({"m": [float((values * counts).sum() / len(code))]})

    tasks = max(spark.sparkContext.defaultParallelism, min(samples, len(x) * samples // 20_000_000))  # about as many draws a task
    means = spark.range(samples, numPartitions=tasks).select(F.col("id").alias("s")).mapInPandas(run, "m double")
    q = means.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return observed.crossJoin(q).select(
        "observed", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), ((F.col("q")[0] <= 0) & (F.col("q")[1] >= 0)).alias("crosses_zero")
    )
