"""Normalisation and fusion of ranked streams: (qid, stream, key, score, rank) -> one ranking.

Streams are stacked and grouped by passage, which does the work of an n-ary full outer join with one
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: tuple[str, ...] = ("qid", "stream"), tie: str = "key") -> DataFrame:
    """df with its rank, from 1, by descending score (rounded to 9 digits) and key."""
    w = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), tie)
    return df.withColumn("rank", F.row_number().over(w))


def minmax(df: DataFrame, by: tuple[str, ...] = ("qid", "stream"), invert: Column | None = None) -> DataFrame:
    """df with norm: the score's place between the least and greatest of its list; 1 where all are equal.

    invert marks lists of distances, whose order is turned round (but not where all are equal). The
    extremes are aggregated and joined, so a hot list isn't gathered in one task.
    """
    span = df.groupBy(*by).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    x = (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    if invert is not None:
        x = F.when(invert, 1 - x).otherwise(x)
    return df.join(span, list(by)).withColumn("norm", F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(x)).drop("lo", "hi")


def fuse(streams: DataFrame, strategy: str, weight: Column, k: int = 60, by: tuple[str, ...] = ("qid",), stream: str = "stream") -> DataFrame:
    """(by..., key, score, first_stream, first_rank): weighted_linear, rrf or weighted_rrf over the stacked streams."""
    if strategy == "weighted_linear":
        part = weight * F.col("norm")
    elif strategy == "rrf":
        part = 1.0 / (k + F.col("rank"))
    elif strategy == "weighted_rrf":
        part = weight / (k + F.col("rank"))
    else:
        raise ValueError(f"unknown fusion {strategy!r}")
    first = F.min(F.struct(F.col(stream).alias("s"), F.col("rank").alias("r")))
    out = streams.groupBy(*by, "key").agg(F.sum(part).alias("score"), first.alias("f"))
    return out.select(*by, "key", "score", F.col("f.s").alias("first_stream"), F.col("f.r").alias("first_rank"))


def order_fused(fused: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The best k rows; ties in the order in which the streams first gave them."""
    w = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "first_stream", "first_rank", "key")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse_variants(lists: DataFrame, strategy: str, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Fusion of already fused lists over the variants of a query; a query with one variant passes unchanged.

    Several lists of one kind are told apart by what follows a # in the variant.
    """
    kind = F.substring_index("variant", "#", 1)
    w = F.coalesce(*(F.when(kind == v, F.lit(float(x))) for v, x in weights.items()), F.lit(1.0))
    many = lists.groupBy("qid").agg(F.count_distinct("variant").alias("variants"))
    stacked = minmax(lists, ("qid", "variant")).join(many, "qid")
    part = {"weighted_linear": w * F.col("norm"), "rrf": 1.0 / (k + F.col("rank")), "weighted_rrf": w / (k + F.col("rank"))}[strategy]
    return stacked.groupBy("qid", "key").agg(F.sum(F.when(F.col("variants") == 1, F.col("score")).otherwise(part)).alias("score"))


def hierarchy_bonus(fused: DataFrame, section: str = "section", size: float = 0.08) -> DataFrame:
    """score plus a bonus for the passage's section: sections are ranked by their best passage."""
    best = fused.groupBy("qid", section).agg(F.max("score").alias("best"))
    w = Window.partitionBy("qid").orderBy(F.round("best", 9).desc(), section)
    n = fused.groupBy("qid").agg(F.count_distinct(section).alias("sections"))
    bonus = best.withColumn("place", F.row_number().over(w) - 1).join(n, "qid").select(
        "qid", section, ((F.col("sections") - F.col("place")) / F.greatest(F.lit(1), F.col("sections")) * size).alias("bonus")
    )
    return fused.join(bonus, ["qid", section]).withColumn("score", F.col("score") + F.col("bonus"))


def component_trace(streams: DataFrame, names: list[str]) -> DataFrame:
    """(qid, key, <stream>_score, <stream>_rank..., stream_count): what each stream said of a passage."""
    cols = []
    for n in names:
        here = F.col("stream") == n
        cols += [F.max(F.when(here, F.col("score"))).alias(f"{n}_score"), F.max(F.when(here, F.col("rank"))).alias(f"{n}_rank")]
    return streams.groupBy("qid", "key").agg(*cols, F.count_distinct("stream").alias("stream_count"))


def add_feedback(original: DataFrame, feedback: DataFrame, weight: float = 0.25) -> DataFrame:
    """(qid, key, score, feedback_rank): original plus weighted feedback scores over the union of both lists."""
    o = original.select("qid", "key", F.col("score").alias("part"), F.lit(None).cast("int").alias("fr"))
    f = feedback.select("qid", "key", (weight * F.col("score")).alias("part"), F.col("rank").cast("int").alias("fr"))
    return o.unionByName(f).groupBy("qid", "key").agg(F.sum("part").alias("score"), F.max("fr").alias("feedback_rank"))


def confidence(fused: DataFrame, streams: DataFrame, dense: str, sparse: str) -> DataFrame:
    """(qid, confidence): half the gap of the two best scores (times 5, at most 1), half the agreement of the streams' firsts."""
    gap = fused.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("s2")
    )
    tops = streams.where("rank = 1").groupBy("qid").agg(
        F.max(F.when(F.col("stream") == dense, F.col("key"))).alias("d"), F.max(F.when(F.col("stream") == sparse, F.col("key"))).alias("s")
    )
    sep = F.when(F.col("s2").isNull(), 0.25).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s1") - F.col("s2")) * 5.0))
    agree = F.when(F.col("d").isNull() | F.col("s").isNull(), 0.25).when(F.col("d") == F.col("s"), 1.0).otherwise(0.0)
    return gap.join(tops, "qid", "left").select("qid", F.round(0.5 * sep + 0.5 * agree, 4).alias("confidence"))


def stream_agreement(streams: DataFrame) -> DataFrame:
    """(qid, agreement, margin): share of the commonest first passage, and mean relative lead of the firsts."""
    tops = streams.where("rank <= 2").groupBy("qid", "stream").agg(
        F.max(F.when(F.col("rank") == 1, F.col("key"))).alias("top"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("s1"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("s2"),
    )
    lead = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s1") - F.col("s2")) / F.greatest(F.abs("s1"), F.lit(1e-8))))
    votes = tops.groupBy("qid", "top").agg(F.count("*").alias("n"), F.sum(lead).alias("lead"))
    return votes.groupBy("qid").agg(
        F.round(F.max("n") / F.sum("n"), 4).alias("agreement"), F.round(F.sum("lead") / F.sum("n"), 4).alias("margin")
    )


def cascade(streams: DataFrame, agreement: DataFrame, shallow: int, deep: int, least: float = 0.42) -> DataFrame:
    """streams cut at the shallow depth, or at the deep one where the confidence is below least."""
    c = agreement.select("qid", (F.round(0.5 * F.col("agreement") + 0.5 * F.col("margin"), 4) < least).alias("escalated"))
    return streams.join(c, "qid").where(F.col("rank") <= F.when(F.col("escalated"), deep).otherwise(shallow))
