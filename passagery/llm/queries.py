"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagery.llm import groupsplit, leakage, leximin, markup, mixture, mojibake, overlap, pieces, reading
from passagery.runtime import table

SCORES = ["dense_score", "sparse_score", "late_interaction_score"]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return leximin.leximin_first(
        table(spark, root, "native_candidates"), "query_id", "chunk_key", SCORES, ["scored_at", "loaded_at"]
    )


def p1_ranking(spark: SparkSession, root: str) -> DataFrame:
    return leximin.leximin_ranking(
        table(spark, root, "native_candidates"), "query_id", "chunk_key", SCORES, ["scored_at", "loaded_at"]
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return pieces.oversized(table(spark, root, "documents_in"), table(spark, root, "phase5_configs"))


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    return pieces.split_documents(table(spark, root, "documents_in"), table(spark, root, "phase5_configs"), once=True)


def _records(spark: SparkSession, root: str) -> DataFrame:
    return markup.records(table(spark, root, "documents_in"), table(spark, root, "spans"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return markup.markup_kinds(_records(spark, root))


def p3_clean(spark: SparkSession, root: str) -> DataFrame:
    return markup.clean_records(_records(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = overlap.overlaps(table(spark, root, "benchmark_cases"))
    return pairs.select(
        F.least("train_case", "eval_case").alias("case_no_a"), F.greatest("train_case", "eval_case").alias("case_no_b")
    ).distinct()


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    return overlap.overlap_report(table(spark, root, "benchmark_cases"))


def _split_tables(spark: SparkSession, root: str) -> list[DataFrame]:
    return [table(spark, root, t) for t in ("benchmark_cases", "case_labels", "spans")]


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return groupsplit.divided_cases(*_split_tables(spark, root))


def p5_splits(spark: SparkSession, root: str) -> DataFrame:
    return groupsplit.new_splits(*_split_tables(spark, root))


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return groupsplit.split_report(p5_splits(spark, root), table(spark, root, "benchmark_cases"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, root, "documents_in")).select("document_id").distinct()


def p6_restored(spark: SparkSession, root: str) -> DataFrame:
    return mojibake.garbled_documents(table(spark, root, "documents_in"))


def p7_leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.leaked_items(table(spark, root, "documents"), table(spark, root, "heldout_passages"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_leaks(spark, root).select("doc_id", "item_id").distinct()


def _mixer(spark: SparkSession, root: str) -> mixture.Mixer:
    return mixture.Mixer(table(spark, root, "documents"), table(spark, root, "mix_targets"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return _mixer(spark, root).report().where("short").select("source").distinct()


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    return _mixer(spark, root).report()


def p8_mixture(spark: SparkSession, root: str) -> DataFrame:
    return _mixer(spark, root).mixture()


def p9_levels(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return reading.reading_levels(docs, reading.train(docs, table(spark, root, "reading_labels")))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    levels = reading.reading_levels(docs, reading.train(docs, table(spark, root, "reading_labels")), only="en")
    return levels.where("reading_level = 5").select("doc_id").distinct()


def p9_profile(spark: SparkSession, root: str) -> DataFrame:
    return p9_levels(spark, root).groupBy("lang", "reading_level").agg(F.count("*").alias("documents"), F.sum("words").alias("words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_ranking": p1_ranking,
        "p2_found": p2_found,
        "p2_pieces": p2_pieces,
        "p3_found": p3_found,
        "p3_clean": p3_clean,
        "p4_found": p4_found,
        "p4_report": p4_report,
        "p5_found": p5_found,
        "p5_splits": p5_splits,
        "p5_report": p5_report,
        "p6_found": p6_found,
        "p6_restored": p6_restored,
        "p7_found": p7_found,
        "p7_leaks": p7_leaks,
        "p8_found": p8_found,
        "p8_report": p8_report,
        "p8_mixture": p8_mixture,
        "p9_found": p9_found,
        "p9_levels": p9_levels,
        "p9_profile": p9_profile,
    }
