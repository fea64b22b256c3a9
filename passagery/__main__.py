"""Command line: ingest a folder, search an index, evaluate labelled cases, chunk documents."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from passagery.functions.text import normalise_source, word_tokens
from passagery.operators import chunking, evaluation, lexical
from passagery.sources import cases, catalog, loaders


def _ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = loaders.with_document_id(loaders.load_directory(spark, a.folder))
    chunks = chunking.chunk_documents(docs.where("content IS NOT NULL"), a.strategy, a.size, a.overlap)
    chunks = chunks.withColumn("key", F.concat("chunk_id", F.lit("@"), "document_id"))
    catalog.Index(spark, a.index).build(chunks, strategy=a.strategy, size=a.size, overlap=a.overlap, corpus=catalog.corpus_fingerprint(docs, "file_name", "content"))
    failed = docs.where("error IS NOT NULL").select("file_name", "error")
    print(f"{chunks.count()} chunks")
    for r in failed.limit(50).collect():
        print(f"not read: {r['file_name']}: {r['error']}")


def _lists(spark: SparkSession, index: str, queries, k: int):
    chunks = catalog.Index(spark, index).part("chunks")
    top = lexical.bm25_topk(queries, "qid", word_tokens(F.col("text")), chunks, "key", word_tokens(F.col("content")), k)
    return top.join(chunks, "key")


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    found = _lists(spark, a.index, spark.createDataFrame([("q", a.question)], "qid string, text string"), a.top_k)
    for r in found.orderBy("rank").collect():
        print(f"{r['rank']}. {r['chunk_id']}  {r['score']:.4f}\n{r['content']}\n")


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = spark.read.text(a.cases)
    labels = cases.labels(lines)
    asked = lines.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.question").alias("text"))
    asked = asked.where("text IS NOT NULL").select(F.coalesce("id", "text").alias("qid"), "text")
    name = F.substring_index("chunk_id", "::", 1)
    where = F.array(normalise_source(name))
    found = _lists(spark, a.index, asked, a.top_k).select(
        F.col("qid").alias("case"), "rank", where.alias("docs"), where.alias("sources"), F.array(F.lower("chunk_id")).alias("aliases"),
        F.col("source_char_start").alias("start"), F.col("source_char_end").alias("end"),
    )
    kind = lambda k: labels.where(F.col("kind") == k)
    m = evaluation.evaluate(
        asked.select(F.col("qid").alias("case")), found, kind("span").select("case", "label", "doc", "start", "end", "gain"),
        kind("chunk").select("case", "label", "gain", "ordinal"), kind("source").select("case", F.col("label").alias("source")), a.top_k,
    )
    evaluation.grouped_metrics(m.withColumn("set", F.lit("cases")), "set").where("level = 'all'").show(truncate=False)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="passagery", description=__doc__)
    sub = p.add_subparsers(required=True)
    c = sub.add_parser("ingest", help="load a folder, cut it into chunks, write an index")
    c.add_argument("folder")
    c.add_argument("index")
    c.add_argument("--strategy", default="character", choices=sorted(chunking.STRATEGIES))
    c.add_argument("--size", type=int, default=1000)
    c.add_argument("--overlap", type=int, default=200)
    c.set_defaults(run=_ingest)
    c = sub.add_parser("search", help="the best passages for a question")
    c.add_argument("index")
    c.add_argument("question")
    c.add_argument("--top-k", type=int, default=5)
    c.set_defaults(run=_search)
    c = sub.add_parser("evaluate", help="retrieval metrics over a file of cases, one JSON line each")
    c.add_argument("index")
    c.add_argument("cases")
    c.add_argument("--top-k", type=int, default=5)
    c.set_defaults(run=_evaluate)
    a = p.parse_args(argv)
    a.run(SparkSession.builder.appName("passagery").getOrCreate(), a)


if __name__ == "__main__":
    main()
