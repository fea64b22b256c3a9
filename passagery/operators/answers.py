"""Context, prompts and answers for batches of questions; the language model is a callable that is passed in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is answered where nothing was found.
NOTHING = "No relevant context found to answer the question."
HISTORY = 4


def message_text(value: object) -> str:
    """The text of a message: nothing, a text, a mapping with a text, or a list of such, joined by blanks."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, dict):
        own = value.get("text")
        return own if isinstance(own, str) else str(value)
    if isinstance(value, (list, tuple)):
        return " ".join(t for t in map(message_text, value) if t).strip()
    return str(value)


def normalise_history(items: list) -> list[dict[str, str]]:
    """Messages {role, content} of a chat given as mappings or as (user, assistant) pairs; other roles and empty texts are left out."""
    flat: list[tuple[str, object]] = []
    for x in items or []:
        if isinstance(x, dict):
            flat.append((str(x.get("role")), x.get("content")))
        elif isinstance(x, (list, tuple)) and len(x) == 2:
            flat += [("user", x[0]), ("assistant", x[1])]
    made = [{"role": r, "content": message_text(c)} for r, c in flat if r in ("user", "assistant")]
    return [m for m in made if m["content"]]


def last_messages(messages: DataFrame, by: str, order: str, n: int = HISTORY) -> DataFrame:
    """The last n messages of each conversation."""
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return messages.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def source_line(rank: Column, file: Column, index: Column | None = None) -> Column:
    """The line above a passage: its number, its file, and the number of its chunk."""
    name = F.coalesce(file, F.lit("Unknown Source"))
    tail = F.lit("") if index is None else F.concat(F.lit(" (Chunk "), F.coalesce(index.cast("string"), F.lit("?")), F.lit(")"))
    return F.concat(F.lit("--- Source ["), rank.cast("string"), F.lit("]: "), name, tail, F.lit(" ---"))


def contexts(results: DataFrame, numbered: bool = True) -> DataFrame:
    """(qid, context): the passages of each query in their order; results: (qid, rank, content, file_name, chunk_index)."""
    line = source_line(F.col("rank"), F.col("file_name"), F.col("chunk_index") if numbered else None)
    part = F.concat(line, F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    own = results.select("qid", F.struct("rank", part.alias("part")).alias("p"))
    return own.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "\n").alias("context"))  # top_k a query


def prompt(question: Column, context: Column) -> Column:
    """One text that asks for an answer from the context alone, with the numbers of its sources."""
    return F.concat(
        F.lit("Answer the question from the numbered sources below and from nothing else. Name the sources of each statement like [1]. "
              "If they do not hold the answer, say that you do not know. Where they contradict each other, keep to the most fitting one.\n\n"),
        F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\nAnswer:"),
    )


def answer(
    questions: DataFrame, results: DataFrame, generate: Callable[[str, list[dict[str, str]]], str], history: DataFrame | None = None
) -> DataFrame:
    """(qid, final_answer, retrieved_sources, confidence_notes) for every question.

    questions: (qid, text); history: (qid, place, role, content), of which the last HISTORY messages count.
    A question without passages isn't generated for; what generate raises becomes the answer's text, so
    one failure doesn't end a batch.
    """
    ctx = contexts(results, numbered=False)
    listed = F.struct(F.col("rank").cast("int").alias("source_id"), "file_name", F.col("score").cast("double").alias("score"), F.col("chunk_index").cast("int").alias("chunk_index"))
    sources = results.groupBy("qid").agg(F.array_sort(F.collect_list(listed)).alias("retrieved_sources"))  # top_k a query
    own = questions.join(ctx, "qid", "left").join(sources, "qid", "left")
    kind = "array<struct<source_id:int,file_name:string,score:double,chunk_index:int>>"
    own = own.withColumn("retrieved_sources", F.coalesce("retrieved_sources", F.array().cast(kind)))
    if history is None:
        own = own.withColumn("said", F.array().cast("array<struct<place:long,role:string,content:string>>"))
    else:
        kept = last_messages(history.where("role IN ('user', 'assistant') AND content <> ''"), "qid", "place")
        said = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("long").alias("place"), "role", "content"))).alias("said"))  # at most HISTORY
        own = own.join(said, "qid", "left")
    own = own.withColumn("prompt", prompt(F.col("text"), F.col("context")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for context, text, said in zip(pdf["context"], pdf["prompt"], pdf["said"]):
                if context is None:
                    out.append(NOTHING)
                    continue
                messages = [{"role": m["role"], "content": m["content"]} for m in (said if said is not None else [])]
                try:
                    out.append(generate(text, messages))
                except Exception as e:  # noqa: BLE001  (shown in the answer)
                    out.append(f"Error generating answer: {e}")
            notes = ["Low confidence: there is no context." if c is None else "Generated from the retrieved context." for c in pdf["context"]]
            yield pdf[["qid", "retrieved_sources"]].assign(final_answer=out, confidence_notes=notes)[["qid", "final_answer", "retrieved_sources", "confidence_notes"]]

    qid = dict(questions.dtypes)["qid"]
    return own.select("qid", "context", "prompt", "said", "retrieved_sources").mapInPandas(
        run, f"qid {qid}, final_answer string, retrieved_sources {kind}, confidence_notes string"
    )
