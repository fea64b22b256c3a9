"""Streaming ingestion: new documents are chunked and appended once. An extension beyond batch ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagery.operators.chunking import chunk_documents
from passagery.sources.catalog import append_new


def read_documents(spark: SparkSession, path: str, schema: str, time: str = "ingested_at", late: str = "30 days") -> DataFrame:
    """Documents of a Parquet folder as a stream; an id within the watermark is taken once."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(time, late).dropDuplicatesWithinWatermark(["id"])


def ingest(docs: DataFrame, out: str, checkpoint: str, size: int = 1000, overlap: int = 200) -> StreamingQuery:
    """Chunk every micro-batch and append the chunks that the table lacks, so a batch that runs again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(chunk_documents(batch, "character", size, overlap), out, ["document_id", "chunk_index"])

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total): events per tumbling window; rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
