"""Exact nearest neighbours over dense vectors by blocked products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagery.runtime import BROADCAST_ROWS


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


#: Bytes of query vectors in one block, and cells of one matrix of scores.
BLOCK_BYTES, CELLS = 128 << 20, 4_000_000


def top_k(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, max_queries: int = BROADCAST_ROWS) -> DataFrame:
    """(qid, key, score, rank): the k rows of base with the greatest cosine to each query row.

    A block of at most max_queries query vectors and BLOCK_BYTES is shipped to the tasks; more are
    searched in blocks, each with one pass over base. A part of a batch of base is one matrix product of
    at most CELLS cells, and a task hands on only its k best per query, so the shuffle is bounded by
    tasks * queries * k. Null vectors are left out; a vector finds itself. Equal scores (to 5 digits) go
    to the smaller key.
    """
    spark = base.sparkSession
    own = queries.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("q"), F.col(vector).alias("v"))
    total, dims = own.agg(F.count("*"), F.max(F.size("v"))).first()
    max_queries = max(1, min(max_queries, BLOCK_BYTES // (8 * (dims or 1))))
    out = None
    for part in range(max(1, -(-total // max_queries))):
        block = own.where(F.pmod(F.xxhash64("q"), F.lit(max(1, -(-total // max_queries)))) == part).toPandas()
        ids = block["q"].to_numpy(np.int64)
        order = np.argsort(ids)
        mat = _unit(np.array(block["v"].tolist(), np.float64).reshape(len(ids), -1))[order] if len(ids) else np.zeros((0, 1))
        shared = spark.sparkContext.broadcast((ids[order], mat))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qids, q = shared.value
            best_s = np.full((len(qids), 0), -np.inf)
            best_k = np.zeros((len(qids), 0), np.int64)
            step = max(1, CELLS // max(len(qids), 1))
            for pdf in (whole.iloc[lo : lo + step] for whole in batches for lo in range(0, len(whole) if len(qids) else 0, step)):
                s = np.round(q @ _unit(np.array(pdf["v"].tolist(), np.float64)).T, 5)
                keys = np.broadcast_to(pdf["key"].to_numpy(np.int64), s.shape)
                s, keys = np.hstack([best_s, s]), np.hstack([best_k, keys])
                at = np.lexsort((keys, -s), axis=1)[:, :k]
                best_s, best_k = np.take_along_axis(s, at, 1), np.take_along_axis(keys, at, 1)
            n = best_s.shape[1]
            yield pd.DataFrame({"qid": np.repeat(qids, n), "key": best_k.ravel(), "score": best_s.ravel()})

        rows = base.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
        found = rows.mapInPandas(search, "qid long, key long, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "key")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
