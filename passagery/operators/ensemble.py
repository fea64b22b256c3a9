"""Several dense streams and several instructions at once; routing learned from text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, NGram, SQLTransformer, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagery.functions import signals
from passagery.functions.text import word_tokens
from passagery.operators.protocol import Unavailable

#: The instructions of an ensemble.
ENSEMBLE = ("generic", "semantic", "precision", "ambiguity", "multiple")


def instruction_modes(query: Column, mode: str) -> Column:
    """The instructions under which a query is encoded: all of them, the one routed by its signals, or the given one."""
    if mode == "ensemble":
        return F.array(*map(F.lit, ENSEMBLE))
    return F.array(signals.field_instruction(query) if mode == "routed" else F.lit(mode))


def best_over_modes(hits: DataFrame, depth: int) -> DataFrame:
    """(qid, stream, key, score, rank): of each candidate the greatest score over the modes; ties by key. hits: (qid, stream, mode, key, score)."""
    best = hits.groupBy("qid", "stream", "key").agg(F.max("score").alias("score"))
    w = Window.partitionBy("qid", "stream").orderBy(F.col("score").desc(), "key")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= depth)


def resolve_hits(hits: DataFrame, records: DataFrame) -> DataFrame:
    """hits (file_name, chunk_index, content, distance, ...) with key and score = 1 - distance of the records they are.

    A hit is known by file and index, else by its text (the least key of equal texts); others are left out.
    records: (key, file_name, chunk_index, content), file and index being unique.
    """
    by_place = records.select("file_name", "chunk_index", F.col("key").alias("_a"))
    by_text = records.groupBy(F.xxhash64("content").alias("_h"), "content").agg(F.min("key").alias("_b"))
    placed = hits.join(by_place, ["file_name", "chunk_index"], "left")
    lost = placed.where("_a IS NULL").withColumn("_h", F.xxhash64("content")).join(by_text, ["_h", "content"], "left")
    shown = [c for c in hits.columns if c != "distance"]
    score = (1 - F.col("distance")).alias("score")
    known = placed.where("_a IS NOT NULL").select(*shown, F.col("_a").alias("key"), score)
    return known.unionByName(lost.where("_b IS NOT NULL").select(*shown, F.col("_b").alias("key"), score))


class StreamIndex:
    """Dense streams by name, each a function from (queries, depth) to (qid, key, score, rank).

    A stream whose model isn't there doesn't raise: it is left out, and errors tells why.
    """

    def __init__(self, backends: dict[str, Callable[[], Callable[[DataFrame, int], DataFrame]]]):
        self.streams: dict[str, Callable[[DataFrame, int], DataFrame]] = {}
        self.errors: dict[str, str] = {}
        for name, make in backends.items():
            try:
                self.streams[name] = make()
            except (Unavailable, ImportError, OSError) as e:
                self.errors[name] = str(e)

    def search(self, queries: DataFrame, weights: dict[str, float], depth: int) -> dict[str, DataFrame]:
        """The streams that have a weight above 0 and a model."""
        return {n: self.streams[n](queries, depth) for n, w in weights.items() if w > 0 and n in self.streams}


def hypothetical(queries: DataFrame, provider: Callable[[DataFrame], DataFrame] | None, search: Callable[[DataFrame], DataFrame], found: DataFrame, weight: float = 0.25) -> tuple[DataFrame, str]:
    """(found with the scores of a second search added, status): the second search is for an answer that provider makes up.

    provider turns (qid, text) into (qid, text); without one nothing is added and the status is blocked.
    found and what search gives: (qid, key, score).
    """
    if provider is None:
        return found.select("qid", "key", "score"), "blocked"
    more = search(provider(queries))
    both = found.select("qid", "key", "score").unionByName(more.select("qid", "key", (weight * F.col("score")).alias("score")))
    return both.groupBy("qid", "key").agg(F.sum("score").alias("score")), "applied"


def best_instruction(scored: DataFrame) -> DataFrame:
    """(case, mode): the instruction with the greatest nDCG, then MRR, the generic one before others, then by name. scored: (case, mode, ndcg, mrr)."""
    w = Window.partitionBy("case").orderBy(F.desc("ndcg"), F.desc("mrr"), (F.col("mode") != "generic").cast("int"), "mode")
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("case", "mode")


class InstructionRouter:
    """Multinomial logistic regression over TF-IDF of words and pairs of words; with fewer than two labels it is constant."""

    def __init__(self, buckets: int = 1 << 14):
        self.buckets = buckets
        self.model = None
        self.constant: str | None = None

    @staticmethod
    def _tokens(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_t", word_tokens(F.col("text")))

    def fit(self, rows: DataFrame) -> InstructionRouter:
        """rows: (text, mode)."""
        kinds = [r[0] for r in rows.select("mode").distinct().orderBy("mode").limit(2).collect()]
        if len(kinds) < 2:
            self.constant = kinds[0] if kinds else "generic"
            return self
        index = StringIndexer(inputCol="mode", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
        stages = [
            NGram(n=2, inputCol="_t", outputCol="_p"), SQLTransformer(statement="SELECT *, concat(_t, _p) AS _w FROM __THIS__"),
            HashingTF(inputCol="_w", outputCol="_c", numFeatures=self.buckets), IDF(inputCol="_c", outputCol="features"),
            LogisticRegression(labelCol="_y", family="multinomial", regParam=0.01), IndexToString(inputCol="prediction", outputCol="_mode", labels=index.labels),
        ]
        self.model = Pipeline(stages=stages).fit(index.transform(self._tokens(rows)))
        return self

    def route(self, rows: DataFrame) -> DataFrame:
        """rows with mode."""
        if self.constant is not None:
            return rows.withColumn("mode", F.lit(self.constant))
        if self.model is None:
            raise RuntimeError("the router isn't fitted")
        return self.model.transform(self._tokens(rows)).select(*rows.columns, F.col("_mode").alias("mode"))


def cross_validated_modes(rows: DataFrame, fold: str = "fold") -> DataFrame:
    """rows (case, text, mode, fold) with routed: the instruction that a router chooses which learnt from the other folds."""
    out = None
    for f in sorted(r[0] for r in rows.select(fold).distinct().collect()):
        router = InstructionRouter().fit(rows.where(F.col(fold) != f).select("text", "mode"))
        part = router.route(rows.where(F.col(fold) == f).withColumnRenamed("mode", "_own")).withColumnRenamed("mode", "routed").withColumnRenamed("_own", "mode")
        out = part if out is None else out.unionByName(part)
    return out
