"""Reranking pools, diversity selection and learned ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagery.functions import text as T
from passagery.operators.protocol import Unavailable


class BackendUnavailable(Unavailable):
    """A model that isn't installed was asked for."""


def rerank(results: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], pool: int, top_k: int) -> DataFrame:
    """The best top_k of the first `pool` results by score(queries, passages); results: (qid, rank, key, text, content).

    The pool is cut before the scorer, so that only its rows reach Python; what the scorer leaves
    null keeps its place behind the rest.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, p in batches:
            yield score(q, p).astype("float64")

    kept = results.where(F.col("rank") <= max(pool, top_k))
    scored = kept.withColumn("new", F.pandas_udf(run, "double")("text", "content"))
    w = Window.partitionBy("qid").orderBy(F.col("new").desc_nulls_last(), "rank")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top_k)


def _select(pdf: pd.DataFrame, top_k: int, balance: float) -> list[int]:
    n = len(pdf)
    if n <= top_k:
        return list(range(n))
    s = pdf["score"].to_numpy(float)
    rel = np.ones(n) if s.max() == s.min() else (s - s.min()) / (s.max() - s.min())
    bags = [frozenset(t) for t in pdf["tokens"]]
    picked, near = [0], np.zeros(n)
    free = np.ones(n, bool)
    free[0] = False
    while len(picked) < top_k:
        last = bags[picked[-1]]
        sim = np.array([len(b & last) / len(b | last) if b or last else 0.0 for b in bags])
        near = np.maximum(near, sim)
        value = np.where(free, balance * rel - (1 - balance) * near, -np.inf)
        best = int(np.argmax(value))
        picked.append(best)
        free[best] = False
    return picked


def diversify(results: DataFrame, top_k: int, balance: float = 0.7, depth: int | None = None) -> DataFrame:
    """(qid, place, key, score): greedy maximal marginal relevance over the results of each query, or the first `depth` of them.

    The first result stays first. Each further one maximises balance * relevance (min-max scaled)
    less (1 - balance) * its greatest token overlap with what is picked; ties to the better rank.
    Lists of at most top_k stay as they are.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        own = pdf.loc[_select(pdf, top_k, balance), ["qid", "key", "score"]]
        return own.assign(place=np.arange(1, len(own) + 1, dtype="int32"))[["qid", "place", "key", "score"]]

    cut = results if depth is None else results.where(F.col("rank") <= max(depth, top_k))
    cut = cut.select("qid", "rank", "key", "score", T.diversity_tokens(F.col("content")).alias("tokens"))
    kind = dict(results.dtypes)
    return cut.groupBy("qid").applyInPandas(group, f"qid {kind['qid']}, place int, key {kind['key']}, score double")  # one query's results


#: The names of the ranking features, in their order.
FEATURES = (
    "dense_score", "dense_rank", "sparse_score", "sparse_rank", "late_interaction_score", "late_interaction_rank", "reranker_score", "reranker_rank", "stream_count",
    "rank_agreement", "exact_token_overlap", "query_token_count", "chunk_token_count", "identifier_signal", "qwen_score", "qwen_rank", "bge_score",
    "bge_rank", "e5_score", "e5_rank", "bm25_score", "bm25_rank", "title_lexical_overlap", "heading_lexical_overlap", "stream_presence",
    "section_depth", "source_char_length", "identifier_overlap",
)


def features(candidates: DataFrame, query: str = "text", content: str = "content", heading: str = "heading_path") -> DataFrame:
    """candidates with the 28 ranking features; scores and ranks of streams that aren't there are 0."""
    have = set(candidates.columns)
    given = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    q, c = F.array_distinct(T.ltr_tokens(F.col(query))), F.array_distinct(T.ltr_tokens(F.col(content)))
    h = F.array_distinct(T.ltr_tokens(F.col(heading)))
    title = F.array_distinct(T.ltr_tokens(F.element_at(F.split(F.coalesce(heading, F.lit("")), " > "), 1)))
    share = lambda part, own: F.when(F.size(own) > 0, F.size(F.array_intersect(own, part)) / F.size(own)).otherwise(F.lit(0.0))
    marked = lambda col: F.filter(
        T._runs(F.col(col)),
        lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*$") & (t.rlike("[-_]") | ((F.upper(t) == t) & t.rlike("[A-Z]"))),
    )
    ids = lambda col: F.array_distinct(F.transform(marked(col), F.lower))
    ranks = F.array_compact(F.array(*(F.col(r).cast("double") if r in have else F.lit(None).cast("double") for r in ("dense_rank", "sparse_rank", "late_interaction_rank", "reranker_rank"))))
    derived = {
        "rank_agreement": F.when(F.size(ranks) > 0, 1.0 / (1.0 + F.array_max(ranks) - F.array_min(ranks))).otherwise(F.lit(0.0)),
        "exact_token_overlap": share(c, q), "query_token_count": F.size(q).cast("double"), "chunk_token_count": F.size(c).cast("double"),
        "identifier_signal": F.size(marked(content)).cast("double"), "title_lexical_overlap": share(title, q), "heading_lexical_overlap": share(h, q),
        "stream_presence": given("stream_count"),
        "section_depth": F.when(F.coalesce(heading, F.lit("")) != "", F.size(F.split(heading, " > "))).otherwise(0).cast("double"),
        "source_char_length": F.length(F.coalesce(content, F.lit(""))).cast("double"), "identifier_overlap": share(ids(content), ids(query)),
    }
    return candidates.withColumns({f: derived.get(f, given(f)) for f in FEATURES})


class PairwiseRanker:
    """Logistic regression on differences of feature vectors of unequally labelled rows of one query."""

    def __init__(self, columns: tuple[str, ...] = FEATURES):
        self.columns = columns
        self.weights: np.ndarray | None = None

    def fit(self, rows: DataFrame, group: str = "qid", label: str = "gain", key: str = "key") -> PairwiseRanker:
        """Learn from all pairs of a better and a worse row.

        A row of the least label of its group is nobody's better and only meets the rows above it, so
        where few rows stand above the least label, the pairs grow with the rows and not with their square.
        """
        if rows.select(group).distinct().limit(2).count() < 2:
            raise ValueError("at least two groups are needed")
        own = rows.select(group, key, label, F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns)).alias("x"))
        least = own.groupBy(group).agg(F.min(label).alias("least"))
        better = own.join(least, group).where(F.col(label) > F.col("least"))
        a, b = better.alias("a"), own.alias("b")
        pairs = b.join(a, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{label}") > F.col(f"b.{label}")))
        diff = pairs.select(F.zip_with("a.x", "b.x", lambda u, v: u - v).alias("d"))
        ways = F.array(F.struct(F.col("d"), F.lit(1.0).alias("y")), F.struct(F.transform("d", lambda v: -v).alias("d"), F.lit(0.0).alias("y")))
        both = diff.select(F.explode(ways).alias("w")).select("w.d", "w.y")
        vec = both.select(array_to_vector("d").alias("raw"), "y")
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=False, withStd=True).fit(vec)
        model = LogisticRegression(featuresCol="features", labelCol="y", regParam=0.01, fitIntercept=False).fit(scaler.transform(vec))
        std = scaler.std.toArray()
        self.weights = np.where(std > 0, model.coefficients.toArray() / np.where(std > 0, std, 1.0), 0.0)
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.weights is None:
            raise RuntimeError("the ranker isn't fitted")
        terms = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(w) for c, w in zip(self.columns, self.weights)]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return rows.withColumn("prediction", total)


class ForestRanker:
    """Regression forest on the gains, the stand-in where no gradient-boosted ranker is installed."""

    def __init__(self, columns: tuple[str, ...] = FEATURES, trees: int = 80, depth: int = 8, seed: int = 1729):
        self.assembler = VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="keep")
        self.regressor = RandomForestRegressor(featuresCol="_x", labelCol="gain", numTrees=trees, maxDepth=depth, seed=seed)
        self.model = None

    def fit(self, rows: DataFrame) -> ForestRanker:
        self.model = self.regressor.fit(self.assembler.transform(rows.na.fill(0.0)))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("the ranker isn't fitted")
        return self.model.transform(self.assembler.transform(rows.na.fill(0.0))).drop("_x")


class LambdaRanker:
    """Gradient-boosted LambdaMART by an installed library; no other ranker stands in for it.

    Without the library BackendUnavailable is raised when the ranker is made.
    """

    def __init__(self, columns: tuple[str, ...] = FEATURES, seed: int = 1729, **settings: object):
        try:
            from xgboost.spark import SparkXGBRanker
        except ImportError as e:
            raise BackendUnavailable("LambdaMART needs xgboost") from e
        self.columns = list(columns)
        self.ranker = SparkXGBRanker(features_col=self.columns, label_col="gain", qid_col="_group", objective="rank:ndcg", random_state=seed, **settings)
        self.model = None

    def _numbered(self, rows: DataFrame, group: str) -> DataFrame:
        return rows.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.columns}).withColumn("_group", F.xxhash64(group))

    def fit(self, rows: DataFrame, group: str = "qid") -> LambdaRanker:
        if rows.select(group).distinct().limit(2).count() < 2:
            raise ValueError("at least two groups are needed")
        self.model = self.ranker.fit(self._numbered(rows, group).sort("_group"))
        return self

    def predict(self, rows: DataFrame, group: str = "qid") -> DataFrame:
        if self.model is None:
            raise RuntimeError("the ranker isn't fitted")
        return self.model.transform(self._numbered(rows, group)).drop("_group")


def reorder(results: DataFrame, predictions: DataFrame) -> DataFrame:
    """results in the order of their predictions; rows without one come last."""
    w = Window.partitionBy("qid").orderBy(F.col("prediction").desc_nulls_last(), "rank")
    return results.join(predictions.select("qid", "key", "prediction"), ["qid", "key"], "left").withColumn("place", F.row_number().over(w))



def ltr_examples(candidates: DataFrame, earned: DataFrame) -> DataFrame:
    """candidates (qid, key, rank, ...) with their features and gain; a candidate that earned nothing has gain 0. earned: (qid, rank, gain)."""
    gain = earned.groupBy("qid", "rank").agg(F.max("gain").alias("gain"))
    return features(candidates).join(gain, ["qid", "rank"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))


def predicted_metrics(rows: DataFrame, k: int) -> DataFrame:
    """(qid, recall, precision, mrr, ndcg) of rows (qid, key, gain, prediction) in the order of their predictions, ties by key.

    The ideal order is that of all rows of the query; a query without a gain counts 0.
    """
    by = Window.partitionBy("qid")
    r = rows.select("qid", "key", F.coalesce("gain", F.lit(0.0)).alias("gain"), "prediction").withColumn(
        "place", F.row_number().over(by.orderBy(F.col("prediction").desc_nulls_last(), "key"))
    ).withColumn("ideal", F.row_number().over(by.orderBy(F.col("gain").desc(), "key")))
    worth = lambda at: F.when(F.col(at) <= k, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col(at) + 1.0)).otherwise(0.0)
    hit = (F.col("gain") > 0) & (F.col("place") <= k)
    m = r.groupBy("qid").agg(
        F.sum(worth("place")).alias("dcg"), F.sum(worth("ideal")).alias("idcg"), F.count_if(hit).alias("hits"),
        F.count_if(F.col("gain") > 0).alias("relevant"), F.min(F.when(hit, F.col("place"))).alias("first"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return m.select(
        "qid", zero(F.try_divide("hits", "relevant")).alias("recall"), (F.col("hits") / F.lit(float(k))).alias("precision"),
        zero(1.0 / F.col("first")).alias("mrr"), zero(F.try_divide("dcg", "idcg")).alias("ndcg"),
    )


def cross_validate(rows: DataFrame, make: Callable[[], PairwiseRanker | ForestRanker], k: int, fold: str = "fold") -> DataFrame:
    """(fold, qid, recall, precision, mrr, ndcg): each fold ranked by a ranker that learnt from the other folds.

    rows: (qid, key, gain, fold, features...), whole queries to a fold. The driver goes through the folds,
    which are few; learning and ranking are distributed.
    """
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    if len(folds) < 2:
        raise ValueError("at least two folds are needed")
    out = None
    for f in folds:
        ranker = make().fit(rows.where(F.col(fold) != f))
        part = predicted_metrics(ranker.predict(rows.where(F.col(fold) == f)), k).select(F.lit(f).alias(fold), "*")
        out = part if out is None else out.unionByName(part)
    return out


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """One row: the means, to four digits, over all queries."""
    return metrics.agg(*(F.coalesce(F.round(F.avg(m), 4), F.lit(0.0)).alias(m) for m in ("recall", "precision", "mrr", "ndcg")))


def native_pool(dense: DataFrame, sparse: DataFrame, every: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(qid, key, score, rank): the candidates of both streams, each once, scored by a native backend in place of the dense stream.

    dense, sparse: (qid, key, rank); a query without candidates takes all of every (qid, key). score adds
    a column score, which is negated to a distance: the backend's best comes first when distances are
    inverted. Ties go to the earlier candidate, dense before sparse.
    """
    part = lambda df, n: df.select("qid", "key", F.struct(F.lit(n).alias("s"), F.col("rank").cast("long").alias("r")).alias("at"))
    pool = part(dense, 0).unionByName(part(sparse, 1)).groupBy("qid", "key").agg(F.min("at").alias("at"))
    rest = every.join(pool.select("qid").distinct(), "qid", "left_anti").select("qid", "key", F.struct(F.lit(2).alias("s"), F.lit(0).cast("long").alias("r")).alias("at"))
    scored = score(pool.unionByName(rest)).withColumn("distance", -F.col("score"))
    w = Window.partitionBy("qid").orderBy(F.col("distance").asc_nulls_last(), "at", "key")
    return scored.withColumn("rank", F.row_number().over(w)).select("qid", "key", "score", "rank")
