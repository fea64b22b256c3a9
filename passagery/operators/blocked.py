"""BM25 for a block of queries against a streamed corpus.

A join of query terms with postings makes a row for every pair of a query and a passage that share any
word, which for common words is nearly all pairs. Here the query side, bounded by the size of a block,
is shipped to the tasks instead; the corpus streams past it once, each batch is scored by counting
over its terms, and a task hands on only its best k per query. Nothing of the corpus is shuffled.

Once a task has k passages for a query, its words are parted by the greatest they can add in the batch:
those that together stay below the k-th score can't bring in a passage by themselves, so only passages
with one of the other words are scored (block-max pruning; the bounds are those of the batch, so nothing
is lost).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query terms in one block; more queries are searched in several passes over the corpus.
BLOCK_TERMS = 200_000
_CELLS = 4_000_000
#: Looking up one word of a query in one passage costs as much as adding so many cells of a whole matrix.
_LOOKUP = 8


def query_blocks(terms: DataFrame, most: int = BLOCK_TERMS) -> Iterator[pd.DataFrame]:
    """terms (qid, field, term, w) in blocks of about `most` rows, queries whole."""
    first = terms.limit(most + 1).toPandas()
    if len(first) <= most:
        yield first
        return
    n = -(-terms.count() // most)
    for i in range(n):
        yield terms.where(F.pmod(F.xxhash64("qid"), F.lit(n)) == i).toPandas()


class Block:
    """Query terms of one block, by field: for each term the queries that ask for it and their weights."""

    def __init__(self, terms: pd.DataFrame, fields: list[str], avgdl: dict[str, float]):
        self.qids = sorted(terms["qid"].unique().tolist())
        place = {q: i for i, q in enumerate(self.qids)}
        self.fields, self.avgdl = fields, avgdl
        self.vocabulary, self.first, self.query, self.weight = {}, {}, {}, {}
        self.term, self.own_first, self.own = {}, {}, {}  # the entries of each query
        for f in fields:
            own = terms[terms["field"] == f].sort_values(["term", "qid"])
            names = own["term"].unique().tolist()
            self.vocabulary[f] = {t: i for i, t in enumerate(names)}
            at = own["term"].map(self.vocabulary[f]).to_numpy(np.int64)
            self.first[f] = np.searchsorted(at, np.arange(len(names) + 1))
            self.query[f] = own["qid"].map(place).to_numpy(np.int64)
            self.weight[f] = own["w"].to_numpy(float)
            self.term[f] = at
            by_query = np.argsort(self.query[f], kind="stable")
            self.own_first[f] = np.searchsorted(self.query[f][by_query], np.arange(len(self.qids) + 1))
            self.own[f] = by_query
        self.batch = max(16, min(512, _CELLS // max(1, len(self.qids))))

    def counts(self, field: str, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(passage, term, tf, dl) of the asked terms of a batch; texts are arrays of tokens."""
        get = self.vocabulary[field].get
        doc, term = [], []
        for d, tokens in enumerate(texts):
            own = [i for i in map(get, tokens) if i is not None]
            term += own
            doc += [d] * len(own)
        n = max(1, len(self.vocabulary[field]))
        cell, tf = np.unique(np.array(doc, np.int64) * n + np.array(term, np.int64), return_counts=True)
        return cell // n, cell % n, tf, np.array([len(t) for t in texts], float)

    def scores(self, field: str, counted: tuple, size: int, k1: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        """(queries x passages) scores, and which of them share a term."""
        doc, term, tf, dl = counted
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / max(self.avgdl[field], 1e-12)))
        n = self.first[field][term + 1] - self.first[field][term]
        at = np.repeat(self.first[field][term] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        cell = self.query[field][at] * size + np.repeat(doc, n)
        shape = (len(self.qids), size)
        total = len(self.qids) * size
        return (
            np.bincount(cell, np.repeat(part, n) * self.weight[field][at], total).reshape(shape),
            np.bincount(cell, minlength=total).reshape(shape) > 0,
        )


    def promising(self, field: str, counted: tuple, size: int, k1: float, b: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(query, passage, score) of all pairs that can reach the query's floor; None where pruning wouldn't pay."""
        doc, term, tf, dl = counted
        n = max(1, len(self.vocabulary[field]))
        if not len(doc) or not np.isfinite(floor).any():
            return None
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[doc] / max(self.avgdl[field], 1e-12)))
        most, held = np.zeros(n), np.bincount(term, minlength=n)
        np.maximum.at(most, term, part)
        query, entry_term = self.query[field], self.term[field]
        bound = np.maximum(self.weight[field] * most[entry_term], 0.0)
        order = np.lexsort((bound, query))
        upto = np.cumsum(bound[order])
        start = self.own_first[field][query[order]]
        within = upto - np.where(start > 0, upto[np.maximum(start - 1, 0)], 0.0)
        needed = np.zeros(len(query), bool)
        needed[order] = within >= floor[query[order]] - 1e-8
        needed &= held[entry_term] > 0
        many = held[entry_term[needed]]
        words = len(query) / max(1, len(self.qids))
        if many.sum() * words * _LOOKUP > held[entry_term].sum() + 2 * len(self.qids) * size:
            return None  # scoring all pairs is quicker
        by_term = np.argsort(term, kind="stable")
        first = np.searchsorted(term[by_term], np.arange(n + 1))
        at = np.repeat(first[entry_term[needed]] - np.append(0, np.cumsum(many)[:-1])[: len(many)], many) + np.arange(many.sum())
        cell = np.unique(np.repeat(query[needed], many) * size + doc[by_term[at]])
        q, d = cell // size, cell % size
        known = doc * n + term  # ascending, as counts gives it
        score = np.zeros(len(cell))
        step = max(1, _CELLS // 16)
        for lo in range(0, len(cell), step):
            qs, ds = q[lo : lo + step], d[lo : lo + step]
            own = self.own_first[field][qs + 1] - self.own_first[field][qs]
            row = np.repeat(np.arange(len(qs)), own)
            e = self.own[field][np.repeat(self.own_first[field][qs] - np.append(0, np.cumsum(own)[:-1])[: len(own)], own) + np.arange(own.sum())]
            key = ds[row] * n + entry_term[e]
            pos = np.minimum(np.searchsorted(known, key), len(known) - 1)
            hit = known[pos] == key
            score[lo : lo + step] = np.bincount(row[hit], self.weight[field][e[hit]] * part[pos[hit]], len(qs))
        return q, d, score


class _Best:
    """The best k passages of every query so far: by score to 9 digits, then key."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.least = np.full(queries, -np.inf)
        self.rows = pd.DataFrame({"q": np.zeros(0, np.int64), "score": np.zeros(0), "r": np.zeros(0), "key": np.zeros(0, object)})

    def add(self, scores: np.ndarray, fits: np.ndarray, keys: np.ndarray) -> None:
        s = np.where(fits, np.round(scores, 9), -np.inf)
        if s.shape[1] > self.k:
            floor = np.maximum(self.least, np.partition(s, -self.k, axis=1)[:, -self.k])
        else:
            floor = self.least
        q, d = np.nonzero((s >= floor[:, None]) & fits)
        if not len(q):
            return
        self._merge(q, scores[q, d], s[q, d], keys[d])

    def add_cells(self, q: np.ndarray, score: np.ndarray, keys: np.ndarray) -> None:
        r = np.round(score, 9)
        on = r >= self.least[q]
        if on.any():
            self._merge(q[on], score[on], r[on], keys[on])

    def _merge(self, q: np.ndarray, score: np.ndarray, r: np.ndarray, keys: np.ndarray) -> None:
        new = pd.DataFrame({"q": q, "score": score, "r": r, "key": keys})
        both = pd.concat([self.rows, new], ignore_index=True) if len(self.rows) else new
        both = both.sort_values(["q", "r", "key"], ascending=[True, False, True])
        self.rows = both[both.groupby("q").cumcount() < self.k]
        full = self.rows.groupby("q")["r"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.least[full.index.to_numpy()] = full["min"].to_numpy()


def _batches(block: Block, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for lo in range(0, len(pdf), block.batch):
        yield pdf.iloc[lo : lo + block.batch]


def best(block: Block, corpus: DataFrame, settings: list[tuple[float, float]], k: int, positive: bool = True) -> DataFrame:
    """(qid, setting, key, score): each task's best k; corpus: (key, t0) with t0 an array of tokens, setting the number of (k1, b)."""
    shared = corpus.sparkSession.sparkContext.broadcast(block)
    field = block.fields[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        tops = [_Best(len(own.qids), k) for _ in settings]
        for whole in batches:
            for pdf in _batches(own, whole):
                counted = own.counts(field, pdf["t0"].tolist())
                keys = pdf["key"].to_numpy(object)
                for top, (k1, b) in zip(tops, settings):
                    some = own.promising(field, counted, len(pdf), k1, b, top.least) if positive else None
                    if some is None:
                        s, hit = own.scores(field, counted, len(pdf), k1, b)
                        top.add(s, (s > 0) if positive else hit, keys)
                    else:
                        q, d, s = some
                        top.add_cells(q[s > 0], s[s > 0], keys[d[s > 0]])
        qids = np.array(own.qids, object)
        for n, top in enumerate(tops):
            yield pd.DataFrame({"qid": qids[top.rows["q"].to_numpy(np.int64)], "setting": n, "key": top.rows["key"], "score": top.rows["score"]})

    return corpus.mapInPandas(run, _schema(block, "qid {}, setting int, key string, score double"))


def _schema(block: Block, form: str) -> str:
    whole = block.qids and isinstance(block.qids[0], (int, np.integer))
    return form.format("long" if whole else "string")


def spans(block: Block, corpus: DataFrame, k1: float, b: float) -> DataFrame:
    """(qid, field, lo, hi, hit): the range of the scores of the matching passages, and their number, for the whole corpus."""
    shared = corpus.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        lo = np.full((len(own.fields), len(own.qids)), np.inf)
        hi, hit = -lo, np.zeros(lo.shape, np.int64)
        for whole in batches:
            for pdf in _batches(own, whole):
                for n, f in enumerate(own.fields):
                    s, m = own.scores(f, own.counts(f, pdf[f"t{n}"].tolist()), len(pdf), k1, b)
                    lo[n] = np.minimum(lo[n], np.where(m, s, np.inf).min(axis=1))
                    hi[n] = np.maximum(hi[n], np.where(m, s, -np.inf).max(axis=1))
                    hit[n] += m.sum(axis=1)
        for n, f in enumerate(own.fields):
            some = hit[n] > 0
            yield pd.DataFrame({"qid": np.array(own.qids, object)[some], "field": f, "lo": lo[n][some], "hi": hi[n][some], "hit": hit[n][some]})

    each = corpus.mapInPandas(run, _schema(block, "qid {}, field string, lo double, hi double, hit long"))
    return each.groupBy("qid", "field").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("hit").alias("hit"))


def best_scaled(block: Block, corpus: DataFrame, scale: pd.DataFrame, weights: dict[str, float], k1: float, b: float, k: int) -> DataFrame:
    """(qid, key, score): each task's best k by the weighted sum of the fields' scores, scaled by scale (qid, field, lo, hi)."""
    place = {q: i for i, q in enumerate(block.qids)}
    lo, gain = {}, {}
    for n, f in enumerate(block.fields):
        own = scale[(scale["field"] == f) & (scale["hi"] > scale["lo"])]
        at = own["qid"].map(place).to_numpy(np.int64)
        lo[f], gain[f] = np.zeros(len(block.qids)), np.zeros(len(block.qids))
        lo[f][at] = own["lo"].to_numpy(float)
        gain[f][at] = weights[f] / (own["hi"] - own["lo"]).to_numpy(float)
    shared = corpus.sparkSession.sparkContext.broadcast((block, lo, gain))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, low, up = shared.value
        top = _Best(len(own.qids), k)
        for whole in batches:
            for pdf in _batches(own, whole):
                total = np.zeros((len(own.qids), len(pdf)))
                for n, f in enumerate(own.fields):
                    s, m = own.scores(f, own.counts(f, pdf[f"t{n}"].tolist()), len(pdf), k1, b)
                    total += np.where(m, (s - low[f][:, None]) * up[f][:, None], 0.0)
                top.add(total, total > 0, pdf["key"].to_numpy(object))
        qids = np.array(own.qids, object)
        yield pd.DataFrame({"qid": qids[top.rows["q"].to_numpy(np.int64)], "key": top.rows["key"], "score": top.rows["score"]})

    return corpus.mapInPandas(run, _schema(block, "qid {}, key string, score double"))
