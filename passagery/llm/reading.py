"""Problem 9: the reading level of each document, by smoothed unigram language models.

One unigram model per level is trained on a bounded sample of graded documents and of ungraded ones
graded by a formula (Flesch-Kincaid, fitted to the grades); each document takes the level with the
highest posterior. Training picks its sample by keys and language alone and reads the texts once;
scoring reads the texts once, needs no shuffle, and ships a model of the words of the sample.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagery.runtime import cut_lineage

LEVELS = 5
_FENCE = re.compile(r"```.*?(?:```|\Z)|<pre\b.*?(?:</pre>|\Z)|<!--.*?-->|<script\b.*?(?:</script>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|\\[A-Za-z]+\*?|\]\([^()\s]*\)")
_NAME = re.compile(r"\S*[A-Za-z0-9][_./:\\=][A-Za-z0-9]\S*|\S*\d\S*|\b[A-Za-z]*[a-z][A-Z]\w*|\b[A-Z]{2,}\b")
_WORD = re.compile(r"[a-z]+(?:['’-][a-z]+)*")
_VOWELS = re.compile(r"[aeiouy]+")


def running_text(text: str) -> str:
    """text without code, markup and names of things, which tell nothing of how hard it reads."""
    if "&" in text:
        text = html.unescape(text)
    return _NAME.sub(" ", _TAG.sub(" ", _FENCE.sub(" ", text)))


def words(text: str) -> list[str]:
    return _WORD.findall(running_text(text).lower())


def formula_grade(text: str) -> float:
    """Flesch-Kincaid grade of the running text; 0 where there are no words."""
    plain = running_text(text)
    own = _WORD.findall(plain.lower())
    if not own:
        return 0.0
    ends = max(1, len(re.findall(r"[.!?]+(?:\s|$)", plain)))
    syllables = sum(max(1, len(_VOWELS.findall(w))) for w in own)
    return 0.39 * len(own) / ends + 11.8 * syllables / len(own) - 15.59


def fit_formula(grades: list[float], levels: list[int]) -> tuple[float, float]:
    """(a, b) of level = a + b * formula grade; the usual school grades where the labels don't tell."""
    if len(set(levels)) >= 2 and np.ptp(grades) > 1e-9:
        b, a = np.polyfit(grades, levels, 1)
        if b > 0:
            return float(a), float(b)
    return 0.2, 0.28


class LevelModel:
    """Log probabilities of words by level, with additive smoothing; unseen words count nothing."""

    def __init__(self, counts: dict[str, np.ndarray], mass: np.ndarray, alpha: float = 0.1):
        kept = sorted(counts)
        self.place = {x: i for i, x in enumerate(kept)}
        table = np.array([counts[x] for x in kept]).T if kept else np.zeros((LEVELS, 0))
        self.log = np.log((table + alpha) / (table.sum(axis=1, keepdims=True) + alpha * max(len(kept), 1)))
        self.prior = np.log((mass + 1.0) / (mass + 1.0).sum())

    def posterior(self, at: list[int]) -> np.ndarray:
        """Of a text given as the places of its known words."""
        s = self.prior + (self.log[:, at].sum(axis=1) if at else 0)
        p = np.exp(s - s.max())
        return p / p.sum()


def sample_keys(corpus: DataFrame, labels: DataFrame, doc_key: str, lang: str, max_labelled: int, seed_docs: int, seed_weight: float) -> list[tuple]:
    """(key, grade or 0, weight) of the documents to learn from: the first by hash, max_labelled grades and seed_docs ungraded ones.

    A document with several grades counts with each at its part of the weight; a key that stands in
    several rows counts once, but takes as many places of the bound.
    """
    docs = corpus.select(F.col(doc_key).alias("d"), F.col(lang).alias("l")).where("d IS NOT NULL")
    graded = labels.select(F.col(doc_key).alias("d"), F.col("reading_level").cast("int").alias("y")).where(f"y BETWEEN 1 AND {LEVELS}")
    picked = docs.select("d").join(graded, "d").orderBy(F.xxhash64("d"), "d", "y").limit(max_labelled).collect()
    times = Counter(r["d"] for r in picked)
    known = Counter((r["d"], int(r["y"])) for r in picked)
    seeds = docs.where("l = 'en'").select("d").orderBy(F.xxhash64(F.lit(7), "d"), "d").limit(seed_docs).collect()
    out = [(d, y, n / times[d]) for (d, y), n in known.items()]
    return out + [(d, 0, seed_weight) for d in dict.fromkeys(r["d"] for r in seeds) if d not in times]


def train(
    corpus: DataFrame, labels: DataFrame, doc_key: str = "doc_id", text: str = "text", lang: str = "lang",
    max_labelled: int = 5_000, seed_docs: int = 2_000, seed_weight: float = 0.05,
) -> LevelModel:
    """Fit the models on at most max_labelled grades and seed_docs formula-graded documents, both picked by hash.

    Grades outside 1..5 and null texts are left out. Without any grades the formula alone seeds the
    models. Words that only one document of the sample uses are left out; all others are in the model.
    """
    picked = sample_keys(corpus, labels, doc_key, lang, max_labelled, seed_docs, seed_weight)
    kind = corpus.schema[doc_key].dataType.simpleString()
    keys = corpus.sparkSession.createDataFrame(picked, f"d {kind}, y int, w double")
    docs = corpus.select(F.col(doc_key).alias("d"), F.col(text).alias("t")).where("d IS NOT NULL AND t IS NOT NULL")
    # at most max_labelled + seed_docs keys, whatever the input; their texts are read once
    sample = cut_lineage(docs.join(F.broadcast(keys), "d"))

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["y"]].assign(g=[formula_grade(t) for t in pdf["t"]])

    known = sample.where("y > 0").select("y", "t").mapInPandas(grade, "y int, g double").collect()
    a, b = fit_formula([r["g"] for r in known], [r["y"] for r in known])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, y, w in zip(pdf["t"], pdf["y"], pdf["w"]):
                own = words(t)
                level = int(y) or int(min(LEVELS, max(1, round(a + b * formula_grade(t)))))
                one = 1.0 if y == 0 else float(w)
                out.append((level, "", float(w), one))
                out += [(level, x, n * float(w), one) for x, n in Counter(own).items()]
            yield pd.DataFrame(out, columns=["level", "word", "n", "docs"])

    counted = sample.mapInPandas(count, "level int, word string, n double, docs double").groupBy("word").agg(
        F.sum("docs").alias("docs"), *(F.sum(F.when(F.col("level") == k, F.col("n")).otherwise(0.0)).alias(f"n{k}") for k in range(1, LEVELS + 1))
    )
    rows = counted.where("word = '' OR docs >= 2").collect()  # words of the bounded sample
    table = {r["word"]: np.array([r[f"n{k}"] for k in range(1, LEVELS + 1)]) for r in rows}
    return LevelModel({w: x for w, x in table.items() if w}, table.get("", np.zeros(LEVELS)))


def reading_levels(
    corpus: DataFrame, model: LevelModel, doc_key: str = "doc_id", text: str = "text", lang: str = "lang", only: str | None = None
) -> DataFrame:
    """(doc_id, lang, reading_level, confidence, words, known): a level for every document with text.

    only keeps the documents of one language, before anything is scored. known is the share of a text's
    words that the model knows: the grades are of English texts, so a text in another language has a low
    one and its level says little. Texts without known words take the most common level, with its share
    as confidence; null texts give no row; rows with equal keys are judged each by itself.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            level, sure, size, known = [], [], [], []
            for t in pdf["text"]:
                own = words(t)
                at = [i for i in map(m.place.get, own) if i is not None]
                p = m.posterior(at)
                level.append(int(p.argmax()) + 1)
                sure.append(float(p.max()))
                size.append(len(own))
                known.append(len(at) / len(own) if own else 0.0)
            yield pdf[["doc_id", "lang"]].assign(reading_level=np.array(level, "int32"), confidence=sure, words=size, known=known)

    docs = corpus if only is None else corpus.where(F.col(lang) == only)
    docs = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInPandas(
        score, "doc_id long, lang string, reading_level int, confidence double, words int, known double"
    )
