"""Problem 7: held-out passages inside a training corpus, by a BM25 index with block-max pruning.

The held-out items form a small inverted index (BM25 impacts, items in blocks, the greatest impact of
each term in each block). The corpus streams past it: every document is cut into overlapping passages,
each passage is a query, whole blocks are skipped when the sum of their greatest impacts stays below
the threshold, and what reaches its item's threshold is verified word by word.

The thresholds are proven, not tuned: no passage that holds what the definition asks for can score
less (see LeakIndex), so pruning loses nothing. The index is broadcast behind a check of its size;
the corpus is neither shuffled nor collected.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagery.runtime import cut_lineage

K1, B = 1.2, 0.75
BLOCK = 16
STRIDE = 20
#: Up to so many cells the places of terms in blocks are kept as a table.
TABLE = 4_000_000
#: So many cells of (passage, block of items) are held at once.
CELLS = 2_000_000
#: A sentence of so many items is a stock sentence.
STOCK = 3

_BREAK = re.compile(r"(?<=\w)[-\u2010\u2011]\s*\n\s*(?=\w)|[\u00ad\u200b-\u200d\u2060\ufeff]")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_BLOCK_TAG = re.compile(r"<(?:/?(?:p|div|li|ul|ol|tr|td|th|table|h[1-6]|pre|blockquote)\b[^<>]*|br\s*/?|hr\s*/?)>", re.I)
_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>")
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*\)")
_WIKI = re.compile(r"\[\[([^\[\]|\n]*)(?:\|[^\[\]\n]*)?\]\]")
_CITE = re.compile(r"~?\\(?:cite|ref|label|footnote)\{[^{}]*\}")
_MACRO = re.compile(r"\\[A-Za-z]+\*?\{([^{}]*)\}")
_SIGNS = re.compile(r"[\W_]+")


def plain_words(text: str) -> list[str]:
    """Lower-case words of letters and digits; markup, signs, line breaks and hyphens at them are gone."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", _COMMENT.sub(" ", text)))
    if "[" in text:
        text = _WIKI.sub(r"\1", _LINK.sub(r"\1", text))
    if "\\" in text:
        text = _MACRO.sub(r"\1", _CITE.sub(" ", text))
    text = _BREAK.sub("", text).lower()
    return [w for w in (x if x.isalnum() else _SIGNS.sub("", x) for x in text.split()) if w]


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(a):
        where[w] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


class BlockMaxIndex:
    """BM25 inverted index over bags of terms, with the greatest impact of each term in each block of items."""

    def __init__(self, items: list[list[str]]):
        n = len(items)
        df = Counter(t for terms in items for t in set(terms))
        mean = sum(map(len, items)) / max(n, 1)
        self.vocabulary = {t: i for i, t in enumerate(sorted(df))}
        self.impacts: list[dict[str, float]] = []
        for terms in items:
            norm = K1 * (1 - B + B * len(terms) / max(mean, 1e-9))
            self.impacts.append({
                t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm)
                for t, tf in Counter(terms).items()
            })

    def build(self, thresholds: list[float]) -> None:
        """Lay out the blocks: items with like thresholds together, so that the least one of a block is telling."""
        self.order = sorted(range(len(thresholds)), key=lambda i: thresholds[i])
        self.blocks = -(-len(thresholds) // BLOCK)
        self.local_terms, self.local_impacts = [], []
        post: list[tuple[int, int, float]] = []
        for b in range(self.blocks):
            own = [self.impacts[i] for i in self.order[b * BLOCK : (b + 1) * BLOCK]]
            terms = sorted({self.vocabulary[t] for x in own for t in x})
            place = {t: k for k, t in enumerate(terms)}
            dense = np.zeros((len(terms) + 1, BLOCK), np.float32)
            for i, x in enumerate(own):
                for t, v in x.items():
                    dense[place[self.vocabulary[t]], i] = v
            self.local_terms.append(np.array(terms, np.int64))
            self.local_impacts.append(dense)
            post += zip(terms, [b] * len(terms), dense[:-1].max(axis=1).tolist())
        self.table = None
        if self.blocks * len(self.vocabulary) <= TABLE:
            self.table = np.zeros((self.blocks, len(self.vocabulary)), np.int32)
            for b, terms in enumerate(self.local_terms):
                self.table[b] = len(terms)
                self.table[b, terms] = np.arange(len(terms))
        post.sort()
        term = np.array([x[0] for x in post], np.int64)
        self.first = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.post_block = np.array([x[1] for x in post], np.int64)
        self.post_max = np.array([x[2] for x in post], np.float64)
        self.term_max = np.zeros(len(self.vocabulary))
        np.maximum.at(self.term_max, term, self.post_max)
        self.threshold = np.full(self.blocks * BLOCK, np.inf)
        self.threshold[: len(thresholds)] = np.array([thresholds[i] for i in self.order]) * 0.999
        self.block_threshold = self.threshold.reshape(self.blocks, BLOCK).min(axis=1)
        self.least = float(self.threshold.min(initial=math.inf))

    def search(self, doc: np.ndarray, place: np.ndarray, term: np.ndarray, width: int, stride: int) -> set[tuple[int, int]]:
        """(document, item) where some passage of the document reaches the item's threshold.

        doc, place and term say which known term stands where. A passage holds width places and
        starts at a multiple of stride; one that begins behind the end of the text is a part of the
        one before, so it can add nothing. Passages whose greatest possible score stays below all
        thresholds are dropped first, then blocks of items whose bound stays below theirs.
        """
        if not len(doc) or not self.blocks:
            return set()
        many = int(place.max()) // stride + 1
        cells = []
        for back in range(-(-width // stride)):
            start = place // stride - back
            ok = (start >= 0) & (start * stride + width > place)
            cells.append(((doc[ok] * many + start[ok]) * len(self.term_max)) + term[ok])
        cell = np.unique(np.concatenate(cells))
        key, term = cell // len(self.term_max), cell % len(self.term_max)
        passages, owner = np.unique(key, return_inverse=True)
        good = np.bincount(owner, self.term_max[term]) >= self.least
        kept = good[owner]
        term, owner = term[kept], (np.cumsum(good) - 1)[owner[kept]]
        passages = passages[good]
        if not len(passages):
            return set()
        out: set[tuple[int, int]] = set()
        step = max(1, CELLS // self.blocks)
        for lo in range(0, len(passages), step):  # entries stand in the order of their passages
            a, b = np.searchsorted(owner, (lo, min(lo + step, len(passages))))
            out |= self._search(passages[lo : lo + step] // many, owner[a:b] - lo, term[a:b])
        return out

    def _search(self, doc: np.ndarray, owner: np.ndarray, term: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) met by some passages, of which doc says whose they are, owner and term which terms they hold."""
        n = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        spot = np.repeat(owner, n) * self.blocks + self.post_block[at]
        bounds = np.bincount(spot, self.post_max[at], len(doc) * self.blocks).reshape(len(doc), self.blocks)
        out = set()
        reached = bounds >= self.block_threshold
        for b in np.nonzero(reached.any(axis=0))[0]:  # one product for all passages that need the block
            rows = np.nonzero(reached[:, b])[0]
            row = np.full(len(doc), -1)
            row[rows] = np.arange(len(rows))
            mine = row[owner] >= 0
            local = self._local(b, term[mine])
            bag = np.zeros((len(rows), len(self.local_terms[b]) + 1), np.float32)
            bag[row[owner[mine]], local] = 1
            bag[:, -1] = 0
            scores = bag @ self.local_impacts[b]
            for r, i in zip(*np.nonzero(scores >= self.threshold[b * BLOCK : (b + 1) * BLOCK])):
                out.add((int(doc[rows[r]]), self.order[b * BLOCK + i]))
        return out

    def _local(self, b: int, term: np.ndarray) -> np.ndarray:
        """Place of each term in block b; one behind the last for terms that it lacks."""
        if self.table is not None:
            return self.table[b][term]
        terms = self.local_terms[b]
        k = np.searchsorted(terms, term)
        k[(k == len(terms)) | (terms[np.minimum(k, len(terms) - 1)] != term)] = len(terms)
        return k


def _pairs(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


class LeakIndex:
    """Two block-max indexes of the held-out items: of word pairs, for runs, and of words, for whole items.

    A run of min_run words of item i has min_run - 1 adjacent pairs and scores at least the least sum
    of their impacts over all such runs of i; every run lies whole in one passage, since passages
    start each STRIDE words and share at least min_run words with the next. A place that
    holds min_share of the words of i within stretch times its length lies whole in one wide passage,
    and scores at least the impacts of i without those of the most telling words that may be missing.
    """

    def __init__(
        self, items: list[tuple], min_run: int = 20, min_share: float = 0.75, stretch: float = 1.5, stock_items: int = STOCK,
        stock: set[tuple[str, ...]] | None = None,
    ):
        self.min_run, self.min_share, self.stretch = min_run, min_share, stretch
        shared: Counter = Counter()
        parts = []
        for key, text in items:
            own = [tuple(plain_words(s)) for s in sentences(text)]
            parts.append((key, own))
            shared.update(set(own))
        if stock is None:
            stock = {s for s, n in shared.items() if n >= stock_items}
        self.keys, self.words = [], []
        segments: list[list[list[str]]] = []
        for key, own in parts:
            segs: list[list[str]] = [[]]
            for s in own:
                if s in stock:
                    segs.append([])
                else:
                    segs[-1].extend(s)
            segs = [s for s in segs if s]
            if segs:
                self.keys.append(key)
                segments.append(segs)
                self.words.append([w for s in segs for w in s])
        half = self.half = max(1, min_run // 2)
        self.runs = [{" ".join(s[j : j + min_run]) for s in x for j in range(len(s) - min_run + 1)} for x in segments]
        self.parts = [{" ".join(s[j : j + half]) for s in x for j in range(len(s) - half + 1)} for x in segments]
        self.pairs = BlockMaxIndex([[p for s in x for p in _pairs(s)] for x in segments])
        self.singles = BlockMaxIndex(self.words)
        own = self.singles.vocabulary
        keys = {own[a] * len(own) + own[b]: t for p, t in self.pairs.vocabulary.items() for a, b in [p.split(" ")]}
        self.pair_keys = np.array(sorted(keys), np.int64)
        self.pair_terms = np.array([keys[k] for k in sorted(keys)], np.int64)
        self.passage = 2 * max(min_run, STRIDE)
        longest = max(map(len, self.words), default=1)
        self.wide_stride = 64
        self.wide = math.ceil(stretch * longest) + 1 + self.wide_stride
        least_run, least_whole = [], []
        for i, x in enumerate(segments):
            v = self.pairs.impacts[i]
            least_run.append(min(
                (sum(v[p] for p in set(_pairs(s[j : j + min_run]))) for s in x for j in range(len(s) - min_run + 1)),
                default=math.inf,
            ))
            v, counts, least = self.singles.impacts[i], Counter(self.words[i]), 0.0
            spare = len(self.words[i]) - math.ceil(min_share * len(self.words[i]))
            for w in sorted(counts, key=lambda w: -v[w] / counts[w]):
                gone = min(spare, counts[w])  # a part of the word that breaks the allowance, which bounds any choice of words
                spare -= gone
                least += v[w] * (1 - gone / counts[w])
            least_whole.append(least)
        self.pairs.build(least_run)
        self.singles.build(least_whole)

    def candidates(self, docs: list[list[str]]) -> tuple[list[set[int]], list[set[int]]]:
        """For each document: items of which it may hold a run, and items it may hold whole."""
        get = self.singles.vocabulary.get
        known = np.array([get(w, -1) for words in docs for w in words], np.int64)
        sizes = np.array([len(w) for w in docs], np.int64)
        doc = np.repeat(np.arange(len(docs)), sizes)
        place = np.arange(len(known)) - np.repeat(np.append(0, np.cumsum(sizes)[:-1]), sizes)
        runs: list[set[int]] = [set() for _ in docs]
        wholes: list[set[int]] = [set() for _ in docs]
        if len(known) > 1 and len(self.pair_keys):
            key = known[:-1] * len(self.singles.vocabulary) + known[1:]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            ok = (self.pair_keys[at] == key) & (known[:-1] >= 0) & (known[1:] >= 0) & (doc[:-1] == doc[1:])
            for d, i in self.pairs.search(doc[:-1][ok], place[:-1][ok], self.pair_terms[at[ok]], self.passage - 1, STRIDE):
                runs[d].add(i)
        ok = known >= 0
        for d, i in self.singles.search(doc[ok], place[ok], known[ok], self.wide, self.wide_stride):
            wholes[d].add(i)
        return runs, wholes

    def has_run(self, words: list[str], item: int) -> bool:
        """Does a run of min_run words of the item occur? Each covers a part that starts at a multiple of half."""
        n, half = self.min_run, self.half
        for s in range(0, len(words) - half + 1, half):
            if " ".join(words[s : s + half]) in self.parts[item]:
                for j in range(max(0, s - (n - half)), min(s, len(words) - n) + 1):
                    if " ".join(words[j : j + n]) in self.runs[item]:
                        return True
        return False

    def share(self, words: list[str], item: int) -> float:
        """The greatest share of the item's words that stands in order within stretch times its length.

        Places that start at each word of the item are tried, as far as their bag of words allows
        min_share; 0 where none does.
        """
        own = self.words[item]
        known, need = set(own), math.ceil(self.min_share * len(own))
        hits = [i for i, w in enumerate(words) if w in known]
        width, best, j, tried = int(self.stretch * len(own)) + 1, 0, 0, -1
        for i, at in enumerate(hits):
            while j < len(hits) and hits[j] < at + width:
                j += 1
            if j - i >= need and j > tried:  # the window has gained a word since the last try
                best, tried = max(best, lcs_length(own, words[at : at + width])), j
        return best / len(own)


SCHEMA = "doc_id long, item_id long, has_run boolean, share double"


def leaked_items(
    corpus: DataFrame,
    held_out: DataFrame,
    max_items: int = 20_000,
    doc_key: str = "doc_id",
    doc_text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, has_run, share): every document with every item it holds, whole or in part.

    The held-out set is the small side by nature; an index holds at most max_items of its rows. More of
    them are indexed in parts, by hash, and the corpus is read once a part; stock sentences are told over
    all items either way. Null texts and keys match nothing; rows with equal keys are merged; an empty
    side gives no rows. Documents are read whole, whatever their length.
    """
    items = held_out.select(F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    docs = corpus.select(corpus[doc_key].cast("long").alias("doc_id"), corpus[doc_text].alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    first = items.limit(max_items + 1).collect()
    if len(first) <= max_items:
        return _matches(docs, LeakIndex(sorted({(r["item"], r["text"]) for r in first})))
    parts = -(-items.count() // (max_items // 2))
    placed = items.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(parts)).cast("int"))
    stock = cut_lineage(stock_sentences(placed))
    out = None
    for k in range(parts):
        own = placed.where(F.col("part") == k).collect()  # about max_items / 2 rows
        known = {tuple(r["sentence"].split(" ")) for r in stock.where(F.col("part") == k).select("sentence").collect()}
        found = _matches(docs, LeakIndex(sorted({(r["item"], r["text"]) for r in own}), stock=known))
        out = found if out is None else out.unionByName(found)
    return out


def stock_sentences(placed: DataFrame) -> DataFrame:
    """(part, sentence): the sentences of each part of the items that at least STOCK items of any part share."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(p, i, " ".join(s)) for p, i, t in zip(pdf["part"], pdf["item"], pdf["text"]) for s in {tuple(plain_words(x)) for x in sentences(t)} if s]
            yield pd.DataFrame(out, columns=["part", "item", "sentence"])

    of = placed.select("part", "item", "text").mapInPandas(split, "part int, item long, sentence string").distinct()
    per = of.groupBy("sentence", "part").agg(F.count("*").alias("n"))
    shared = per.groupBy("sentence").agg(F.sum("n").alias("n"), F.collect_set("part").alias("parts")).where(F.col("n") >= STOCK)  # one entry a part
    return shared.select(F.explode("parts").alias("part"), "sentence")


def _matches(docs: DataFrame, index: LeakIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                docs = [plain_words(t) for t in part["text"]]
                out = []
                for key, words, runs, wholes in zip(part["doc_id"], docs, *ix.candidates(docs)):
                    for i in runs | wholes:
                        run = i in runs and ix.has_run(words, i)
                        share = ix.share(words, i)
                        if run or share >= ix.min_share:
                            out.append((key, ix.keys[i], run, share))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "has_run", "share"])

    return docs.mapInPandas(match, SCHEMA)
