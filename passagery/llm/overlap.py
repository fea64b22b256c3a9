"""Problem 4: the same or nearly the same question in training and evaluation splits.

Evaluation questions become sequences of whole-number tokens in a compressed full-text index (a BWT in
a wavelet matrix), built shard by shard. Training questions stream through it by backward search: the
stretch of names and numbers must match whole and gives the candidates; the maximal matches with each
candidate, merged, give the share of both questions that is found, and that share decides. What decides
is whole words; an exact check follows on the words that no match covers: slips of spelling are paired,
and words of opposite sense or of different names part the questions.

A question's tokens are put in one order first (its names and numbers sorted, then its words, long ones
first), so the order of words in the question doesn't matter. Shards are routed by the names, so a
training question meets only the shard that can hold its matches; a shard that outgrows its bound is
cut into parts, and its training rows into blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagery.llm.skew import small_or_salted_join
from passagery.runtime import cut_lineage

#: Courtesies and labels around a question.
COURTESIES = re.compile(
    r"\((?:please )?(?:cite|name|quote) [^()]*\)|\[[a-z ]{1,20}\]|"
    r"\b(?:hi|hello|hey|dear)(?: team| all| there| everyone| folks)?\b[,!:]?|\b(?:please|kindly|pls|plz)(?: tell me)?\b[,:]?|"
    r"\b(?:thanks|thank you|thx|cheers)(?: a lot| in advance| so much)?\b[.!]*|\banswer (?:briefly|shortly|in short)\b[.!]?|"
    r"^\W*(?:quick )?(?:question|q|note|case|fyi)\b\s*[:–-]\s*|\b(?:can|could) you (?:please )?tell me\b[,:]?"
)
#: Pairs of words of opposite sense.
OPPOSITES = frozenset(
    frozenset(p.split("/"))
    for p in (
        "upper/lower minimum/maximum min/max enabled/disabled enable/disable before/after first/last start/stop started/stopped "
        "with/without open/closed opened/closed allow/deny allowed/denied allow/forbid accept/reject accepts/rejects accepted/rejected "
        "add/remove added/removed on/off up/down more/less most/least increase/decrease increases/decreases above/below over/under "
        "always/never old/new earliest/latest longest/shortest highest/lowest largest/smallest read/write reads/writes source/target "
        "import/export online/offline manual/automatic manually/automatically internal/external public/private valid/invalid "
        "success/failure succeed/fail succeeds/fails grant/revoke lock/unlock locked/unlocked connect/disconnect begin/end inside/outside "
        "early/late primary/secondary input/output sender/receiver client/server push/pull encrypt/decrypt raise/lower "
        "required/optional include/exclude includes/excludes ascending/descending left/right sync/async"
    ).split()
)
NEGATIONS = frozenset("not no never without cannot cant dont doesnt isnt arent wont".split())
_ANY_CASE = re.compile(COURTESIES.pattern, re.IGNORECASE)
_ZERO = re.compile("[​-‏⁠﻿­]")
_TOKEN = re.compile(r"[^\W_]+(?:[_.\-/:'’][^\W_]+)*")
_NAME = re.compile(r"[A-Za-z0-9]+[_.\-/:][A-Za-z0-9]|[a-z][A-Z]|\d")
MIN_NAME = 9
#: Endings of words of the language, which a long rare word that is a name hardly has.
_ENDING = re.compile(r"(?:ly|ing|ed|ions?|ments?|ness|able|ible|ances?|ences?|ish|ical|ous|ity|ies|ful|less|ive)$")


def tokens(text: str) -> list[tuple[str, bool]]:
    """(token in lower case without signs, does it look like a name or number)."""
    text = _ZERO.sub("", unicodedata.normalize("NFKC", text))
    bare = COURTESIES.sub(" ", text.lower())
    if len(bare) == len(text):
        bare = text  # keeps the capitals that tell names
    else:
        looks = {m.group().lower() for m in _TOKEN.finditer(text) if _NAME.search(m.group())}
        return [(re.sub(r"[\W_]", "", t), t in looks or bool(_NAME.search(t))) for t in _TOKEN.findall(bare)]
    return [(re.sub(r"[\W_]", "", t).lower(), bool(_NAME.search(t))) for t in _TOKEN.findall(bare)]


def one_slip(a: str, b: str) -> bool:
    """Does one letter lost, doubled, changed or swapped with its neighbour part the words? Words of under 3 letters are never slips."""
    if min(len(a), len(b)) < 2 or max(len(a), len(b)) < 3 or a.isdigit() or b.isdigit():
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@lru_cache(maxsize=100_000)
def _opposites_of(w: str) -> frozenset[str]:
    """The words of opposite sense to w, or to what w is a slip of."""
    return frozenset(b for pair in OPPOSITES for a in pair for b in pair - {a} if a == w or one_slip(a, w))


def opposed(p: str, q: str) -> bool:
    return any(q == b or one_slip(q, b) for b in _opposites_of(p))


def lost_capitals(text: str) -> bool:
    """Has the question, without courtesies and its first word, not both capitals and small letters?"""
    bare = _ANY_CASE.sub(" ", _ZERO.sub("", unicodedata.normalize("NFKC", text)))
    body = re.sub(r"^\W+", "", bare).partition(" ")[2]
    return not any(c.isupper() for c in body) or not any(c.islower() for c in body)


def may_be_name(t: str) -> bool:
    """May this word, met only in questions without capitals, be a name? Long ones may, unless they end like a word of the language."""
    return len(t) >= MIN_NAME and not _ENDING.search(t)


def canonical(names: set[str], words: set[str]) -> tuple[str, str]:
    """(names, words) in the order of the index, joined by blanks: names sorted; long words, which are rarer, before short ones."""
    return " ".join(sorted(names)), " ".join(sorted(words - names, key=lambda w: (-len(w), w)))


def same_sense(names: int, x: set[str], y: set[str], unknown: frozenset[str] | set[str], min_share: float) -> bool:
    """Do two questions with the same names ask the same? x and y are their words, names the number of their names.

    The words that only one has are paired where a slip parts them, unless both are unknown words, which
    may be names. No unknown word may stay alone, no two words of opposite sense may stand against each
    other, and the share of words in common, slips counted, must reach min_share.
    """
    left, right = sorted(x - y), sorted(y - x)
    slips, alone = 0, []
    for u in left:
        k = next((v for v in right if not (u in unknown and v in unknown) and one_slip(u, v)), None)
        if k is None:
            alone.append(u)
        else:
            right.remove(k)
            slips += 1
    if any(w in unknown for w in (*alone, *right)):
        return False
    if any(opposed(p, q) for p in alone for q in right):
        return False
    if len(NEGATIONS.intersection(alone)) != len(NEGATIONS.intersection(right)):
        return False
    return 2 * (len(x & y) + slips + names) >= min_share * (len(x) + len(y) + 2 * names)


class WaveletMatrix:
    """Ranks of symbols in a sequence, kept as packed bits: bits of the greatest symbol times the length, and a count a word."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.depth = max(1, int(symbols.max(initial=0)).bit_length())
        words = self.n // 64 + 1
        self.bits, self.counts, self.zeros = [], [], []
        now = symbols.astype(np.int64)
        for level in range(self.depth - 1, -1, -1):
            one = (now >> level) & 1 == 1
            packed = np.zeros(words * 8, np.uint8)
            raw = np.packbits(one, bitorder="little")
            packed[: len(raw)] = raw
            packed = packed.view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed))]).astype(np.int32))
            self.zeros.append(int(self.n - one.sum()))
            now = np.concatenate([now[~one], now[one]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.counts[k][word] + np.bitwise_count(self.bits[k][word] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        lo, hi = np.zeros_like(i), i
        for k in range(self.depth):
            one = (symbol >> (self.depth - 1 - k)) & 1 == 1
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def at(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.depth):
            one = (self.bits[k][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            a = self._ones(k, i)
            i = np.where(one, self.zeros[k] + a, i - a)
            out = out * 2 + one
        return out


class FullTextIndex:
    """Compressed full-text index of token sequences: the BWT in a wavelet matrix; no text and no suffix array is kept.

    Every sequence starts with the symbol FIRST, which stands nowhere else, so a row that starts with it
    tells its sequence. All searches take whole arrays of patterns.
    """

    FIRST, SEP = 1, 2

    def __init__(self, sequences: list[tuple[list[str], list[str]]]):
        self.ids: dict[str, int] = {}
        text: list[int] = []
        starts = []
        for names, words in sequences:
            starts.append(len(text))
            text += [self.FIRST, *(self.ids.setdefault(t, len(self.ids) + 3) for t in names), self.SEP]
            text += [self.ids.setdefault(t, len(self.ids) + 3) for t in words]
        text.append(0)
        n = self.n = len(text)
        t = np.array(text, np.int64)
        rank, width = t.copy(), 1
        while True:  # suffix order by doubling; it is needed only while the index is built
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            order = np.lexsort((after, rank))
            key = np.stack([rank[order], after[order]])
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.any(key[:, 1:] != key[:, :-1], axis=0))])
            rank = new
            if rank.max() == n - 1 or width >= n:
                break
            width *= 2
        self.wavelet = WaveletMatrix(t[np.argsort(rank) - 1])
        self.before = np.searchsorted(np.sort(t), np.arange(len(self.ids) + 4))
        first = np.array(starts, np.int64)
        self.owner = np.argsort(rank[first]).astype(np.int32)  # sequences in the order of their first rows
        self.length = np.diff(np.append(first, n - 1)).astype(np.int32)
        self.end_row = rank[np.append(first, n - 1)[1:]].astype(np.int32) if len(first) else np.zeros(0, np.int32)

    def encode(self, names: list[str], words: list[str]) -> np.ndarray:
        get = self.ids.get
        return np.array([self.FIRST, *(get(x, -1) for x in names), self.SEP, *(get(x, -1) for x in words)], np.int64)

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes start with symbol followed by what rows lo..hi start with; none for an unknown symbol."""
        known = np.maximum(symbol, 0)
        a = self.before[known] + self.wavelet.rank(known, lo)
        b = self.before[known] + self.wavelet.rank(known, hi)
        return a, np.where(symbol > 0, b, a)

    def find(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the rows that start with it whole, by backward search; lo >= hi where there are none."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        size = np.array([len(p) for p in patterns], np.int64)
        for k in range(int(size.max(initial=0))):
            on = np.nonzero((size > k) & (lo < hi))[0]
            if not len(on):
                break
            lo[on], hi[on] = self.extend(lo[on], hi[on], np.array([patterns[i][size[i] - 1 - k] for i in on], np.int64))
        return lo, hi

    def _step(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the row of the suffix one place to the left, the symbol there)."""
        s = self.wavelet.at(rows)
        return self.before[s] + self.wavelet.rank(s, rows), s

    def owners(self, lo: int, hi: int) -> np.ndarray:
        """The sequences whose suffixes stand in rows lo..hi: by steps to the left until their first symbol."""
        rows = np.arange(lo, hi, dtype=np.int64)
        begin, end = int(self.before[self.FIRST]), int(self.before[self.FIRST + 1])
        out = []
        while len(rows):
            home = (rows >= begin) & (rows < end)
            out.append(self.owner[rows[home] - begin])
            rows = rows[~home]
            if len(rows):
                rows, _ = self._step(rows)
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def rows_of(self, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in owners, row) of every suffix of each sequence."""
        which, rows, left = np.arange(len(owners)), self.end_row[owners].astype(np.int64), self.length[owners].astype(np.int64)
        ks, rs = [], []
        while len(which):
            rows, _ = self._step(rows)
            left = left - 1
            ks.append(which)
            rs.append(rows)
            on = left > 0
            which, rows, left = which[on], rows[on], left[on]
        return (np.concatenate(ks), np.concatenate(rs)) if ks else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def maximal_matches(self, seqs: list[np.ndarray], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(k, start, end): for each end in seqs[k] the longest match with sequence owners[k] that ends there."""
        k, row = self.rows_of(owners)
        held = np.sort(k * (self.n + 1) + row)
        size = np.array([len(q) for q in seqs], np.int64)
        flat = np.concatenate(seqs) if len(seqs) else np.zeros(0, np.int64)
        offset = np.append(0, np.cumsum(size)[:-1])
        pair = np.repeat(np.arange(len(seqs)), size)
        end = np.arange(len(flat)) - offset[pair] + 1
        start = end.copy()
        lo, hi = np.zeros(len(flat), np.int64), np.full(len(flat), self.n, np.int64)
        on = np.arange(len(flat))
        while len(on):
            a, b = self.extend(lo[on], hi[on], flat[offset[pair[on]] + start[on] - 1])
            base = pair[on] * (self.n + 1)
            met = (a < b) & (np.searchsorted(held, base + a) < np.searchsorted(held, base + b))
            on = on[met]
            lo[on], hi[on] = a[met], b[met]
            start[on] -= 1
            on = on[start[on] > 0]
        some = start < end
        return pair[some], start[some], end[some]


def merged_lengths(pairs: int, k: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each pair the number of places that its spans cover together."""
    width = int(end.max(initial=0)) + 1
    edge = np.zeros((pairs, width), np.int32)
    np.add.at(edge, (k, start), 1)
    np.add.at(edge, (k, end), -1)
    return (np.cumsum(edge, axis=1) > 0).sum(axis=1)


TOKEN_SCHEMA = "case_no long, split string, origin string, looks array<string>, plain array<string>, lost boolean"
PAIR_SCHEMA = "hard string, train_soft string, eval_soft string, found_share double, longest_run int"


def token_kinds(own: DataFrame) -> DataFrame:
    """(t, kind): tokens that need to be told apart over all questions.

    'name': written like a name at least as often as plainly by questions that have kept their capitals;
    'word': the other tokens that some question writes like a name; 'unknown': met only in questions
    without capitals and long enough to be a name. Tokens only ever written like a name, and plain words,
    are not listed.
    """
    seen = own.select(F.explode("looks").alias("t"), F.lit(1).alias("look"), F.lit(0).alias("plain"), F.lit(0).alias("low")).unionByName(
        own.select(F.explode("plain").alias("t"), F.lit(0).alias("look"), (~F.col("lost")).cast("int").alias("plain"), F.col("lost").cast("int").alias("low"))
    )
    n = seen.groupBy("t").agg(F.sum("look").alias("look"), F.sum("plain").alias("plain"), F.sum("low").alias("low"))
    unknown = (F.col("look") == 0) & (F.col("plain") == 0) & (F.length("t") >= MIN_NAME) & ~F.col("t").rlike(_ENDING.pattern)
    mixed = (F.col("look") > 0) & (F.col("plain") + F.col("low") > 0)
    kind = F.when(unknown, "unknown").when(mixed & (F.col("look") >= F.col("plain")), "name").when(mixed, "word")
    return n.select("t", kind.alias("kind")).where("kind IS NOT NULL")


def classes(cases: DataFrame) -> DataFrame:
    """(case_no, split, origin, hard, soft, unknown) of every distinct case row with a question that has words.

    Whether a token is a name is decided once for all questions, so that both sides of a pair are split
    alike, and from how it is written alone, whatever the number of questions.
    """
    rows = cases.select(
        F.col("case_no").cast("long").alias("case_no"),
        F.lower(F.trim("split_name")).alias("split"),
        F.col("ground_truth_origin").alias("origin"),
        F.col("question").alias("q"),
    ).where("case_no IS NOT NULL AND q IS NOT NULL AND split IN ('train', 'dev', 'test')").distinct()

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            looks, plain = [], []
            for q in pdf["q"]:
                got = [x for x in tokens(q) if x[0]]
                like = {t for t, name in got if name}
                looks.append(sorted(like))
                plain.append(sorted({t for t, _ in got} - like))
            yield pdf[["case_no", "split", "origin"]].assign(looks=looks, plain=plain, lost=[lost_capitals(q) for q in pdf["q"]])

    own = cut_lineage(rows.mapInPandas(parts, TOKEN_SCHEMA).withColumn("row", F.monotonically_increasing_id()))
    used = own.select("row", F.explode(F.array_union("looks", "plain")).alias("t"))
    told = small_or_salted_join(used, token_kinds(own), ["t"], F.col("row")).groupBy("row").agg(  # the tokens of one question
        *(F.collect_set(F.when(F.col("kind") == k, F.col("t"))).alias(k) for k in ("name", "word", "unknown"))
    )
    none = F.array().cast("array<string>")
    both = own.join(told, "row", "left").withColumns({k: F.coalesce(k, none) for k in ("name", "word", "unknown")})
    names = F.array_except(F.array_union("looks", "name"), "word")
    words = F.array_except(F.array_union("looks", "plain"), names)
    order = lambda x: F.transform(F.array_sort(F.transform(x, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    return both.select(
        "case_no", "split", "origin", F.array_join(F.array_sort(names), " ").alias("hard"), F.array_join(order(words), " ").alias("soft"),
        F.array_join(F.array_sort(F.array_intersect("unknown", words)), " ").alias("unknown"),
    ).where("hard <> '' OR soft <> ''")


class _Shard:
    """The evaluation wordings of a shard, searched by training wordings."""

    #: Cells of (match end, pair) that one step of the search holds.
    CELLS = 200_000
    #: Groups of wordings with equal names above this size are narrowed by counts of words before they are searched.
    SMALL = 64

    def __init__(self, held: pd.DataFrame):
        self.hards, self.softs = held["eh"].tolist(), held["es"].tolist()
        self.words = [set(s.split()) for s in self.softs]
        self.unknown = [set(u.split()) for u in held["eu"]]
        self.index = FullTextIndex([(h.split(), s.split()) for h, s in zip(self.hards, self.softs)])
        self.posts: dict[str, np.ndarray] = {}

    def _narrow(self, owners: np.ndarray, names: int, words: list[str], min_exact: float) -> np.ndarray:
        """Of the owners, which all have the same names, those that share enough words for min_exact."""
        count = np.zeros(len(self.softs), np.int32)
        for w in words:
            if w not in self.posts:
                lo, hi = self.index.find([np.array([self.index.ids.get(w, -1)], np.int64)])
                self.posts[w] = self.index.owners(int(lo[0]), int(hi[0])) if lo[0] < hi[0] else np.zeros(0, np.int64)
            count[self.posts[w]] += 1
        whole = 2 * names + len(words) + self.index.length[owners] - 2 - names
        return owners[2 * (count[owners] + names) >= min_exact * whole]

    def search(self, stream: pd.DataFrame, min_share: float, min_exact: float) -> Iterator[tuple]:
        split = [(h.split(), s.split()) for h, s in zip(stream["th"], stream["ts"])]
        lo, hi = self.index.find([self.index.encode(names, []) for names, _ in split])
        todo: list[tuple[int, np.ndarray]] = []
        cells = 0
        for q in np.nonzero(lo < hi)[0]:
            own = self.index.owners(int(lo[q]), int(hi[q]))
            if len(own) > self.SMALL:
                own = self._narrow(own, len(split[q][0]), split[q][1], min_exact)
            width = len(split[q][0]) + len(split[q][1]) + 2
            step = max(1, self.CELLS // width)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                if cells and cells + len(part) * width > self.CELLS:
                    yield from self._decide(todo, split, stream, min_share, min_exact)
                    todo, cells = [], 0
                todo.append((int(q), part))
                cells += len(part) * width
        if todo:
            yield from self._decide(todo, split, stream, min_share, min_exact)

    def _decide(self, todo: list[tuple[int, np.ndarray]], split: list, stream: pd.DataFrame, min_share: float, min_exact: float) -> Iterator[tuple]:
        qs = np.repeat([q for q, _ in todo], [len(o) for _, o in todo])
        owners = np.concatenate([o for _, o in todo])
        if not len(qs):
            return
        code = {q: self.index.encode(*split[q]) for q, _ in todo}
        k, start, end = self.index.maximal_matches([code[q] for q in qs], owners)
        found = merged_lengths(len(qs), k, start, end) - 2  # without the two signs of order
        longest = np.zeros(len(qs), np.int64)
        np.maximum.at(longest, k, end - start)
        size = np.array([len(split[q][0]) + len(split[q][1]) for q in qs])
        share = 2 * found / np.maximum(size + self.index.length[owners] - 2, 1)
        for i in np.nonzero(share >= min_exact)[0]:
            q, o = int(qs[i]), int(owners[i])
            unknown = self.unknown[o] | set(stream["tu"].iat[q].split())
            if same_sense(len(split[q][0]), set(split[q][1]), self.words[o], unknown, min_share):
                yield stream["th"].iat[q], stream["ts"].iat[q], self.softs[o], float(share[i]), int(longest[i])


def class_pairs(rows: DataFrame, min_share: float, min_exact: float, shard_rows: int, block_rows: int) -> DataFrame:
    """Pairs of a training and an evaluation wording that ask the same, with what the maximal matches found."""
    evals = rows.where("split <> 'train'").select("hard", "soft", "unknown").distinct()
    trains = rows.where("split = 'train'").select("hard", "soft", "unknown").distinct()
    shards = max(1, -(-evals.count() // shard_rows))
    evals = evals.toDF("eh", "es", "eu").withColumn("shard", F.pmod(F.xxhash64("eh"), F.lit(shards)).cast("int"))
    trains = trains.toDF("th", "ts", "tu").withColumn("shard", F.pmod(F.xxhash64("th"), F.lit(shards)).cast("int"))
    parts = evals.groupBy("shard").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    blocks = trains.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    plan = parts.join(blocks, "shard")  # one row a shard
    left = evals.join(plan, "shard").select(
        F.col("shard").alias("s1"), F.pmod(F.xxhash64("es", "eh"), F.col("parts")).cast("int").alias("p1"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b1"), "eh", "es", "eu",
    )
    right = trains.join(plan, "shard").select(
        F.col("shard").alias("s2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p2"),
        F.pmod(F.xxhash64("ts", "th"), F.col("blocks")).cast("int").alias("b2"), "th", "ts", "tu",
    )

    def search(held: pd.DataFrame, stream: pd.DataFrame) -> pd.DataFrame:
        out = list(_Shard(held).search(stream, min_share, min_exact)) if len(held) and len(stream) else []
        return pd.DataFrame(out, columns=["hard", "train_soft", "eval_soft", "found_share", "longest_run"])

    return left.groupBy("s1", "p1", "b1").cogroup(right.groupBy("s2", "p2", "b2")).applyInPandas(search, PAIR_SCHEMA)


def overlaps(cases: DataFrame, min_share: float = 0.7, min_exact: float = 0.5, shard_rows: int = 2_000, block_rows: int = 5_000) -> DataFrame:
    """(train_case, eval_case, split_name, origin, found_share): a training and an evaluation case that ask the same.

    found_share is the part of both questions that the merged maximal matches cover, min_exact of it at
    least; with slips of spelling paired min_share must be reached. Pairs are found between distinct
    wordings and expanded to cases at the end. Rows loaded twice count once; rows with null or empty
    question, case_no or split are left out; an empty side gives no rows.
    """
    rows = cut_lineage(classes(cases))
    pairs = class_pairs(rows, min_share, min_exact, shard_rows, block_rows)
    train = rows.where("split = 'train'").toDF("train_case", "s", "o", "hard", "train_soft", "u")
    held = rows.where("split <> 'train'").toDF("eval_case", "split_name", "origin", "hard", "eval_soft", "u")
    with_eval = pairs.alias("p").join(
        held.alias("h"), (F.col("p.hard") == F.col("h.hard")) & (F.col("p.eval_soft") == F.col("h.eval_soft"))
    ).select(F.col("p.hard").alias("names"), F.col("p.train_soft").alias("wording"), "eval_case", "split_name", "origin", "found_share")
    return with_eval.join(
        train, (F.col("names") == F.col("hard")) & (F.col("wording") == F.col("train_soft"))
    ).select("train_case", "eval_case", "split_name", "origin", "found_share")


def overlap_report(cases: DataFrame) -> DataFrame:
    """(split_name, ground_truth_origin, cases, overlapping, share, pairs) for evaluation cases; a null origin is its own row."""
    per = overlaps(cases).groupBy("eval_case").agg(F.count_distinct("train_case").alias("pairs"))
    held = cases.select(
        F.col("case_no").cast("long").alias("eval_case"), F.lower(F.trim("split_name")).alias("split_name"), "ground_truth_origin"
    ).where("eval_case IS NOT NULL AND split_name IN ('dev', 'test')").distinct()
    return (
        held.join(per, "eval_case", "left")
        .groupBy("split_name", "ground_truth_origin")
        .agg(
            F.count_distinct("eval_case").alias("cases"),
            F.count_distinct(F.when(F.col("pairs").isNotNull(), F.col("eval_case"))).alias("overlapping"),
            F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        )
        .withColumn("share", F.round(F.col("overlapping") / F.col("cases"), 6))
    )
