"""Problem 8: sources mixed to target weights, by a splitting tree over blocks.

Each source is cut into blocks by hash. From the target shares follows how many tokens a source must
give and so how many of its blocks, in permuted order, pass after pass, are used; the last block is
used in part. The chosen block uses are spread over the output shards by a splitting tree: each node
draws from a multivariate hypergeometric distribution how many uses of each source go left, until a
leaf holds exactly its quota. Documents then meet the plan of their block and are shuffled inside
their shard. The report sums the tokens of the documents drawn; a source falls short when all its
allowed uses are drawn and its quota isn't met. The plan holds a bounded number of blocks, whatever
the size of the corpus.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagery.runtime import BROADCAST_ROWS, cut_lineage

#: Where the vocabulary files of public tokenizers are; a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern of byte-level BPE over 50,257 ids.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Cells by hash of a block that is used in part.
CELLS = 1024


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    lines = Path(path).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """df with its text replaced by tokens, the number of tokens; 0 for null and empty texts."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(tokenizer)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return df.withColumn("tokens", F.pandas_udf(count, "long")(F.col(text))).drop(text)


def sized(docs: DataFrame, targets: DataFrame, doc_key: str, text: str, source: str, tokenizer: str, blocks: int, seed: int) -> DataFrame:
    """(source, d, b, o, tokens): the documents of the target sources with their block and their place in it."""
    names = targets.select("source", F.lower(F.trim("source")).alias("s")).where("s IS NOT NULL").dropDuplicates(["s"])
    own = docs.select(
        F.col(doc_key).alias("d"), F.lower(F.trim(F.col(source))).alias("s"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    # mix_targets lists sources, one row each: a small side by nature, which Spark broadcasts by its size
    mine = own.join(names, "s").drop("s")
    order = F.xxhash64(F.lit(seed), F.col("d"))
    return with_tokens(mine, "text", tokenizer).select(
        "source", "d", "tokens", F.pmod(order, F.lit(blocks)).cast("int").alias("b"), order.alias("o")
    )


def quotas(blocks: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """targets with the tokens there are of each source and the tokens wanted of it.

    The mixture is to be as large as all its documents taken once. Null shares count as 0, null repeats as 1.
    """
    have = blocks.groupby("source")["tokens"].sum() if len(blocks) else pd.Series(dtype="int64")
    out = targets.copy()
    out["tokens"] = [int(have.get(s, 0)) for s in out["source"]]
    out["wanted"] = out["target_share"].fillna(0).astype(float) * float(out["tokens"].sum())
    out["max_repeats"] = out["max_repeats"].fillna(1).astype("int64")
    return out


def block_uses(blocks: pd.DataFrame, plan: pd.DataFrame, seed: int) -> tuple[pd.DataFrame, dict[str, float]]:
    """(source, b, pass_no, part): the uses of each source's blocks, in permuted order, pass after pass; and what each source then lacks.

    part is 1, but below 1 for the last use, of which only as many documents are taken as the quota
    needs. A source is passed at most max_repeats times; one without tokens lacks all that is wanted.
    """
    rng = np.random.default_rng(seed)
    out, lack = [], {}
    for row in plan.sort_values("source").itertuples():
        own = blocks[(blocks["source"] == row.source) & (blocks["tokens"] > 0)].sort_values("b")
        names, sizes = own["b"].to_numpy(np.int64), own["tokens"].to_numpy(float)
        left = float(row.wanted)
        enough = max(1e-9 * left, 1e-9)
        for pass_no in range(int(row.max_repeats) if len(own) else 0):
            if left <= enough:
                break
            order = rng.permutation(len(own))
            before = np.append(0, np.cumsum(sizes[order])[:-1])
            for i, gone in zip(order[before < left], before[before < left]):
                out.append((row.source, int(names[i]), pass_no, min(1.0, (left - gone) / sizes[i])))
            left = max(0.0, left - float(sizes.sum()))
        lack[row.source] = left if left > enough else 0.0
    return pd.DataFrame(out, columns=["source", "b", "pass_no", "part"]), lack


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """counts by source -> counts by shard and source, each shard within one use of an equal number.

    A node gives its left half of the shards a multivariate hypergeometric draw of its uses.
    """
    if shards == 1:
        return counts[None, :]
    half = shards // 2
    left = rng.multivariate_hypergeometric(counts, int(round(counts.sum() * half / shards)), method="marginals")
    return np.vstack([split_tree(left, half, rng), split_tree(counts - left, shards - half, rng)])


def shard_uses(uses: pd.DataFrame, shards: int, seed: int) -> pd.DataFrame:
    """uses with the output shard of each: disjoint permuted uses of a source fill the quotas of the leaves."""
    rng = np.random.default_rng(seed + 1)
    names = sorted(uses["source"].unique())
    counts = np.array([(uses["source"] == s).sum() for s in names], np.int64)
    if not len(names):
        return uses.assign(shard=pd.Series(dtype="int64"))
    leaves = split_tree(counts, shards, rng)
    parts = []
    for k, s in enumerate(names):
        own = uses[uses["source"] == s].sample(frac=1.0, random_state=int(rng.integers(2**31)))
        parts.append(own.assign(shard=np.repeat(np.arange(shards), leaves[:, k])))
    return pd.concat(parts, ignore_index=True)


class Mixer:
    """Plan of a mixture: block sizes are summed in Spark, the plan over the bounded blocks is made once."""

    def __init__(
        self, docs: DataFrame, targets: DataFrame, doc_key: str = "doc_id", text: str = "text", source: str = "source",
        tokenizer: str = TOKENIZER, blocks: int = 512, shards: int = 16, seed: int = 1729,
    ):
        self.shards, self.seed = shards, seed
        self.targets = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL")
        self.drawn: tuple[pd.DataFrame, dict[str, float], pd.DataFrame] | None = None
        self.sized = sized(docs, self.targets, doc_key, text, source, tokenizer, blocks, seed)

    def sizes(self) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(tokens by source and block, targets): at most blocks rows for each target."""
        blocks = self.sized.groupBy("source", "b").agg(F.sum("tokens").alias("tokens")).toPandas()
        targets = self.targets.toPandas()
        targets["s"] = targets["source"].str.strip().str.lower()
        return blocks, targets.drop_duplicates("s").drop(columns="s")

    def draw(self) -> tuple[pd.DataFrame, dict[str, float], pd.DataFrame]:
        """(quotas, what each source lacks, block uses with their shard); tokens are counted once, here."""
        if self.drawn is None:
            self.sized = cut_lineage(self.sized)
            blocks, targets = self.sizes()
            plan = quotas(blocks, targets)
            uses, lack = block_uses(blocks, plan, self.seed)
            self.drawn = plan, lack, shard_uses(uses, self.shards, self.seed)
        return self.drawn

    def _small(self, rows: list[tuple], schema: str) -> DataFrame:
        """A part of the plan, broadcast while it is small."""
        df = self.targets.sparkSession.createDataFrame(rows, schema)
        return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df

    def _parts(self, cut: pd.DataFrame) -> DataFrame:
        """The documents of the blocks used in part (one block a source): in hash order, until the part is full.

        The order is cut where the part ends by the sizes of CELLS cells of a block, so that only the
        documents of one cell need to be put in order.
        """
        cell = F.pmod(F.shiftright("o", 24), F.lit(CELLS)).cast("int")
        named = self._small([(r.source, int(r.b), int(r.pass_no), int(r.shard)) for r in cut.itertuples()], "source string, b int, pass_no int, shard int")
        own = self.sized.join(named, ["source", "b"]).withColumn("cell", cell)
        sizes = own.groupBy("source", "cell").agg(F.sum("tokens").alias("tokens")).toPandas()  # at most CELLS rows a target
        edges = []
        for r in cut.itertuples():
            mine = sizes[sizes["source"] == r.source].sort_values("cell")
            upto = mine["tokens"].cumsum().to_numpy(float)
            want = r.part * upto[-1]
            k = min(int(np.searchsorted(upto, want)), len(upto) - 1)
            edges.append((r.source, int(mine["cell"].iloc[k]), float(want - (upto[k - 1] if k else 0.0))))
        own = own.join(self._small(edges, "source string, edge int, rest double"), "source")
        w = Window.partitionBy("source", "cell").orderBy("o", "d").rowsBetween(Window.unboundedPreceding, 0)
        last = own.where("cell = edge").withColumn("upto", F.sum("tokens").over(w)).where(F.col("upto") - F.col("tokens") / 2 <= F.col("rest"))
        return own.where("cell < edge").unionByName(last.drop("upto")).drop("cell", "edge", "rest")

    def mixture(self) -> DataFrame:
        """(source, doc_id, pass_no, shard, place, tokens): the mixture; place orders the documents inside a shard."""
        _, _, uses = self.draw()
        whole = uses[uses["part"] >= 1]
        plan = [(r.source, int(r.b), int(r.pass_no), int(r.shard)) for r in whole.itertuples()]
        used = self.sized.join(self._small(plan, "source string, b int, pass_no int, shard int"), ["source", "b"])
        if len(cut := uses[uses["part"] < 1]):
            used = used.unionByName(self._parts(cut))
        place = F.xxhash64(F.lit(self.seed), F.col("d"), F.col("pass_no"), F.col("shard"))
        return used.select("source", F.col("d").alias("doc_id"), "pass_no", "shard", place.alias("place"), "tokens")

    def report(self) -> DataFrame:
        """(source, target_share, actual_share, tokens, wanted, given, short): given and actual_share are summed over the mixture drawn.

        A source is short if all its allowed uses are drawn and its quota isn't met; a target without
        documents is short if its share is above 0.
        """
        plan, lack, _ = self.draw()
        given = self.mixture().groupBy("source").agg(F.sum("tokens").alias("given"))
        total = given.agg(F.sum("given").alias("total"))  # one row
        rows = [(r.source, float(r.target_share or 0), int(r.tokens), float(r.wanted), lack[r.source] > 0) for r in plan.itertuples()]
        base = self._small(rows, "source string, target_share double, tokens long, wanted double, short boolean")
        given = base.join(given, "source", "left").withColumn("given", F.coalesce("given", F.lit(0)))
        share = F.coalesce(F.try_divide("given", "total"), F.lit(0.0))
        return given.crossJoin(total).select("source", "target_share", share.alias("actual_share"), "tokens", "wanted", "given", "short")
