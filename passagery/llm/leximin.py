"""Problem 1: one ranking from several differently-scaled scores, by leximin over percentiles.

Each score is replaced by its percentile within the group, every item's percentiles are sorted
ascending, and the vectors are compared lexicographically: the item whose weakest score is
strongest comes first, and no score rules by its range.

Scale: a group may hold a third of all rows. Groups of up to BIG_GROUP rows (or a 100,000th of all) are
shuffled once, whole, and ranked by windows over the group. Larger ones, of which there can't be more
than 100,000, are found first by a count on the group alone; there values are counted per distinct value
(map-side), then ranked inside cells of neighbouring values, and the cells of a group, whose number
depends on the spread of its values alone, carry the offsets. Ranks come back to the items by the value,
those of hot values by broadcast, so neither a hot group nor a hot value becomes one task; missing scores
aren't joined at all.
The cell of a value depends on the value alone, so a stage that runs again gives the same cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagery.llm.skew import HOT_ROWS, hot_above, split_join

BIG_GROUP = HOT_ROWS
CELLS_PER_DOUBLING = 2048
_EXPONENTS = 1100


def value_cell(v: Column) -> Column:
    """A whole number that never falls as v rises: CELLS_PER_DOUBLING cells for each doubling of |v|."""
    size = F.floor(
        F.least(F.greatest(F.log2(F.abs(v)), F.lit(-float(_EXPONENTS))), F.lit(float(_EXPONENTS)))
        * CELLS_PER_DOUBLING
    ) + F.lit(_EXPONENTS * CELLS_PER_DOUBLING + 1)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, size).otherwise(-size).cast("long")


def _given(df: DataFrame, group: str, item: str, scores: Sequence[str], recency: Sequence[str]) -> DataFrame:
    """(g, i, t0.., s0..): NaN is null; rows without group or item are left out, since they can't be ranked."""
    times = [df[c].alias(f"t{k}") for k, c in enumerate(recency)]
    values = [F.when(~F.isnan(df[s]), df[s].cast("double") + F.lit(0.0)).alias(f"s{k}") for k, s in enumerate(scores)]
    return df.select(df[group].alias("g"), df[item].alias("i"), *times, *values).where(F.col("g").isNotNull() & F.col("i").isNotNull())


def latest_rows(rows: DataFrame) -> DataFrame:
    """One row for each (g, i): the one with the greatest times.

    A null time counts as earliest; equal times fall back to the greater scores, so repeated rows
    change nothing.
    """
    scores = [c for c in rows.columns if c[0] == "s"]
    picked = F.max(F.struct(*(c for c in rows.columns if c[0] == "t"), *scores))
    return rows.groupBy("g", "i").agg(picked.alias("m")).select("g", "i", *(F.col(f"m.{s}").alias(s) for s in scores))


def by_size(rows: DataFrame, big_group: int) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of groups that one task can hold, rows of larger ones or None if there are none, the size that parts them)."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    big_group = hot_above(int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]), big_group)
    found = [r["g"] for r in sizes.where(F.col("n") > big_group).collect()]
    if not found:
        return rows, None, big_group
    big = F.broadcast(rows.sparkSession.createDataFrame([(g,) for g in found], rows.select("g").schema))  # at most MOST_HOT rows
    return rows.join(big, "g", "left_anti"), rows.join(big, "g", "left_semi"), big_group


def _vectors_of_small(rows: DataFrame, n: int) -> DataFrame:
    """(g, i, v) by windows over whole groups, all in one shuffle."""
    out = latest_rows(rows.repartition("g"))
    size = F.count("*").over(Window.partitionBy("g"))
    p = []
    for k in range(n):
        w = Window.partitionBy("g").orderBy(F.col(f"s{k}").asc_nulls_first())
        same = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
        out = out.withColumn(f"p{k}", F.when(F.col(f"s{k}").isNull(), 0.0).otherwise((F.rank().over(w) - 1 + (same + 1) / F.lit(2.0)) / size))
        p.append(f"p{k}")
    return out.select("g", "i", F.array_sort(F.array(*p)).alias("v"))


def _vectors_of_big(rows: DataFrame, n: int, big_group: int) -> DataFrame:
    """(g, i, v) by counts of distinct values and cells; no window and no join holds a whole group or value."""
    base = latest_rows(rows)
    given = F.array_compact(F.array(*(F.when(F.col(f"s{k}").isNotNull(), F.struct(F.lit(k).alias("d"), F.col(f"s{k}").alias("v"))) for k in range(n))))
    long = base.select("g", "i", F.explode_outer(given).alias("e")).select("g", "i", F.coalesce("e.d", F.lit(-1)).alias("d"), "e.v")
    counts = long.where("d >= 0").groupBy("g", "d", "v").agg(F.count("*").alias("same")).withColumn("c", value_cell(F.col("v")))
    cells = counts.groupBy("g", "d", "c").agg(F.sum("same").alias("held"))
    total = base.groupBy("g").agg(F.count("*").alias("total"), *(F.count_if(F.col(f"s{k}").isNull()).alias(f"m{k}") for k in range(n)))
    missing = F.element_at(F.array(*(f"m{k}" for k in range(n))), F.col("d") + 1)
    by_cell = Window.partitionBy("g", "d").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.withColumn("before", F.coalesce(F.sum("held").over(by_cell), F.lit(0)))
    placed = placed.join(F.broadcast(total), "g").select("g", "d", "c", (F.col("before") + missing).alias("before"), "total")  # as many rows as big groups
    inside = Window.partitionBy("g", "d", "c").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("lower", F.coalesce(F.sum("same").over(inside), F.lit(0))).join(placed, ["g", "d", "c"]).select(
        "g", "d", "v", "same", ((F.col("before") + F.col("lower") + (F.col("same") + 1) / F.lit(2.0)) / F.col("total")).alias("p")
    )
    told = split_join(long.where("d >= 0"), ranks, ["g", "d", "v"], "same", big_group)
    every = told.select("g", "i", "d", "p").unionByName(long.where("d < 0").select("g", "i", "d", F.lit(0.0).alias("p")))
    out = every.groupBy("g", "i").agg(*(F.max(F.when(F.col("d") == k, F.col("p"))).alias(f"p{k}") for k in range(n)))
    return out.select("g", "i", F.array_sort(F.array(*(F.coalesce(f"p{k}", F.lit(0.0)) for k in range(n)))).alias("v"))


def _vectors(df: DataFrame, group: str, item: str, scores: Sequence[str], recency: Sequence[str], big_group: int) -> tuple[DataFrame, DataFrame | None]:
    """(g, i, v) of small groups and of big ones: every item's percentiles, sorted ascending.

    The percentile of a present score is (lower + (equal + 1) / 2) / all over the items of the
    group, where missing scores (null or NaN) count as lower; a missing score has percentile 0.
    An empty table gives no rows; a group of one item gives ones (zeros where it lacks a score).
    """
    small, big, big_group = by_size(_given(df, group, item, scores, recency), big_group)
    return _vectors_of_small(small, len(scores)), None if big is None else _vectors_of_big(big, len(scores), big_group)


def _descending(n: int) -> list[Column]:
    return [(-F.col("v")[k]).alias(f"n{k}") for k in range(n)]


def _together(parts: Sequence[DataFrame | None]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def leximin_first(
    df: DataFrame, group: str, item: str, scores: Sequence[str], recency: Sequence[str] = (), big_group: int = BIG_GROUP
) -> DataFrame:
    """The first item of every group; full ties go to the smallest item key."""
    firsts = [
        None if v is None else v.groupBy("g").agg(F.min(F.struct(*_descending(len(scores)), F.col("i"))).alias("m"))
        for v in _vectors(df, group, item, scores, recency, big_group)
    ]
    return _together(firsts).select(F.col("g").alias(group), F.col("m.i").alias(item))


def leximin_ranking(
    df: DataFrame, group: str, item: str, scores: Sequence[str], recency: Sequence[str] = (), big_group: int = BIG_GROUP
) -> DataFrame:
    """(group, item, position, v0, v1, ...): every item's place in its group's order.

    Positions are exact and have no gaps. In big groups they are found inside cells, like the
    percentiles, plus the number of items in the cells before. The cell is that of the weakest
    percentile that isn't zero, so that many items which all lack a score don't end up in one cell.
    """
    n = len(scores)
    small, big = _vectors(df, group, item, scores, recency, big_group)
    small = small.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy(*_descending(n), "i")))
    if big is not None:
        cell = F.floor(F.col("v")[n - 1] * 4096)
        for k in range(n - 2, -1, -1):
            cell = F.when(F.col("v")[k] > 0, (n - 1 - k) * 5000 + F.floor(F.col("v")[k] * 4096)).otherwise(cell)
        big = big.withColumn("c", -cell)
        before = Window.partitionBy("g").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        cells = big.groupBy("g", "c").agg(F.count("*").alias("held"))
        cells = cells.select("g", "c", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
        inside = Window.partitionBy("g", "c").orderBy(*_descending(n), "i")
        big = big.withColumn("k", F.row_number().over(inside)).join(cells, ["g", "c"])
        big = big.select("g", "i", "v", (F.col("before") + F.col("k")).alias("position"))
    return _together([small, big]).select(
        F.col("g").alias(group), F.col("i").alias(item), F.col("position").cast("long").alias("position"),
        *(F.col("v")[k].alias(f"v{k}") for k in range(n)),
    )
