"""Joins with hot keys, shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagery.runtime import BROADCAST_ROWS, cut_lineage

SALTS = 16
#: A key of more rows than this is hot, and than a 100,000th of all rows, so hot keys are at most MOST_HOT.
HOT_ROWS = 20_000
MOST_HOT = 100_000


def hot_above(total: int, least: int = HOT_ROWS) -> int:
    return max(least, total // MOST_HOT)


def salted_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with table on keys; a key that holds many of the rows goes to `salts` partitions.

    table, which has few rows a key, is repeated once a salt; spread is what tells the rows of one key apart.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def small_or_salted_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with table, which is written first and broadcast if it has at most BROADCAST_ROWS rows."""
    table = cut_lineage(table)
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), list(keys), how)
    return salted_join(rows, table, keys, spread, how)


def split_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], held: str, above: int) -> DataFrame:
    """rows joined with table, one row a key, whose column `held` counts the rows of its key.

    The hot keys, of which there are at most MOST_HOT if above is hot_above of all rows, are broadcast,
    so their rows aren't shuffled at all; the others meet by a shuffle.
    """
    table = cut_lineage(table)
    hot = table.where(F.col(held) > above)
    if hot.isEmpty():
        return rows.join(table, list(keys))
    cold = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti").join(table.where(F.col(held) <= above), list(keys))
    return rows.join(F.broadcast(hot), list(keys)).unionByName(cold)
