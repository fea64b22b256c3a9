"""Vector arithmetic as column expressions, summed left to right in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Scalar product; null where the lengths differ."""
    s = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )
    return F.when(F.size(a) == F.size(b), s)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for zero vectors."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def sparse_dot(a: Column, b: Column) -> Column:
    """Scalar product of two token -> weight maps."""
    return F.aggregate(
        F.map_keys(a), F.lit(0.0), lambda acc, k: acc + F.coalesce(F.try_element_at(a, k) * F.try_element_at(b, k), F.lit(0.0))
    )


def late_interaction(query: Column, passage: Column) -> Column:
    """Mean over the query's token vectors of the greatest scalar product with a passage token vector."""
    best = F.transform(query, lambda q: F.array_max(F.transform(passage, lambda p: dot(q, p))))
    return F.try_divide(F.aggregate(best, F.lit(0.0), lambda acc, v: acc + v), F.size(query))
