"""Vectors and sets held in arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for a zero vector, empty vectors, different lengths or null."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (n > 0), F.try_divide(dot(a, b), n)), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def softmax(xs: Column) -> Column:
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def moved_centroid(old: Column, new: Column, n: Column) -> Column:
    """Mean of n vectors from the mean of n - 1 and the n-th; no mean yet: the vector."""
    return F.when(F.coalesce(F.size(old), F.lit(0)) <= 0, new).otherwise(F.zip_with(old, new, lambda o, v: (o * (n - 1) + v) / n))


def parse_vector(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def vector_text(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, i, mean): the mean of each key's vectors, component by component (i from 0).

    Components are summed where they are, so a key with many vectors moves one
    row for each component and task. The mean of vectors taken one after the
    other by moved_centroid is the same.
    """
    each = df.select(key, F.posexplode(F.transform(vector, lambda x: x.cast("double"))).alias("i", "x"))
    return each.groupBy(key, "i").agg(F.avg("x").alias("mean"))
