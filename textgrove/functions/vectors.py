"""Vector arithmetic as Spark expressions.

Dense vectors are ``ARRAY<DOUBLE>`` columns; sparse vectors stay in the long form
``weights(doc_id, term_id, w)``, where adding and scaling are an aggregation and a division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(x: Column, y: Column) -> Column:
    products = F.zip_with(x, y, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def length(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, 0 where the denominator is 0 or missing (zero vectors)."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def cosine(x: Column, y: Column, x_length: Column | None = None, y_length: Column | None = None):
    """Cosine similarity; pass cached lengths to avoid recomputing them."""
    x_length = length(x) if x_length is None else x_length
    y_length = length(y) if y_length is None else y_length
    return safe_ratio(dot(x, y), x_length * y_length)


def squared_distance(x: Column, y: Column) -> Column:
    gaps = F.zip_with(x, y, lambda a, b: (a - b) * (a - b))
    return F.aggregate(gaps, F.lit(0.0), lambda total, g: total + g)


def sparse_add(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Coordinate-wise sum of two families of sparse vectors with the same ``keys``."""
    columns = [*keys, "term_id", "w"]
    both = left.select(*columns).unionByName(right.select(*columns))
    return both.groupBy(*keys, "term_id").agg(F.sum("w").alias("w"))


def sparse_scale(weights: DataFrame, divisor: Column) -> DataFrame:
    """Divide every coordinate by ``divisor``."""
    return weights.withColumn("w", F.col("w") / divisor)
