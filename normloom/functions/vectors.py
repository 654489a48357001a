"""Vectors: cosine, exact top-k, random-hyperplane buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def literal(vector: list[float] | Column) -> Column:
    """A list as a column; a column (a scalar subquery) as it is."""
    return vector if isinstance(vector, Column) else F.array(*[F.lit(float(v)) for v in vector])


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null, of zero length or of another number of dimensions."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), 1 - dot(a, b) / size)


def top_k(df: DataFrame, vector: list[float] | Column, k: int, partition: str, key: str, column: str = "embedding") -> DataFrame:
    """The k nearest rows of each partition with distance and rank_v; ties go by key. The query is a literal or a scalar subquery, so nothing but
    the ranked columns is shuffled, and the ranking keeps k rows per partition and task before it is."""
    out = df.where(F.col(column).isNotNull()).withColumn("_q", literal(vector))
    out = out.withColumn("distance", cosine_distance(F.col(column), F.col("_q"))).where("distance is not null").drop(column, "_q")
    order = Window.partitionBy(partition).orderBy("distance", key)
    return out.withColumn("rank_v", F.row_number().over(order)).where(F.col("rank_v") <= k)


def hyperplane_buckets(df: DataFrame, dimensions: int, bits: int, tables: int, seed: int = 0, column: str = "embedding") -> DataFrame:
    """df with buckets, an array of one bucket number per table: the signs of the dot products with random hyperplanes."""
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dimensions))
    one = lambda t: sum((F.when(dot(F.col(column), literal(planes[t, b])) > 0, F.lit(1 << b)).otherwise(F.lit(0)) for b in range(bits)), F.lit(0))
    return df.withColumn("buckets", F.array(*[one(t) for t in range(tables)]))
