"""Relation detection: candidates, reranking, judging, grounding and the gate. The models are plug points."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normloom.functions import validity as V
from normloom.operators.findings import gate
from normloom.operators.search import vector_multi_query

EDGE_TYPES = ("satisfies", "implements", "derives", "covers", "concerns")


def candidates(sources: DataFrame, targets: DataFrame, k: int = 10, window: int = 3) -> DataFrame:
    """(source_id, target_id, distance, place): for every source section (id, embedding) the window x k nearest current target
    sections (id, embedding, validity_status)."""
    items = targets.where(V.current(F.col("validity_status")) & F.col("embedding").isNotNull())
    near = vector_multi_query(items.select(F.col("id").alias("item_id"), "embedding"), sources.select(F.col("id").alias("query_id"), "embedding"), window * k)
    return near.select(F.col("query_id").alias("source_id"), F.col("item_id").alias("target_id"), "distance", "place")


def rank_by_order(df: DataFrame) -> DataFrame:
    """The offline ranker: keeps the order, 1 less 0.1 per place, at least 0."""
    return df.withColumn("rank_score", F.greatest(1 - 0.1 * (F.col("place") - 1), F.lit(0.0)))


def rerank(found: DataFrame, k: int = 10, ranker: Callable[[DataFrame], DataFrame] = rank_by_order) -> DataFrame:
    """The k best candidates per source by the ranker's rank_score, ties by the first order."""
    scored = ranker(found)
    order = Window.partitionBy("source_id").orderBy(F.desc("rank_score"), "place")
    return scored.withColumn("final_place", F.row_number().over(order)).where(F.col("final_place") <= k)


@F.pandas_udf(T.StructType([T.StructField("edge_type", T.StringType()), T.StructField("confidence", T.DoubleType())]))
def judge_constant(source: pd.Series, target: pd.Series) -> pd.DataFrame:
    """The offline judge: satisfies, 0.85."""
    return pd.DataFrame({"edge_type": ["satisfies"] * len(source), "confidence": [0.85] * len(source)})


@F.pandas_udf(T.DoubleType())
def ground_constant(source: pd.Series, target: pd.Series) -> pd.Series:
    """The offline grounder: 0.95."""
    return pd.Series([0.95] * len(source))


def relations(pairs: DataFrame, judge=judge_constant, ground=ground_constant, min_confidence: float = 0.7, min_grounding: float = 0.6) -> DataFrame:
    """Edges from candidate pairs (source_id, target_id, source_text, target_text): judged, of a known type, grounded, gated.
    The grounder sees only what the judge has kept."""
    judged = pairs.withColumn("j", judge("source_text", "target_text")).where(F.col("j.edge_type").isin(*EDGE_TYPES))
    grounded = judged.withColumn("grounding_score", ground("source_text", "target_text")).withColumn("confidence", F.col("j.confidence"))
    return grounded.where(gate(min_confidence, min_grounding)).select("source_id", "target_id", F.col("j.edge_type").alias("edge_type"), "confidence", "grounding_score")


def audit_hash(prompt) -> object:
    """The first 16 hexadecimal digits of the prompt's SHA-256."""
    return F.left(F.sha2(prompt, 256), F.lit(16))


def support_score(n_hits) -> object:
    """How well the hits support an answer: three or more fully."""
    return F.least(n_hits / 3.0, F.lit(1.0))
