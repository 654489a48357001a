"""Dashboards, coverage, roles over time, ingest status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(edges: DataFrame, references: DataFrame) -> DataFrame:
    """One row: promoted satisfies edges, law references, and their percentage, 0 without references, at most 100."""
    a = edges.agg(F.count_if(F.col("promoted") & (F.col("edge_type") == "satisfies")).alias("n_satisfied"))
    b = references.agg(F.count("*").alias("n_refs"))
    pct = F.when(F.col("n_refs") > 0, F.least(100.0 * F.col("n_satisfied") / F.nullif(F.col("n_refs"), F.lit(0)), F.lit(100.0))).otherwise(0.0)
    return a.join(F.broadcast(b)).withColumn("coverage_pct", F.round(pct, 6))  # one row on either side


def per_corpus(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents per registered corpus, hidden or empty ones 0."""
    n = documents.groupBy("corpus_id").agg(F.count("*").alias("n_documents"))
    return registry.select("corpus_id", "kind").join(n, "corpus_id", "left").withColumn("n_documents", F.coalesce("n_documents", F.lit(0)))


def run_status(runs: DataFrame, key: str) -> DataFrame:
    """Per source the state of the latest run and when one last finished well: healthy, ingesting or error."""
    last = F.max(F.struct("started_at", "run_id", "status"))["status"]
    state = F.when(last == "completed", "healthy").when(last == "running", "ingesting").otherwise("error")
    return runs.groupBy(key).agg(state.alias("state"), F.max(F.when(F.col("status") == "completed", F.col("finished_at"))).alias("last_completed"), F.count("*").alias("n_runs"))


def holder_at(history: DataFrame, moments: DataFrame, key: str) -> DataFrame:
    """As-of join: for every moment (key, moment) the holder whose half-open period [from_date, to_date) holds it, the latest
    started on overlap; null before the first period. Both sides meet in one sorted stream per key and hash slice of
    nothing else: a union and a running last value, no range join."""
    from pyspark.sql import Window

    h = history.select(key, F.col("from_date").alias("at"), F.lit(0).alias("ask"), F.struct("from_date", "to_date", "holder").alias("span"), F.lit(None).cast(moments.schema["moment_id"].dataType).alias("moment_id"))
    m = moments.select(key, F.col("moment").alias("at"), F.lit(1).alias("ask"), F.lit(None).cast(h.schema["span"].dataType).alias("span"), "moment_id")
    w = Window.partitionBy(key).orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = h.unionByName(m).withColumn("span", F.last("span", ignorenulls=True).over(w)).where("ask = 1")
    valid = F.col("span.to_date").isNull() | (F.col("span.to_date") > F.col("at"))
    return out.select(key, "moment_id", F.col("at").alias("moment"), F.when(valid, F.col("span.holder")).alias("holder"))


def half_open(rows: DataFrame, key: str, start: str, order: Column, holder: str) -> DataFrame:
    """Periods from changes: each row holds from start to the next row's start."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(start, order)
    return rows.select(key, F.col(holder).alias("holder"), F.col(start).alias("from_date"), F.lead(start).over(w).alias("to_date"))
