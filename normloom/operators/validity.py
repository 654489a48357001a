"""Folding dated amendment events onto legal status, as of any moment; timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.functions import validity as V


def fold(documents: DataFrame, events: DataFrame, moment: Column) -> DataFrame:
    """documents (id, status) with folded_status and n_due after the events (target_id, kind, event_date, event_id) that are due
    at the moment. Repealed absorbs; else the last amended or superseded event counts, ties by event_id; a later event
    isn't applied yet. Recomputed from the events, so it may run any number of times. Events of unknown targets or without
    kind or date change nothing. Pre-aggregated per target before the join, so a target with many events is no burden."""
    due = events.where((F.col("event_date") <= moment) & F.col("kind").isNotNull() & F.col("target_id").isNotNull())
    last = due.groupBy(F.col("target_id").alias("id")).agg(
        F.count("*").alias("n_due"),
        F.max(F.col("kind") == V.REPEALED).alias("repealed"),
        F.max(F.when(F.col("kind").isin(V.AMENDED, V.SUPERSEDED), F.struct("event_date", "event_id", "kind")))["kind"].alias("last_kind"),
    )
    out = documents.join(last, "id", "left").withColumn("n_due", F.coalesce("n_due", F.lit(0)))
    folded = F.when((F.col("status") == V.REPEALED) | F.coalesce("repealed", F.lit(False)), V.REPEALED).otherwise(F.coalesce("last_kind", "status"))
    return out.withColumn("folded_status", folded).drop("repealed", "last_kind")


def due_sweep(documents: DataFrame, events: DataFrame, since: Column, moment: Column) -> DataFrame:
    """Documents whose status differs between two moments: id, status_before, status_after."""
    a = fold(documents, events, since).select("id", F.col("folded_status").alias("status_before"))
    b = fold(documents, events, moment).select("id", F.col("folded_status").alias("status_after"))
    return a.join(b, "id").where(~F.col("status_before").eqNullSafe(F.col("status_after")))


def status_as_of(documents: DataFrame, moment: Column) -> DataFrame:
    """documents with status_as_of: what isn't in effect yet, or no longer, at the moment says so, whatever was stored."""
    later = F.col("effective_date") > moment
    over = F.col("expiry_date") <= moment
    started = F.when(F.col("status") == V.NOT_YET, V.IN_FORCE).otherwise(F.col("status"))
    return documents.withColumn("status_as_of", F.when(F.col("status") == V.REPEALED, V.REPEALED).when(over, V.REPEALED).when(later, V.NOT_YET).otherwise(started))


def superseding(events: DataFrame) -> DataFrame:
    """(id, superseded_by): the last superseding document of each target."""
    one = events.where((F.col("kind") == V.SUPERSEDED) & F.col("amending_id").isNotNull())
    return one.groupBy(F.col("target_id").alias("id")).agg(F.max(F.struct("event_date", "event_id", "amending_id"))["amending_id"].alias("superseded_by"))


def page(df: DataFrame, order: list[tuple[str, bool]], limit: int, after: tuple | None = None) -> DataFrame:
    """One page and the row that tells whether there are more: limit + 1 rows in the order of (column, descending) pairs, the
    last of which is unique; after is the full sort key of the last row seen. A limit outside 1..100 means 20."""
    limit = limit if 0 < limit <= 100 else 20
    if after is not None:
        past, same = F.lit(False), F.lit(True)
        for (c, desc), v in zip(order, after, strict=True):
            value = F.lit(v)
            past = past | (same & ((F.col(c) < value) if desc else (F.col(c) > value)))
            same = same & (F.col(c) == value)
        df = df.where(past)
    return df.orderBy(*[F.desc(c) if d else F.asc(c) for c, d in order]).limit(limit + 1)


def timeline(events: DataFrame, documents: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Events with the title and corpus of their target, from start to end inclusive; events of hidden or missing documents
    don't show."""
    if start is not None:
        events = events.where(F.col("event_date") >= start)
    if end is not None:
        events = events.where(F.col("event_date") <= end)
    return events.join(documents.select(F.col("id").alias("target_id"), "corpus_id", "title"), "target_id")
