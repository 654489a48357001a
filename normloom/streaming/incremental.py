"""Streams: discovery into the ledger, status by due events, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from normloom.operators.ingest import TERMINAL, to_process


def discover(stream: DataFrame, ledger_path: str, checkpoint: str, process) -> None:
    """Runs the available part of a stream of (external_id, content_hash, ...) into a ledger table.

    Each micro-batch is deduplicated, compared with the ledger and handed to process(DataFrame), which returns external_id,
    content_hash and state; the states are appended under the batch's number, so a batch that is run again replaces
    itself. The watermark is the stream's own offset: it moves only when a batch is complete.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        found = df.dropDuplicates(["external_id", "content_hash"])
        new = to_process(found, ledger(spark, ledger_path).where(F.col("batch") < number))
        process(new).select("external_id", "content_hash", "state").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


LEDGER = "external_id string, content_hash string, state string, batch int"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All states so far; empty before the first batch."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("basePath", path).parquet(path)


def terminal(states: DataFrame) -> DataFrame:
    return states.where(F.col("state").isin(*TERMINAL))


STATUS = "id string, status string, changed timestamp"


def _due_statuses(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Status per document: events in the future wait in the state until event time has passed them. The first row of a document gives
    its base status."""
    status, waiting = (None, []) if not state.exists else (state.get[0], list(zip(state.get[1], state.get[2])))
    for frame in frames:
        if status is None:
            status = next((s for s in frame["base_status"] if isinstance(s, str)), None)
        waiting += [(int(t.value // 1000), k) for t, k in zip(frame["event_date"], frame["kind"]) if k is not None]
    status = "in_force" if status is None else status
    now = state.getCurrentWatermarkMs() * 1000
    out = []
    for at, kind in sorted(w for w in waiting if w[0] <= now):
        new = "repealed" if "repealed" in (status, kind) else kind
        if new != status:
            status = new
            out.append((key[0], status, pd.Timestamp(at, unit="us")))
    waiting = sorted(w for w in waiting if w[0] > now)
    state.update((status, [w[0] for w in waiting], [w[1] for w in waiting]))
    if waiting:
        state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["id", "status", "changed"])


def status_stream(events: DataFrame, lateness: str = "0 seconds") -> DataFrame:
    """Changes of status as event time passes the events' dates. events: target_id, kind, event_date, seen_at (event time of
    the stream) and, where there is one, base_status, the document's status before any event; without it a document begins in
    force. An event dated after the watermark is kept and applied by a timer when the watermark passes it. A repealed document stays so."""
    base = F.col("base_status") if "base_status" in events.columns else F.lit(None).cast("string")
    marked = events.select(F.col("target_id").cast("string").alias("id"), "kind", "event_date", "seen_at", base.alias("base_status")).withWatermark("seen_at", lateness)
    return marked.groupBy("id").applyInPandasWithState(
        _due_statuses, STATUS, "status string, dates array<bigint>, kinds array<string>", "append", GroupStateTimeout.EventTimeTimeout
    )


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, lateness: str | None = "10 minutes") -> DataFrame:
    """Counts and sums per window and event type (an extension beyond the engine's own operators). lateness None: the stream has
    its watermark already."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    events = events.withWatermark("ts", lateness) if lateness else events
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", lateness: str = "1 hour") -> DataFrame:
    """The first of each key within the lateness."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])
