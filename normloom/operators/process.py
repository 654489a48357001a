"""From source records to documents, sections and events: normalisation, and the process stage with an outcome per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.functions import text as X
from normloom.functions import tiers
from normloom.functions import validity as V
from normloom.operators import ingest

OUTCOMES = ("skipped", "failed", "out_of_scope", "low_quality", "indexed")


def language(declared: Column, corpus: Column) -> Column:
    """The declared language, else Vietnamese for corpora of Viet Nam, else English."""
    vietnamese = [c.id for c in tiers.CORPORA if c.jurisdiction == "vn"]
    return F.coalesce(F.nullif(declared, F.lit("")), F.when(corpus.isin(*vietnamese), "vi").otherwise("en"))


def documents(records: DataFrame, now: Column) -> DataFrame:
    """records with validity_status, language, access_tier and error.

    records: corpus_id, number, url, title, status, language, effective_date and any more. A record of an unregistered corpus, or with neither number nor URL,
    has an error and is no document; its other columns stay. Empty texts count as null."""
    known = [c.id for c in tiers.CORPORA]
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    error = F.when(~F.coalesce(F.col("corpus_id").isin(*known), F.lit(False)), "unregistered corpus").when(empty("number") & empty("url"), "neither number nor url")
    return records.withColumns({
        "error": error, "language": language(F.col("language"), F.col("corpus_id")), "access_tier": tiers.corpus_tier(F.col("corpus_id")),
        "validity_status": V.map_validity(F.col("status"), F.col("effective_date"), now), "number": F.nullif(F.trim("number"), F.lit("")), "url": F.nullif(F.trim("url"), F.lit("")),
    })


def relation_events(records: DataFrame) -> DataFrame:
    """(external_id, target_number, kind, event_date) from the records' relations (array of struct(label, target_number)): those with a number and a label that changes
    a status; dated by when the record takes effect, else by when it was issued."""
    each = records.select("external_id", F.coalesce("effective_date", "issued_date").alias("event_date"), F.explode("relations").alias("r"))
    rows = each.select("external_id", F.nullif(F.trim("r.target_number"), F.lit("")).alias("target_number"), V.event_kind(F.col("r.label")).alias("kind"), "event_date")
    return rows.where("target_number is not null and kind is not null")


def with_targets(events: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, pending): events whose number a document (id, doc_number) has, with target_id, less those of a document on itself; and the others, which are kept until their
    target comes in, by calling this again."""
    one = docs.where("doc_number is not null").groupBy(F.col("doc_number").alias("target_number")).agg(F.min("id").alias("target_id"))
    both = events.drop("target_id").join(one, "target_number", "left")
    return both.where("target_id is not null and target_id <> external_id"), both.where("target_id is null").drop("target_id")


def extracted_text(content: Column, mime: Column) -> Column:
    """The text by media type: HTML without its markup, plain text and markdown as they are; null for anything else (PDF and office
    files pass a parser first)."""
    kind = ingest.media_type(mime)
    return F.when(kind == "text/html", X.html_to_text(content)).when(kind.isin("text/plain", "text/markdown"), content)


def outcomes(records: DataFrame, ledger: DataFrame, in_scope: Column | None = None, expects_marks: Column | None = None) -> DataFrame:
    """records (external_id, content_hash, text, ...) with outcome and reason; no record ends the run.

    skipped: the ledger (external_id, content_hash, state) has it indexed unchanged; failed: no text; out_of_scope: in_scope is false; low_quality: the quality gate
    rejects the text, with its reasons; indexed: the rest, whose sections are then parsed and written."""
    done = ledger.where("state = 'indexed'").select("external_id", "content_hash").distinct().withColumn("_done", F.lit(True))
    rows = records.join(done, ["external_id", "content_hash"], "left")
    rows = rows.withColumn("_scope", F.lit(True) if in_scope is None else F.coalesce(in_scope, F.lit(False)))
    rows = X.with_quality(rows, "text", F.lit(True) if expects_marks is None else expects_marks)
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    outcome = F.when(F.col("_done"), "skipped").when(blank, "failed").when(~F.col("_scope"), "out_of_scope").when(~F.col("ok"), "low_quality").otherwise("indexed")
    rows = rows.withColumn("outcome", outcome)
    reason = F.when(F.col("outcome") == "failed", "no text").when(F.col("outcome") == "low_quality", F.col("reason"))
    return rows.withColumn("reason", reason).drop("_done", "_scope", "n_chars", *X.COUNTS, "confidence", "ok")


def counters(rows: DataFrame, by: list[str]) -> DataFrame:
    """The number of rows by outcome, one column each."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
