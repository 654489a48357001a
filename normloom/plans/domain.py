"""The driver's tables in the engine's terms, as DataFrames and as the SQL that states the same.

documents and embeddings make the searchable corpus (one section a document, corpus by source); document_envelope gives
documents, doc_section their sections, graph_edge the graph (a node's corpus by the first digit of its id), events the
amendments, orders the history of role holders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.functions import tiers
from normloom.plans.session import table

SOURCE_CORPUS = {"vbpl": "vn-reg", "congbao": "vn-reg", "agc": "my-reg", "standards": "group-std", "library": "local-policy", "bulletin": "local-sop", "minutes": "reports"}
NODE_CORPUS = {"vn-reg": "0123", "my-reg": "45", "group-std": "67", "local-policy": "89a", "local-sop": "bcde", "reports": "f"}
EVENT_LABEL = {"click": "amends", "purchase": "replaces", "error": "repeals", "view": "cites", "signup": "cites"}
DAY = "DATE '2024-01-01'"


def _case(column: Column, pairs: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in pairs.items():
        out = out.when(column == k, F.lit(v))
    return out


def _sql_case(column: str, pairs: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def corpus(spark: SparkSession, sf: str, text: bool = True) -> DataFrame:
    """section_id, corpus_id, access_tier, text, embedding, validity_status, effective_date, expiry_date, doc_number."""
    d = table(spark, sf, "documents")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    effective = F.date_add(F.expr(DAY), (F.col("doc_id") % 400).cast("int"))
    status = F.when(F.col("doc_id") % 5 == 0, "not_yet_effective").when(F.col("doc_id") % 5 == 4, "repealed").otherwise("in_force")
    out = d.join(e, "doc_id", "left").select(
        F.col("doc_id").alias("section_id"), _case(F.col("source"), SOURCE_CORPUS).alias("corpus_id"), "text", "embedding", "label", status.alias("validity_status"),
        effective.alias("effective_date"), F.when(F.col("doc_id") % 7 == 0, F.date_add(effective, 200)).alias("expiry_date"), "doc_number", "lang", "source", "published_at",
    )
    out = out.withColumn("access_tier", F.when(F.col("section_id") % 11 == 0, tiers.LOCAL).otherwise(tiers.corpus_tier(F.col("corpus_id"))))
    return out if text else out.drop("text")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The latest snapshot of each document."""
    t = table(spark, sf, "document_envelope").where("id is not null and observed_at is not null")
    date = lambda c: F.nullif(F.trim(c), F.lit(""))
    s = t.select("id", "observed_at", "loaded_at", F.lower(F.trim("validity_status")).alias("status"), date("effective_date").alias("ef"), date("expiry_date").alias("ex"), "corpus_id", "doc_number", "title", "ingest_run_id")
    one = s.groupBy("id").agg(F.max(F.struct("observed_at", "loaded_at", "status", "ef", "ex", "corpus_id", "doc_number", "title", "ingest_run_id")).alias("d")).select("id", "d.*")
    return one.select("id", "corpus_id", "doc_number", "title", "status", F.col("ef").try_cast("date").alias("effective_date"), F.col("ex").try_cast("date").alias("expiry_date"), "observed_at", "loaded_at", "ingest_run_id")


def sections(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "doc_section")
    return t.groupBy("id").agg(F.max(F.struct("document_id", "citation_path", "heading_path", "text", "validity_status", "sec_position")).alias("s")).select("id", "s.*")


def edges(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "graph_edge")
    s = F.struct("source", "target", F.lower(F.trim("edge_type")).alias("edge_type"), "confidence", "grounding_score", "promoted", "created_at")
    return t.groupBy("id").agg(F.max(s).alias("e")).select("id", "e.*")


def node_corpus(node: Column) -> Column:
    out, first = F.when(F.lit(False), F.lit("")), F.substring(node, 1, 1)
    for c, digits in NODE_CORPUS.items():
        out = out.when(first.isin(list(digits)), F.lit(c))
    return out


def amendments(spark: SparkSession, sf: str) -> DataFrame:
    """event_id, target_id (a section of corpus()), label, event_date."""
    t = table(spark, sf, "events")
    return t.select("event_id", F.col("user_id").alias("target_id"), _case(F.col("event_type"), EVENT_LABEL).alias("label"), F.col("ts").alias("event_date"), "value")


SQL = f"""
corp AS (
  SELECT d.doc_id AS section_id, {_sql_case("d.source", SOURCE_CORPUS)} AS corpus_id, d.text, CAST(e.embedding AS DOUBLE[]) AS embedding, e.label,
    CASE WHEN d.doc_id % 5 = 0 THEN 'not_yet_effective' WHEN d.doc_id % 5 = 4 THEN 'repealed' ELSE 'in_force' END AS validity_status,
    {DAY} + CAST(d.doc_id % 400 AS INTEGER) AS effective_date, CASE WHEN d.doc_id % 7 = 0 THEN {DAY} + CAST(d.doc_id % 400 AS INTEGER) + 200 END AS expiry_date,
    d.doc_number, d.lang, d.source, d.published_at
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id),
docs AS (
  SELECT id, corpus_id, doc_number, title, status, TRY_CAST(ef AS DATE) AS effective_date, TRY_CAST(ex AS DATE) AS expiry_date, observed_at, loaded_at, ingest_run_id FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY observed_at DESC, loaded_at DESC NULLS LAST, status DESC NULLS LAST, ef DESC NULLS LAST, ex DESC NULLS LAST,
      corpus_id DESC NULLS LAST, doc_number DESC NULLS LAST, title DESC NULLS LAST, ingest_run_id DESC NULLS LAST) AS r
    FROM (SELECT id, observed_at, loaded_at, lower(trim(validity_status)) AS status, nullif(trim(effective_date), '') AS ef, nullif(trim(expiry_date), '') AS ex,
      corpus_id, doc_number, title, ingest_run_id FROM document_envelope WHERE id IS NOT NULL AND observed_at IS NOT NULL)) WHERE r = 1),
secs AS (SELECT DISTINCT id, document_id, citation_path, heading_path, text, validity_status, sec_position FROM doc_section),
edges AS (SELECT DISTINCT id, source, target, lower(trim(edge_type)) AS edge_type, confidence, grounding_score, promoted, created_at FROM graph_edge),
amends AS (SELECT event_id, user_id AS target_id, {_sql_case("event_type", EVENT_LABEL)} AS label, ts AS event_date, value FROM events)
"""


def sql_node_corpus(node: str) -> str:
    return "CASE " + " ".join(f"WHEN substr({node}, 1, 1) IN ({', '.join(repr(x) for x in digits)}) THEN '{c}'" for c, digits in NODE_CORPUS.items()) + " END"


def sql_tier(corpus_id: str) -> str:
    return f"CASE WHEN {corpus_id} IN ('vn-reg', 'my-reg') THEN 'public' WHEN {corpus_id} = 'group-std' THEN 'group-confidential' ELSE 'local-confidential' END"


def sql_rank(tier: str) -> str:
    return f"CASE {tier} WHEN 'public' THEN 0 WHEN 'group-confidential' THEN 1 ELSE 2 END"


SQL_ROW_TIER = f"CASE WHEN section_id % 11 = 0 THEN 'local-confidential' ELSE {sql_tier('corpus_id')} END"


def sql_visible(role_rank: int) -> str:
    """Row policy over corp rows."""
    c = sql_rank(sql_tier("corpus_id"))
    return f"({role_rank} >= {c} AND ({c} = 2 OR {sql_rank(SQL_ROW_TIER)} <= {c}))"
