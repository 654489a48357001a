"""Incremental ingest in batch: ledger, watermark, upserts, relations, normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("indexed", "out_of_scope")


def discovery_hash(number: Column, title: Column, url: Column, kind: Column, fingerprint: Column | None = None) -> Column:
    """SHA-256 over the parts, joined by '|', null as empty; the fingerprint only where there is one."""
    parts = [F.coalesce(c, F.lit("")) for c in (number, title, url, kind)]
    text = F.concat_ws("|", *parts)
    if fingerprint is not None:
        text = F.when(F.coalesce(fingerprint, F.lit("")) != "", F.concat_ws("|", text, fingerprint)).otherwise(text)
    return F.sha2(text, 256)


def to_process(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """Found records (external_id, content_hash) that the ledger (and state) doesn't have unchanged in a terminal state; blank
    ids are skipped; failed and merely discovered ones come again."""
    done = ledger.where(F.col("state").isin(*TERMINAL)).select("external_id", "content_hash")
    return found.where(F.trim("external_id") != "").join(done, ["external_id", "content_hash"], "left_anti")


def watermark(old: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Per source the later of the old watermark and the latest issued (else published) date seen in a complete pass (column
    complete); it never goes back and doesn't move on a broken pass."""
    new = seen.groupBy(key).agg(F.max(F.coalesce("issued", "published")).alias("latest"), F.min("complete").alias("whole"))
    moved = F.when(F.coalesce("whole", F.lit(False)), F.greatest("watermark", "latest")).otherwise(F.col("watermark"))
    return old.join(new, key, "full_outer").select(key, moved.alias("watermark"))


def upsert(existing: DataFrame, incoming: DataFrame, columns: list[str]) -> DataFrame:
    """Documents after a merge on the natural key: an incoming row takes the id of the document with its doc_number, else of the
    one with its source_url, else its own new_id; all columns are replaced. Incoming rows of one number, else of one URL, are one document as
    well: that of the first of them (by seen). Of several rows for one document the last seen counts. Empty numbers and URLs
    count as none. Documents that nothing touches stay."""
    rest = [c for c in columns if c != "id"]
    given = incoming.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("doc_number", "source_url")})
    stored = lambda c, name: existing.where(f"{c} <> ''").groupBy(c).agg(F.min("id").alias(name))
    keyed = given.join(stored("doc_number", "by_number"), "doc_number", "left").join(stored("source_url", "by_url"), "source_url", "left").withColumn("known", F.coalesce("by_number", "by_url"))

    def founded(df: DataFrame, c: str, name: str, *ids: str) -> DataFrame:
        """df with the id that the first row of each value of c has."""
        first = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(F.struct("seen", F.coalesce(*ids, "new_id").alias("i")))["i"].alias(name))
        return df.join(first, c, "left")

    keyed = founded(keyed, "doc_number", "of_number", "known")
    keyed = founded(keyed, "source_url", "of_url", "known", "of_number")
    keyed = founded(keyed, "doc_number", "of_both", "known", "of_url")  # a new number may come under a URL seen before
    keyed = keyed.withColumn("id", F.coalesce("known", "of_both", "of_url", "new_id"))
    last = keyed.groupBy("id").agg(F.max(F.struct("seen", *rest)).alias("n")).select("id", *[f"n.{c}" for c in rest])
    return existing.select("id", *rest).join(last.select("id"), "id", "left_anti").unionByName(last)


def replace_sections(existing: DataFrame, incoming: DataFrame, dimensions: int | None = None) -> DataFrame:
    """Sections after replacing all sections of the incoming documents. With dimensions, an embedding of another length
    makes the whole replacement fail before anything is written."""
    if dimensions is not None:
        bad = F.col("embedding").isNotNull() & (F.size("embedding") != dimensions)
        incoming = incoming.withColumn("embedding", F.when(bad, F.raise_error(F.lit(f"an embedding hasn't {dimensions} dimensions"))).otherwise(F.col("embedding")))
    kept = existing.join(incoming.select("document_id").distinct(), "document_id", "left_anti")
    return kept.unionByName(incoming)


def first_events(events: DataFrame) -> DataFrame:
    """One event per (target, amending document or none, clause or '', date), the first by seen; the kind isn't in the key."""
    key = ["target_id", F.coalesce("amending_id", F.lit("")).alias("a"), F.coalesce("clause", F.lit("")).alias("c"), "event_date"]
    rest = [c for c in events.columns if c not in ("target_id", "event_date", "seen")]
    return events.groupBy(*key).agg(F.min(F.struct("seen", *rest)).alias("e")).select("target_id", "event_date", *[f"e.{c}" for c in rest])


def merge_relations(groups: DataFrame) -> DataFrame:
    """Relations of a record from several groups (record_id, group_no, position, target_id, target_number, target_title, label):
    the first of each target, identified by id, else number, else title; others without any are dropped."""
    key = F.coalesce(F.nullif(F.trim("target_id"), F.lit("")), F.nullif(F.trim("target_number"), F.lit("")), F.nullif(F.trim("target_title"), F.lit("")))
    w = Window.partitionBy("record_id", "relation_key").orderBy("group_no", "position")
    return groups.withColumn("relation_key", key).where("relation_key is not null").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def relation_targets(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """(record_id, target_id): relations whose number a document has; misses and the record itself are dropped."""
    one = documents.where("doc_number is not null").groupBy("doc_number").agg(F.min("id").alias("target_id"))
    return relations.join(one, relations["target_number"] == one["doc_number"]).where("record_id <> target_id").select("record_id", "target_id").distinct()


def main_file(files: Column) -> Column:
    """The file of kind main, else the first."""
    return F.coalesce(F.get(F.filter(files, lambda f: f["kind"] == "main"), 0), F.get(files, 0))


def content_type(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain"}
    out = F.when(F.lit(False), F.lit(""))
    for e, k in kinds.items():
        out = out.when(ext == e, F.lit(k))
    return out


def media_type(header: Column) -> Column:
    return F.lower(F.trim(F.split(header, ";")[0]))
