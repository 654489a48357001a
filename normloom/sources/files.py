"""Drop folders, sidecars, golden sets and content-addressed blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.operators.ingest import content_type

EXTENSIONS = ("pdf", "docx", "html", "md")
SIDECAR = "number string, title string, doc_type string, language string, signer_name string, signer_role string, owner_department string, owner_role string, version string, issued_date string, effective_date string, relations array<struct<type:string,target_number:string>>"
GOLDEN = "id string, question string, expected array<struct<doc_number:string,segments:array<string>>>, expect_abstain boolean"


def library(spark: SparkSession, folder: str, modified_after: str | None = None) -> DataFrame:
    """Files of a drop folder: path, name, ext, modified, length, content, fingerprint (SHA-256), content_type. Folders that
    start with a dot are skipped; only known extensions count."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,docx,html,md}")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    df = reader.load(folder).where(~F.col("path").rlike(r"/\.[^/]+/"))
    name = F.substring_index("path", "/", -1)
    return df.select("path", name.alias("name"), F.lower(F.substring_index(name, ".", -1)).alias("ext"), F.col("modificationTime").alias("modified"), "length", "content", F.sha2("content", 256).alias("fingerprint"), content_type(name).alias("content_type"))


def with_sidecars(files: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """files with meta, the parsed '<file>.meta.json' beside each; an unknown field or broken JSON fails the read."""
    side = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.meta.json").load(folder)
    text = F.col("content").cast("string")
    known = {c.split()[0] for c in SIDECAR.split(", ")}
    odd = F.array_except(F.json_object_keys(text), F.array(*[F.lit(k) for k in sorted(known)]))
    meta = F.when(F.json_object_keys(text).isNull() | (F.size(odd) > 0), F.raise_error(F.concat(F.lit("sidecar with unknown fields or broken: "), F.col("path")))).otherwise(F.from_json(text, SIDECAR))
    side = side.select(F.regexp_replace("path", r"\.meta\.json$", "").alias("path"), meta.alias("meta"))
    return files.join(side, "path", "left")


def filled(meta: Column, base: Column) -> Column:
    """The sidecar's value unless empty, else the file's."""
    return F.coalesce(F.nullif(F.trim(meta), F.lit("")), base)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """A retrieval golden set (a JSON array), checked: unique ids, questions present, expectations unless abstaining."""
    df = spark.read.schema(GOLDEN).option("multiLine", True).option("mode", "FAILFAST").json(path)
    lacking = ~F.coalesce("expect_abstain", F.lit(False)) & (F.size(F.filter(F.coalesce("expected", F.array().cast("array<struct<doc_number:string,segments:array<string>>>")), lambda e: e["doc_number"] != "")) < 1)
    bad = df.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.coalesce("question", F.lit("")) == "").alias("q"), F.count_if(lacking).alias("e")).first()
    if not bad["n"] or bad["ids"] < bad["n"] or bad["q"] or bad["e"]:
        raise ValueError(f"golden set: {bad['n']} cases, {bad['ids']} ids, {bad['q']} without question, {bad['e']} without expectation")
    return df


def new_blobs(contents: DataFrame, stored: DataFrame) -> DataFrame:
    """Contents (content) under their key, first two digits as folder, that aren't stored (key) yet; one row per key."""
    digest = F.sha2("content", 256)
    keyed = contents.select(F.concat(F.substring(digest, 1, 2), F.lit("/"), digest).alias("key"), "content")
    return keyed.groupBy("key").agg(F.any_value("content").alias("content")).join(stored.select("key"), "key", "left_anti")


def report_documents(findings: DataFrame, limit: int = 100) -> DataFrame:
    """Findings as documents of the reports corpus, the newest first."""
    title = F.concat_ws(" ", F.initcap("kind"), F.lit("finding"), F.col("dedup_key"))
    return findings.orderBy(F.desc("detected_at"), "dedup_key").limit(limit).select(F.col("dedup_key").alias("external_id"), title.alias("title"), F.to_json(F.struct(*findings.columns)).alias("body"), F.col("detected_at").alias("issued"))
