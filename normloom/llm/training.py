"""Queries of the problems on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.llm import lookalikes, matching, mixing, pii, split, tokens
from normloom.operators import instants
from normloom.plans.session import table


def _numbers_and_titles(spark: SparkSession, sf: str) -> DataFrame:
    search, doc = table(spark, sf, "search_item"), table(spark, sf, "doc_item")
    field = lambda df, name, key, col: df.select(F.lit(name).alias("field_name"), F.col(key).alias("id"), F.col(col).alias("value"))
    return (
        field(search, "number", "item_id", "so_ky_hieu").unionByName(field(doc, "number", "rec_id", "docnum")).unionByName(field(search, "title", "item_id", "tieu_de"))
    )


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalikes.lookalike_pairs(_numbers_and_titles(spark, sf))


def p2_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every number and title in its consistent form."""
    return lookalikes.with_canonical(_numbers_and_titles(spark, sf), ["value"])


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The rows whose value is spelt in several ways, with the class they form."""
    return lookalikes.lookalike_classes(_numbers_and_titles(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.section_classes(table(spark, sf, "doc_section")).select("section_id", "cut_class")


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_sections(table(spark, sf, "doc_section"))


def p3_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """What the pieces of each section give when they are put together again."""
    out = split.rebuilt(split.split_sections(table(spark, sf, "doc_section")))
    return out.select("section_id", "n_chars", "digest", (F.col("longest") <= 1200).alias("within"), "sound")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"), ["doc_id"])


def p7_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether decoding gives every text back."""
    return tokens.round_trip(table(spark, sf, "documents"), ["doc_id"])


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(tokens.count_tokens(table(spark, sf, "documents"), ["doc_id", "source"]), table(spark, sf, "source_weight"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf)[1]


def p5_matches(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs with their confidence and score. The day of a record is the Vietnamese calendar day of its written date."""
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    search = table(spark, sf, "search_item").select(
        F.lit(0).alias("side"), F.lit("search_item.ngay_ban_hanh").alias("source"), F.col("item_id").alias("rid"), text("id_van_ban").alias("gid"), F.col("so_ky_hieu").alias("number"), F.col("tieu_de").alias("title"),
        F.col("loai_van_ban").alias("kind"), F.col("ten_co_quan").alias("agencies"), F.col("ngay_ban_hanh").alias("value"), "tz_hint",
    )
    doc = table(spark, sf, "doc_item").select(
        F.lit(1).alias("side"), F.lit("doc_item.issuedate").alias("source"), F.col("rec_id").alias("rid"), none.alias("gid"), F.col("docnum").alias("number"), "title",
        F.col("doctype").alias("kind"), F.array("agencyname").alias("agencies"), F.col("issuedate").alias("value"), "tz_hint",
    )
    read = instants.to_instants(search.unionByName(doc))
    read = read.withColumn("day", F.floor((F.col("utc_micros") / 1_000_000 + 7 * 3600) / 86400).cast("int"))
    return matching.match(read.where("side = 0"), read.where("side = 1"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_matches(spark, sf).select("item_id", "rec_id")


#: Keys the pseudonyms of p9_masked; a real run passes its own secret.
DEMO_SECRET = b"normloom demo key"


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.found(table(spark, sf, "documents"), DEMO_SECRET)


def p9_masked(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with typed placeholders in the place of personal information."""
    return pii.masked(table(spark, sf, "documents"), DEMO_SECRET, ["doc_id"])


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of every masked text with its surfaces put back: what is outside the stretches is as it was."""
    docs = table(spark, sf, "documents")
    back = pii.restored(pii.masked(docs, DEMO_SECRET, ["doc_id"]), pii.spans(docs, DEMO_SECRET))
    return back.select("doc_id", F.md5("text").alias("digest"))


def p9_links(spark: SparkSession, sf: str) -> DataFrame:
    """Per type the stretches, and how many break the rules: placeholders that stand for different values, values whose placeholders differ,
    numbers that change their written shape. A value is its digits, or its letters without case, blanks and bracketed signs."""
    rows = pii.spans(table(spark, sf, "documents"), DEMO_SECRET)
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    inside = F.regexp_extract("placeholder", r"^\[[A-Z_]+:(.*)\]$", 1)
    number = F.col("pii_type").isin("phone", "id_number") & F.col("surface").rlike(r"\d{6}|\d.*\d.*\d.*\d.*\d.*\d")
    plain = F.lower(F.regexp_replace("surface", r"\s+", " "))
    rows = rows.select("pii_type", F.when(number, F.regexp_replace("surface", r"\d", "0")).alias("shape"), F.when(number, digits("surface")).otherwise(plain).alias("value"), F.when(number, digits(inside)).otherwise(inside).alias("code"), F.when(number, F.regexp_replace(inside, r"\d", "0")).alias("coded_shape"))
    pairs = rows.groupBy("pii_type", "value", "code").agg(F.count("*").alias("n"), F.count_if(~F.col("shape").eqNullSafe(F.col("coded_shape"))).alias("n_shape"))
    per = lambda c: pairs.groupBy("pii_type", c).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("n_shape").alias("n_shape")).groupBy("pii_type").agg(F.sum("n").alias("n"), F.count_if(F.col("k") > 1).alias(f"{c}_twice"), F.sum("n_shape").alias("n_shape"))
    return per("value").drop("n").join(per("code").drop("n", "n_shape"), "pii_type").select("pii_type", "value_twice", "code_twice", "n_shape")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_canonical, p2_classes, p3_found, p3_pieces, p3_rebuilt, p5_found, p5_matches, p9_found, p9_masked, p9_restored, p9_links, p7_ids, p7_round_trip, p8_mix, p8_shares)}


def oracle_sql() -> dict[str, str]:
    values = """SELECT 'number' AS field_name, item_id AS id, so_ky_hieu AS value FROM search_item UNION ALL
        SELECT 'number', rec_id, docnum FROM doc_item UNION ALL SELECT 'title', item_id, tieu_de FROM search_item"""
    # The consistent form, stated on its own: the characters that the tables hold beyond plain Latin and Vietnamese ones.
    wide = "".join(f" || chr({0xFEE0 + c})" for c in range(0x21, 0x7F))
    plain = "".join(f" || chr({c})" for c in range(0x21, 0x7F))
    letters = ("АВЕЅІЈКМНОРСТХҮасеорхуѕіјһԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳνՕօÐƉɡ‐‑⁃−⁄∕⧸․꞉∶", "ABESIJKMHOPCTXYaceopxysijhdqwlABEZHIKMNOPTYXocjvOoĐĐg----///.::")
    accented = ("ЀЁЇѐёїΆΈΊΌΎό", "ÈËÏèëïÁÉÍÓÝó")
    hidden = r"[\x{AD}\x{34F}\x{61C}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"
    blank = r"[\t\n\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    form = f"nfc_normalize(translate(regexp_replace(regexp_replace(value, '{hidden}', '', 'g'), '{blank}', ' ', 'g'), ''{wide} || '{letters[0]}{accented[0]}', ''{plain} || '{letters[1]}{accented[1]}'))"
    brk = r"\r\n|[\n\r\v\f\x{85}\x{2028}\x{2029}]|([.;:!?])[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return {
        "p9_restored": "SELECT doc_id, md5(text) AS digest FROM documents",
        "p2_found": f"""WITH f AS (SELECT *, {form} AS form FROM ({values}) WHERE value <> '')
            SELECT a.field_name, a.id AS id_a, b.id AS id_b FROM f a JOIN f b USING (field_name, form) WHERE a.id < b.id AND a.value <> b.value""",
        "p2_classes": f"""WITH f AS (SELECT *, {form} AS form FROM ({values}) WHERE value <> ''), c AS (SELECT field_name, form, min(id) AS class_id, count(DISTINCT value) AS n_spellings FROM f GROUP BY 1, 2)
            SELECT field_name, id, class_id, n_spellings FROM f JOIN c USING (field_name, form) WHERE n_spellings > 1""",
        "p2_canonical": f"SELECT *, {form} AS value_canonical FROM ({values})",
        "p3_rebuilt": """SELECT id AS section_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest, true AS within, true AS sound FROM (
            SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY length(text) DESC, md5(text) DESC) AS r FROM doc_section WHERE length(text) > 1200 AND id IS NOT NULL) WHERE r = 1""",
        "p3_found": f"""WITH s AS (SELECT id, arg_max(text, (length(text), md5(text))) AS text FROM doc_section WHERE length(text) > 1200 AND id IS NOT NULL GROUP BY id)
            SELECT id AS section_id, CASE WHEN list_max(list_transform(string_split(regexp_replace(text, '{brk}', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x))) > 1200
              THEN 'forced' ELSE 'natural' END AS cut_class FROM s""",
    }
