"""Pure transforms of the record sources: feeds, list pages, file choices, numbers.

Fetching is not the engine's business: pages and responses come as rows (a URL and its content), from files or from a caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from normloom.functions.text import fold_marks

#: A document number inside running text: 12/2024/TT-ABC and the like.
NUMBER = r"([0-9]+(?:/[0-9]{4})?/[A-ZĐ]+(?:[0-9]*-[A-ZĐ0-9]+)*)"


def document_number(text: Column) -> Column:
    """The first document number of a text, upper case, without outer punctuation; null where there is none."""
    found = F.regexp_extract(F.upper(F.regexp_replace(text, r"\s*([/-])\s*", "$1")), NUMBER, 1)
    return F.nullif(F.trim(found, F.lit(".,;:-/ ")), F.lit(""))


FEED = T.StructType([T.StructField("item", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("title", "link", "guid", "pubDate", "description")])))])


def feed_items(pages: DataFrame, xml: str = "content") -> DataFrame:
    """One row per item of RSS pages: title, link, guid, published (timestamp), description, number."""
    channel = F.regexp_extract(F.col(xml), r"(?s)(<channel>.*</channel>)", 1)
    items = pages.withColumn("c", F.from_xml(channel, FEED)).select(*[c for c in pages.columns if c != xml], F.explode("c.item").alias("i"))
    published = F.try_to_timestamp(F.regexp_replace("i.pubDate", r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return items.select(*[c for c in pages.columns if c != xml], "i.title", "i.link", "i.guid", published.alias("published"), "i.description", document_number(F.col("i.title")).alias("number"))


def table_rows(pages: DataFrame, html: str = "content") -> DataFrame:
    """One row per table row of HTML list pages: the cells' texts, the first link and the first date (d MMM yyyy or d/M/yyyy)."""
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("row_no", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " ")))
    link = F.nullif(F.regexp_extract("row", r"(?is)<a[^>]+href=[\"']([^\"']+)[\"']", 1), F.lit(""))
    text = F.regexp_replace("row", r"<[^>]+>", " ")
    date = F.coalesce(
        F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2} [A-Z][a-z]{2} \d{4})", 1), F.lit("d MMM yyyy")), F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("d/M/yyyy"))
    )
    return rows.withColumns({"cells": cells, "link": link, "dated": date.cast("date")}).where(F.size("cells") > 0).drop("row")


def anchors(pages: DataFrame, html: str = "content", key: str = "guid", pattern: str = r"[?&]id=([0-9A-Fa-f-]{8,})") -> DataFrame:
    """One row per distinct key in the links of section pages: key, link, title; the first in page and text order."""
    found = F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<a[^>]+href=[\"'][^\"']+[\"'][^>]*>.*?</a>)"), F.lit(1))).alias("at", "a")
    rows = pages.withColumn("page_no", F.monotonically_increasing_id()).select("page_no", found)
    rows = rows.select("page_no", "at", F.regexp_extract("a", r"(?i)href=[\"']([^\"']+)", 1).alias("link"), F.trim(F.regexp_replace("a", r"<[^>]+>", "")).alias("title"))
    rows = rows.withColumn(key, F.regexp_extract("link", pattern, 1)).where(F.col(key) != "")
    return rows.groupBy(key).agg(F.min(F.struct("page_no", "at", "link", "title")).alias("f")).select(key, "f.link", "f.title")


#: What the names of appendices hold, without accents.
APPENDIX_NAMES = ("phu luc", "phuluc", "bieu mau", "bieumau", "mau so", "danh muc", "ban hanh kem theo", "dinh kem")
#: The order in which kinds of files and text formats are preferred.
FILE_KINDS = ("main", "appendix", "attachment", "version_snapshot", "original_scan")
TEXT_FORMATS = ("docx", "doc")


def file_kind(name: Column, ext: Column) -> Column:
    """appendix by its name (compared without accents), original_scan for another PDF, else main."""
    plain = fold_marks(name)
    named = F.lit(False)
    for word in APPENDIX_NAMES:
        named = named | plain.contains(word)
    return F.when(named, "appendix").when(ext == "pdf", "original_scan").otherwise("main")


def preferred_files(files: Column) -> Column:
    """The files to keep of an array of struct(name, url), as struct(name, url, ext, kind): those with a URL that are DOCX, DOC or PDF;
    texts before PDFs, then by kind, texts also by format; equal ones stay in order."""

    def described(f: Column, i: Column) -> Column:
        ext = F.lower(F.regexp_extract(f["name"], r"\.([A-Za-z0-9]+)\s*$", 1))
        kind = file_kind(f["name"], ext)
        rank = lambda c, values: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), c), F.lit(0)), F.lit(99))
        pdf = ext == "pdf"
        return F.struct(pdf.cast("int").alias("a"), rank(kind, FILE_KINDS).alias("b"), F.when(pdf, 0).otherwise(rank(ext, TEXT_FORMATS)).alias("c"), i.alias("i"), f["name"].alias("name"), f["url"].alias("url"), ext.alias("ext"), kind.alias("kind"))

    usable = F.filter(F.transform(files, described), lambda f: (F.trim(f["url"]) != "") & f["ext"].isin("docx", "doc", "pdf"))
    return F.transform(F.array_sort(usable), lambda f: F.struct(f["name"], f["url"], f["ext"], f["kind"]))


def best_file(files: Column) -> Column:
    """The first of the preferred files; null where there is none."""
    return F.get(preferred_files(files), 0)


def since(records: DataFrame, watermark: Column, keyword: str = "") -> DataFrame:
    """Records issued after the watermark, undated ones too, that hold the keyword in number or title."""
    out = records.where(F.col("issued").isNull() | (F.col("issued") > watermark))
    return out.where(F.lower(F.concat_ws(" ", "number", "title")).contains(keyword.lower())) if keyword else out


# --- the sources' own codes ---------------------------------------------------------------------------------------------

#: The law portal's codes of relations.
RELATION_CODES = {3: "legal_basis", 10: "amends_supplements", 12: "replaces"}
#: The gazette's slugs of document types, a longer one before its beginning, and abbreviations with letters that slugs don't have.
SLUG_TYPES = {
    "van-ban-hop-nhat": "Văn bản hợp nhất", "nghi-quyet": "Nghị quyết", "nghi-dinh": "Nghị định", "quyet-dinh": "Quyết định", "thong-tu-lien-tich": "Thông tư liên tịch", "thong-tu": "Thông tư", "chi-thi": "Chỉ thị",
    "cong-van": "Công văn", "cong-dien": "Công điện", "phap-lenh": "Pháp lệnh", "sac-lenh": "Sắc lệnh", "lenh": "Lệnh", "luat": "Luật", "hien-phap": "Hiến pháp", "thong-bao": "Thông báo", "ke-hoach": "Kế hoạch",
    "quy-dinh": "Quy định", "quy-che": "Quy chế",
}
SLUG_CODES = {"qd": "QĐ", "nd": "NĐ"}


def relation_label(code: Column) -> Column:
    """The label of a relation code; unknown codes get one of their own."""
    out = F.when(F.lit(False), F.lit(""))
    for number, label in RELATION_CODES.items():
        out = out.when(code == number, F.lit(label))
    return F.when(code.isNotNull(), out.otherwise(F.concat(F.lit("vbpl_type_"), code.cast("string"))))


def slug_parts(url: Column) -> Column:
    """struct(id, slug) of a detail page: the number before '.htm' at the end, null without one, and the rest of the last path element."""
    last = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), r"([^/]*)$", 1)
    number = F.nullif(F.regexp_extract(last, r"-(\d+)\.htm$", 1), F.lit(""))
    return F.struct(number.alias("id"), F.when(number.isNull(), F.regexp_replace(last, r"\.htm$", "")).otherwise(F.regexp_replace(last, r"-\d+\.htm$", "")).alias("slug"))


def slug_number(slug: Column) -> Column:
    """struct(number, doc_type) that a gazette slug states: the type by its beginning; the number behind '-so-', else behind the type: sequence, year where there is one,
    and code, joined by '/'. Empty values are null."""
    clean = F.lower(F.trim(slug))
    kind, behind = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for prefix, name in SLUG_TYPES.items():
        hit = clean.rlike(f"^{prefix}(-|$)")
        kind, behind = kind.when(hit, F.lit(name)), behind.when(hit, F.regexp_replace(clean, f"^{prefix}-?", ""))
    rest = F.when(clean.contains("-so-"), F.regexp_replace(clean, "^.*?-so-", "")).otherwise(F.coalesce(behind, clean))
    parts = F.filter(F.split(F.regexp_replace(rest, "^-+|-+$", ""), "-"), lambda p: F.lit(True))
    upper = lambda p: F.when(p == "qd", SLUG_CODES["qd"]).when(p == "nd", SLUG_CODES["nd"]).otherwise(F.upper(p))
    dated = F.coalesce(F.get(parts, 1).rlike(r"^(19|20)\d\d$"), F.lit(False))
    tail = F.array_join(F.transform(F.slice(parts, F.when(dated, 3).otherwise(2), F.greatest(F.size(parts), F.lit(1))), upper), "-")
    number = F.concat_ws("/", upper(F.get(parts, 0)), F.when(dated, F.get(parts, 1)), F.nullif(tail, F.lit("")))
    return F.struct(F.nullif(number, F.lit("")).alias("number"), kind.alias("doc_type"))


ACT_PAGE = "struct<recordsTotal:int,records:array<struct<lgt_act_id:string,lgt_act_no:string,title:string,doc2downloadgeneratepdf:string>>>"
ACT_FILES = "array<struct<path:string,docName:string,icon:string>>"


def act_records(pages: DataFrame, base_url: str, body: str = "content") -> DataFrame:
    """One row per act of the act list's JSON pages: external_id, number ('Act 12'), title (of the English link, without the mark of a revision), issued (the date
    as at which it was reprinted), detail_url and file (struct(name, url) of the English reprint, null without one). Broken pages and acts without an id give no rows."""
    records = pages.select(F.explode(F.from_json(body, ACT_PAGE)["records"]).alias("r")).where("r.lgt_act_id <> ''")
    base = base_url.rstrip("/")
    link = F.regexp_extract("r.title", r'(?is)<a[^>]*\bact=\d+&lang=BI[^"]*">(.*?)</a>', 1)
    title = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(link, r"(?s)<[^>]+>", " "), r"\s+", " ")), r"^[* ]+", "")
    dated = F.try_to_timestamp(F.regexp_extract("r.title", r"(?is)As At\s*</i>\s*<i>\s*(\d{2}-\d{2}-\d{4})", 1), F.lit("dd-MM-yyyy")).cast("date")
    english = F.get(F.filter(F.from_json("r.doc2downloadgeneratepdf", ACT_FILES), lambda f: f["path"].contains("_BI/") | f["icon"].contains("-en-")), 0)
    escaped = F.replace(F.url_encode(english["docName"]), F.lit("+"), F.lit("%20"))
    file = F.when(english.isNotNull(), F.struct(english["docName"].alias("name"), F.concat(F.lit(f"{base}/ilims"), english["path"], escaped).alias("url")))
    return records.select(
        F.col("r.lgt_act_id").alias("external_id"), F.concat(F.lit("Act "), F.coalesce("r.lgt_act_no", F.lit(""))).alias("number"), title.alias("title"), dated.alias("issued"),
        F.concat(F.lit(f"{base}/act-detail.php?act="), "r.lgt_act_id", F.lit("&lang=BI")).alias("detail_url"), file.alias("file"),
    )


PORTAL_PAGE = (
    "struct<id:string,docNum:string,title:string,docAbs:string,docType:struct<name:string,code:string>,agencyName:string,effStatus:struct<name:string,code:string>,"
    "issueDate:string,effFrom:string,effTo:string,hasContent:boolean,isConsolidatedDocument:boolean>"
)


def portal_records(pages: DataFrame, body: str = "content") -> DataFrame:
    """One row per document of the law portal's list pages (a JSON array each): external_id, number, title, abstract, doc_type, issuer, status (the code), issued, effective, expires (dates; other
    writings are null), has_content, consolidated. Broken pages give no rows; of a document on several pages the rows stay."""
    each = pages.select(F.explode(F.from_json(body, f"array<{PORTAL_PAGE}>")).alias("r")).where("r.id <> ''")
    day = lambda c: F.left(F.col(f"r.{c}"), F.lit(10)).try_cast("date")
    return each.select(
        F.col("r.id").alias("external_id"), F.col("r.docNum").alias("number"), "r.title", F.col("r.docAbs").alias("abstract"), F.col("r.docType.name").alias("doc_type"), F.col("r.agencyName").alias("issuer"),
        F.col("r.effStatus.code").alias("status"), day("issueDate").alias("issued"), day("effFrom").alias("effective"), day("effTo").alias("expires"), F.col("r.hasContent").alias("has_content"), F.col("r.isConsolidatedDocument").alias("consolidated"),
    )
