"""Queries of the general training-data problems (1, 4 and 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normloom.operators import hierarchy, history, instants
from normloom.plans.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf, "graph_edge"), with_path=False).select("node", "root", "depth")


def p1_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Every node with its path from the root (ids joined by ' > '), root, depth and number of descendants."""
    tree = hierarchy.with_descendant_counts(hierarchy.hierarchy(table(spark, sf, "graph_edge")))
    return tree.select("node", "root", "depth", F.array_join("path", " > ").alias("path"), "n_descendants")


def p1_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendant_pairs(hierarchy.hierarchy(table(spark, sf, "graph_edge")))


def _written_dates(spark: SparkSession, sf: str) -> DataFrame:
    def fields(name: str, key: str, cols: list[str]) -> DataFrame:
        df = table(spark, sf, name)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in cols])).alias("x")
        return df.select(F.lit(name).alias("src_table"), F.col(key).alias("rec_key"), "tz_hint", each).select("src_table", "rec_key", "tz_hint", "x.*")

    both = fields("search_item", "item_id", ["ngay_ban_hanh", "ngay_co_hieu_luc"]).unionByName(fields("doc_item", "rec_id", ["issuedate", "efffrom"]))
    return both.withColumn("source", F.concat_ws(".", "src_table", "field_name"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    out = instants.to_instants(_written_dates(spark, sf)).where("utc_micros is not null")
    return out.select("src_table", "rec_key", "field_name", instants.iso_utc(F.col("utc_micros")).alias("utc_ts"))


def p4_formats(spark: SparkSession, sf: str) -> DataFrame:
    """What each source writes, judged by its own mixture alone (no day-first rule): values by format and status."""
    out = instants.to_instants(_written_dates(spark, sf), day_first=False)
    return out.groupBy("src_table", "field_name", "fmt", "status").agg(F.count("*").alias("n_values"), F.round(F.min("posterior"), 6).alias("least_posterior"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    out = history.versions(table(spark, sf, "document_envelope"), "id", ["validity_status"], ["effective_date", "expiry_date"])
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select(F.col("id").alias("document_id"), "version_no", text("valid_from").alias("valid_from"), F.coalesce(text("valid_to"), F.lit("")).alias("valid_to"))


def p6_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The versions with their attributes."""
    return history.versions(table(spark, sf, "document_envelope"), "id", ["validity_status"], ["effective_date", "expiry_date"]).withColumnRenamed("id", "document_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_hierarchy, p1_descendants, p4_found, p4_formats, p6_found, p6_versions)}


_TREE = """
WITH RECURSIVE links AS (
  SELECT source AS child, min(target) AS parent FROM graph_edge
  WHERE lower(trim(edge_type)) = 'derives' AND source IS NOT NULL GROUP BY 1),
real_links AS (SELECT * FROM links WHERE parent IS NOT NULL),
nodes AS (SELECT child AS node FROM links UNION SELECT parent FROM real_links),
tree AS (
  SELECT node, node AS root, 0 AS depth, [node] AS path FROM nodes WHERE node NOT IN (SELECT child FROM real_links)
  UNION ALL
  SELECT l.child, t.root, t.depth + 1, list_append(t.path, l.child) FROM tree t JOIN real_links l ON l.parent = t.node),
stuck AS (SELECT child AS node, parent FROM real_links WHERE child NOT IN (SELECT node FROM tree)),
above AS (SELECT node AS start, parent AS pos FROM stuck UNION SELECT a.start, s.parent FROM above a JOIN stuck s ON s.node = a.pos),
low AS (
  SELECT a.start AS node, min(a.pos) AS root FROM above a
  WHERE a.pos IN (SELECT start FROM above WHERE start = pos) GROUP BY 1)
"""

_SNAPS = """
WITH ranked AS (
  SELECT id, observed_at, lower(trim(validity_status)) AS st, nullif(trim(effective_date), '') AS ef, nullif(trim(expiry_date), '') AS ex,
    row_number() OVER (PARTITION BY id, observed_at ORDER BY loaded_at DESC NULLS LAST, lower(trim(validity_status)) DESC NULLS LAST,
      nullif(trim(effective_date), '') DESC NULLS LAST, nullif(trim(expiry_date), '') DESC NULLS LAST) AS r
  FROM document_envelope WHERE id IS NOT NULL AND observed_at IS NOT NULL),
marked AS (
  SELECT *, row_number() OVER w = 1 OR st IS DISTINCT FROM lag(st) OVER w OR ef IS DISTINCT FROM lag(ef) OVER w OR ex IS DISTINCT FROM lag(ex) OVER w AS begins
  FROM ranked WHERE r = 1 WINDOW w AS (PARTITION BY id ORDER BY observed_at)),
v AS (
  SELECT *, row_number() OVER w AS n, lead(observed_at) OVER w AS ends
  FROM marked WHERE begins WINDOW w AS (PARTITION BY id ORDER BY observed_at))
"""


#: The written forms as strptime lists, for the SQL side.
_FORMS = (
    "%Y-%m-%dT%H:%M:%S.%f %Y-%m-%dT%H:%M:%S %Y-%m-%dT%H:%M %Y-%m-%d_%H:%M:%S.%f %Y-%m-%d_%H:%M:%S %Y-%m-%d_%H:%M %Y-%m-%d %d/%m/%Y_%H:%M:%S %d/%m/%Y_%H:%M %d/%m/%Y_%I:%M_%p %d/%m/%Y %d.%m.%Y %d-%m-%Y "
    "%b_%d,_%Y_%I:%M_%p %b_%d,_%Y_%H:%M:%S %b_%d,_%Y %B_%d,_%Y %d_%B_%Y_%H:%M:%S %d_%b_%Y_%H:%M:%S %d_%B_%Y %d_%b_%Y ngày_%d_tháng_%m_năm_%Y Ngày_%d_tháng_%m_năm_%Y %H_giờ_%M_ngày_%d/%m/%Y"
).split()
_FORM_LIST = "[" + ", ".join("'" + f.replace("_", " ") + "'" for f in _FORMS) + "]"
_ZONE = r"(Z|(?:GMT|UTC)(?:[+-]\d{1,2}(?::?\d{2})?)?|[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]+/[A-Za-z0-9_/+-]+)$"
_WRITTEN = " UNION ALL ".join(f"SELECT '{t}' AS src_table, {k} AS rec_key, '{c}' AS field_name, {c} AS value, tz_hint FROM {t}" for t, k, cs in (("search_item", "item_id", ("ngay_ban_hanh", "ngay_co_hieu_luc")), ("doc_item", "rec_id", ("issuedate", "efffrom"))) for c in cs)
_INSTANTS = f"""
WITH v AS (SELECT *, trim(regexp_replace(value, '[\\s\\x{{A0}}\\x{{3000}}]+', ' ', 'g')) AS t FROM ({_WRITTEN})),
z AS (SELECT *, CASE WHEN regexp_matches(t, '(\\d:\\d\\d|[AP]M|\\d [A-Za-z]+/\\S+$)') THEN regexp_extract(t, '(?:\\d| )' || '{_ZONE}', 1) ELSE '' END AS zone FROM v),
b AS (SELECT *, trim(left(t, length(t) - length(zone))) AS body, nullif(regexp_extract(zone, '[+-]\\d.*$'), '') AS shift, CASE WHEN contains(zone, '/') THEN zone END AS named FROM z),
w AS (SELECT *, CASE WHEN regexp_full_match(t, '\\d{{8}}') THEN try_strptime(t, '%Y%m%d') WHEN NOT regexp_full_match(t, '\\d+') THEN try_strptime(body, {_FORM_LIST}) END AS wall,
  CASE WHEN regexp_full_match(t, '\\d{{9,10}}') THEN make_timestamp(t::BIGINT * 1000000) WHEN regexp_full_match(t, '\\d{{12,13}}') THEN make_timestamp(t::BIGINT * 1000) END AS epoch,
  coalesce(named, (SELECT name FROM pg_timezone_names() WHERE name = trim(tz_hint)), 'Asia/Ho_Chi_Minh') AS place FROM b),
i AS (SELECT *, CASE WHEN epoch IS NOT NULL THEN epoch WHEN zone IN ('Z', 'GMT', 'UTC') THEN wall
    WHEN shift IS NOT NULL THEN wall - (CASE WHEN shift[1] = '-' THEN -1 ELSE 1 END) * (regexp_extract(shift, '^.(\\d{{1,2}})', 1)::INT * INTERVAL 1 HOUR + coalesce(try_cast(regexp_extract(shift, '^.\\d{{1,2}}:?(\\d{{2}})$', 1) AS INT), 0) * INTERVAL 1 MINUTE)
    ELSE timezone('UTC', timezone(place, wall)) END AS first, zone = '' OR named IS NOT NULL AS local FROM w),
r AS (SELECT *, CASE WHEN epoch IS NULL AND local AND timezone(place, timezone('UTC', first - INTERVAL 1 HOUR)) = wall THEN first - INTERVAL 1 HOUR ELSE first END AS utc FROM i)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"{_INSTANTS} SELECT src_table, rec_key, field_name, strftime(utc, '%Y-%m-%dT%H:%M:%S.%fZ') AS utc_ts FROM r WHERE utc IS NOT NULL",
        "p1_found": f"{_TREE} SELECT node, root, CAST(depth AS INTEGER) AS depth FROM tree UNION ALL SELECT node, root, -1 FROM low",
        "p1_hierarchy": f"""{_TREE}, counts AS (SELECT a AS node, count(*) AS n FROM (SELECT unnest(list_slice(path, 1, depth)) AS a FROM tree WHERE depth > 0) GROUP BY 1)
            SELECT t.node, t.root, CAST(t.depth AS INTEGER) AS depth, array_to_string(t.path, ' > ') AS path, coalesce(c.n, 0) AS n_descendants FROM tree t LEFT JOIN counts c USING (node)
            UNION ALL SELECT node, root, -1, NULL, NULL FROM low""",
        "p1_descendants": f"{_TREE} SELECT path[i] AS ancestor, node, CAST(depth + 1 - i AS INTEGER) AS steps FROM (SELECT node, depth, path, unnest(range(1, depth + 1)) AS i FROM tree WHERE depth > 0)",
        "p6_found": f"""{_SNAPS} SELECT id AS document_id, CAST(n AS INTEGER) AS version_no, strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS valid_from,
            coalesce(strftime(ends, '%Y-%m-%d %H:%M:%S'), '') AS valid_to FROM v""",
        "p6_versions": f"{_SNAPS} SELECT id AS document_id, CAST(n AS INTEGER) AS version_no, st AS validity_status, ef AS effective_date, ex AS expiry_date, observed_at AS valid_from, ends AS valid_to FROM v",
    }
