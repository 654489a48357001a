"""Queries of the engine's own operators and the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from normloom.functions import text as X
from normloom.functions import tiers, vectors
from normloom.functions import validity as V
from normloom.operators import detect, evals, findings, graph, ingest, parsing, process, reports, search
from normloom.operators import validity as fold
from normloom.plans import domain as D
from normloom.plans.session import Scratch, table
from normloom.sources import records

QUERIES: dict = {}
SQLS: dict[str, str] = {}
NOW = "TIMESTAMP '2024-01-16 00:00:00'"
MOMENT = "DATE '2024-06-01'"
WORDS = "hồ sơ or records -phê"
VECTOR_ID = 0


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query under its function's name; sql follows the domain's common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQLS[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{D.SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return add


def _vector(spark: SparkSession, sf: str) -> Column:
    """The query's embedding: one row by key, as a scalar subquery, so that it is read when the query runs."""
    return table(spark, sf, "embeddings").where(F.col("vec_id") == VECTOR_ID).select("embedding").scalar()


_QV = f"(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {VECTOR_ID})"
_DIST = f"list_cosine_distance(embedding, {_QV})"
_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
#: 'hồ sơ or records -phê': hồ AND (sơ OR records) AND NOT phê, since or joins only its neighbours.
_QMATCH = "list_contains(w, 'hồ') AND (list_contains(w, 'sơ') OR list_contains(w, 'records')) AND NOT list_contains(w, 'phê')"
#: The query's requirements: 'hồ' and ('sơ' or 'records'), without 'phê'.
_G1, _G2 = "('hồ')", "('sơ', 'records')"


def _sql_lexical(source: str) -> str:
    """Common table expressions that end in lex (corpus_id, section_id, lexical): the cover density of the rows of source that match."""
    places = lambda g, k: f"max(CASE WHEN tok IN {g} THEN pos END) OVER p AS pos{k}, max(CASE WHEN tok IN {g} THEN no END) OVER p AS no{k}"
    return f"""lw AS (SELECT corpus_id, section_id, w FROM (SELECT corpus_id, section_id, {_TOKENS} AS w FROM {source}) WHERE {_QMATCH}),
lt AS (SELECT corpus_id, section_id, unnest(w) AS tok, unnest(range(len(w))) AS pos FROM lw),
ln AS (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY pos) AS no FROM lt WHERE tok IN {_G1} OR tok IN {_G2}),
lp AS (SELECT *, {places(_G1, 1)}, {places(_G2, 2)} FROM ln WINDOW p AS (PARTITION BY section_id ORDER BY pos)),
ls AS (SELECT corpus_id, section_id, pos, no, least(pos1, pos2) AS st, least(no1, no2) AS sn FROM lp WHERE pos1 IS NOT NULL AND pos2 IS NOT NULL),
lc AS (SELECT *, lag(st) OVER (PARTITION BY section_id ORDER BY pos) AS prev FROM ls),
lex AS (SELECT lw.corpus_id, lw.section_id, round(coalesce(sum(0.1::DOUBLE / (1 + (pos - st) - (no - sn))) FILTER (WHERE prev IS NULL OR st > prev), 0), 9) AS lexical FROM lw LEFT JOIN lc USING (section_id) GROUP BY 1, 2)"""


def _sql_hybrid(where: str, k: int = 10) -> str:
    """The hybrid search over corp rows that hold the condition."""
    return f""", base AS (SELECT * FROM corp WHERE {where}),
v AS (SELECT * FROM (SELECT corpus_id, section_id, row_number() OVER (PARTITION BY corpus_id ORDER BY {_DIST}, section_id) AS rank_v FROM base WHERE embedding IS NOT NULL) WHERE rank_v <= {k}),
{_sql_lexical("base")},
l AS (SELECT * FROM (SELECT corpus_id, section_id, row_number() OVER (PARTITION BY corpus_id ORDER BY lexical DESC, section_id) AS rank_l FROM lex) WHERE rank_l <= {k}),
f AS (SELECT corpus_id, section_id, rank_v, rank_l, round(coalesce(1.0::DOUBLE / (60 + rank_v), 0) + coalesce(1.0::DOUBLE / (60 + rank_l), 0), 9) AS score FROM v FULL JOIN l USING (corpus_id, section_id)),
g AS (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY score DESC, section_id) AS place FROM f)
SELECT corpus_id, section_id, rank_v, rank_l, score FROM g WHERE place <= {k} ORDER BY score DESC, corpus_id, section_id LIMIT {k}"""




# --- search ---------------------------------------------------------------------------------------------------------


@query(f"SELECT corpus_id, section_id, round(distance, 6) AS distance, rank_v FROM (SELECT corpus_id, section_id, {_DIST} AS distance, row_number() OVER (PARTITION BY corpus_id ORDER BY {_DIST}, section_id) AS rank_v FROM corp WHERE embedding IS NOT NULL) WHERE rank_v <= 10")
def vector_topk(spark, sf):
    top = vectors.top_k(D.corpus(spark, sf).select("corpus_id", "section_id", "embedding"), _vector(spark, sf), 10, "corpus_id", "section_id")
    return top.select("corpus_id", "section_id", F.round("distance", 6).alias("distance"), "rank_v")


@query(f"SELECT corpus_id, section_id, len(w) AS n_tokens FROM (SELECT corpus_id, section_id, {_TOKENS} AS w FROM corp) WHERE {_QMATCH}")
def lexical_match(spark, sf):
    w = D.corpus(spark, sf).select("corpus_id", "section_id", X.tokens(F.col("text")).alias("w"))
    return w.where(X.query_predicate(WORDS, F.col("w"))).select("corpus_id", "section_id", F.size("w").cast("bigint").alias("n_tokens"))


@query(f"SELECT corpus_id, count(*) AS n FROM corp WHERE regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}])hồ[^\\p{{L}}\\p{{N}}]+sơ[^\\p{{L}}\\p{{N}}]+tồn([^\\p{{L}}\\p{{N}}]|$)') GROUP BY 1")
def phrase_match(spark, sf):
    w = D.corpus(spark, sf).select("corpus_id", X.tokens(F.col("text")).alias("w"))
    return w.where(X.query_predicate('"hồ sơ tồn"', F.col("w"))).groupBy("corpus_id").agg(F.count("*").alias("n"))


@query(f", {_sql_lexical('corp')} SELECT corpus_id, section_id, lexical, rank_l FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY lexical DESC, section_id) AS rank_l FROM lex) WHERE rank_l <= 10")
def lexical_rank(spark, sf):
    return search.lexical_top_k(D.corpus(spark, sf).select("corpus_id", "section_id", "text"), WORDS, 10, "corpus_id", "section_id").select("corpus_id", "section_id", "lexical", "rank_l")


@query(f", {_sql_lexical('corp')} SELECT corpus_id, section_id, lexical, rank_l FROM (SELECT *, row_number() OVER (PARTITION BY corpus_id ORDER BY lexical DESC, section_id) AS rank_l FROM lex) WHERE rank_l <= 10")
def lexical_postings(spark, sf):
    """lexical_rank over the written postings of the corpus instead of its texts."""
    made = search.lexical_index(D.corpus(spark, sf), "section_id", ["corpus_id"])
    scratch = Scratch(spark, "postings")
    return search.lexical_top_k(scratch.write(made, "postings"), WORDS, 10, "corpus_id", "section_id", postings=True).select("corpus_id", "section_id", "lexical", "rank_l")


@query(_sql_hybrid("true"))
def rrf_hybrid(spark, sf):
    return search.hybrid_search(D.corpus(spark, sf), WORDS, _vector(spark, sf))


@query(_sql_hybrid("validity_status IN ('in_force', 'amended')"))
def search_in_force(spark, sf):
    return search.hybrid_search(D.corpus(spark, sf), WORDS, _vector(spark, sf), where=V.predicate(in_force_only=True))


@query(_sql_hybrid(f"(effective_date IS NULL OR effective_date <= {MOMENT}) AND (expiry_date IS NULL OR expiry_date > {MOMENT})"))
def search_as_of(spark, sf):
    return search.hybrid_search(D.corpus(spark, sf), WORDS, _vector(spark, sf), where=V.predicate(moment=F.expr(MOMENT)))


def _role_search(role: str):
    def run(spark, sf):
        return search.hybrid_search(D.corpus(spark, sf), WORDS, _vector(spark, sf), where=tiers.row_visible(role, F.col("corpus_id"), F.col("access_tier")))

    run.__name__ = f"tier_{role}"
    return run


for _r, _role in enumerate(tiers.ROLES):
    query(_sql_hybrid(D.sql_visible(_r)))(_role_search(_role))


def flagship(spark, sf):
    """Hybrid search over current law that the group role may read, with the bodies of the hits."""
    base = D.corpus(spark, sf)
    where = tiers.row_visible("group", F.col("corpus_id"), F.col("access_tier")) & V.predicate(in_force_only=True)
    hits = search.hybrid_search(base, WORDS, _vector(spark, sf), where=where)
    return search.with_bodies(hits, base.select("section_id", "corpus_id", "text", "doc_number", "access_tier"))


@query(_sql_hybrid(f"{D.sql_visible(1)} AND validity_status IN ('in_force', 'amended')").replace("SELECT corpus_id, section_id, rank_v, rank_l, score FROM g", "SELECT section_id, corpus_id, text, doc_number, CASE WHEN section_id % 11 = 0 THEN 'local-confidential' ELSE " + D.sql_tier("corpus_id") + " END AS access_tier, rank_v, rank_l, score FROM g JOIN (SELECT section_id, text, doc_number FROM corp) USING (section_id)"))
def search_with_bodies(spark, sf):
    return flagship(spark, sf)


@query(f"""SELECT query_id, item_id, distance, place FROM (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 6) AS distance,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(i.embedding AS DOUBLE[])), 9), i.vec_id) AS place FROM embeddings q JOIN embeddings i ON true WHERE q.vec_id % 20 = 0) WHERE place <= 10""")
def vector_multi_query(spark, sf):
    e = table(spark, sf, "embeddings")
    near = search.vector_multi_query(e.select(F.col("vec_id").alias("item_id"), "embedding"), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    return near.withColumn("distance", F.round("distance", 6))


# --- tiers and validity -----------------------------------------------------------------------------------------------


@query(f"SELECT corpus_id, {D.SQL_ROW_TIER} AS access_tier, count(*) FILTER (WHERE {D.sql_visible(0)}) AS n_public, count(*) FILTER (WHERE {D.sql_visible(1)}) AS n_group, count(*) FILTER (WHERE {D.sql_visible(2)}) AS n_local FROM corp GROUP BY 1, 2")
def tier_counts(spark, sf):
    see = lambda r: F.count_if(tiers.row_visible(r, F.col("corpus_id"), F.col("access_tier"))).alias(f"n_{r}")
    return D.corpus(spark, sf, text=False).groupBy("corpus_id", "access_tier").agg(*[see(r) for r in tiers.ROLES])


@query(f"SELECT a.event_id, a.target_id FROM amends a WHERE EXISTS (SELECT 1 FROM corp WHERE section_id = a.target_id AND {D.sql_visible(1)})")
def event_semi_visible(spark, sf):
    seen = D.corpus(spark, sf, text=False).where(tiers.row_visible("group", F.col("corpus_id"), F.col("access_tier"))).select(F.col("section_id").alias("target_id"))
    return D.amendments(spark, sf).join(seen, "target_id", "left_semi").select("event_id", "target_id")


_EDGE_TIER = f"CASE WHEN {D.sql_rank(D.sql_tier(D.sql_node_corpus('source')))} >= {D.sql_rank(D.sql_tier(D.sql_node_corpus('target')))} THEN {D.sql_tier(D.sql_node_corpus('source'))} ELSE {D.sql_tier(D.sql_node_corpus('target'))} END"


def _tiered_edges(spark, sf) -> DataFrame:
    e = D.edges(spark, sf)
    a, b = tiers.corpus_tier(D.node_corpus(F.col("source"))), tiers.corpus_tier(D.node_corpus(F.coalesce("target", F.lit(""))))
    return e.withColumn("access_tier", tiers.stricter_tier(a, b))


@query(f"SELECT access_tier, count(*) AS n FROM (SELECT {_EDGE_TIER} AS access_tier FROM edges) GROUP BY 1")
def stricter_tier_edges(spark, sf):
    return _tiered_edges(spark, sf).groupBy("access_tier").agg(F.count("*").alias("n"))


#: Every status code and relation label with its meaning, as the SQL side states them.
_STATUSES = {
    "in_force": "in_force", "partial": "amended", "expired": "repealed", "suspended": "repealed", "not_yet": "not_yet_effective", "CHL": "in_force", "HHL": "repealed", "HHL1P": "amended", "HHL1PHAN": "amended",
    "CCHL": "not_yet_effective", "TNHL": "not_yet_effective", "CHUACOHIEULUC": "not_yet_effective", "TDHL": "repealed", "PRINCIPAL": "in_force", "REPEALED": "repealed", "Còn hiệu lực": "in_force",
    "Hết hiệu lực một phần": "amended", "Hết hiệu lực": "repealed", "Chưa có hiệu lực": "not_yet_effective", " Tạm dừng hiệu lực ": "repealed",
}
_LABELS = {
    "amends": "amended", "amend": "amended", "amends_supplements": "amended", "corrects": "amended", "correction": "amended", "replaces": "superseded", "replace": "superseded", "supersedes": "superseded", "supersede": "superseded",
    "superseded": "superseded", "repeals": "repealed", "repeal": "repealed", "Abrogates ": "repealed", "abrogate": "repealed", "legal_basis": None, "consolidates": None, "pua": None, "pub": None, "vbpl_type_99": None, "cites": None, "": None,
}
_UNKNOWN = ("amended", "superseded", "bogus", "ngưng hiệu lực", "", "   ")


def _values(pairs) -> str:
    q = lambda v: "NULL" if v is None else "'" + v + "'"
    return "(VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in pairs) + ")"


_BY_DATE = f"CASE WHEN effective_date IS NULL OR effective_date <= {MOMENT} THEN 'in_force' ELSE 'not_yet_effective' END"


@query(f"""SELECT id, raw, coalesce(m.mapped, {_BY_DATE}) AS mapped FROM (SELECT id, status AS raw, effective_date FROM docs UNION ALL SELECT 'code ' || raw, raw, DATE '2030-01-01' FROM {_values([*_STATUSES.items(), *((u, None) for u in _UNKNOWN)])} c(raw, x))
  LEFT JOIN {_values((k.strip().lower(), v) for k, v in _STATUSES.items())} m(code, mapped) ON m.code = lower(trim(raw))""")
def map_validity(spark, sf):
    """Every document's status, and every code that a source writes beside a date in the future."""
    d = D.documents(spark, sf).select("id", F.col("status").alias("raw"), "effective_date")
    codes = spark.createDataFrame([(f"code {c}", c) for c in (*_STATUSES, *_UNKNOWN)], "id string, raw string").withColumn("effective_date", F.expr("DATE '2030-01-01'"))
    return d.unionByName(codes).select("id", "raw", V.map_validity(F.col("raw"), F.col("effective_date"), F.expr(MOMENT)).alias("mapped"))


@query(f"SELECT label, kind, n FROM (SELECT label, count(*) AS n FROM (SELECT label FROM amends UNION ALL SELECT label FROM {_values(_LABELS.items())} v(label, kind)) GROUP BY 1) LEFT JOIN {_values((k.strip().lower(), v) for k, v in _LABELS.items())} m(code, kind) ON m.code = lower(trim(label))")
def event_kind(spark, sf):
    """The labels of the amendments, and every label that a source writes."""
    labels = spark.createDataFrame([(c,) for c in _LABELS], "label string")
    return D.amendments(spark, sf).select("label").unionByName(labels).groupBy("label", V.event_kind(F.col("label")).alias("kind")).agg(F.count("*").alias("n"))


_EV = "ev AS (SELECT *, CASE label WHEN 'amends' THEN 'amended' WHEN 'replaces' THEN 'superseded' WHEN 'repeals' THEN 'repealed' END AS kind FROM amends)"


def _folded(moment: str) -> str:
    return f"""SELECT c.section_id AS id, c.validity_status AS status, coalesce(n, 0) AS n_due, CASE WHEN c.validity_status = 'repealed' OR coalesce(rep, false) THEN 'repealed' ELSE coalesce(last_kind, c.validity_status) END AS folded_status
  FROM corp c LEFT JOIN (SELECT target_id, count(*) AS n, bool_or(kind = 'repealed') AS rep, arg_max(kind, (event_date, event_id)) FILTER (WHERE kind IN ('amended', 'superseded')) AS last_kind
    FROM ev WHERE kind IS NOT NULL AND event_date <= {moment} GROUP BY 1) x ON x.target_id = c.section_id"""


def _base(spark, sf) -> DataFrame:
    return D.corpus(spark, sf, text=False).select(F.col("section_id").alias("id"), F.col("validity_status").alias("status"))


def _events(spark, sf) -> DataFrame:
    return D.amendments(spark, sf).withColumn("kind", V.event_kind(F.col("label")))


@query(f", {_EV} {_folded(NOW)}")
def validity_fold(spark, sf):
    return fold.fold(_base(spark, sf), _events(spark, sf), F.expr(NOW))


@query(f", {_EV}, a AS ({_folded("TIMESTAMP '2024-01-02 00:00:00'")}), b AS ({_folded(NOW)}) SELECT a.id, a.folded_status AS status_before, b.folded_status AS status_after FROM a JOIN b USING (id) WHERE a.folded_status IS DISTINCT FROM b.folded_status")
def due_transitions(spark, sf):
    return fold.due_sweep(_base(spark, sf), _events(spark, sf), F.expr("TIMESTAMP '2024-01-02 00:00:00'"), F.expr(NOW))


@query(f"""SELECT id, CASE WHEN status = 'repealed' OR expiry_date <= {MOMENT} THEN 'repealed' WHEN effective_date > {MOMENT} THEN 'not_yet_effective' WHEN status = 'not_yet_effective' THEN 'in_force' ELSE status END AS status_as_of FROM docs""")
def status_as_of(spark, sf):
    return fold.status_as_of(D.documents(spark, sf), F.expr(MOMENT)).select("id", "status_as_of")


@query(f"SELECT a.event_id, a.target_id, c.corpus_id, a.label, a.event_date FROM amends a JOIN corp c ON c.section_id = a.target_id WHERE a.event_date BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND {NOW} AND {D.sql_visible(1)} ORDER BY a.event_date DESC, a.event_id DESC LIMIT 21")
def timeline_page(spark, sf):
    seen = D.corpus(spark, sf, text=False).where(tiers.row_visible("group", F.col("corpus_id"), F.col("access_tier"))).select(F.col("section_id").alias("id"), "corpus_id", F.col("doc_number").alias("title"))
    rows = fold.timeline(D.amendments(spark, sf), seen, F.expr("TIMESTAMP '2024-01-05 00:00:00'"), F.expr(NOW))
    return fold.page(rows, [("event_date", True), ("event_id", True)], 20).select("event_id", "target_id", "corpus_id", "label", "event_date")


@query("SELECT d.id, d.corpus_id, d.status, count(s.id) AS n_sections, coalesce(sum(length(s.text)), 0)::BIGINT AS n_chars, string_agg(s.id, ',' ORDER BY s.sec_position, s.id) AS section_ids FROM docs d LEFT JOIN secs s ON s.document_id = d.id GROUP BY 1, 2, 3")
def document_detail(spark, sf):
    s = D.sections(spark, sf).select(F.col("document_id").alias("id"), F.struct(F.col("sec_position").alias("p"), F.col("id").alias("s")).alias("k"), F.length("text").alias("n"))
    s = s.groupBy("id").agg(F.count("*").alias("n_sections"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chars"), F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x["s"]), ",").alias("section_ids"))
    return D.documents(spark, sf).select("id", "corpus_id", "status").join(s, "id", "left").fillna(0, ["n_sections", "n_chars"])


# --- graph ------------------------------------------------------------------------------------------------------------

_FIRST = "fe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target, edge_type ORDER BY created_at, id) AS r FROM edges WHERE target IS NOT NULL) WHERE r = 1)"


@query(f", {_FIRST} SELECT edge_type, count(*) AS n, count(*) FILTER (WHERE promoted) AS n_promoted FROM fe GROUP BY 1")
def edge_dedup(spark, sf):
    return graph.first_edges(D.edges(spark, sf)).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_if(F.col("promoted")).alias("n_promoted"))


@query("SELECT l_orderkey AS edge_id, l_discount + 0.0 AS confidence, l_linenumber AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber, l_partkey DESC) AS r FROM lineitem) WHERE r = 1")
def best_evidence(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("edge_id"), (F.col("l_discount") + 0.0).alias("confidence"), F.col("l_linenumber").alias("seen"), F.col("l_linenumber").alias("evidence"), F.col("l_partkey").alias("part"))
    return graph.best_evidence(e).select("edge_id", "confidence", "evidence")


@query(f"SELECT source AS node, count(*) AS n_edges, count(DISTINCT edge_type) AS n_types, count(*) FILTER (WHERE promoted) AS n_promoted, round(max(confidence), 9) AS best_confidence FROM edges WHERE target IS NOT NULL AND {D.sql_rank(_EDGE_TIER)} <= 1 GROUP BY 1")
def node_view(spark, sf):
    return graph.node_view(_tiered_edges(spark, sf).where("target is not null").where(tiers.tier_visible("group", F.col("access_tier"))))


_UP = "up AS (SELECT source, target, edge_type, promoted FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at, id) AS r FROM edges WHERE target IS NOT NULL AND edge_type IN ('derives', 'satisfies', 'implements')) WHERE r = 1)"
_CHAIN = f""", {_UP}, walk AS (SELECT source AS start, source AS pos, [source] AS seen, [] :: VARCHAR[] AS hops, true AS ok, 0 AS depth FROM (SELECT DISTINCT source FROM edges)
  UNION ALL SELECT w.start, u.target, list_append(w.seen, u.target), list_append(w.hops, u.edge_type || ' ' || u.target), w.ok AND u.promoted, w.depth + 1 FROM walk w JOIN up u ON u.source = w.pos WHERE w.depth < 8 AND NOT list_contains(w.seen, u.target)),
ends AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth DESC) AS r FROM walk) WHERE r = 1)"""


def _chains(spark, sf) -> DataFrame:
    e = D.edges(spark, sf)
    return graph.chains(e.select(F.col("source").alias("node")).distinct(), e.where("target is not null"))


@query(f"{_CHAIN} SELECT start, depth, array_to_string(hops, ' > ') AS hops FROM ends", recursive=True)
def chain_walk(spark, sf):
    return _chains(spark, sf).select("start", F.size("hops").alias("depth"), F.array_join(F.transform("hops", lambda h: F.concat_ws(" ", h["edge_type"], h["target"])), " > ").alias("hops"))


@query(f"{_CHAIN} SELECT depth, {D.sql_node_corpus('pos')} AS terminal_corpus, count(*) AS n FROM ends GROUP BY 1, 2", recursive=True)
def chain_terminal(spark, sf):
    last = F.coalesce(F.get("hops", F.size("hops") - 1)["target"], F.col("start"))
    return _chains(spark, sf).groupBy(F.size("hops").alias("depth"), D.node_corpus(last).alias("terminal_corpus")).agg(F.count("*").alias("n"))


@query(f"{_CHAIN} SELECT start AS source, pos AS target FROM ends WHERE depth > 0 AND ok AND {D.sql_node_corpus('pos')} IN ('vn-reg', 'my-reg')", recursive=True)
def covers(spark, sf):
    return graph.covers(_chains(spark, sf), D.node_corpus)


@query("SELECT id, source, target, edge_type, created_at FROM edges ORDER BY created_at DESC, id LIMIT 500")
def canvas_edges(spark, sf):
    return graph.canvas(D.edges(spark, sf)).select("id", "source", "target", "edge_type", "created_at")


@query(f", c AS (SELECT * FROM edges ORDER BY created_at DESC, id LIMIT 500), n AS (SELECT source AS node FROM c UNION SELECT target FROM c) SELECT node, {D.sql_node_corpus('node')} AS corpus_id, {D.sql_tier(D.sql_node_corpus('node'))} AS tier FROM n WHERE node IS NOT NULL")
def canvas_nodes(spark, sf):
    n = graph.canvas_nodes(graph.canvas(D.edges(spark, sf))).where("node is not null").withColumn("corpus_id", D.node_corpus(F.col("node")))
    return n.withColumn("tier", tiers.corpus_tier(F.col("corpus_id")))


@query("SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT source AS node, 1 AS o, 0 AS i FROM edges WHERE target IS NOT NULL UNION ALL SELECT target, 0, 1 FROM edges WHERE target IS NOT NULL) GROUP BY 1")
def degrees(spark, sf):
    return graph.degrees(D.edges(spark, sf).where("target is not null"))


_NAMED = "named AS (SELECT 'vn-reg:' || upper(trim(so_ky_hieu)) AS ref_key, tieu_de AS label, item_id AS seen FROM search_item WHERE so_ky_hieu IS NOT NULL)"


def _named(spark, sf) -> DataFrame:
    s = table(spark, sf, "search_item").where("so_ky_hieu is not null")
    return s.select(graph.ref_key(F.lit("vn-reg"), F.col("so_ky_hieu")).alias("ref_key"), F.col("tieu_de").alias("label"), F.lit(None).cast("string").alias("document_id"), F.col("item_id").alias("seen"))


@query(f", {_NAMED} SELECT ref_key, arg_min(label, seen) AS label FROM named GROUP BY 1")
def ensure_doc_ref(spark, sf):
    return graph.ensure_refs(_named(spark, sf)).select("ref_key", "label")


@query(f", {_NAMED}, r AS (SELECT ref_key, arg_min(label, seen) AS label FROM named GROUP BY 1), d AS (SELECT 'vn-reg:' || upper(trim(docnum)) AS ref_key, min(id) AS id FROM doc_item WHERE docnum IS NOT NULL GROUP BY 1) SELECT ref_key, d.id AS document_id, d.id IS NOT NULL AS flipped FROM r LEFT JOIN d USING (ref_key)")
def resolve_stubs(spark, sf):
    d = table(spark, sf, "doc_item").where("docnum is not null").select(graph.ref_key(F.lit("vn-reg"), F.col("docnum")).alias("ref_key"), "id")
    return graph.resolve_stubs(graph.ensure_refs(_named(spark, sf)), d).select("ref_key", "document_id", "flipped")


#: Every permitted pair of the seven corpora, as the SQL side states them.
_PAIRS = [
    ("local-sop", "local-policy", "derives"), ("local-policy", "group-std", "implements"), ("local-policy", "vn-reg", "satisfies"), ("group-std", "my-reg", "satisfies"),
    *[(a, b, "concerns") for a in ("reports", "diagrams") for b in ("vn-reg", "my-reg", "group-std", "local-policy")],
]
_PAIR_ROWS = ", ".join(str(p) for p in _PAIRS)


@query(f""", p AS (SELECT {D.sql_node_corpus('source')} AS a, {D.sql_node_corpus('target')} AS b, count(*) AS n FROM edges WHERE target IS NOT NULL GROUP BY 1, 2)
SELECT x.a AS from_corpus, x.b AS to_corpus, x.t AS wanted, coalesce(p.n, 0) AS n FROM (VALUES {_PAIR_ROWS}) x(a, b, t) LEFT JOIN p ON p.a = x.a AND p.b = x.b""")
def edge_type_pairs(spark, sf):
    """Every permitted pair of corpora with its edge type and the number of edges between them."""
    e = D.edges(spark, sf).where("target is not null").select(D.node_corpus(F.col("source")).alias("from_corpus"), D.node_corpus(F.col("target")).alias("to_corpus"))
    n = e.groupBy("from_corpus", "to_corpus").agg(F.count("*").alias("n"))
    return graph_pairs(spark).join(n, ["from_corpus", "to_corpus"], "left").fillna(0, ["n"]).withColumnRenamed("edge_type", "wanted")


def graph_pairs(spark: SparkSession) -> DataFrame:
    """At most 49 rows."""
    return tiers.edge_pairs(spark)


# --- findings ---------------------------------------------------------------------------------------------------------

_NODES = f"nodes AS (SELECT node, {D.sql_node_corpus('node')} AS corpus_id FROM (SELECT source AS node FROM edges UNION SELECT target FROM edges) WHERE node IS NOT NULL)"
_WANTED = [("local-policy", "out", "satisfies", "no_satisfies"), ("group-std", "in", "implements", "no_implements"), ("local-policy", "in", "derives", "no_sop_coverage")]


def _nodes(spark, sf) -> DataFrame:
    return graph.canvas_nodes(D.edges(spark, sf)).where("node is not null").withColumn("corpus_id", D.node_corpus(F.col("node")))


def _gap_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT 'gap' AS kind, 'medium' AS severity, node, corpus_id, '{n}' AS detail, 'gap:{n}:' || node AS dedup_key FROM nodes WHERE corpus_id = '{c}' AND node NOT IN (SELECT {'source' if d == 'out' else 'target'} FROM edges WHERE edge_type = '{t}' AND target IS NOT NULL)"
        for c, d, t, n in _WANTED
    )


def _gaps(spark, sf) -> DataFrame:
    return findings.gaps(_nodes(spark, sf), D.edges(spark, sf).where("target is not null"), _WANTED)


@query(f", {_NODES} {_gap_sql()}")
def gap_scan(spark, sf):
    return _gaps(spark, sf)


_AMENDED = "am AS (SELECT target AS node, max(created_at) AS amended_on FROM edges WHERE target IS NOT NULL AND promoted GROUP BY 1)"


def _stale(spark, sf) -> DataFrame:
    e = D.edges(spark, sf).where("target is not null")
    amended = e.where("promoted").groupBy(F.col("target").alias("node")).agg(F.max("created_at").alias("amended_on"))
    return findings.stale(graph.first_edges(e), amended)


@query(f", {_FIRST}, {_AMENDED} SELECT 'stale' AS kind, 'high' AS severity, f.source AS node, f.target AS upstream, am.amended_on, 'stale:' || f.source || ':' || f.target AS dedup_key FROM fe f JOIN am ON am.node = f.target WHERE am.amended_on > f.created_at")
def stale_scan(spark, sf):
    return _stale(spark, sf)


@query(f", {_FIRST}, {_AMENDED}, s AS (SELECT source AS node, max(amended_on) AS amended_on FROM fe JOIN am ON am.node = fe.target WHERE am.amended_on > fe.created_at GROUP BY 1) SELECT d.source AS node, count(*) AS n_stale_upstreams, max(s.amended_on) AS amended_on FROM fe d JOIN s ON s.node = d.target GROUP BY 1")
def stale_cascade(spark, sf):
    s = _stale(spark, sf).groupBy("node").agg(F.max("amended_on").alias("amended_on"))
    e = graph.first_edges(D.edges(spark, sf)).select("source", "target")
    return e.join(s.withColumnRenamed("node", "target"), "target").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n_stale_upstreams"), F.max("amended_on").alias("amended_on"))


@query(", a AS (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'satisfies' AND target IS NOT NULL), b AS (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'implements' AND target IS NOT NULL) SELECT source, a.target AS law, b.target AS standard, 'conflict:' || b.target || ':' || a.target || ':' || source AS dedup_key FROM a JOIN b USING (source)")
def conflict_candidates(spark, sf):
    return findings.conflicts(D.edges(spark, sf).where("target is not null"))


@query("SELECT edge_type, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.7 AND grounding_score >= 0.6) AS n_passed FROM edges GROUP BY 1")
def relation_gate(spark, sf):
    return D.edges(spark, sf).groupBy("edge_type").agg(F.count("*").alias("n"), F.count_if(findings.gate()).alias("n_passed"))


@query(f", {_NODES}, g AS ({_gap_sql()}) SELECT g.dedup_key, g.node, g.detail FROM g WHERE corpus_id || node NOT IN (SELECT corpus_id || node FROM g WHERE substr(node, 36, 1) IN ('0', '1')) ")
def finding_dedup(spark, sf):
    g = _gaps(spark, sf)
    old = g.where(F.substring("node", 36, 1).isin("0", "1"))
    return findings.new_findings(g.unionByName(g), old, ["node"]).select("dedup_key", "node", "detail")


@query(f""", p AS (SELECT source, list({D.sql_node_corpus('target')}) AS corpora FROM edges GROUP BY 1) SELECT source, CASE WHEN list_contains(list_transform(corpora, lambda c: c IS NULL), true) OR list_max(list_transform(corpora, lambda c: {D.sql_rank(D.sql_tier('c'))})) = 2 THEN 'local-confidential'
  WHEN list_max(list_transform(corpora, lambda c: {D.sql_rank(D.sql_tier('c'))})) = 1 THEN 'group-confidential' ELSE 'public' END AS access_tier FROM p""")
def finding_tier_fold(spark, sf):
    p = D.edges(spark, sf).groupBy("source").agg(F.collect_list(F.coalesce(D.node_corpus(F.coalesce("target", F.lit(""))), F.lit("unknown"))).alias("corpora"))
    return findings.with_tier(p).select("source", "access_tier")


@query(f", {_NODES}, g AS ({_gap_sql()}), m AS (SELECT min(node) AS node FROM g) SELECT dedup_key, detail FROM g WHERE node = (SELECT node FROM m) AND corpus_id = (SELECT corpus_id FROM nodes WHERE node = (SELECT node FROM m))")
def findings_by_node(spark, sf):
    g = _gaps(spark, sf)
    one = lambda c: g.agg(F.min(F.struct("node", "corpus_id")).alias("m")).select(f"m.{c}").scalar()
    refs = g.withColumn("node_refs", F.array(F.struct("corpus_id", F.col("node").alias("document_id"), F.lit(None).cast("string").alias("section_id"))))
    return findings.about_node(refs, one("corpus_id"), one("node")).select("dedup_key", "detail")


@query("SELECT id, confidence, created_at FROM edges WHERE NOT promoted ORDER BY confidence DESC NULLS LAST, created_at, id LIMIT 100")
def review_queue(spark, sf):
    return findings.review_queue(D.edges(spark, sf), by_confidence=True).limit(100).select("id", "confidence", "created_at")


_ACT = "act AS (SELECT id, CASE substr(id, 1, 1) WHEN '0' THEN 'promote' WHEN '1' THEN 'reject' WHEN '2' THEN 'relink' END AS action FROM edges WHERE NOT promoted)"


@query(f", {_ACT} SELECT e.id, CASE WHEN a.action = 'relink' THEN e.source ELSE e.target END AS target, e.promoted OR coalesce(a.action = 'promote', false) AS promoted, CASE WHEN a.action = 'promote' THEN 1.0 ELSE e.confidence END AS confidence FROM edges e LEFT JOIN act a USING (id) WHERE a.action IS NULL OR a.action <> 'reject'")
def review_actions(spark, sf):
    e = D.edges(spark, sf)
    first = F.substring("id", 1, 1)
    act = e.where("not promoted").select("id", F.when(first == "0", "promote").when(first == "1", "reject").when(first == "2", "relink").alias("action"), F.col("source").alias("new_target"), F.lit(1).alias("seen"))
    return findings.apply_review(e, act.where("action is not null")).select("id", "target", "promoted", "confidence")


@query(f", {_NODES}, g AS ({_gap_sql()}) SELECT g.dedup_key, h.hook_id FROM g JOIN (VALUES (1, 'medium', 'local-confidential'), (2, 'high', 'local-confidential'), (3, 'low', 'group-confidential')) h(hook_id, sev, tier) ON (CASE h.sev WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) <= 1 AND {D.sql_rank(D.sql_tier('g.corpus_id'))} <= {D.sql_rank('h.tier')}")
def notification_fanout(spark, sf):
    hooks = spark.createDataFrame([(1, [], "medium", tiers.LOCAL, True), (2, [], "high", tiers.LOCAL, True), (3, ["gap"], "low", tiers.GROUP, True), (4, [], None, tiers.LOCAL, False)], "hook_id int, kinds array<string>, min_severity string, tier string, active boolean")
    g = _gaps(spark, sf).withColumn("access_tier", tiers.corpus_tier(F.col("corpus_id")))
    return findings.fan_out(g, F.broadcast(hooks)).select("dedup_key", "hook_id")


# --- reports ----------------------------------------------------------------------------------------------------------


@query(f", {_NODES} SELECT n_satisfied, n_refs, round(CASE WHEN n_refs > 0 THEN least(100.0 * n_satisfied / n_refs, 100) ELSE 0 END, 6) AS coverage_pct FROM (SELECT count(*) FILTER (WHERE promoted AND edge_type = 'satisfies') AS n_satisfied FROM edges), (SELECT count(*) AS n_refs FROM nodes WHERE corpus_id IN ('vn-reg', 'my-reg'))")
def coverage_pct(spark, sf):
    return reports.coverage(D.edges(spark, sf), _nodes(spark, sf).where(F.col("corpus_id").isin("vn-reg", "my-reg")))


@query("SELECT r.corpus_id, coalesce(n, 0) AS n_documents FROM (VALUES ('vn-reg'), ('my-reg'), ('group-std'), ('local-policy'), ('local-sop'), ('reports'), ('diagrams')) r(corpus_id) LEFT JOIN (SELECT corpus_id, count(*) AS n FROM docs GROUP BY 1) USING (corpus_id)")
def dashboard(spark, sf):
    return reports.per_corpus(D.documents(spark, sf), tiers.registry(spark)).select("corpus_id", "n_documents")


@query("SELECT edge_type, count(*) FILTER (WHERE NOT promoted) AS n_unpromoted, count(*) FILTER (WHERE promoted) AS n_promoted FROM edges GROUP BY GROUPING SETS ((edge_type), ())")
def dashboard_counts(spark, sf):
    return D.edges(spark, sf).rollup("edge_type").agg(F.count_if(~F.col("promoted")).alias("n_unpromoted"), F.count_if(F.col("promoted")).alias("n_promoted"))


_HIST = "h AS (SELECT o_custkey AS role, o_orderpriority AS holder, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t, o_orderkey FROM orders)"


def _history(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("role"), "o_orderdate", "o_orderkey", "o_orderpriority")
    return reports.half_open(o, "role", "o_orderdate", F.col("o_orderkey"), "o_orderpriority")


@query(f", {_HIST}, m AS (SELECT c_custkey AS role, c_custkey AS moment_id, TIMESTAMP '1998-06-15 00:00:00' AS moment FROM customer) SELECT m.role, m.moment_id, m.moment, (SELECT h.holder FROM h WHERE h.role = m.role AND h.f <= m.moment AND (h.t IS NULL OR h.t > m.moment)) AS holder FROM m")
def role_as_of(spark, sf):
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("role"), F.col("c_custkey").alias("moment_id"), F.expr("TIMESTAMP '1998-06-15 00:00:00'").alias("moment"))
    h = _history(spark, sf).where("to_date is null or to_date > from_date")
    return reports.holder_at(h.withColumns({"from_date": F.col("from_date").cast("timestamp"), "to_date": F.col("to_date").cast("timestamp")}), m, "role")


@query(f", {_HIST} SELECT role, holder, f AS since FROM h WHERE t IS NULL")
def role_current(spark, sf):
    return _history(spark, sf).where("to_date is null").select("role", "holder", F.col("from_date").alias("since"))


_RUNS = "runs AS (SELECT source, doc_id AS run_id, ingested_at AS started_at, published_at AS finished_at, CASE doc_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS status FROM documents WHERE ingested_at IS NOT NULL)"


@query(f", {_RUNS} SELECT source, CASE arg_max(status, (started_at, run_id)) WHEN 'completed' THEN 'healthy' WHEN 'running' THEN 'ingesting' ELSE 'error' END AS state, max(finished_at) FILTER (WHERE status = 'completed') AS last_completed, count(*) AS n_runs FROM runs GROUP BY 1")
def ingest_status(spark, sf):
    d = table(spark, sf, "documents").where("ingested_at is not null")
    k = F.col("doc_id") % 4
    runs = d.select("source", F.col("doc_id").alias("run_id"), F.col("ingested_at").alias("started_at"), F.col("published_at").alias("finished_at"), F.when(k == 0, "running").when(k == 1, "failed").otherwise("completed").alias("status"))
    return reports.run_status(runs, "source")


# --- evaluation -------------------------------------------------------------------------------------------------------

_CASES = """exp AS (SELECT label AS case_id, vec_id AS item FROM embeddings WHERE vec_id % 3 = 0), hit AS (
  SELECT e.label AS case_id, e.vec_id AS item, row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id * 7919 % 1009, e.vec_id) AS rank, c.validity_status IN ('in_force', 'amended') AS current FROM embeddings e JOIN corp c ON c.section_id = e.vec_id),
top AS (SELECT * FROM hit WHERE rank <= 40), k AS (SELECT *, max(CASE WHEN current THEN rank END) OVER (PARTITION BY case_id) AS lc FROM top),
m AS (SELECT k.*, e.item IS NOT NULL AS wanted, lc IS NULL OR rank <= lc AS kept FROM k LEFT JOIN exp e USING (case_id, item)),
per AS (SELECT case_id, count(DISTINCT CASE WHEN wanted THEN item END) AS n_found, min(CASE WHEN wanted THEN rank END) AS first, count(*) AS n_hits, count(*) FILTER (WHERE wanted) AS n_right, count(*) FILTER (WHERE kept AND current) AS n_current, count(*) FILTER (WHERE kept) AS n_kept FROM m GROUP BY 1),
w AS (SELECT case_id, count(*) AS n_want FROM exp GROUP BY 1),
cases AS (SELECT case_id, coalesce(n_found, 0) AS n_found, coalesce(n_hits, 0) AS n_hits, coalesce(n_right, 0) AS n_right, coalesce(n_current, 0) AS n_current, coalesce(n_kept, 0) AS n_kept, coalesce(n_want, 0) AS n_want, CASE WHEN n_want > 0 THEN coalesce(1.0 / first, 0) END AS rr FROM per FULL JOIN w USING (case_id))"""


def _cases(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("label").alias("case_id"), F.col("vec_id").alias("item"))
    order = Window.partitionBy("case_id").orderBy(F.col("item") * 7919 % 1009, "item")
    c = D.corpus(spark, sf, text=False).select(F.col("section_id").alias("item"), V.current(F.col("validity_status")).alias("current"))
    hits = e.join(c, "item").withColumn("rank", F.row_number().over(order)).where("rank <= 40")
    return evals.retrieval(e.where("item % 3 = 0"), hits)


@query(f", {_CASES} SELECT case_id, n_found, n_want, round(n_found / n_want, 9) AS recall FROM cases")
def recall_at_k(spark, sf):
    return _cases(spark, sf).select("case_id", "n_found", "n_want", F.round("recall", 9).alias("recall"))


@query(f", {_CASES} SELECT case_id, round(rr, 9) AS reciprocal_rank FROM cases")
def mrr(spark, sf):
    return _cases(spark, sf).select("case_id", F.round("reciprocal_rank", 9).alias("reciprocal_rank"))


@query(f", {_CASES} SELECT case_id, round(n_right / n_hits, 9) AS precision, round(n_current / n_kept, 9) AS in_force_precision FROM cases")
def citation_precision(spark, sf):
    return _cases(spark, sf).select("case_id", F.round("precision", 9).alias("precision"), F.round("in_force_precision", 9).alias("in_force_precision"))


@query(f", {_CASES} SELECT count(*) AS n_cases, round(sum(n_found) / sum(n_want), 9) AS recall, round(avg(rr), 9) AS mrr, round(sum(n_right) / sum(n_hits), 9) AS precision, round(sum(n_current) / sum(n_kept), 9) AS in_force_precision FROM cases")
def eval_micro_avg(spark, sf):
    return evals.roll_up(_cases(spark, sf))


@query("SELECT count(*) FILTER (WHERE e AND p) AS tp, count(*) FILTER (WHERE NOT e AND p) AS fp, count(*) FILTER (WHERE e AND NOT p) AS fn, count(*) FILTER (WHERE NOT e AND NOT p) AS tn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM (SELECT promoted AS e, coalesce(confidence >= 0.7 AND grounding_score >= 0.6, false) AS p FROM edges)")
def mapping_confusion(spark, sf):
    return evals.confusion(D.edges(spark, sf).select(F.col("promoted").alias("expected"), findings.gate().alias("predicted")))


@query("SELECT l_orderkey AS case_id, count(*) FILTER (WHERE l_discount > 0.02) AS n_hits, coalesce(max(l_discount) + 0.0 < 0.08, true) OR n_hits = 0 AS abstains FROM lineitem GROUP BY 1")
def abstain(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count_if(F.col("l_discount") > 0.02).alias("n_hits"), F.max(F.col("l_discount") + 0.0).alias("top_score"))
    return evals.abstention(c.withColumn("expect_abstain", F.lit(False)), 0.08).select("case_id", "n_hits", "abstains")


# --- ingest -----------------------------------------------------------------------------------------------------------


@query("SELECT item_id, sha256(concat_ws('|', coalesce(so_ky_hieu, ''), coalesce(tieu_de, ''), coalesce(id_van_ban, ''), coalesce(loai_van_ban, '')) || CASE WHEN coalesce(nguoi_ky, '') <> '' THEN '|' || nguoi_ky ELSE '' END) AS content_hash FROM search_item")
def discovery_hash(spark, sf):
    s = table(spark, sf, "search_item")
    return s.select("item_id", ingest.discovery_hash(F.col("so_ky_hieu"), F.col("tieu_de"), F.col("id_van_ban"), F.col("loai_van_ban"), F.col("nguoi_ky")).alias("content_hash"))


@query(", s AS (SELECT item_id, id_van_ban, coalesce(so_ky_hieu, '') || '|' || coalesce(tieu_de, '') AS h FROM search_item), led AS (SELECT DISTINCT id_van_ban, h FROM s WHERE item_id % 2 = 0 AND item_id % 3 <> 0) SELECT item_id FROM s WHERE trim(id_van_ban) <> '' AND (id_van_ban, h) NOT IN (SELECT id_van_ban, h FROM led)")
def ledger_unchanged(spark, sf):
    s = table(spark, sf, "search_item").select("item_id", F.col("id_van_ban").alias("external_id"), F.concat_ws("|", F.coalesce("so_ky_hieu", F.lit("")), F.coalesce("tieu_de", F.lit(""))).alias("content_hash"))
    ledger = s.where("item_id % 2 = 0").withColumn("state", F.when(F.col("item_id") % 3 == 0, "failed").otherwise("indexed"))
    return ingest.to_process(s, ledger).select("item_id")


@query("SELECT source, greatest(TIMESTAMP '2021-01-01 00:00:00', max(coalesce(published_at, ingested_at))) AS watermark FROM documents GROUP BY 1")
def watermark_advance(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("published_at").alias("issued"), F.col("ingested_at").alias("published"), F.lit(True).alias("complete"))
    old = d.select("source").distinct().withColumn("watermark", F.expr("TIMESTAMP '2021-01-01 00:00:00'"))
    return ingest.watermark(old, d, "source")


#: Crawled records as incoming documents: every third without its number, under a URL made of its title, so that both natural keys are met.
_INCOMING = """inc AS (SELECT id AS new_id, CASE WHEN rec_id % 3 > 0 THEN nullif(docnum, '') END AS num, 'u:' || nullif(title, '') AS url, title, rec_id AS seen FROM doc_item),
old AS (SELECT id, nullif(doc_number, '') AS doc_number, 'u:' || nullif(title, '') AS url, title FROM docs),
k0 AS (SELECT i.*, coalesce(n.id, u.id) AS known FROM inc i LEFT JOIN (SELECT doc_number, min(id) AS id FROM old WHERE doc_number IS NOT NULL GROUP BY 1) n ON n.doc_number = i.num
  LEFT JOIN (SELECT url, min(id) AS id FROM old WHERE url IS NOT NULL GROUP BY 1) u ON u.url = i.url),
k1 AS (SELECT *, CASE WHEN num IS NOT NULL THEN first_value(coalesce(known, new_id)) OVER (PARTITION BY num ORDER BY seen) END AS of_number FROM k0),
k2 AS (SELECT *, CASE WHEN url IS NOT NULL THEN first_value(coalesce(known, of_number, new_id)) OVER (PARTITION BY url ORDER BY seen) END AS of_url FROM k1),
k3 AS (SELECT *, CASE WHEN num IS NOT NULL THEN first_value(coalesce(known, of_url, new_id)) OVER (PARTITION BY num ORDER BY seen) END AS of_both FROM k2),
k4 AS (SELECT *, row_number() OVER (PARTITION BY coalesce(known, of_both, of_url, new_id) ORDER BY seen DESC) AS r, coalesce(known, of_both, of_url, new_id) AS id FROM k3)"""


@query(f", {_INCOMING} SELECT id, doc_number, title FROM docs WHERE id NOT IN (SELECT id FROM k4) UNION ALL SELECT id, num, title FROM k4 WHERE r = 1")
def upsert_natural_key(spark, sf):
    url = F.concat(F.lit("u:"), F.nullif(F.col("title"), F.lit(""))).alias("source_url")
    old = D.documents(spark, sf).select("id", "doc_number", "title", url)
    number = F.when(F.col("rec_id") % 3 > 0, F.col("docnum")).alias("doc_number")
    new = table(spark, sf, "doc_item").select(F.col("id").alias("new_id"), number, "title", url, F.col("rec_id").alias("seen"))
    return ingest.upsert(old, new, ["id", "doc_number", "title"])


@query(", new AS (SELECT id || '+' AS id, document_id, upper(text) AS text FROM secs WHERE substr(document_id, 1, 1) IN ('0', '1')) SELECT id, document_id, text FROM secs WHERE document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT * FROM new")
def section_replace(spark, sf):
    s = D.sections(spark, sf).select("id", "document_id", "text")
    new = s.where(F.substring("document_id", 1, 1).isin("0", "1")).select(F.concat("id", F.lit("+")).alias("id"), "document_id", F.upper("text").alias("text"))
    return ingest.replace_sections(s, new)


@query("SELECT target_id, CAST(event_date AS DATE) AS event_date, min(event_id) AS event_id FROM amends GROUP BY 1, 2")
def event_dedup(spark, sf):
    e = D.amendments(spark, sf).select("target_id", F.to_date("event_date").alias("event_date"), "event_id", F.col("event_id").alias("seen"), F.lit(None).cast("string").alias("amending_id"), F.lit(None).cast("string").alias("clause"))
    return ingest.first_events(e).select("target_id", "event_date", "event_id")


@query("SELECT record_id, relation_key, group_no FROM (SELECT *, row_number() OVER (PARTITION BY record_id, relation_key ORDER BY group_no, position) AS n FROM (SELECT source AS record_id, coalesce(nullif(trim(target), ''), nullif(trim(edge_type), '')) AS relation_key, CASE WHEN promoted THEN 0 ELSE 1 END AS group_no, id AS position FROM edges) WHERE relation_key IS NOT NULL) WHERE n = 1")
def relation_merge(spark, sf):
    g = D.edges(spark, sf).select(F.col("source").alias("record_id"), F.when(F.col("promoted"), 0).otherwise(1).alias("group_no"), F.col("id").alias("position"), F.col("target").alias("target_id"), F.lit(None).cast("string").alias("target_number"), F.col("edge_type").alias("target_title"))
    return ingest.merge_relations(g).select("record_id", "relation_key", "group_no")


# --- text -------------------------------------------------------------------------------------------------------------


@query(f"SELECT section_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT section_id, {_TOKENS} AS w FROM corp)")
def token_stats(spark, sf):
    w = D.corpus(spark, sf).select("section_id", X.tokens(F.col("text")).alias("w"))
    return w.select("section_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


_STRONG, _TITLE, _WEAK, _SIGNAL = ["kho dữ liệu", "khóa mã"], ["hạn mức rủi ro"], ["kiểm thử", "niêm phong"], ["hệ thống lõi", "chứng từ"]
_NUM = "lower(nfc_normalize(coalesce(so_ky_hieu, '')))"
_NEAR = f"({_NUM} || chr(10) || lower(nfc_normalize(coalesce(tieu_de, ''))))"
_WIDE = f"({_NEAR} || chr(10) || lower(nfc_normalize(coalesce(trich_yeu, ''))))"
_SIG = f"(contains({_NUM}, 'nhnn') OR " + " OR ".join(f"contains({_NEAR}, '{s}')" for s in _SIGNAL) + ")"
_SCOPE = ", ".join([*[f"CASE WHEN contains({_WIDE}, '{t}') THEN '{t}' END" for t in _STRONG], *[f"CASE WHEN contains({_NEAR}, '{t}') THEN '{t}' END" for t in _TITLE], *[f"CASE WHEN {_SIG} AND contains({_NEAR}, '{t}') THEN '{t}' END" for t in _WEAK]])


@query(f"SELECT item_id, array_to_string(list_filter([{_SCOPE}], lambda t: t IS NOT NULL), ',') AS terms FROM search_item")
def scope_match(spark, sf):
    s = table(spark, sf, "search_item")
    return s.select("item_id", F.array_join(X.scope_terms(F.col("so_ky_hieu"), F.col("tieu_de"), F.col("trich_yeu"), _STRONG, _TITLE, _WEAK, _SIGNAL), ",").alias("terms"))


_QUALITY = """, q0 AS (SELECT doc_id, nfc_normalize(coalesce(text, '')) AS t, coalesce(lang, 'vi') = 'vi' AS marks FROM documents),
q1 AS (SELECT doc_id, marks, length(t) AS n_chars, len(regexp_extract_all(t, '\\p{L}')) AS letters, len(regexp_extract_all(t, '\\p{L}')) - len(regexp_extract_all(t, '[A-Za-z]')) AS wide_letters,
  len(regexp_extract_all(t, '[\\x{FFFD}\\x00-\\x08\\x0B\\x0E-\\x1F\\x7F-\\x{9F}]')) AS bad, len(regexp_extract_all(t, '[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')) AS blanks,
  len(regexp_extract_all(t, '[\\x{E000}-\\x{F8FF}]')) AS private_use, len(list_filter(string_split(t, ''), lambda x: x <> '' AND contains('√∆·ªƒ∫≠‚ÄØ', x))) AS mojibake, len(regexp_extract_all(t, '[\\x{400}-\\x{4FF}]')) AS cyrillic FROM q0),
q2 AS (SELECT *, bad / n_chars > 0.01 AS s1, letters < 50 AS s2, blanks / n_chars > 0.4 AS s3, private_use / n_chars > 0.005 AS s4, mojibake >= 8 AND mojibake / n_chars > 0.005 AS s5,
  cyrillic >= 8 AND cyrillic / n_chars >= 0.005 AS s6, marks AND letters >= 200 AND wide_letters / nullif(letters, 0) < 0.02 AS s7 FROM q1),
q3 AS (SELECT *, CASE WHEN n_chars = 0 THEN 0.0::DOUBLE ELSE least(greatest(1 - CASE WHEN s1 THEN 5 * bad / n_chars ELSE 0 END - 0.3 * s2::INT - 0.3 * s3::INT - 0.5 * s4::INT - 0.7 * s5::INT - 0.7 * s6::INT - 0.5 * s7::INT, 0), 1)::DOUBLE END AS confidence FROM q2)
SELECT doc_id, n_chars, letters, wide_letters, bad, blanks, private_use, mojibake, cyrillic, round(confidence, 9) AS confidence,
  n_chars > 0 AND confidence >= 0.6 AND NOT coalesce(s2 OR s4 OR s5 OR s6 OR bad / n_chars >= 0.01, true) AS ok FROM q3"""


@query(_QUALITY)
def quality_signals(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    out = X.with_quality(d, "text", F.coalesce("lang", F.lit("vi")) == "vi").withColumn("confidence", F.round("confidence", 9))
    return out.select("doc_id", "n_chars", *X.COUNTS, "confidence", "ok")


@query()
def html_text(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", X.html_to_text(F.concat(F.lit("<p>"), F.col("text"), F.lit("</p><script>x</script>"))).alias("text"))


@query(f", {_sql_lexical('corp')} SELECT section_id, lexical FROM lex WHERE lexical > 0")
def cover_density(spark, sf):
    w = D.corpus(spark, sf).where(X.may_match(WORDS, F.col("text"))).select("section_id", X.tokens(F.col("text")).alias("w")).where(X.query_predicate(WORDS, F.col("w")))
    return w.select("section_id", F.round(X.cover_density(X.query_groups(WORDS), F.col("w")), 9).alias("lexical")).where("lexical > 0")


@query()
def det_embed(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", X.embedder(32)("text").alias("embedding"))


def _pairs(spark, sf) -> DataFrame:
    c = D.corpus(spark, sf).where("embedding is not null").select(F.col("section_id").alias("id"), "embedding", "validity_status", "text")
    found = detect.rerank(detect.candidates(c.where("id % 20 = 0"), c, k=5), k=5)
    return found, c


_CAND = """, c AS (SELECT section_id AS id, embedding, validity_status FROM corp WHERE embedding IS NOT NULL), r AS (SELECT s.id AS source_id, t.id AS target_id, row_number() OVER (PARTITION BY s.id ORDER BY round(list_cosine_distance(s.embedding, t.embedding), 9), t.id) AS place
  FROM c s JOIN c t ON t.validity_status IN ('in_force', 'amended') WHERE s.id % 20 = 0)"""


@query(f"{_CAND} SELECT source_id, target_id, place AS final_place, round(1 - 0.1 * (place - 1), 6) AS rank_score FROM r WHERE place <= 5")
def candidate_rerank(spark, sf):
    found, _ = _pairs(spark, sf)
    return found.select("source_id", "target_id", "final_place", F.round("rank_score", 6).alias("rank_score"))


@query(f"{_CAND} SELECT source_id, target_id, 'satisfies' AS edge_type, 0.85::DOUBLE AS confidence, 0.95::DOUBLE AS grounding_score FROM r WHERE place <= 5")
def relation_detect(spark, sf):
    found, c = _pairs(spark, sf)
    text = lambda name: c.select(F.col("id").alias(f"{name}_id"), F.col("text").alias(f"{name}_text"))
    return detect.relations(found.join(text("source"), "source_id").join(text("target"), "target_id"))


@query(f"{_CHAIN} SELECT {D.sql_node_corpus('start')} AS corpus_id, count(*) AS n, count(*) FILTER (WHERE depth > 0 AND {D.sql_node_corpus('pos')} IN ('vn-reg', 'my-reg')) AS n_to_law, count(*) FILTER (WHERE depth > 0 AND ok AND {D.sql_node_corpus('pos')} IN ('vn-reg', 'my-reg')) AS n_promoted FROM ends GROUP BY 1", recursive=True)
def coverage_chains(spark, sf):
    c = _chains(spark, sf)
    law = D.node_corpus(F.coalesce(F.get("hops", F.size("hops") - 1)["target"], F.lit(""))).isin("vn-reg", "my-reg")
    done = F.forall("hops", lambda h: h["promoted"])
    return c.groupBy(D.node_corpus(F.col("start")).alias("corpus_id")).agg(F.count("*").alias("n"), F.count_if((F.size("hops") > 0) & law).alias("n_to_law"), F.count_if((F.size("hops") > 0) & law & done).alias("n_promoted"))


@query(f", {_EV} SELECT target_id AS id, arg_max(event_id, (event_date, event_id)) AS superseded_by FROM ev WHERE kind = 'superseded' GROUP BY 1")
def superseded_by(spark, sf):
    return fold.superseding(_events(spark, sf).withColumn("amending_id", F.col("event_id")))


def _grammar() -> Column:
    """Every document has one: by its language, else (null or another one) by the corpus of its source."""
    by_lang = F.when(F.col("lang") == "vi", "vn").when(F.col("lang").isin("en", "ms"), "my")
    corpus = D._case(F.col("source"), D.SOURCE_CORPUS)
    return F.coalesce(by_lang, F.when(corpus == "my-reg", "my"), F.lit("vn"))


@query()
def vn_parse(spark, sf):
    d = table(spark, sf, "documents").where(_grammar() == "vn")
    return parsing.sections(d, "vn")


@query()
def my_parse(spark, sf):
    d = table(spark, sf, "documents").where(_grammar() == "my")
    return parsing.sections(d, "my")


# --- writing and reading the graph ------------------------------------------------------------------------------------

_DOCS_OF = f"(SELECT {D.sql_node_corpus('id')} AS corpus_id, id AS doc_number, 'doc-' || id AS id FROM docs)"
#: Every edge as the reference of a document's header; 'implements' and 'derives' of two kinds of documents lead somewhere.
_EXTRACTED = f"""hd AS (SELECT DISTINCT id, source, target, edge_type AS raw FROM graph_edge), hx AS (SELECT {D.sql_node_corpus('source')} AS from_corpus, source AS from_document, trim(target) AS num, id AS seen, lower(trim(raw)) AS verb FROM hd
  WHERE source IS NOT NULL AND trim(target) <> ''),
ht AS (SELECT *, CASE WHEN from_corpus = 'local-policy' AND verb = 'implements' THEN 'group-std' WHEN from_corpus = 'local-sop' AND verb IN ('derives', 'derives from') THEN 'local-policy' END AS to_corpus FROM hx),
ex AS (SELECT from_corpus, from_document, ht.to_corpus, d.id AS to_document, ht.to_corpus || ':' || upper(num) AS ref_key, CASE ht.to_corpus WHEN 'group-std' THEN 'implements' ELSE 'derives' END AS edge_type, seen
  FROM ht LEFT JOIN {_DOCS_OF} d ON d.corpus_id = ht.to_corpus AND d.doc_number = num WHERE ht.to_corpus IS NOT NULL)"""


def _extracted(spark, sf) -> DataFrame:
    raw = table(spark, sf, "graph_edge").where("source is not null").select("id", "source", "target", "edge_type").distinct()
    ref = F.struct(F.col("edge_type").alias("relation"), F.col("target").alias("target_number"), F.lit(" ").alias("target_title"), F.col("id").alias("quoted_span"))
    headers = raw.select(D.node_corpus(F.col("source")).alias("corpus_id"), F.col("source").alias("doc_id"), F.lit("owner").alias("owner"), F.array(ref).alias("refs"))
    docs = D.documents(spark, sf).select(D.node_corpus(F.col("id")).alias("corpus_id"), F.col("id").alias("doc_number"), F.concat(F.lit("doc-"), "id").alias("id"))
    return graph.extract_edges(headers, docs, graph_pairs(spark)).withColumn("seen", F.col("quoted_from"))


@query(f", {_EXTRACTED} SELECT from_corpus, from_document, to_corpus, to_document, ref_key, edge_type, seen FROM ex")
def extract_edges(spark, sf):
    return _extracted(spark, sf).select("from_corpus", "from_document", "to_corpus", "to_document", "ref_key", "edge_type", "seen")


_KEY = "from_corpus, from_document, ref_key, edge_type"
_EDGE_ID = "left(sha256(from_corpus || chr(0) || from_document || chr(0) || ref_key || chr(0) || edge_type), 32)"


def _written(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges and evidence after two passes over the same headers: the first half promoted, then all."""
    new = _extracted(spark, sf)
    none = new.select(graph.edge_id().alias("id"), *graph.EDGE_KEY, "to_corpus", "direction", F.lit(False).alias("promoted"), "seen").limit(0)
    old = graph.write_edges(none, new.where(F.substring("from_document", 2, 1) < "8")).withColumn("promoted", F.lit(True))
    judged = new.where(F.substring("seen", 1, 1) < "4").withColumns({"confidence": F.lit(0.8), "grounding_score": F.lit(0.9)})
    first = graph.extracted_evidence(new)
    evidence = graph.write_evidence(graph.write_evidence(first.limit(0), first), graph.model_evidence(judged).unionByName(first))
    return new, graph.write_edges(old, new), evidence


@query(f", {_EXTRACTED} SELECT {_EDGE_ID} AS id, edge_type, substr(from_document, 2, 1) < '8' AS promoted, min(seen) AS seen FROM ex GROUP BY {_KEY}")
def write_edges(spark, sf):
    return _written(spark, sf)[1].select("id", "edge_type", "promoted", "seen")


@query(f", {_EXTRACTED}, k AS (SELECT *, {_EDGE_ID} AS id FROM ex), v AS (SELECT id, 'extracted' AS kind, min(seen) AS seen, 1.0::DOUBLE AS confidence FROM k GROUP BY 1 UNION ALL SELECT id, 'model_classification', min(seen), 0.8::DOUBLE FROM k WHERE substr(seen, 1, 1) < '4' GROUP BY 1) SELECT id, count(*) AS n_evidence, string_agg(kind || ' ' || seen, ', ' ORDER BY seen, kind) AS listed, max(confidence) AS best FROM v GROUP BY 1")
def edge_evidence(spark, sf):
    _, e, evidence = _written(spark, sf)
    out = graph.with_evidence(e, evidence)
    one = F.transform("evidence", lambda x: F.concat_ws(" ", x["kind"], x["seen"]))
    return out.select("id", F.size("evidence").cast("bigint").alias("n_evidence"), F.array_join(one, ", ").alias("listed"), F.array_max(F.transform("evidence", lambda x: x["confidence"])).alias("best"))


@query(f"SELECT r.role, count(*) AS n FROM edges e JOIN (VALUES ('public', 0), ('group', 1), ('local', 2)) r(role, rank) ON {D.sql_rank(_EDGE_TIER)} <= r.rank GROUP BY 1")
def evidence_policy(spark, sf):
    e = _tiered_edges(spark, sf)
    evidence = e.select(F.col("id").alias("edge_id"), "confidence")
    seen = [graph.visible_evidence(evidence, e, role).select(F.lit(role).alias("role")) for role in tiers.ROLES]
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).groupBy("role").agg(F.count("*").alias("n"))


_LABELLED = f"(SELECT id, {D.sql_node_corpus('id')} || ':' || upper(id) AS ref_key, nullif(trim(title), '') AS label FROM docs)"


@query(f""", {_UP}, ue AS (SELECT source, id, confidence, grounding_score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at, id) AS r FROM edges WHERE target IS NOT NULL AND edge_type IN ('derives', 'satisfies', 'implements')) WHERE r = 1), {_CHAIN[len(_UP) + 4:]},
hp AS (SELECT start, unnest(list_zip(seen[1:len(hops)], hops, range(1, len(hops) + 1))) AS h FROM ends WHERE depth > 0),
hh AS (SELECT start, h[3] AS hop_no, h[1] AS source, split_part(h[2], ' ', 1) AS edge_type, split_part(h[2], ' ', 2) AS target FROM hp)
SELECT start, CAST(hop_no AS INTEGER) AS hop_no, hh.target, edge_type, coalesce(l.label, l.ref_key) AS citation, round(ue.confidence, 9) AS confidence, round(ue.grounding_score, 9) AS grounding_score FROM hh LEFT JOIN ue ON ue.source = hh.source LEFT JOIN {_LABELLED} l ON l.id = hh.target""", recursive=True)
def hop_citations(spark, sf):
    e = D.edges(spark, sf).where("target is not null")
    refs = D.documents(spark, sf).select(F.col("id").alias("document_id"), graph.ref_key(D.node_corpus(F.col("id")), F.col("id")).alias("ref_key"), F.trim("title").alias("label"))
    evidence = e.select(F.col("id").alias("edge_id"), "confidence", "grounding_score", F.lit(1).alias("seen"))
    rows = graph.hop_rows(_chains(spark, sf), e, refs, evidence)
    return rows.select("start", "hop_no", "target", "edge_type", "citation", F.round("confidence", 9).alias("confidence"), F.round("grounding_score", 9).alias("grounding_score"))


@query(f"SELECT r.role, count(*) AS n FROM {_LABELLED} l JOIN (VALUES ('public', 0), ('group', 1), ('local', 2)) r(role, rank) ON {D.sql_rank(D.sql_tier(D.sql_node_corpus('l.id')))} <= r.rank GROUP BY 1")
def reference_policy(spark, sf):
    refs = D.documents(spark, sf).select("id", D.node_corpus(F.col("id")).alias("corpus_id"))
    seen = [graph.visible_references(refs, role).select(F.lit(role).alias("role")) for role in tiers.ROLES]
    return seen[0].unionByName(seen[1]).unionByName(seen[2]).groupBy("role").agg(F.count("*").alias("n"))


# --- citations, conflicts, notifications, process ----------------------------------------------------------------------

#: Sections of the documents of one first digit are a case's hits; its expectations are citations of its own and of other documents.
_CITED = f"""ht AS (SELECT substr(document_id, 1, 1) AS case_id, id, substr(document_id, 1, 8) AS num, citation_path, heading_path, validity_status = 'in_force' AS current, row_number() OVER (PARTITION BY substr(document_id, 1, 1) ORDER BY id) AS rank FROM secs WHERE document_id IS NOT NULL),
hk AS (SELECT * FROM ht WHERE rank <= 60),
xp AS (SELECT case_id, id AS no, upper(num) AS num, coalesce(citation_path, '') AS seg FROM ht WHERE rank % 7 = 0 AND rank <= 90),
mt AS (SELECT x.case_id, x.no, h.rank FROM xp x JOIN hk h USING (case_id) WHERE contains(lower(nfc_normalize(h.num || ' ' || coalesce(h.citation_path, '') || ' ' || coalesce(h.heading_path, ''))), lower(nfc_normalize(x.num)))
  AND contains(lower(nfc_normalize(coalesce(h.citation_path, '') || ' ' || coalesce(h.heading_path, ''))), lower(nfc_normalize(x.seg)))),
m1 AS (SELECT case_id, count(DISTINCT no) AS n_found, min(rank) AS first, count(DISTINCT rank) AS n_right FROM mt GROUP BY 1), w1 AS (SELECT case_id, count(*) AS n_want FROM xp GROUP BY 1), h1 AS (SELECT case_id, count(*) AS n_hits FROM hk GROUP BY 1)"""


@query(f", {_CITED} SELECT case_id, coalesce(n_want, 0) AS n_want, coalesce(n_found, 0) AS n_found, round(coalesce(n_found, 0) / n_want, 9) AS recall, CASE WHEN n_want > 0 THEN round(coalesce(1.0 / first, 0), 9) END AS reciprocal_rank, round(coalesce(n_right, 0) / n_hits, 9) AS precision FROM w1 FULL JOIN h1 USING (case_id) LEFT JOIN m1 USING (case_id)")
def eval_citations(spark, sf):
    order = Window.partitionBy("case_id").orderBy("id")
    s = D.sections(spark, sf).where("document_id is not null").withColumn("case_id", F.substring("document_id", 1, 1)).withColumn("rank", F.row_number().over(order))
    s = s.withColumn("doc_number", F.substring("document_id", 1, 8))
    hits = s.where("rank <= 60").select("case_id", "rank", "doc_number", "citation_path", "heading_path", (F.col("validity_status") == "in_force").alias("current"))
    expected = s.where("rank % 7 = 0 and rank <= 90").select("case_id", F.upper("doc_number").alias("doc_number"), F.array(F.coalesce("citation_path", F.lit(""))).alias("segments"))
    out = evals.retrieval_by_citation(expected, hits)
    return out.select("case_id", "n_want", "n_found", F.round("recall", 9).alias("recall"), F.round("reciprocal_rank", 9).alias("reciprocal_rank"), F.round("precision", 9).alias("precision"))


@query("SELECT count(*) AS n_cases, round(avg((ek = k)::INT), 9) AS abstention_accuracy, count(*) FILTER (WHERE ek = 'answer' AND k = 'answer') AS n_cited, round(count(*) FILTER (WHERE ek = 'answer' AND k = 'answer' AND (want IS NULL OR contains(path, want))) / n_cited, 9) AS citation_correctness FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'abstain' ELSE 'answer' END AS ek, CASE WHEN o_orderkey % 7 = 0 THEN 'abstain' ELSE 'answer' END AS k, CASE WHEN o_orderkey % 3 > 0 THEN left(o_orderpriority, 1) END AS want, o_orderstatus || o_custkey AS path FROM orders)")
def eval_answers(spark, sf):
    k = F.col("o_orderkey")
    kind = lambda n: F.when(k % n == 0, "abstain").otherwise("answer")
    cases = table(spark, sf, "orders").select(kind(5).alias("expected_kind"), kind(7).alias("kind"), F.when(k % 3 > 0, F.left("o_orderpriority", F.lit(1))).alias("expected_contains"), F.array(F.concat("o_orderstatus", F.col("o_custkey").cast("string"))).alias("citations"))
    return evals.answers(cases)


_PAIRED = ", a AS (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'satisfies' AND target IS NOT NULL), b AS (SELECT DISTINCT source, target FROM edges WHERE edge_type = 'implements' AND target IS NOT NULL)"


@query(f"{_PAIRED} SELECT 'conflict:' || b.target || ':' || a.target || ':' || source AS dedup_key, 'critical' AS severity, b.target AS first_node, a.target AS second_node FROM a JOIN b USING (source) WHERE left(a.target, 1) < left(b.target, 1) AND right(a.target, 1) >= '4'")
def conflict_detect(spark, sf):
    """The candidates under a judge that calls a law that sorts before its standard a contradiction, and a grounder that supports some."""
    c = findings.conflicts(D.edges(spark, sf).where("target is not null")).withColumns({"standard_text": F.col("standard"), "law_text": F.col("law"), "standard_corpus": F.lit("group-std"), "law_corpus": F.lit("vn-reg")})
    judge = lambda a, b: F.struct(F.when(F.left(b, F.lit(1)) < F.left(a, F.lit(1)), "contradiction").otherwise("satisfies").alias("edge_type"), F.lit(0.85).alias("confidence"), F.col(b).alias("rationale"))
    ground = lambda rationale, both: F.when(F.right(F.col(rationale), F.lit(1)) >= "4", 0.9)
    f = findings.judged_conflicts(c, judge, ground)
    return f.select("dedup_key", "severity", F.col("node_refs")[0]["document_id"].alias("first_node"), F.col("node_refs")[1]["document_id"].alias("second_node"))


@query(f", {_NODES}, g AS ({_gap_sql()}) SELECT dedup_key AS id, detail AS kind FROM g WHERE detail = 'no_satisfies' ORDER BY right(node, 6) DESC, dedup_key LIMIT 21")
def findings_list(spark, sf):
    g = _gaps(spark, sf).select(F.col("dedup_key").alias("id"), F.col("detail").alias("kind"), F.right("node", F.lit(6)).alias("detected_at"), F.lit("open").alias("status"))
    return fold.page(findings.listed(g, kind="no_satisfies", status="open"), [("detected_at", True), ("id", False)], 20).select("id", "kind")


@query("SELECT CAST(e.event_id AS VARCHAR) AS id, CASE WHEN e.event_id % 4 = 0 THEN e.ts WHEN e.event_id % 3 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' END AS read_at FROM events e")
def notifications_read(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("read_at"), "event_id")
    at = e.where("event_id % 3 = 0").select("id", F.expr("TIMESTAMP '2024-02-01 00:00:00'").cast(e.schema["read_at"].dataType).alias("at"))
    return findings.marked_read(e, at.unionByName(at)).select("id", "read_at")


_OUTCOMES = _QUALITY[: _QUALITY.index("SELECT doc_id, n_chars, letters, wide_letters, bad, blanks, private_use, mojibake, cyrillic, round(confidence")]


@query(f"{_OUTCOMES}, q4 AS (SELECT doc_id, confidence >= 0.6 AND NOT coalesce(s2 OR s4 OR s5 OR s6 OR bad / n_chars >= 0.01, true) AS ok FROM q3) SELECT d.source, count(*) FILTER (WHERE o = 'skipped') AS skipped, count(*) FILTER (WHERE o = 'failed') AS failed, count(*) FILTER (WHERE o = 'out_of_scope') AS out_of_scope, count(*) FILTER (WHERE o = 'low_quality') AS low_quality, count(*) FILTER (WHERE o = 'indexed') AS indexed FROM (SELECT d.source, CASE WHEN d.doc_id % 5 = 0 THEN 'skipped' WHEN trim(coalesce(text, '')) = '' THEN 'failed' WHEN coalesce(lang, '') = 'ms' THEN 'out_of_scope' WHEN NOT ok THEN 'low_quality' ELSE 'indexed' END AS o FROM documents d JOIN q4 USING (doc_id)) d GROUP BY 1")
def process_outcomes(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("external_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "text", "lang", "source", "doc_id")
    ledger = d.where("doc_id % 5 in (0, 1)").select("external_id", "content_hash", F.when(F.col("doc_id") % 5 == 0, "indexed").otherwise("failed").alias("state"))
    out = process.outcomes(d, ledger, in_scope=F.coalesce("lang", F.lit("")) != "ms", expects_marks=F.coalesce("lang", F.lit("vi")) == "vi")
    return process.counters(out, ["source"])


_GRAMMAR_PAGE = """[{"id":"a1","docNum":"1/2024/TT-A","title":"T","docAbs":null,"docType":{"name":"Thông tư","code":"TT"},"agencyName":"A","effStatus":{"code":"CHL"},"issueDate":"2024-01-05T00:00:00","effFrom":"2024-02-01","effTo":null,"hasContent":true},{"id":"","docNum":"x"},{"id":"b2","effStatus":{"code":"TDHL"},"issueDate":"?"}]"""
_ACTS_PAGE = """{"recordsTotal":3,"records":[{"lgt_act_id":"7","lgt_act_no":"12","title":"<a href=\\"x?act=7&lang=BI&t\\">* Banking <b>Act</b> 1989</a><i>As At</i> <i>05-03-2021</i>","doc2downloadgeneratepdf":"[{\\"path\\":\\"/7_BM/\\",\\"docName\\":\\"bm.pdf\\",\\"icon\\":\\"m\\"},{\\"path\\":\\"/7_BI/\\",\\"docName\\":\\"Act 12.pdf\\",\\"icon\\":\\"e\\"}]"},{"lgt_act_id":"8","lgt_act_no":"13","title":"plain","doc2downloadgeneratepdf":""},{"lgt_act_id":""}]}"""


@query("SELECT * FROM (VALUES ('a1', '1/2024/TT-A', 'Thông tư', 'in_force', DATE '2024-01-05', DATE '2024-02-01'), ('b2', NULL, NULL, 'repealed', NULL, NULL)) v(external_id, number, doc_type, validity_status, issued, effective)")
def portal_pages(spark, sf):
    pages = spark.createDataFrame([(_GRAMMAR_PAGE,), ("{broken",), (None,)], "content string")
    r = records.portal_records(pages)
    return r.select("external_id", "number", "doc_type", V.map_validity(F.col("status"), F.col("effective"), F.expr(MOMENT)).alias("validity_status"), "issued", "effective")


@query("SELECT * FROM (VALUES ('7', 'Act 12', 'Banking Act 1989', DATE '2021-03-05', 'https://site.test/ilims/7_BI/Act%2012.pdf'), ('8', 'Act 13', '', NULL, NULL)) v(external_id, number, title, issued, file_url)")
def act_pages(spark, sf):
    r = records.act_records(spark.createDataFrame([(_ACTS_PAGE,), ("[]",), (None,)], "content string"), "https://site.test/")
    return r.select("external_id", "number", "title", "issued", F.col("file.url").alias("file_url"))


_SLUGS = [
    ("https://x.test/van-ban/quyet-dinh-so-840-qd-ttg-12345.htm?a=1", "12345", "840/QĐ-TTG", "Quyết định"), ("/thong-tu-lien-tich-so-5-2019-ttlt-nhnn-77.htm", "77", "5/2019/TTLT-NHNN", "Thông tư liên tịch"),
    ("nghi-dinh-12-2020-nd-cp-9.htm", "9", "12/2020/NĐ-CP", "Nghị định"), ("luat-so-46-8.htm", "8", "46", "Luật"), ("https://x.test/trang-chu/", None, "TRANG/CHU", None), ("", None, None, None),
]
_SLUG_VALUES = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in _SLUGS)


@query(f"SELECT * FROM (VALUES {_SLUG_VALUES}) v(url, id, number, doc_type)")
def gazette_slugs(spark, sf):
    urls = spark.createDataFrame([(row[0],) for row in _SLUGS], "url string").withColumn("p", records.slug_parts(F.col("url")))
    return urls.select("url", "p.id", records.slug_number(F.col("p.slug")).alias("n")).select("url", "id", "n.number", "n.doc_type")


# --- extensions over events -------------------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ev_tumbling(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query(", b AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS t0, event_id FROM events), x AS (SELECT t0 AS start FROM b UNION ALL SELECT t0 - INTERVAL 6 HOUR FROM b) SELECT start, count(*) AS n FROM x GROUP BY 1")
def ev_sliding(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query(", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM k GROUP BY user_id, k")
def ev_session(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_rollup(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT n, count(*) AS k FROM (SELECT so_ky_hieu AS n FROM search_item INTERSECT SELECT docnum FROM doc_item) GROUP BY 1 UNION ALL SELECT n, -1 FROM (SELECT so_ky_hieu AS n FROM search_item EXCEPT SELECT docnum FROM doc_item)")
def set_ops(spark, sf):
    a, b = table(spark, sf, "search_item").select(F.col("so_ky_hieu").alias("n")), table(spark, sf, "doc_item").select("docnum")
    return a.intersect(b).groupBy("n").agg(F.count("*").alias("k")).unionByName(a.subtract(b).withColumn("k", F.lit(-1).cast("bigint")))


@query()
def approx_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("n_parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median_price"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQLS)
