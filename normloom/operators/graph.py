"""The compliance graph: references, edges with evidence, node views, chains, derived coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.functions import tiers

MAX_DEPTH = 8
UP_TYPES = ("derives", "satisfies", "implements")


def ref_key(corpus: Column, number: Column) -> Column:
    return F.concat(corpus, F.lit(":"), F.upper(F.trim(number)))


def ensure_refs(named: DataFrame) -> DataFrame:
    """One row per ref_key from rows of ref_key, label, document_id, seen (order): the first label wins, the ids are the first
    that aren't null; a reference without document is a stub."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seen", F.col(c))))[c].alias(c)
    return named.where("ref_key is not null").groupBy("ref_key").agg(first("label"), first("document_id"))


def resolve_stubs(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """refs with document_id filled in for stubs whose key a document (ref_key, id) has; resolved ones never change."""
    one = documents.where("ref_key is not null").groupBy("ref_key").agg(F.min("id").alias("found"))
    out = refs.join(one, "ref_key", "left")
    return out.withColumn("flipped", F.col("document_id").isNull() & F.col("found").isNotNull()).withColumn("document_id", F.coalesce("document_id", "found")).drop("found")


def first_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target, edge_type), the first created, ties by id; rows without source, target or type are ignored."""
    whole = edges.where("source is not null and target is not null and edge_type is not null")
    cols = [c for c in whole.columns if c not in ("source", "target", "edge_type")]
    rest = [c for c in cols if c not in ("created_at", "id")]
    one = whole.groupBy("source", "target", "edge_type").agg(F.min(F.struct("created_at", "id", *rest)).alias("e"))
    return one.select("source", "target", "edge_type", *[f"e.{c}" for c in cols])


def best_evidence(evidence: DataFrame) -> DataFrame:
    """The evidence with the most confidence per edge_id, the first (by seen) on a tie; null confidence counts least."""
    rest = [c for c in evidence.columns if c not in ("edge_id", "confidence", "seen")]
    lead = F.struct(F.coalesce("confidence", F.lit(-1.0)).alias("c"), (-F.col("seen")).alias("s"), "confidence", *rest)
    return evidence.groupBy("edge_id").agg(F.max(lead).alias("b")).select("edge_id", "b.confidence", *[f"b.{c}" for c in rest])


def node_view(edges: DataFrame) -> DataFrame:
    """Per node what leaves it, by type, and whether any edge is promoted; a node without visible edges isn't there."""
    return edges.groupBy(F.col("source").alias("node")).agg(
        F.count("*").alias("n_edges"), F.count_distinct("edge_type").alias("n_types"), F.count_if(F.col("promoted")).alias("n_promoted"), F.round(F.max("confidence"), 9).alias("best_confidence")
    )


def up_edges(edges: DataFrame, types: tuple[str, ...] = UP_TYPES) -> DataFrame:
    """The one edge that a chain follows from each node: the first created, ties by id. Filter by role before."""
    cols = ["target", "edge_type", "promoted"]
    up = edges.where(F.col("edge_type").isin(*types)).groupBy("source").agg(F.min(F.struct("created_at", "id", *cols)).alias("e"))
    return up.select("source", *[f"e.{c}" for c in cols])


def chains(starts: DataFrame, edges: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """start, hops (array of struct(edge_type, target, promoted)) for all starts (node) at once.

    A chain ends where no edge leaves, at a node met before (self-loops give no hop) and after depth hops (1 to 8; anything else
    is 8). One join per hop over the single up-edge of each node; the plan is bounded, nothing is collected.
    """
    depth = depth if 0 < depth <= MAX_DEPTH else MAX_DEPTH
    up = up_edges(edges)
    now = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.array("node").alias("seen"), F.array().cast("array<struct<edge_type:string,target:string,promoted:boolean>>").alias("hops"))
    for _ in range(depth):
        step = now.join(up, now["at"] == up["source"], "left")
        go = F.col("target").isNotNull() & ~F.array_contains("seen", F.coalesce("target", F.lit("")))
        now = step.select(
            "start", F.when(go, F.col("target")).alias("at"), F.when(go, F.concat("seen", F.array("target"))).otherwise(F.col("seen")).alias("seen"),
            F.when(go, F.concat("hops", F.array(F.struct("edge_type", "target", "promoted")))).otherwise(F.col("hops")).alias("hops"),
        )
    return now.select("start", "hops")


def covers(chain: DataFrame, corpus_of) -> DataFrame:
    """(source, target): chains whose hops are all promoted and whose end lies in a law corpus; corpus_of maps a node column."""
    end = F.try_element_at("hops", F.lit(-1))["target"]
    law = corpus_of(end).isin(*[c.id for c in tiers.CORPORA if c.kind == "law"])
    return chain.where((F.size("hops") > 0) & F.forall("hops", lambda h: h["promoted"])).where(law).select(F.col("start").alias("source"), end.alias("target"))


def canvas(edges: DataFrame, cap: int = 500) -> DataFrame:
    """The newest edges, at most cap, ties by id."""
    return edges.orderBy(F.desc("created_at"), "id").limit(cap)


def canvas_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in."""
    both = edges.select(F.col("source").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def rank_per_left(left: DataFrame, right: DataFrame, on: list[str], score: Column, key: str, k: int) -> DataFrame:
    """Candidates: for every left row the k best right rows that share the block columns, by score, ties by key."""
    order = Window.partitionBy("left_id").orderBy(F.desc("score"), key)
    return left.join(right, on).withColumn("score", score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


# --- writing -------------------------------------------------------------------------------------------------------------

#: How documents write the relation to what they control, and the corpus that a source's relation leads to.
RELATION_VERBS = {"implements": "implements", "derives": "derives", "derives from": "derives"}
TARGET_CORPORA = {("local-policy", "implements"): "group-std", ("local-sop", "derives"): "local-policy"}
EDGE_KEY = ["from_corpus", "from_document", "ref_key", "edge_type"]


def relation_verb(written: Column) -> Column:
    """implements or derives, whatever the case and outer blanks; null for anything else."""
    clean, out = F.lower(F.trim(written)), F.when(F.lit(False), F.lit(""))
    for said, verb in RELATION_VERBS.items():
        out = out.when(clean == said, F.lit(verb))
    return out


def target_corpus(source: Column, verb: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for (corpus, v), target in TARGET_CORPORA.items():
        out = out.when((source == corpus) & (verb == v), F.lit(target))
    return out


def control_refs(headers: DataFrame) -> DataFrame:
    """One row per usable reference of document headers (corpus_id, doc_id, owner, refs: array of struct(relation, target_number,
    target_title, quoted_span)): relation, target_number, target_title (trimmed, empty as null), quoted_span. References with another relation, or with neither number
    nor title, are dropped; null lists and empty ones give none."""
    each = headers.select("corpus_id", "doc_id", "owner", F.explode("refs").alias("r"))
    text = lambda c: F.nullif(F.trim(F.col(f"r.{c}")), F.lit("")).alias(c)
    rows = each.select("corpus_id", "doc_id", "owner", relation_verb(F.col("r.relation")).alias("relation"), text("target_number"), text("target_title"), F.col("r.quoted_span").alias("quoted_span"))
    return rows.where("relation is not null and (target_number is not null or target_title is not null)")


def extract_edges(headers: DataFrame, documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidate edges from the headers' references: from_corpus, from_document, to_corpus, to_document (null for a stub), ref_key, label, edge_type,
    direction, quoted_from, created_by.

    documents: corpus_id, doc_number, id; of several with one number the smallest id. The target's corpus follows from source and relation; other
    combinations are dropped, as are pairs that pairs (of tiers.edge_pairs) doesn't know. A reference by title alone is a stub under its title."""
    refs = control_refs(headers).withColumn("to_corpus", target_corpus(F.col("corpus_id"), F.col("relation"))).where("to_corpus is not null")
    known = documents.where("doc_number is not null").groupBy(F.col("corpus_id").alias("to_corpus"), F.col("doc_number").alias("target_number")).agg(F.min("id").alias("to_document"))
    found = refs.join(known, ["to_corpus", "target_number"], "left").join(F.broadcast(pairs.select(F.col("from_corpus").alias("corpus_id"), "to_corpus", "edge_type")), ["corpus_id", "to_corpus"])
    return found.select(
        F.col("corpus_id").alias("from_corpus"), F.col("doc_id").alias("from_document"), "to_corpus", "to_document", ref_key(F.col("to_corpus"), F.coalesce("target_number", "target_title")).alias("ref_key"),
        F.col("target_title").alias("label"), "edge_type", F.lit("up").alias("direction"), F.col("quoted_span").alias("quoted_from"), F.col("owner").alias("created_by"),
    )


def checked_roles(edges: DataFrame) -> DataFrame:
    """edges, failing where a corpus isn't registered, the source can't be one, or the target can't be one."""
    named = lambda test: [c.id for c in tiers.CORPORA if test(c)]
    good = F.col("from_corpus").isin(*named(lambda c: c.can_source)) & F.col("to_corpus").isin(*named(lambda c: c.can_target))
    failure = F.raise_error(F.concat(F.lit("no edge may lead from "), F.coalesce("from_corpus", F.lit("null")), F.lit(" to "), F.coalesce("to_corpus", F.lit("null"))))
    return edges.withColumn("from_corpus", F.when(F.coalesce(good, F.lit(False)), F.col("from_corpus")).otherwise(failure))


def edge_id() -> Column:
    """The id of an edge: a digest of its natural key, so that writing it again changes nothing."""
    return F.left(F.sha2(F.concat_ws("\x00", *EDGE_KEY), 256), F.lit(32))


def write_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """edges after writing candidates: id, the natural key, to_corpus, direction, promoted, seen. A key that exists keeps its row, promoted or not; of several new
    ones of a key the first seen counts; new ones aren't promoted."""
    columns = ["id", *EDGE_KEY, "to_corpus", "direction", "promoted", "seen"]
    made = checked_roles(new).groupBy(*EDGE_KEY).agg(F.min(F.struct("seen", "to_corpus", F.coalesce("direction", F.lit("up")).alias("direction"))).alias("e"))
    made = made.select(edge_id().alias("id"), *EDGE_KEY, "e.to_corpus", "e.direction", F.lit(False).alias("promoted"), "e.seen")
    return existing.select(*columns).unionByName(made.join(existing.select(*EDGE_KEY), EDGE_KEY, "left_anti"))


def write_evidence(existing: DataFrame, new: DataFrame) -> DataFrame:
    """evidence after appending: one row per (edge_id, kind), the first (an existing one, else the first seen) counts."""
    rest = [c for c in existing.columns if c not in ("edge_id", "kind", "seen")]
    made = new.groupBy("edge_id", "kind").agg(F.min(F.struct("seen", *rest)).alias("e")).select("edge_id", "kind", "e.seen", *[f"e.{c}" for c in rest])
    return existing.select("edge_id", "kind", "seen", *rest).unionByName(made.join(existing.select("edge_id", "kind"), ["edge_id", "kind"], "left_anti"))


def extracted_evidence(new: DataFrame) -> DataFrame:
    """The evidence of extracted edges: sure, with the quoted stretch."""
    return new.select(edge_id().alias("edge_id"), F.lit("extracted").alias("kind"), "seen", F.lit(1.0).alias("confidence"), F.lit(None).cast("double").alias("grounding_score"), "quoted_from", "created_by")


def model_evidence(new: DataFrame) -> DataFrame:
    """The evidence of judged edges, with the judge's scores."""
    return new.select(edge_id().alias("edge_id"), F.lit("model_classification").alias("kind"), "seen", "confidence", "grounding_score", "quoted_from", "created_by")


# --- reading -------------------------------------------------------------------------------------------------------------


def with_evidence(edges: DataFrame, evidence: DataFrame) -> DataFrame:
    """edges (id, ...) with evidence, the array of their rows in the order of seen and kind (at most one of each kind), empty without any."""
    kind = F.struct("seen", "kind", "confidence", "grounding_score")
    each = evidence.groupBy(F.col("edge_id").alias("id")).agg(F.array_sort(F.collect_list(kind)).alias("evidence"))
    return edges.join(each, "id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(each.schema["evidence"].dataType)))


def hop_rows(chain: DataFrame, edges: DataFrame, references: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per hop of chains(): start, hop_no (from 1), target, edge_type, promoted, citation, confidence, grounding_score.

    references: document_id, ref_key, label; the citation is the label, without one the key. evidence: edge_id, confidence, grounding_score, seen; the best
    one counts, null without any. The edge behind a hop is the one that leaves the node before it."""
    hops = chain.select("start", F.posexplode("hops").alias("at", "h"), "hops")
    before = F.when(F.col("at") == 0, F.col("start")).otherwise(F.get("hops", F.col("at") - 1)["target"])
    hops = hops.select("start", (F.col("at") + 1).alias("hop_no"), before.alias("source"), "h.target", "h.edge_type", "h.promoted")
    up = edges.where(F.col("edge_type").isin(*UP_TYPES)).groupBy("source").agg(F.min(F.struct("created_at", "id"))["id"].alias("edge_id"))
    best = best_evidence(evidence.select("edge_id", "confidence", "seen", "grounding_score"))
    named = references.groupBy(F.col("document_id").alias("target")).agg(F.min(F.struct("ref_key", "label")).alias("n"))
    out = hops.join(up, "source", "left").join(best, "edge_id", "left").join(named, "target", "left")
    citation = F.coalesce(F.nullif(F.col("n.label"), F.lit("")), F.col("n.ref_key"))
    return out.select("start", "hop_no", "target", "edge_type", "promoted", citation.alias("citation"), "confidence", "grounding_score")


def visible_evidence(evidence: DataFrame, edges: DataFrame, role: str) -> DataFrame:
    """Evidence of the edges (id, access_tier) that the role may see."""
    return evidence.join(edges.where(tiers.tier_visible(role, F.col("access_tier"))).select(F.col("id").alias("edge_id")), "edge_id", "left_semi")


def visible_references(references: DataFrame, role: str) -> DataFrame:
    """References (corpus_id) of the corpora that the role may see."""
    return references.where(tiers.tier_visible(role, tiers.corpus_tier(F.col("corpus_id"))))
