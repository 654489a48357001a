"""Findings: gaps, stale controls, conflicts; deduplication, tiers, review and notification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normloom.functions import tiers


def gate(min_confidence: float = 0.7, min_grounding: float = 0.6) -> Column:
    """Both thresholds inclusive; null or NaN passes neither."""
    ok = lambda c, t: F.coalesce((F.col(c) >= t) & ~F.isnan(c), F.lit(False))
    return ok("confidence", min_confidence) & ok("grounding_score", min_grounding)


def gaps(nodes: DataFrame, edges: DataFrame, wanted: list[tuple[str, str, str, str]]) -> DataFrame:
    """Findings for nodes (node, corpus_id) that lack an edge. wanted: (corpus, direction 'out' or 'in', edge type, gap name)."""
    parts = []
    for corpus, direction, kind, name in wanted:
        have = edges.where(F.col("edge_type") == kind).select(F.col("source" if direction == "out" else "target").alias("node")).distinct()
        lacking = nodes.where(F.col("corpus_id") == corpus).join(have, "node", "left_anti")
        parts.append(lacking.select(F.lit("gap").alias("kind"), F.lit("medium").alias("severity"), "node", "corpus_id", F.lit(name).alias("detail"), F.concat(F.lit(f"gap:{name}:"), "node").alias("dedup_key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stale(edges: DataFrame, amended: DataFrame) -> DataFrame:
    """Findings for nodes whose upstream (node, amended_on) was amended strictly after the edge was made: one per edge."""
    late = edges.join(amended.withColumnRenamed("node", "target"), "target").where(F.col("amended_on") > F.col("created_at"))
    return late.select(F.lit("stale").alias("kind"), F.lit("high").alias("severity"), F.col("source").alias("node"), F.col("target").alias("upstream"), "amended_on", F.concat(F.lit("stale:"), "source", F.lit(":"), "target").alias("dedup_key"))


def conflicts(edges: DataFrame) -> DataFrame:
    """Sources that satisfy one target and implement another: candidates of a contradiction, one row per pair of targets."""
    a = edges.where("edge_type = 'satisfies'").select("source", F.col("target").alias("law"))
    b = edges.where("edge_type = 'implements'").select("source", F.col("target").alias("standard"))
    return a.join(b, "source").distinct().withColumn("dedup_key", F.concat_ws(":", F.lit("conflict"), "standard", "law", "source"))


def new_findings(found: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """The found rows whose dedup_key doesn't exist yet, the first of each key by order; only these are counted."""
    rest = [c for c in found.columns if c != "dedup_key" and c not in order]
    first = found.where("dedup_key is not null").groupBy("dedup_key").agg(F.min(F.struct(*order, *rest)).alias("f"))
    return first.select("dedup_key", *[f"f.{c}" for c in (*order, *rest)]).join(existing.select("dedup_key"), "dedup_key", "left_anti")


def with_tier(found: DataFrame, corpora: str = "corpora") -> DataFrame:
    return found.withColumn("access_tier", tiers.strictest(F.col(corpora)))


def about_node(found: DataFrame, corpus: str | Column, document: str | Column, section: str | None = None) -> DataFrame:
    """Findings whose node_refs hold the node; without a section any section of the document."""

    def same(n: Column) -> Column:
        hit = (n["corpus_id"] == F.col("_corpus")) & (n["document_id"] == F.col("_document"))
        return hit if section is None else hit & n["section_id"].eqNullSafe(F.lit(section))

    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return found.withColumns({"_corpus": column(corpus), "_document": column(document)}).where(F.exists("node_refs", same)).drop("_corpus", "_document")


def review_queue(edges: DataFrame, by_confidence: bool = False) -> DataFrame:
    """Unpromoted edges, oldest first, or surest first."""
    order = ([F.desc_nulls_last("confidence")] if by_confidence else []) + [F.asc("created_at"), F.asc("id")]
    return edges.where(~F.col("promoted")).orderBy(*order)


def apply_review(edges: DataFrame, actions: DataFrame) -> DataFrame:
    """edges after the actions (id, action, new_target): promote sets the flag and full confidence, reject removes, relink
    sets the target. The last action (by seen) on an edge counts. Actions on unknown edges change nothing."""
    last = actions.groupBy("id").agg(F.max(F.struct("seen", "action", "new_target")).alias("a"))
    out = edges.join(last, "id", "left")
    action = F.col("a.action")
    out = out.where(action.isNull() | (action != "reject"))
    return out.withColumns({
        "promoted": F.when(action == "promote", True).otherwise(F.col("promoted")),
        "confidence": F.when(action == "promote", 1.0).otherwise(F.col("confidence")),
        "target": F.when(action == "relink", F.col("a.new_target")).otherwise(F.col("target")),
    }).drop("a")


SEVERITY = ("low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for i, s in enumerate(SEVERITY):
        out = out.when(severity == s, F.lit(i))
    return out


def fan_out(found: DataFrame, hooks: DataFrame) -> DataFrame:
    """Deliveries (finding, hook): active hooks whose kinds hold the finding's (or are empty), with a minimal severity no
    higher and a tier no lower than the finding's. Hooks: hook_id, kinds, min_severity, tier, active; few rows."""
    ready = hooks.where("active")
    fits = (
        ((F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind")))
        & (severity_rank(F.col("severity")) >= severity_rank(F.coalesce("min_severity", F.lit("medium"))))
        & (tiers.tier_rank(F.col("access_tier")) <= tiers.tier_rank(F.col("tier")))
    )
    return found.join(ready, fits).drop("kinds", "min_severity", "tier", "active")


def judged_conflicts(candidates: DataFrame, judge, ground, min_confidence: float = 0.7, min_grounding: float = 0.6) -> DataFrame:
    """Critical findings from candidates (standard, law, source, standard_corpus, law_corpus, standard_text, law_text) that the judge calls a contradiction and the grounder
    supports: kind, severity, status, node_refs (standard, then law), evidence, dedup_key.

    judge(text, text) gives edge_type, confidence and rationale; ground(rationale, both texts) a score, null where the rationale has no support. Scores gate as gate()."""
    seen = candidates.withColumn("j", judge("standard_text", "law_text")).where("j.edge_type = 'contradiction'")
    both = F.concat_ws("\n---\n", "standard_text", "law_text")
    seen = seen.withColumn("grounding_score", ground("j.rationale", both)).withColumn("confidence", F.col("j.confidence")).where(gate(min_confidence, min_grounding))
    node = lambda corpus, doc: F.struct(F.col(corpus).alias("corpus_id"), F.col(doc).alias("document_id"), F.lit(None).cast("string").alias("section_id"))
    return seen.select(
        F.lit("conflict").alias("kind"), F.lit("critical").alias("severity"), F.lit("open").alias("status"), F.array(node("standard_corpus", "standard"), node("law_corpus", "law")).alias("node_refs"),
        F.struct(F.col("j.rationale").alias("rationale"), "confidence", "grounding_score").alias("evidence"), F.concat_ws(":", F.lit("conflict"), "standard", "law", "source").alias("dedup_key"),
    )


def listed(found: DataFrame, kind: str | None = None, status: str | None = None) -> DataFrame:
    """Findings of a kind and a status (none or empty: all), the newest first, ties by id; pages come from validity.page()."""
    for column, value in (("kind", kind), ("status", status)):
        if value:
            found = found.where(F.col(column) == value)
    return found.orderBy(F.desc("detected_at"), "id")


def add_resolutions(existing: DataFrame, new: DataFrame, found: DataFrame) -> DataFrame:
    """Resolutions after appending those (id, finding_id, ...) whose finding exists; an id that exists isn't written again."""
    good = new.join(found.select(F.col("id").alias("finding_id")), "finding_id", "left_semi").join(existing.select("id"), "id", "left_anti")
    return existing.unionByName(good.select(*existing.columns))


def visible_resolutions(resolutions: DataFrame, found: DataFrame, role: str) -> DataFrame:
    """Resolutions of the findings that the role may see."""
    return resolutions.join(found.where(tiers.tier_visible(role, F.col("access_tier"))).select(F.col("id").alias("finding_id")), "finding_id", "left_semi")


def review_evidence(actions: DataFrame) -> DataFrame:
    """The human evidence of promotions: edge_id, kind, confidence 1, created_by."""
    return actions.where("action = 'promote'").select(F.col("id").alias("edge_id"), F.lit("human").alias("kind"), "seen", F.lit(1.0).alias("confidence"), "created_by")


def unknown_actions(edges: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions on edges that don't exist."""
    return actions.join(edges.select("id"), "id", "left_anti")


def marked_read(notifications: DataFrame, read: DataFrame) -> DataFrame:
    """notifications (id, read_at) with read_at set for those of read (id, at) that had none; others stay."""
    one = read.groupBy("id").agg(F.min("at").alias("_at"))
    return notifications.join(one, "id", "left").withColumn("read_at", F.coalesce("read_at", "_at")).drop("_at")


def notifications_of(notifications: DataFrame, unread_only: bool = False) -> DataFrame:
    """The newest first, ties by falling id."""
    rows = notifications.where("read_at is null") if unread_only else notifications
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def active_hooks(hooks: DataFrame) -> DataFrame:
    return hooks.where("active").orderBy(F.desc("created_at"), "hook_id")
