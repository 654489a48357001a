"""Corpus registry and access tiers. Anything unknown counts as the strictest."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PUBLIC, GROUP, LOCAL = "public", "group-confidential", "local-confidential"


@dataclass(frozen=True)
class Corpus:
    id: str
    kind: str
    tier: str
    jurisdiction: str | None
    can_source: bool
    can_target: bool
    default_edges: str
    satisfies_target: str | None
    dimensions: int = 1536


#: The seven built-in corpora.
CORPORA = (
    Corpus("vn-reg", "law", PUBLIC, "vn", False, True, "", None),
    Corpus("my-reg", "law", PUBLIC, "my", False, True, "", None),
    Corpus("group-std", "standard", GROUP, "my", True, True, "implements", "my-reg"),
    Corpus("local-policy", "policy", LOCAL, "vn", True, True, "satisfies,implements", "vn-reg"),
    Corpus("local-sop", "sop", LOCAL, "vn", True, False, "derives", None),
    Corpus("reports", "report", LOCAL, None, True, False, "concerns", None),
    Corpus("diagrams", "diagram", LOCAL, None, True, False, "concerns", None),
)
ROLES = ("public", "group", "local")


def registry(spark: SparkSession, extra: tuple[Corpus, ...] = ()) -> DataFrame:
    """The registry as a DataFrame. Extra corpora need a new id and the shared number of dimensions."""
    known = {c.id for c in CORPORA}
    for c in extra:
        if c.id in known or not c.id:
            raise ValueError(f"corpus {c.id!r} exists or has no id")
        if c.dimensions != CORPORA[0].dimensions:
            raise ValueError(f"corpus {c.id!r} has another embedding space")
        known.add(c.id)
    columns = "corpus_id string, kind string, tier string, jurisdiction string, can_source boolean, can_target boolean, default_edges string, satisfies_target string, dimensions int"
    return spark.createDataFrame([astuple(c) for c in (*CORPORA, *extra)], columns)


def role_rank(role: str) -> int:
    """'' means public; an unknown role is an error."""
    if role and role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    return ROLES.index(role or "public")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == PUBLIC, 0).when(tier == GROUP, 1).otherwise(2)


def corpus_tier(corpus: Column) -> Column:
    by_tier = {t: [c.id for c in CORPORA if c.tier == t] for t in (PUBLIC, GROUP)}
    return F.when(corpus.isin(by_tier[PUBLIC]), PUBLIC).when(corpus.isin(by_tier[GROUP]), GROUP).otherwise(LOCAL)


def stricter_tier(a: Column, b: Column) -> Column:
    return F.when(tier_rank(a) >= tier_rank(b), a).otherwise(b)


def row_visible(role: str, corpus: Column, tier: Column) -> Column:
    """Row policy of the corpus tables: the role must reach the corpus, and a law or group corpus shows no row that is
    stricter than itself to anyone."""
    rank = tier_rank(corpus_tier(corpus))
    return (F.lit(role_rank(role)) >= rank) & ((rank == 2) | (tier_rank(tier) <= rank))


def tier_visible(role: str, tier: Column) -> Column:
    """Row policy of edges, findings and references: by their own tier."""
    return tier_rank(tier) <= role_rank(role)


def strictest(corpora: Column) -> Column:
    """The strictest tier over an array of corpus ids; an empty array or a null entry is the strictest of all."""
    ranks = F.transform(corpora, lambda c: tier_rank(corpus_tier(F.coalesce(c, F.lit("")))))
    rank = F.when(F.size(F.coalesce(corpora, F.array().cast("array<string>"))) == 0, 2).otherwise(F.array_max(ranks))
    return F.when(rank == 0, PUBLIC).when(rank == 1, GROUP).otherwise(LOCAL)


#: The links of the control chain that no column of the registry states.
CONTROL_CHAIN = {("local-sop", "local-policy"): "derives", ("local-policy", "group-std"): "implements"}


def edge_pairs(spark: SparkSession, extra: tuple[Corpus, ...] = ()) -> DataFrame:
    """(from_corpus, to_corpus, edge_type) of every pair that may be linked: the control chain; satisfies where the source's
    satisfies_target is the target; the first default edge of reports and diagrams to anything that can be a target."""
    corpora, rows = (*CORPORA, *extra), []
    for a in corpora:
        for b in corpora:
            if kind := CONTROL_CHAIN.get((a.id, b.id)):
                rows.append((a.id, b.id, kind))
            elif a.satisfies_target and a.satisfies_target == b.id:
                rows.append((a.id, b.id, "satisfies"))
            elif a.kind in ("report", "diagram") and a.can_source and b.can_target and a.default_edges:
                rows.append((a.id, b.id, a.default_edges.split(",")[0]))
    return spark.createDataFrame(rows, "from_corpus string, to_corpus string, edge_type string")
