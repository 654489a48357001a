"""Retrieval, mapping and question-answering metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from normloom.functions.text import fold_nfc


def retrieval(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """Per case: n_want, n_found, recall, reciprocal_rank, precision, in_force_precision.

    expected: case_id, item; hits: case_id, item, rank, current. A trailing run of hits that aren't current law doesn't count
    for the in-force precision. Cases without expectations have null recall and rank; without hits, null precisions.
    """
    want = expected.where("item is not null").select("case_id", "item").distinct()
    trimmed = hits.withColumn("last_current", F.max(F.when(F.col("current"), F.col("rank"))).over(Window.partitionBy("case_id")))
    trimmed = trimmed.withColumn("kept", F.col("last_current").isNull() | (F.col("rank") <= F.col("last_current")))
    marked = trimmed.join(want.withColumn("wanted", F.lit(True)), ["case_id", "item"], "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
    per = marked.groupBy("case_id").agg(
        F.count_distinct(F.when(F.col("wanted"), F.col("item"))).alias("n_found"), F.min(F.when(F.col("wanted"), F.col("rank"))).alias("first"), F.count("*").alias("n_hits"),
        F.count_if("wanted").alias("n_right"), F.count_if(F.col("kept") & F.col("current")).alias("n_current"), F.count_if("kept").alias("n_kept"),
    )
    n = want.groupBy("case_id").agg(F.count("*").alias("n_want"))
    out = per.join(n, "case_id", "full_outer").fillna(0, ["n_found", "n_hits", "n_right", "n_current", "n_kept", "n_want"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({
        "recall": share("n_found", "n_want"), "reciprocal_rank": F.when(F.col("n_want") > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0))),
        "precision": share("n_right", "n_hits"), "in_force_precision": share("n_current", "n_kept"),
    }).drop("first")


def roll_up(cases: DataFrame) -> DataFrame:
    """One row: micro-averages (sums over sums) and the mean reciprocal rank over cases with expectations; a metric without a
    denominator is null, not 0."""
    part = lambda a, b: F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 9)
    return cases.agg(
        F.count("*").alias("n_cases"), part("n_found", "n_want").alias("recall"), F.round(F.avg("reciprocal_rank"), 9).alias("mrr"),
        part("n_right", "n_hits").alias("precision"), part("n_current", "n_kept").alias("in_force_precision"),
    )


def abstention(cases: DataFrame, floor: float = 0.0) -> DataFrame:
    """cases (case_id, expect_abstain, n_hits, top_score) with abstains and correct: no hits, or a top score under a positive floor."""
    low = (F.coalesce("top_score", F.lit(0.0)) < floor) if floor > 0 else F.lit(False)
    out = cases.withColumn("abstains", (F.col("n_hits") == 0) | low)
    return out.withColumn("correct", F.col("abstains") == F.col("expect_abstain"))


def confusion(pairs: DataFrame) -> DataFrame:
    """One row of counts, precision and recall from expected and predicted (booleans)."""
    e, p = F.col("expected"), F.col("predicted")
    out = pairs.agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"))
    share = lambda n, d: F.round(F.when(d > 0, n / d), 9)
    return out.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})


def failing(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(metric, value, floor) of the metrics below their floor; metrics without data and floors of 0 are skipped."""
    live = {m: f for m, f in floors.items() if f > 0}
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(f).alias("floor")) for m, f in live.items()]))
    return metrics.select(rows.alias("m")).select("m.*").where("value < floor")


def citation_match(number: Column, segments: Column, hit_number: Column, path: Column, heading: Column) -> Column:
    """Whether a hit is the expected citation: its number, path and heading together hold the expected number, and path and heading hold every
    segment. Arguments are folded already (composed, lower case); null and empty segments ask for nothing."""
    text = lambda c: F.coalesce(c, F.lit(""))
    place = F.concat_ws(" ", text(path), text(heading))
    whole = F.concat_ws(" ", text(hit_number), text(path), text(heading))
    return whole.contains(text(number)) & F.forall(F.coalesce(segments, F.array().cast("array<string>")), lambda s: place.contains(text(s)))


def retrieval_by_citation(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """The metrics of retrieval() with citations instead of ids.

    expected: case_id, doc_number, segments; hits: case_id, rank, doc_number, citation_path, heading_path, current. A citation expected twice counts
    twice. Texts are folded once per row, then each case's few expectations meet its hits."""
    e = expected.select("case_id", F.monotonically_increasing_id().alias("no"), fold_nfc("doc_number").alias("n"), F.transform(F.split(fold_nfc(F.array_join(F.coalesce("segments", F.array().cast("array<string>")), "\x00")), "\x00"), lambda s: s).alias("segs"))
    h = hits.select("case_id", "rank", "current", fold_nfc("doc_number").alias("hn"), fold_nfc("citation_path").alias("hp"), fold_nfc("heading_path").alias("hh"))
    pairs = e.join(h, "case_id").where(citation_match(F.col("n"), F.col("segs"), F.col("hn"), F.col("hp"), F.col("hh")))
    found = pairs.groupBy("case_id").agg(F.count_distinct("no").alias("n_found"), F.min("rank").alias("first"), F.count_distinct("rank").alias("n_right"))
    last = Window.partitionBy("case_id")
    kept = h.withColumn("last", F.max(F.when(F.col("current"), F.col("rank"))).over(last)).withColumn("kept", F.col("last").isNull() | (F.col("rank") <= F.col("last")))
    seen = kept.groupBy("case_id").agg(F.count("*").alias("n_hits"), F.count_if(F.col("kept") & F.col("current")).alias("n_current"), F.count_if("kept").alias("n_kept"))
    want = e.groupBy("case_id").agg(F.count("*").alias("n_want"))
    out = want.join(seen, "case_id", "full_outer").join(found, "case_id", "left").fillna(0, ["n_want", "n_hits", "n_current", "n_kept", "n_found", "n_right"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumns({
        "recall": share("n_found", "n_want"), "reciprocal_rank": F.when(F.col("n_want") > 0, F.coalesce(1.0 / F.col("first"), F.lit(0.0))),
        "precision": share("n_right", "n_hits"), "in_force_precision": share("n_current", "n_kept"),
    }).drop("first")


def answers(cases: DataFrame) -> DataFrame:
    """One row from question-answering cases (expected_kind, kind, expected_contains, citations: array of paths): n_cases, abstention_accuracy (share of cases of the
    expected kind), n_cited, citation_correctness (share of the answered ones, where an answer is expected, that cite what is expected; without an expectation any answer is
    right). A share without cases is 1."""
    asked = (F.col("expected_kind") == "answer") & (F.col("kind") == "answer")
    wanted = F.coalesce("expected_contains", F.lit(""))
    right = (wanted == "") | F.exists(F.coalesce("citations", F.array().cast("array<string>")), lambda c: c.contains(wanted))
    out = cases.agg(F.count("*").alias("n_cases"), F.count_if(F.col("expected_kind") == F.col("kind")).alias("a"), F.count_if(asked).alias("n_cited"), F.count_if(asked & right).alias("c"))
    share = lambda n, d: F.round(F.when(F.col(d) == 0, 1.0).otherwise(F.col(n) / F.col(d)), 9)
    return out.select("n_cases", share("a", "n_cases").alias("abstention_accuracy"), "n_cited", share("c", "n_cited").alias("citation_correctness"))
