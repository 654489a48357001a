"""Mixing sources to target weights.

Method: systematic sampling. Within a source every document of n tokens is expected the same number of times, the rate at
which the source has to be repeated; the expected copies are summed up in a fixed order, one random offset per source is
added, and a document is emitted once per integer boundary that its part of the sum crosses. The order goes by length, so
the boundaries fall on short and long documents alike and the token shares come out close to the targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normloom.plans.session import Scratch

#: Hash blocks per length class: the prefix sums of a source run in this many tasks per class.
BLOCKS = 64


def plan(sized: DataFrame, weights: DataFrame, total: float | None = None) -> DataFrame:
    """One row per wanted source: source, target_share, max_repeats, n_docs, tokens, target_tokens and rate.

    total is the wanted size of the mix; by default the largest that respects every max_repeats. A source without tokens
    or without a positive share takes no part (rate 0) and doesn't bound the size; the others' shares are scaled to 1.
    """
    have = sized.where("n_tokens > 0").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    want = weights.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = want.join(have, "source", "left").fillna(0, ["n_docs", "tokens"])
    live = (F.col("tokens") > 0) & (F.coalesce("target_share", F.lit(0.0)) > 0) & (F.coalesce("max_repeats", F.lit(0)) > 0)
    everything = Window.partitionBy(F.lit(1))  # one row per source
    both = both.withColumn("share", F.when(live, F.col("target_share"))).withColumn("share", F.col("share") / F.sum("share").over(everything))
    bound = F.min(F.col("tokens") * F.col("max_repeats") / F.col("share")).over(everything)
    size = bound if total is None else F.least(bound, F.lit(float(total)))
    both = both.withColumn("target_tokens", F.coalesce(F.col("share") * size, F.lit(0.0)))
    rate = F.when(live, F.least(F.col("target_tokens") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.withColumn("rate", rate).drop("share")


def mix(sized: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 0, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(copies, shares) from rows of key, source and n_tokens.

    copies: key, source, n_tokens, copy_no (from 1), one row per use of a document; no document is used more than
    max_repeats times. shares: per source target_share, actual_share, n_docs, docs_used, copies, tokens, tokens_out,
    max_repeats, most_copies. Documents without tokens (null and empty texts), of a null source or of one without a weight
    are never used. The same input and seed give the same mix, in any order of rows and any partitioning.
    """
    scratch = Scratch(sized.sparkSession, "mix")
    sized = scratch.write(sized.select(key, "source", F.col("n_tokens").cast("bigint").alias("n_tokens")), "sized")
    rates = scratch.write(plan(sized, weights, total), "plan")  # one row per source: small by nature

    small = F.broadcast(rates.select("source", "rate", "max_repeats"))
    docs = sized.where("n_tokens > 0").join(small, "source").where("rate > 0")
    docs = docs.withColumn("len_class", F.floor(F.log2("n_tokens") * 4)).withColumn("block", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(BLOCKS)))
    blocks = docs.groupBy("source", "len_class", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("len_class", "block").rowsBetween(Window.unboundedPreceding, -1)  # at most length classes x BLOCKS rows
    offsets = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "len_class", "block").orderBy("n_tokens", F.xxhash64(F.col(key).cast("string"), F.lit(seed + 1)), key)
    docs = docs.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(offsets), ["source", "len_class", "block"])
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 20)) / F.lit(1 << 20)  # 20 bits, so that the sums below stay exact
    place = F.col("before") + F.col("rank")
    crossed = F.floor(offset + F.col("rate") * place) - F.floor(offset + F.col("rate") * (place - 1))
    docs = docs.withColumn("copies", F.least(crossed, F.col("max_repeats").cast("bigint"))).where("copies > 0").select(key, "source", "n_tokens", "copies")
    docs = scratch.write(docs, "used")

    used = docs.groupBy("source").agg(
        F.count("*").alias("docs_used"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_out"), F.max("copies").alias("most_copies")
    )
    shares = rates.join(used, "source", "left").fillna(0, ["docs_used", "copies", "tokens_out", "most_copies"])
    whole = F.sum("tokens_out").over(Window.partitionBy(F.lit(1)))
    shares = shares.withColumn("actual_share", F.when(whole > 0, F.col("tokens_out") / whole).otherwise(0.0))
    out = docs.select(key, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"))
    return out, shares.select("source", "target_share", "actual_share", "n_docs", "docs_used", "copies", "tokens", "tokens_out", "max_repeats", "most_copies")
