"""History of changing attributes from snapshots.

Method: presence bitmaps. The snapshots of an entity are numbered in the order of their moments in words of 64; each state
sets one bit per snapshot in the word's bitmap of that state. The runs of set bits, carried over from word to word, are
the versions. An entity with very many snapshots is worked on in slices of its time; only one short row per slice is put in
order per entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normloom.plans.session import Scratch

WORD = 64
#: Slices that one entity is cut into at most: beyond MAX_SLICES x slice_rows snapshots the slices grow.
MAX_SLICES = 1000


def _clean(name: str, lower: bool):
    value = F.trim(F.col(name))
    return (F.lower(value) if lower else F.when(value != "", value)).alias(name)


def versions(
    snapshots: DataFrame,
    entity: str,
    folded: list[str],
    blank_is_null: list[str],
    observed: str = "observed_at",
    loaded: str = "loaded_at",
    slice_rows: int = 100_000,
) -> DataFrame:
    """One row per version: entity, version_no (from 1), the attributes, valid_from and valid_to (timestamps; null for the last).

    A version is a longest run of snapshots with equal attributes; folded ones are compared without case and outer blanks, of
    blank_is_null ones a blank equals a null. Of several snapshots with one moment the last loaded counts; of those loaded
    together the one with the largest attributes, so that repeated rows change nothing and any order of rows gives the same
    result; a null loaded counts as earliest. Rows without entity or moment are ignored. An entity with more than slice_rows
    snapshots is cut at quantiles of its moments into up to MAX_SLICES slices; bitmaps and moments are never gathered beyond a slice.
    """
    spark = snapshots.sparkSession
    attrs = [*folded, *blank_is_null]
    rows = snapshots.where(F.col(entity).isNotNull() & F.col(observed).isNotNull()).select(
        F.col(entity).alias("_e"), F.unix_micros(F.col(observed).cast("timestamp")).alias("_t"), F.unix_micros(F.col(loaded).cast("timestamp")).alias("_l"),
        *[_clean(a, True) for a in folded], *[_clean(a, False) for a in blank_is_null],
    )
    hot = rows.groupBy("_e").agg(F.count("*").alias("n")).where(F.col("n") > slice_rows)
    hot = Scratch(spark, "history").write(hot, "hot")
    sliced = hot.limit(1).count() > 0
    if sliced:
        steps = F.array(*[F.lit(i / MAX_SLICES) for i in range(1, MAX_SLICES)])
        cuts = rows.join(hot, "_e").groupBy("_e").agg(F.percentile_approx("_t", steps, MAX_SLICES * 10).alias("cuts"), F.first("n").alias("n"))
        parts = F.least(F.ceil(F.col("n") / slice_rows), F.lit(MAX_SLICES))
        cuts = cuts.select("_e", F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.element_at("cuts", F.floor(i * MAX_SLICES / parts).cast("int"))).alias("cuts"))
        at = F.size(F.filter("cuts", lambda c: c <= F.col("_t")))
        rows = rows.join(cuts, "_e", "left").withColumn("_s", F.when(F.col("cuts").isNull(), 0).otherwise(at)).drop("cuts")
    else:
        rows = rows.withColumn("_s", F.lit(0))

    rows = rows.repartition("_e", "_s")  # one shuffle for the steps that follow
    last = rows.groupBy("_e", "_s", "_t").agg(F.max(F.struct("_l", *attrs)).alias("v")).select("_e", "_s", "_t", F.struct(*[F.col(f"v.{a}").alias(a) for a in attrs]).alias("state"))
    at = F.row_number().over(Window.partitionBy("_e", "_s").orderBy("_t")) - 1
    bits = last.withColumn("i", at).withColumn("word", F.floor(F.col("i") / WORD)).withColumn("i", (F.col("i") % WORD).cast("int"))
    maps = bits.groupBy("_e", "_s", "word", "state").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("bits"), F.collect_list(F.struct("i", "_t")).alias("ts"))
    words = maps.groupBy("_e", "_s", "word").agg(
        F.collect_list(F.struct("state", "bits")).alias("maps"), F.array_sort(F.flatten(F.collect_list("ts"))).alias("ts")
    )
    words = words.withColumn("n", F.size("ts")).withColumn("tail", F.expr("filter(maps, m -> (shiftrightunsigned(m.bits, n - 1) & 1L) = 1L)[0].state"))

    order = Window.partitionBy("_e", "_s").orderBy("word")
    words = words.withColumn("carried", F.lag(F.struct("tail")).over(order))
    # A run starts at a set bit whose lower neighbour is not set; the lowest bit's neighbour is the last snapshot of the word before.
    begins = "aggregate(maps, 0L, (acc, m) -> acc | (m.bits & ~(shiftleft(m.bits, 1) | if(carried is not null and m.state <=> carried.tail, 1L, 0L))))"
    words = words.withColumn("starts", F.expr(begins)).withColumn("at", F.expr("filter(sequence(0, n - 1), p -> (shiftrightunsigned(starts, p) & 1L) = 1L)"))
    words = words.withColumn("before", F.coalesce(F.sum(F.size("at")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    back = Window.partitionBy("_e", "_s").orderBy(F.desc("word")).rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("next_start", F.last(F.expr("if(size(at) > 0, ts[at[0]]._t, null)"), ignorenulls=True).over(back))
    words = _joined_slices(words) if sliced else words.withColumns({"earlier": F.lit(0).cast("bigint"), "goes_on": F.lit(False), "later": F.lit(None).cast("bigint")})

    out = words.select("_e", "maps", "ts", "at", "before", "next_start", "earlier", "goes_on", "later", F.posexplode("at").alias("k", "p"))
    out = out.withColumn("k0", F.col("before") + F.col("k")).where(~(F.col("goes_on") & (F.col("k0") == 0)))  # a slice's first run may be the end of the one before
    state = F.expr("filter(maps, m -> (shiftrightunsigned(m.bits, p) & 1L) = 1L)[0].state")
    return out.select(
        F.col("_e").alias(entity), (F.col("earlier") + F.col("k0") + 1 - F.col("goes_on").cast("int")).cast("int").alias("version_no"), state.alias("state"),
        F.timestamp_micros(F.expr("ts[p]._t")).alias("valid_from"), F.timestamp_micros(F.expr("coalesce(get(ts, get(at, k + 1))._t, next_start, later)")).alias("valid_to"),
    ).select(entity, "version_no", *[F.col(f"state.{a}").alias(a) for a in attrs], "valid_from", "valid_to")


def _joined_slices(words: DataFrame) -> DataFrame:
    """words with earlier (versions that begin in slices before), goes_on (whether the slice's first run continues the last one of the slice
    before) and later (the first beginning in a slice behind), from one row per slice: first and last state, number of runs and the moments
    of the first two."""
    runs = F.struct(F.col("word").alias("w"), F.expr("filter(maps, m -> (m.bits & 1L) = 1L)[0].state").alias("head"), F.expr("ts[at[0]]._t").alias("t0"), F.expr("coalesce(get(ts, get(at, 1))._t, next_start)").alias("t1"))
    one = words.groupBy("_e", "_s").agg(F.min_by(runs, "word").alias("a"), F.max_by(F.struct("tail"), "word").alias("z"), F.sum(F.size("at")).alias("n"))
    order = Window.partitionBy("_e").orderBy("_s")
    one = one.withColumn("before", F.lag("z").over(order))
    one = one.withColumn("goes_on", F.col("before").isNotNull() & F.col("a.head").eqNullSafe(F.col("before.tail")))
    ahead = Window.partitionBy("_e").orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("earlier", F.coalesce(F.sum(F.col("n") - F.col("goes_on").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    one = one.withColumn("later", F.last(F.when(F.col("goes_on"), F.col("a.t1")).otherwise(F.col("a.t0")), ignorenulls=True).over(ahead))
    return words.join(one.select("_e", "_s", "earlier", "goes_on", "later"), ["_e", "_s"])


def at_moment(history: DataFrame, moment) -> DataFrame:
    """The version of each entity that was valid at the moment: valid_from inclusive, valid_to exclusive."""
    return history.where((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment)))
