"""Parent-child links to full hierarchies.

Method: level-wise frontier joins from the roots. The links are written once, bucketed by parent, so that each level
shuffles only its frontier (the nodes found one level above) and never the links. Nodes that no level reaches hang
below a cycle; for those the cycle is found by doubling the step length, which needs a number of rounds logarithmic
in the longest way.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normloom.plans.session import Scratch


def parent_links(edges: DataFrame, edge_type: str = "derives") -> DataFrame:
    """(child, parent): one row per source of an edge of the type, compared without case and outer blanks.

    Repeated edges count once; a null target gives no parent; of several different parents the smallest id counts.
    Edges with a null source or a null type are ignored.
    """
    wanted = F.lower(F.trim(F.col("edge_type"))) == F.lit(edge_type.strip().lower())
    return edges.where(wanted & F.col("source").isNotNull()).groupBy(F.col("source").alias("child")).agg(F.min("target").alias("parent"))


def _cycles(scratch: Scratch, stuck: DataFrame) -> DataFrame:
    """(node, root) for links none of whose nodes reaches a root: root is the smallest node of the cycle at the end of the way.

    State per node: the node 2^k steps up and the smallest of the 2^k nodes met before it. Once the set of nodes stepped
    on stops shrinking it is the set of nodes on cycles, and once no minimum changes it covers each whole cycle.
    """
    state = scratch.write(stuck.select(F.col("child").alias("node"), F.col("parent").alias("hop"), F.col("child").alias("low")), "cycle-0")
    k, seen = 0, -1
    while True:
        up = state.select(F.col("node").alias("hop"), F.col("hop").alias("hop2"), F.col("low").alias("low2"))
        k += 1
        step = state.join(up, "hop").select("node", F.col("hop2").alias("hop"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved"))
        state = scratch.write(step, f"cycle-{k}")
        scratch.drop(f"cycle-{k - 1}")
        moved, met = state.agg(F.coalesce(F.max("moved"), F.lit(False)), F.count_distinct("hop")).first()
        if not moved and met == seen:
            break
        seen = met
    ends = state.select(F.col("node").alias("hop"), F.col("low").alias("root"))
    return state.join(ends, "hop").select("node", "root")


def hierarchy(edges: DataFrame, edge_type: str = "derives", with_path: bool = True, hot_children: int = 200_000) -> DataFrame:
    """One row per node of an edge of the type: node, root, depth and (with_path) path, the ids from the root to the node.

    A node whose way up never ends has depth -1, a null path, and as root the smallest id of the cycle it runs into.
    A parent with more than hot_children children has its links spread over several buckets by a hash of the child, and
    its frontier row repeated once for each. An empty input gives an empty result; other columns of edges are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "hierarchy")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = scratch.write(parent_links(edges, edge_type), "links")
    real = links.where("parent is not null")

    children = real.groupBy("parent").agg(F.count("*").alias("n"))
    hot = scratch.write(children.where(F.col("n") > hot_children).select("parent", F.ceil(F.col("n") / hot_children).cast("int").alias("fan")), "hot")
    is_hot = hot.limit(1).count() > 0

    keys = ["parent", "salt"] if is_hot else ["parent"]  # a constant salt would be folded away and with it the match of the buckets

    def salted(df: DataFrame, key: str, salt) -> DataFrame:
        if not is_hot:
            return df
        named = hot.withColumnRenamed("parent", key)
        return df.join(named, key, "left").withColumn("salt", salt(F.coalesce("fan", F.lit(1)))).drop("fan")

    name = f"normloom_links_{uuid.uuid4().hex[:12]}"
    by_parent = salted(real, "parent", lambda fan: F.pmod(F.xxhash64("child"), fan).cast("int"))
    by_parent.repartition(buckets, *keys).write.bucketBy(buckets, *keys).format("parquet").option("path", scratch.path("by-parent")).saveAsTable(name)
    down = spark.table(name)

    parents = real.select(F.col("parent").alias("node")).distinct()
    tops = parents.join(links.select(F.col("child").alias("node")), "node", "left_anti")
    roots = tops.unionByName(links.where("parent is null").select(F.col("child").alias("node")))
    level = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), *([F.array("node").alias("path")] if with_path else []))
    frontier, n = scratch.write_counted(level, "levels/at=0")
    depth = 0
    while n:
        depth += 1
        above = salted(frontier.select(F.col("node").alias("parent"), "root", *(["path"] if with_path else [])), "parent", lambda fan: F.explode(F.sequence(F.lit(0), fan - 1)))
        found = down.join(above, keys).select(
            F.col("child").alias("node"), "root", F.lit(depth).alias("depth"), *([F.concat("path", F.array("child")).alias("path")] if with_path else [])
        )
        frontier, n = scratch.write_counted(found, f"levels/at={depth}")
    reached = spark.read.schema(level.schema).parquet(*[scratch.path(f"levels/at={k}") for k in range(depth + 1)])

    stuck, n = scratch.write_counted(real.join(reached.select(F.col("node").alias("child")), "child", "left_anti"), "stuck")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    if not n:
        return reached
    lost = _cycles(scratch, stuck).select("node", "root", F.lit(-1).alias("depth"), *([F.lit(None).cast("array<string>").alias("path")] if with_path else []))
    return reached.unionByName(lost)


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor, node, steps): every proper ancestor of every node that reaches a root, from the paths of hierarchy().

    The pairs are rows, not lists, since a root may stand above most of the nodes.
    """
    pairs = tree.where("depth > 0").select("node", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "ancestor"))
    return pairs.select("ancestor", "node", (F.col("depth") - F.col("at")).alias("steps"))


def with_descendant_counts(tree: DataFrame) -> DataFrame:
    """tree with n_descendants; 0 for leaves, null for nodes that reach no root."""
    counts = tree.where("depth > 0").select(F.explode(F.slice("path", F.lit(1), F.col("depth"))).alias("node")).groupBy("node").agg(F.count("*").alias("n_descendants"))
    joined = tree.join(counts, "node", "left")
    return joined.withColumn("n_descendants", F.when(F.col("depth") >= 0, F.coalesce("n_descendants", F.lit(0).cast("bigint"))))
