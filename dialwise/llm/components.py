"""Connected components of an edge table, by alternating large and small stars.

Every round is two groupings over the edges; no vertex's neighbours are ever
gathered in one place, only their minimum. Each round is written to the shared
folder, so a lost executor costs one round at most. Rounds over few edges run in
few tasks: what is left of a contracted graph is soon far smaller than a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialwise.llm.common import store

#: edges that a task takes in small graphs
EDGES = 50_000


def _tasks(df: DataFrame, edges: int) -> DataFrame:
    """The same rows in as few tasks as their number asks for."""
    tasks = edges // EDGES + 1
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)`` long pairs to ``(node, root)`` for every node with an edge; root is the component's smallest node."""
    now = store(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        n = now.count()
        few = lambda df: _tasks(df, n)
        # done when the edges are stars: every node is a centre or has one edge to a centre
        ends = few(now).select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            few(now).select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ups = few(ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")))
        if ups.where("up > 1 OR up > 0 AND down > 0").isEmpty():
            return now.toDF("node", "root").unionByName(now.select("v", "v").distinct().toDF("node", "root"))
        both = few(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # every larger neighbour moves to the smallest of a node's neighbours and itself
        large = store(few(both.where("v > u").join(least, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().transform(few))
        # every node and its smaller neighbours move to the smallest of these
        lowest = few(large.groupBy("u").agg(F.min("v").alias("m")))
        now = store(few(few(large).join(lowest, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
                    .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct().transform(few))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` as ``components`` gives them, after more ``links``: only the components that these join are looked at."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
    found = store(links.join(of("a"), "a", "left").join(of("b"), "b", "left")
                  .select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b")).where("a != b").distinct())
    if found.isEmpty():
        return roots
    top = store(components(found))
    moved = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("higher")), "root", "left") \
        .select("node", F.coalesce("higher", "root").alias("root"))
    return store(moved.unionByName(top.join(roots.select("node"), "node", "left_anti")))
