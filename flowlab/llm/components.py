"""Connected components of an undirected edge table, as Spark joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.llm.common import cut_lineage

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long edges -> (node, component): the smallest node reachable, for every node with an edge.

    Alternates two star operations until the edge table no longer changes:
    the large star links every larger neighbour of a node to the smallest
    member of its neighbourhood, the small star does so for the smaller
    neighbours. What is left is one star per component, centred on its
    smallest node. The number of rounds grows with the logarithm of the
    longest path. Each round is checkpointed to the shared folder, so lineage
    stays short and a lost executor costs one round. Minima are combined
    before the shuffle, and a hub node only meets the skew-splittable join.

    Null ends and self loops are ignored; an empty table gives an empty table.
    Raises if the star form is not reached in ``MAX_ROUNDS`` rounds.
    """
    cur = cut_lineage(edges.where("a is not null and b is not null and a <> b")
                      .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(MAX_ROUNDS):
        cur = cut_lineage(_small_star(_large_star(cur)))
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            centre = cur.select(F.col("v").alias("node")).distinct()
            return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
                    .unionByName(centre.withColumn("component", F.col("node"))))
        before = now
    raise RuntimeError(f"connected components: no fixed point after {MAX_ROUNDS} rounds")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u")).toDF("n", "m")
    low = both.groupBy("n").agg(F.min(F.least("n", "m")).alias("low"))
    return (both.join(low, "n").where("m > n")
            .select(F.col("m").alias("u"), F.col("low").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("m")).where("n <> m")
    low = down.groupBy("n").agg(F.min("m").alias("low"))
    moved = down.join(low, "n").where("m <> low").select(F.col("m").alias("u"), F.col("low").alias("v"))
    return moved.union(low.select("n", "low")).distinct()
