"""Connected components as repeated contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.core.scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is its smallest node.

    Each round lets every node point at the neighbour that comes first in the round's order, then
    replaces both ends of every edge by what they point at. Even rounds order nodes by value, which
    folds a star in one round; odd rounds order them by a hash, which is expected to halve a chain
    however its ids run. The edge list shrinks each round and the pointers are followed at the end.
    A hub costs one pre-aggregated row per task in the grouping; in the joins it is the long side of
    a skewed join, which adaptive execution splits. Edges with a null end and self-loops link
    nothing; a node that has only such edges is not returned.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = scratch.write(e, "edges0")
    levels: list[DataFrame] = []
    for k in range(max_rounds):
        if e.isEmpty():
            break
        p = scratch.write(_pointers(e, k), f"pointers{k}")
        levels.append(p)
        left = p.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = p.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        n = e.join(left, "a").join(right, "b").where("pa <> pb")
        n = n.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        e = scratch.write(n, f"edges{k + 1}")
        scratch.drop(f"edges{k}")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not levels:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    labels = levels[0]
    for k, p in enumerate(levels[1:], 1):
        step = p.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        labels = labels.join(step, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))
    labels = scratch.write(labels, "labels")
    least = scratch.write(labels.groupBy("parent").agg(F.min("node").alias("component")), "least")
    scratch.drop(*(f"pointers{k}" for k in range(len(levels))))
    return labels.join(least, "parent").select("node", "component")


def _order(c: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), c) if k % 2 else F.lit(0).cast("long")


def _pointers(e: DataFrame, k: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = F.min(F.struct(_order(F.col("b"), k).alias("o"), F.col("b").alias("n")))
    got = both.groupBy(F.col("a").alias("node")).agg(first.alias("first"))
    own = F.struct(_order(F.col("node"), k).alias("o"), F.col("node").alias("n"))
    return got.select("node", F.least(F.col("first"), own)["n"].alias("parent"))
