"""Connected components of a graph that is only ever a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import release, settle


SHARES = 64  # tasks that the edges of one node are dealt over
FEW = 100_000  # edges of a graph up to which the least of each node is broadcast


def _least(pairs: DataFrame, few: bool) -> DataFrame:
    """Every (u, v) with the least of u and all its v; the edges of a node never meet in one task."""
    if few:
        return pairs.join(F.broadcast(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))), "u")
    dealt = pairs.withColumn("share", F.pmod(F.xxhash64("v"), F.lit(SHARES)).cast("int"))
    each = dealt.groupBy("u", "share").agg(F.min("v").alias("m"))
    least = each.groupBy("u").agg(F.least("u", F.min("m")).alias("m"), F.collect_list("share").alias("shares"))
    return dealt.join(least.select("u", "m", F.explode("shares").alias("share")), ["u", "share"]).drop("share")


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    """May repeat edges, not more than there were; the small star drops them."""
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    return _least(both, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _least(down, few)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", "m"))
    return moved.toDF("u", "v").where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge to another; component is its least node.

    edges has two columns of one ordered type; direction, repeats, loops and rows with nulls don't
    matter. Alternating large and small stars: each step is an aggregation and a join on a node and a share
    of its edges, so no component ever meets in one task, and steps grow with the logarithm of the size. In a graph
    of few edges the aggregated nodes are broadcast instead, which spares most shuffles. Every
    step is written to the shared folder; the one before it is deleted.
    """
    a, b = edges.columns
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = settle(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        few = mark[0] <= FEW
        after = settle(_small_star(_large_star(now, few), few))
        new = _mark(after)
        release(now)
        now = after
        if new == mark:
            break
        mark = new
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(now.select("v", "v")).distinct()
