"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import discard, shared_path, stored_at


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The larger end of each edge moves to the least neighbour of the smaller.

    ``least`` (u, m) is stored, so both sides of the join are plain exchanges: adaptive execution can
    split a node that a third of the edges point at.
    """
    up = least.select(F.col("u").alias("v"), "m")
    return edges.join(up, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    moved = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """For each node of ``edges`` (u, v) but the least of its component: (node, component), the least node.

    Nulls and loops are left out; repeated and reversed edges count once; without edges the result is
    empty. Every iteration is written to the shared folder, so a lost executor costs one iteration.
    An iteration changes no table once all nodes point at the least; more than ``most`` raise an error.
    """
    spark = edges.sparkSession
    oriented = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = shared_path(spark, name)
    table = stored_at(oriented, now)
    mark = None
    for _ in range(most):
        row = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            return table.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark, old = tuple(row), now
        least_at = shared_path(spark, name)
        least = stored_at(table.groupBy("u").agg(F.min("v").alias("m")), least_at)
        now = shared_path(spark, name)
        table = stored_at(_small_star(_large_star(table, least)), now)
        discard(spark, old)
        discard(spark, least_at)
    raise RuntimeError(f"components did not settle in {most} iterations")
