"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_util import drop, saved


def _open(edges: DataFrame) -> int:
    """Nodes that keep the edges from being stars whose centres are smallest: those with two targets, or with one while they are a target."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("_u"), F.lit(0).alias("_v")), F.struct(F.col("v").alias("x"), F.lit(0).alias("_u"), F.lit(1).alias("_v")))).alias("e"))
    per = ends.groupBy("e.x").agg(F.sum("e._u").alias("n"), F.max("e._v").alias("hit"))
    return per.where((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("hit") > 0))).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the smallest node that it is linked with.

    Edges point from the larger to the smaller node. A round moves each edge to its target's smallest
    target (large star), then a node's other targets and itself to its smallest (small star). Its tables
    are written to the shared folder; the smallest targets on their own, so that the join with them is a
    plain one of two shuffles, in which adaptive execution splits the edges of a hub. Rounds end when the edges are
    stars; their number grows with the logarithm of the largest component, and edges that are stars already take none.
    """
    now = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while _open(now):
        targets = saved(now.groupBy("u").agg(F.min("v").alias("_m")).withColumnRenamed("u", "_p"))
        large = now.join(targets, F.col("v") == F.col("_p"), "left").select("u", F.coalesce("_m", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("_m"))  # a node has as many targets as buckets at most
        small = large.join(low, "u").where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        last, now = now, saved(small.unionByName(low.select("u", F.col("_m").alias("v"))).distinct())
        drop(last)
        drop(targets)
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
