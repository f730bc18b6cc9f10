"""Distribution statistics of box tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import Box, center, extent, overlap_volume, volume
from .joins import grid_join


def mbb(data: DataFrame, dims: Sequence[int] = (0, 1)) -> DataFrame:
    """The least box around all records."""
    return data.agg(*[(F.min if s == "l" else F.max)(f"x{d}_{s}").alias(f"x{d}_{s}") for d in dims for s in "lh"])


def mbb_report(data: DataFrame, dims: Sequence[int] = (0, 1)) -> DataFrame:
    """A row per dimension: extremes of boxes and of centres, how many records attain each, and the edge.

    The extremes are one aggregation; multiplicities are counted in a second pass against them."""
    one = data.agg(*[f for d in dims for f in (F.min(f"x{d}_l").alias(f"l{d}"), F.max(f"x{d}_h").alias(f"h{d}"), F.min(center(Box(dims), d)).alias(f"cl{d}"), F.max(center(Box(dims), d)).alias(f"ch{d}"))])
    both = data.join(one.hint("broadcast"), F.lit(True))  # one row
    counted = both.agg(*[F.first(c).alias(c) for c in one.columns], *[F.count_if(F.col(f"x{d}_{s}") == F.col(f"{s}{d}")).alias(f"n{s}{d}") for d in dims for s in "lh"])
    rows = [F.struct(F.lit(d).alias("dim"), F.col(f"l{d}").alias("low"), F.col(f"nl{d}").alias("n_low"), F.col(f"h{d}").alias("high"), F.col(f"nh{d}").alias("n_high"), (F.col(f"h{d}") - F.col(f"l{d}")).alias("edge"), F.col(f"cl{d}").alias("center_low"), F.col(f"ch{d}").alias("center_high")) for d in dims]
    return counted.select(F.inline(F.array(*rows)))


def least_squares(data: DataFrame, dims: Sequence[int] = (0, 1)) -> DataFrame:
    """One row: the edge of the least square (cube) around all records that starts at their low corner, and of that around their centre; volume of the box."""
    edges = F.array(*[F.max(f"x{d}_h") - F.min(f"x{d}_l") for d in dims])
    return data.agg(F.array_max(edges).alias("edge"), F.aggregate(edges, F.lit(1.0), lambda a, x: a * x).alias("volume"), *[((F.min(f"x{d}_l") + F.max(f"x{d}_h")) / 2 - F.array_max(edges) / 2).alias(f"centered{d}_l") for d in dims])


def box_report(data: DataFrame, dims: Sequence[int] = (0, 1), key: str = "rid") -> DataFrame:
    """One row: number of boxes, of intersecting ordered pairs of different boxes, points, squares, boxes of
    zero volume and by number of zero dimensions, smallest volume above zero; means of volume, of a box's
    mean extent, of its extents' deviation and of its least extent in per cent (of mean and largest), and of
    the share of volume overlapped."""
    b, last = Box(dims), dims[-1]
    zero = sum((F.when(extent(b, d) == 0, 1).otherwise(0) for d in dims), F.lit(0))
    square = F.lit(True)
    for d in dims:
        square = square & (extent(b, d) == extent(b, last))
    v = volume(b)
    extents = F.array(*[extent(b, d) for d in dims])
    mean = F.aggregate(extents, F.lit(0.0), lambda a, x: a + x) / len(dims)
    spread = F.sqrt(F.aggregate(extents, F.lit(0.0), lambda a, x: a + x * x) / len(dims) - mean * mean)
    widest = F.array_max(extents)
    one = data.agg(
        *[F.count_if(zero == k).alias(f"n_zero{k}") for k in range(1, len(dims) + 1)],
        F.avg(mean).alias("avg_extent"),
        F.avg(F.when(mean > 0, 100 * spread / mean)).alias("avg_nsd"),
        F.avg(F.when(widest > 0, 100 * F.array_min(extents) / widest)).alias("avg_min_max"),
        F.count("*").alias("n_boxes"),
        F.count_if(zero == len(dims)).alias("n_points"),
        F.count_if(zero > 0).alias("n_flat"),
        F.count_if(square & (zero == 0)).alias("n_squares"),
        F.min(F.when(v > 0, v)).alias("min_volume"),
        F.avg(v).alias("avg_volume"),
    )
    names = [key, *b.columns()]
    pairs = grid_join(data.select(*names), data.select(*names), dims).where(F.col(f"a_{key}") != F.col(f"b_{key}"))
    own = volume(Box(dims, "a_"))
    met = pairs.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum(F.when(own > 0, overlap_volume(Box(dims, "a_"), Box(dims, "b_")) / own)), F.lit(0.0)).alias("_o"))
    return one.join(met.hint("broadcast"), F.lit(True)).withColumn("avg_overlap", F.col("_o") / F.col("n_boxes")).drop("_o")  # one row each


def duplicate_values(points: DataFrame, dims: Sequence[int] = (0, 1), top: int | None = 10) -> DataFrame:
    """(dim, v, n, rank): coordinate values that occur more than once, by frequency and value descending (top: so many a dimension, None: all). Points only."""
    bad = points.where(~_degenerate(dims)).limit(1)
    values = points.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"x{d}_l").alias("v")) for d in dims])).alias("s")).select("s.dim", "s.v")
    counts = values.groupBy("dim", "v").agg(F.count("*").alias("n")).where("n > 1")
    if bad.count():
        raise ValueError("duplicate_values takes points only (l = h in every dimension)")
    if top is None:
        return counts
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), F.desc("v")))).where(F.col("rank") <= top)


def _degenerate(dims: Sequence[int]):
    out = F.lit(True)
    for d in dims:
        out = out & (F.col(f"x{d}_l") == F.col(f"x{d}_h"))
    return out


def compare_segments(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """One row: segments in both, how many differ and in per cent."""
    met = a.select(key, F.col(value).alias("_a")).join(b.select(key, F.col(value).alias("_b")), key)
    return met.agg(F.count("*").alias("n"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("differing")).withColumn("percent", 100.0 * F.col("differing") / F.col("n"))


def bad_boxes(data: DataFrame, dims: Sequence[int] = (0, 1)) -> DataFrame:
    """Records with l > h in some dimension."""
    from ..functions.boxes import ok

    return data.where(~ok(Box(dims)))
