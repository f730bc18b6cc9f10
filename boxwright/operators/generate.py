"""Synthetic box tables and box transforms. Generators are ``spark.range`` plus expressions: no data moves.

Random values are hashes of (seed, record number, purpose), so a table is the same on any cluster and a
record can be made again by itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import Box, center
from .knn import query_boxes, ranked_globally


def uniform(seed: int, *what) -> Column:
    """A value in [0, 1) for each record and purpose."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("rid"), *[F.lit(w) for w in what]), F.lit(1 << 53)).cast("double") / float(1 << 53)


def _box(dims: Sequence[int], mid: dict[int, Column], extent: Column) -> dict[str, Column]:
    return {f"x{d}_{s}": mid[d] - extent / 2 if s == "l" else mid[d] + extent / 2 for d in dims for s in "lh"}


def uni(spark: SparkSession, n: int, dims: Sequence[int] = (0, 1), area: float = 0.0, seed: int = 1) -> DataFrame:
    """n boxes with uniform centres in the unit world; area: their total volume over the world's."""
    extent = F.lit((area / n) ** (1.0 / len(dims)) if n else 0.0)
    return spark.range(1, n + 1).withColumnRenamed("id", "rid").withColumns(_box(dims, {d: uniform(seed, "c", d) for d in dims}, extent))


def grid(spark: SparkSession, side: int, dims: Sequence[int] = (0, 1), area: float = 0.7, dither: float = 0.2, seed: int = 1) -> DataFrame:
    """A regular grid of side ** D boxes, each of volume ``area`` of its cell, shifted by up to ``dither`` cells."""
    n = side ** len(dims)
    rows = spark.range(1, n + 1).withColumnRenamed("id", "rid")
    cell = 1.0 / side
    mid = {d: (F.floor((F.col("rid") - 1) / F.lit(side**i)) % side + 0.5 + (uniform(seed, "d", d) * 2 - 1) * dither) * cell for i, d in enumerate(dims)}
    return rows.withColumns(_box(dims, mid, F.lit(cell * area ** (1.0 / len(dims)))))


def bit(spark: SparkSession, n: int, dims: Sequence[int] = (0, 1), chance: float = 0.3, bits: int = 53, seed: int = 1) -> DataFrame:
    """n points whose coordinates' binary digits are 1 with the given chance each."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "rid")

    def coordinate(d: int) -> Column:
        def add(acc: Column, b: Column) -> Column:
            one = F.pmod(F.xxhash64(F.lit(seed), F.col("rid"), F.lit(d), b), F.lit(1_000_000)) < int(chance * 1_000_000)
            return acc + F.when(one, F.pow(F.lit(2.0), -b.cast("double"))).otherwise(0.0)

        return F.aggregate(F.sequence(F.lit(1), F.lit(bits)), F.lit(0.0), add)

    return rows.withColumns({f"_v{d}": coordinate(d) for d in dims}).select("rid", *[F.col(f"_v{d}").alias(f"x{d}_{s}") for d in dims for s in "lh"])


def dia(spark: SparkSession, n: int, dims: Sequence[int] = (0, 1), area: float = 2.0, dither: float = 1.0, seed: int = 1) -> DataFrame:
    """n boxes along the diagonal, each ``area`` of a cell of edge 1 / n, shifted by up to ``dither`` cells."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "rid")
    cell = 1.0 / max(n, 1)
    mid = {d: (F.col("rid") - 0.5 + (uniform(seed, "d", d) * 2 - 1) * dither) * cell for d in dims}
    return rows.withColumns(_box(dims, mid, F.lit(cell * area ** (1.0 / len(dims)))))


def parcels(spark: SparkSession, depth: int, dims: Sequence[int] = (0, 1), seed: int = 1, least: float = 0.1) -> DataFrame:
    """2 ** depth parcels: the world split in two again and again, at a random place of a random dimension.

    The splits on a parcel's path are functions of the seed and of the path's first bits, so each parcel is
    made by itself, by ``depth`` nested expressions folded over its own number."""
    rows = spark.range(1, (1 << depth) + 1).withColumnRenamed("id", "rid")
    start = F.struct(*[F.lit(v).alias(f"x{d}_{s}") for d in dims for s, v in (("l", 0.0), ("h", 1.0))])

    def split(acc: Column, level: Column) -> Column:
        path = F.floor((F.col("rid") - 1) / F.pow(F.lit(2.0), F.lit(depth) - level)).cast("long")
        upper = F.floor((F.col("rid") - 1) / F.pow(F.lit(2.0), F.lit(depth - 1) - level)).cast("long") % 2 == 1
        axis = F.pmod(F.xxhash64(F.lit(seed), F.lit("a"), level, path), F.lit(len(dims)))
        at = F.lit(least) + (1 - 2 * least) * (F.pmod(F.xxhash64(F.lit(seed), F.lit("p"), level, path), F.lit(1 << 53)).cast("double") / float(1 << 53))
        out = []
        for i, d in enumerate(dims):
            low, high = acc[f"x{d}_l"], acc[f"x{d}_h"]
            cut = low + (high - low) * at
            out += [F.when((axis == i) & upper, cut).otherwise(low).alias(f"x{d}_l"), F.when((axis == i) & ~upper, cut).otherwise(high).alias(f"x{d}_h")]
        return F.struct(*out)

    return rows.withColumn("_b", F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), start, split)).select("rid", "_b.*")


def par(spark: SparkSession, depth: int, dims: Sequence[int] = (0, 1), area: float = 0.5, seed: int = 1) -> DataFrame:
    """Parcels shrunk about their centres to ``area`` of their volume."""
    return scale_area(parcels(spark, depth, dims, seed), area, dims)


def clusters(spark: SparkSession, depth: int, each: int, dims: Sequence[int] = (0, 1), along: bool = False, width: float = 0.001, seed: int = 1) -> DataFrame:
    """Points around the parcels' low corners, or with ``along`` spread along one of their edges: ``each`` a parcel."""
    base = parcels(spark, depth, dims, seed).withColumnRenamed("rid", "_p").withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(each)))).withColumn("rid", (F.col("_p") - 1) * each + F.col("_i"))
    axis = F.pmod(F.xxhash64(F.lit(seed), F.lit("e"), "_p"), F.lit(len(dims)))
    out = base
    for i, d in enumerate(dims):
        spot = F.col(f"x{d}_l") + (uniform(seed, "w", d) + uniform(seed, "v", d) - 1) * width
        if along:
            spot = F.when(axis == i, F.col(f"x{d}_l") + (F.col(f"x{d}_h") - F.col(f"x{d}_l")) * uniform(seed, "u", d)).otherwise(spot)
        out = out.withColumn(f"_v{d}", spot)
    return out.select("rid", *[F.col(f"_v{d}").alias(f"x{d}_{s}") for d in dims for s in "lh"])


def every_kth(data: DataFrame, k: int, order: str = "rid") -> DataFrame:
    """Each k-th record in the order of ``order``."""
    return ranked_globally(data, [order], "_rank").where(F.col("_rank") % k == 0).drop("_rank")


def scale_area(data: DataFrame, factor: float, dims: Sequence[int] = (0, 1)) -> DataFrame:
    """Volumes times ``factor``, about the centres (0: points)."""
    f, b = factor ** (1.0 / len(dims)), Box(dims)
    return data.withColumns({f"x{d}_{s}": center(b, d) + (F.col(f"x{d}_{s}") - center(b, d)) * f for d in dims for s in "lh"})


def dither(data: DataFrame, rate: float, cell: Sequence[float], dims: Sequence[int] = (0, 1), seed: int = 1) -> DataFrame:
    """Boxes shifted in each dimension by up to ``rate`` cell widths either way."""
    return data.withColumns({f"x{d}_{s}": F.col(f"x{d}_{s}") + (uniform(seed, "s", d) * 2 - 1) * rate * c for d, c in zip(dims, cell) for s in "lh"})


def project(data: DataFrame, keep: Sequence[int], dims: Sequence[int], key: Sequence[str] = ("rid",)) -> DataFrame:
    """The dimensions of ``keep``, renumbered from 0."""
    if not set(keep) <= set(dims):
        raise ValueError(f"dimensions {keep} are not among {dims}")
    return data.select(*key, *[F.col(f"x{d}_{s}").alias(f"x{i}_{s}") for i, d in enumerate(keep) for s in "lh"])


def shuffled(data: DataFrame, seed: int = 1, key: str = "rid") -> DataFrame:
    """Records in a pseudorandom order that the seed fixes."""
    return data.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def workload(data: DataFrame, hits: int, dims: Sequence[int] = (0, 1), each: int = 10, seed: int = 1) -> DataFrame:
    """(qid, box): query boxes of about ``hits`` hits at the centres of every ``each * sqrt(hits)``-th record.

    One hit: the records themselves, shrunk to their centres. More: boxes that touch between half and one
    and a half times so many of the nearest records. Larger boxes come in fewer numbers, so that all
    workloads find a like number of records per record of data."""
    chosen = every_kth(data, max(1, round(each * hits**0.5)))
    if hits == 1:
        return scale_area(chosen, 0.0, dims).select(F.col("rid").alias("qid"), *Box(dims).columns())
    points = chosen.select(F.col("rid").alias("qid"), *[center(Box(dims), d).alias(f"p{d}") for d in dims])
    want = F.floor(F.lit(0.5 * hits) + F.pmod(F.xxhash64(F.lit(seed), "qid"), F.lit(hits + 1))).cast("long")
    return query_boxes(data, points, want, int(1.5 * hits) + 1, dims)
