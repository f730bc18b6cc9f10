"""Selection queries and query batches over box tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box, intersects
from .counting import box_counts
from .joins import grid_join

Test = Callable[[Box, Box], Column]


def region_query(data: DataFrame, query: Box, test: Test = intersects) -> DataFrame:
    """The records for which ``test(record, query)`` holds; pushed down to the scan where the test is made of comparisons."""
    return data.where(test(Box(query.dims), query))


def region_count(data: DataFrame, query: Box, test: Test = intersects) -> DataFrame:
    return region_query(data, query, test).agg(F.count("*").alias("n"))


def exists_region(data: DataFrame, query: Box, test: Test = intersects) -> DataFrame:
    """One row, ``found``: reads until the first match."""
    return region_query(data, query, test).limit(1).agg((F.count("*") > 0).alias("found"))


def modify(data: DataFrame, query: Box, changes: dict[str, Column], test: Test = intersects) -> DataFrame:
    """The records with payload columns changed where the test holds; boxes can't be changed."""
    if set(changes) & set(Box(query.dims).columns()):
        raise ValueError("box columns can't be modified")
    hit = test(Box(query.dims), query)
    return data.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in changes.items()})


def batch_counts(data: DataFrame, queries: DataFrame, key: str = "qid", dims: Sequence[int] = (0, 1), extra: Test | None = None, cell: Sequence[float] | None = None, within: Sequence[int] = ()) -> DataFrame:
    """(key, n): number of records that meet each query box, zeros included. ``extra`` further restricts matches,
    and ``within`` names dimensions in which a record must lie in the query.

    Plain counts in one or two dimensions make no pairs (see ``counting``); others join the distinct boxes of both
    sides, with how often each occurs. Boxes with a null or l > h meet nothing."""
    names = Box(dims).columns()
    if extra is None and not within and cell is None and len(dims) <= 2:
        per = box_counts(data, queries, dims)
    else:
        met = grid_join(boxes_of(data, dims), boxes_of(queries, dims), dims, cell=cell, extra=extra, within=within)
        per = met.groupBy(*[F.col(f"b_{c}").alias(c) for c in names]).agg(F.sum("a_n_equal").alias("n"))
    per = per.withColumnsRenamed({c: f"_{c}" for c in names})
    joined = queries.select(key, *names).join(per, [F.col(c) == F.col(f"_{c}") for c in names], "left")
    return joined.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def boxes_of(data: DataFrame, dims: Sequence[int] = (0, 1)) -> DataFrame:
    """The distinct boxes and ``n_equal``, how many records have each."""
    return data.groupBy(*Box(dims).columns()).agg(F.count("*").alias("n_equal"))


def intersection_count(a: DataFrame, b: DataFrame, dims: Sequence[int] = (0, 1), extra: Test | None = None, within: Sequence[int] = ()) -> DataFrame:
    """One row, n: the number of intersecting pairs, without making them where that can be (see ``batch_counts``)."""
    names = Box(dims).columns()
    if extra is None and not within and len(dims) <= 2:
        per = box_counts(a, b, dims).withColumnsRenamed({c: f"_{c}" for c in names})
        met = boxes_of(b, dims).join(per, [F.col(c) == F.col(f"_{c}") for c in names]).select((F.col("n") * F.col("n_equal")).alias("n"))
    else:
        met = grid_join(boxes_of(a, dims), boxes_of(b, dims), dims, extra=extra, within=within).select((F.col("a_n_equal") * F.col("b_n_equal")).alias("n"))
    return met.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def batch_stats(counts: DataFrame) -> DataFrame:
    """One row over the counts of a batch: total, empty queries, min, max, mean, population variance, deviation and their ratio."""
    n = F.col("n").cast("double")
    return counts.agg(
        F.sum("n").alias("allfound"),
        F.count_if(F.col("n") == 0).alias("emptyquery"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
        F.avg(n).alias("avg_n"),
        F.var_pop(n).alias("var_n"),
        F.stddev_pop(n).alias("sd_n"),
        (F.stddev_pop(n) / F.avg(n)).alias("nsd_n"),
    )


def hit_queries(data: DataFrame, queries: DataFrame, key: str = "qid", dims: Sequence[int] = (0, 1), missing: bool = False) -> DataFrame:
    """The queries with a match, or with ``missing`` those without (semi and anti join over the boxes that have matches)."""
    names = Box(dims).columns()
    if len(dims) <= 2:
        hits = box_counts(data, queries, dims).where("n > 0")
    else:
        hits = grid_join(boxes_of(data, dims), boxes_of(queries, dims), dims).select(*[F.col(f"b_{c}").alias(c) for c in names]).distinct()
    hits = hits.select(*[F.col(c).alias(f"_{c}") for c in names])
    return queries.join(hits, [F.col(c) == F.col(f"_{c}") for c in names], "left_anti" if missing else "left_semi")


def exact_match(data: DataFrame, queries: DataFrame, dims: Sequence[int] = (0, 1), payload: Sequence[str] = ()) -> DataFrame:
    """Records whose box (and payload) equals one of the queries': a semi join on all coordinates."""
    return data.join(queries.select(*Box(dims).columns(), *payload), [*Box(dims).columns(), *payload], "left_semi")


def exact_counts(data: DataFrame, queries: DataFrame, key: str = "qid", dims: Sequence[int] = (0, 1)) -> DataFrame:
    """(key, n): records with exactly the query's box."""
    names = Box(dims).columns()
    per = data.groupBy(*names).agg(F.count("*").alias("n"))
    return queries.select(key, *names).join(per, names, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
