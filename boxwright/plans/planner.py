"""Chooses the path of a query batch: plain scan, grid join, or index. All paths return the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box, intersects
from ..operators.index import Index
from ..operators.select import batch_counts

SCAN_QUERIES = 64


def choose(n_queries: int, index: Index | None, dims: Sequence[int]) -> str:
    """index: one is at hand over these dimensions; scan: few queries, as one pass of pushed-down comparisons; grid: else."""
    if index is not None and set(index.dims) == set(dims):
        return "index"
    return "scan" if n_queries <= SCAN_QUERIES else "grid"


def region_counts(data: DataFrame, queries: DataFrame, key: str = "qid", dims: Sequence[int] = (0, 1), index: Index | None = None, path: str | None = None) -> DataFrame:
    """(key, n) of each query box, zeros included, by the chosen (or given) path."""
    few = queries.limit(SCAN_QUERIES + 1).count() if path is None else 0
    path = path or choose(few, index, dims)
    if path == "index":
        return index.region_counts(queries, key)
    if path == "grid":
        return batch_counts(data, queries, key, dims)
    boxes = queries.select(key, *Box(dims).columns()).collect()  # at most SCAN_QUERIES rows, unless asked for
    if not boxes:
        return queries.select(key, F.lit(0).cast("long").alias("n"))
    tests = [intersects(Box(dims), Box.of([(r[f"x{d}_l"], r[f"x{d}_h"]) for d in dims], dims)) for r in boxes]
    one = data.agg(*[F.count_if(t).alias(f"c{i}") for i, t in enumerate(tests)])
    rows = F.array(*[F.struct(F.lit(r[key]).alias(key), F.col(f"c{i}").alias("n")) for i, r in enumerate(boxes)])
    return one.select(F.inline(rows))
