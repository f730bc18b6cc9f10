"""Region counts over boxes that arrive as a stream.

Each micro-batch is joined with the query boxes like a static table and its counts are written under its
batch number, replacing whatever an earlier try of that batch wrote; totals are sums over batches. So
restarts neither lose nor double records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box
from ..operators.joins import grid_join


class RegionCounts:
    """A sink for ``writeStream.foreachBatch`` and the totals that it has kept."""

    def __init__(self, queries: DataFrame, path: str, key: str = "qid", dims: Sequence[int] = (0, 1)):
        self.queries, self.path, self.key, self.dims = queries.select(key, *Box(dims).columns()), path, key, tuple(dims)

    def __call__(self, batch: DataFrame, number: int) -> None:
        hits = grid_join(batch.select(*Box(self.dims).columns()), self.queries, self.dims)
        counts = hits.groupBy(F.col(f"b_{self.key}").alias(self.key)).agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def totals(self) -> DataFrame:
        """(key, n) of all batches so far, zeros included."""
        spark = self.queries.sparkSession
        done = spark.read.schema(f"{self.key} {dict(self.queries.dtypes)[self.key]}, n long, batch long").parquet(self.path)
        each = done.groupBy(self.key).agg(F.sum("n").alias("n"))
        return self.queries.select(self.key).join(each, self.key, "left").select(self.key, F.coalesce("n", F.lit(0)).alias("n"))
