"""Inserts and deletes as table rewrites, and the consistency check of a node catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import Box


def insert(data: DataFrame, records: DataFrame) -> DataFrame:
    """Bag semantics: all records are added."""
    return data.unionByName(records)


def insert_unique(data: DataFrame, records: DataFrame, order: str, dims: Sequence[int] = (0, 1)) -> DataFrame:
    """Box as key: of the new records of one box the first by ``order`` is added, if no stored record has it."""
    names = Box(dims).columns()
    first = Window.partitionBy(*names).orderBy(order)
    new = records.join(data.select(*names), names, "left_anti").withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    return data.unionByName(new.select(*data.columns))


class Records:
    """A table of records with a switch between bag and unique semantics (off at first), as tables are rewritten.

    With the switch on, a new record is refused if its box is there already; records that were there before stay, equal ones too."""

    def __init__(self, data: DataFrame, order: str = "rid", dims: Sequence[int] = (0, 1), unique: bool = False):
        self.data, self.order, self.dims, self.unique = data, order, tuple(dims), unique

    def set_unique(self, unique: bool = True) -> "Records":
        return Records(self.data, self.order, self.dims, unique)

    def insert(self, records: DataFrame) -> "Records":
        data = insert_unique(self.data, records, self.order, self.dims) if self.unique else insert(self.data, records)
        return Records(data, self.order, self.dims, self.unique)

    def delete(self, requests: DataFrame, payload: Sequence[str] = ()) -> "Records":
        return Records(delete(self.data, requests, self.order, self.dims, payload), self.order, self.dims, self.unique)


def refused(data: DataFrame, records: DataFrame, order: str, payload: str, dims: Sequence[int] = (0, 1)) -> DataFrame:
    """The records that ``insert_unique`` refuses, with the stored record's payload as ``stored``."""
    names = Box(dims).columns()
    first = Window.partitionBy(*names).orderBy("_new", order)
    both = data.select(*names, payload, order, F.lit(0).alias("_new")).unionByName(records.select(*names, payload, order, F.lit(1).alias("_new")))
    return both.withColumn("stored", F.first(payload).over(first)).withColumn("_r", F.row_number().over(first)).where("_r > 1 AND _new = 1").drop("_r", "_new")


def delete(data: DataFrame, requests: DataFrame, order: str, dims: Sequence[int] = (0, 1), payload: Sequence[str] = ()) -> DataFrame:
    """Each request deletes one record of its box (and payload), the lowest by ``order`` first; requests beyond that do nothing."""
    names = [*Box(dims).columns(), *payload]
    number = Window.partitionBy(*names).orderBy(order)
    wanted = requests.groupBy(*names).agg(F.count("*").alias("_w"))
    return data.withColumn("_r", F.row_number().over(number)).join(wanted, names, "left").where("_r > coalesce(_w, 0)").select(*data.columns)


def inconsistent(nodes: DataFrame, entries: DataFrame, dims: Sequence[int] = (0, 1)) -> DataFrame:
    """Nodes whose stored box or count differs from that of their entries (by node_id): empty for a sound index."""
    again = entries.groupBy("node_id").agg(F.count("*").alias("_n"), *[(F.min if s == "l" else F.max)(f"x{d}_{s}").alias(f"_x{d}_{s}") for d in dims for s in "lh"])
    joined = nodes.join(again, "node_id", "full_outer")
    same = F.col("n").eqNullSafe(F.col("_n"))
    for c in Box(dims).columns():
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return joined.where(~same)
