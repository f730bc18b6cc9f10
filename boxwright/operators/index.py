"""A bulk-loaded index: leaves along a Hilbert curve, and a catalogue of node boxes and clip points on every level.

``build`` sorts records by the Hilbert key of their centres (one range shuffle), cuts pages of ``leaf_cap``
records, and groups as many pages to a directory node, level by level, in the same pass; records and catalogue are
written once. A query batch meets the nodes of the top level and goes down: box and clip points drop nodes, and a node
all of whose records meet the query (no record starts beyond its end or ends before its start) is counted as a whole, so that
counts read the records of a query's border only. All paths return exactly what a plain scan returns. Records
with a null or l > h in an indexed dimension meet nothing and are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box, center, clipped_away, every, intersects, ok, volume
from .clip import CLIP_TYPE, THRESHOLD, clips_of_pages
from .joins import grid_join
from .storage import folder, kept

LEAF_CAP = 72
BITS = 20
CLIP = pa.struct([("corner", pa.int32()), ("p", pa.list_(pa.float64())), ("score", pa.float64())])


def leaf_capacity(page_bytes: int, dims: int, info_bytes: int = 4) -> int:
    """Records of a page: 16 bytes a dimension and the payload, in units of 8; a count and a mid point a page."""
    entry = 16 * dims + -(-info_bytes // 8) * 8
    return max(2, (page_bytes - 8 - 8 * dims) // entry)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the D-dimensional Hilbert curve of integer cells (n x D, each below 2 ** bits), by the transpose method."""
    x = cells.T.astype(np.uint64).copy()
    n = len(x)
    m = np.uint64(1) << np.uint64(bits - 1)
    q = m
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(n):
            hit = (x[i] & q) > 0
            t = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = m
    while q > one:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def hilbert_key(data: DataFrame, world: Sequence[tuple[float, float]], dims: Sequence[int] = (0, 1)) -> DataFrame:
    """``data`` with ``hkey``. world: the declared extent of each dimension; centres outside are an error."""
    bits = min(BITS, 62 // len(dims))
    top = (1 << bits) - 1

    @F.pandas_udf("long")
    def key(*parts: pd.Series) -> pd.Series:
        cells = []
        for s, (a, b) in zip(parts, world):
            v = (s.to_numpy() - a) / max(b - a, 1e-300)
            if len(v) and (v.min() < 0 or v.max() > 1):
                raise ValueError("a record's centre lies outside the declared world")
            cells.append(np.minimum((v * (1 << bits)).astype(np.int64), top))
        return pd.Series(hilbert(np.stack(cells, 1), bits))

    return data.withColumn("hkey", key(*[center(Box(dims), d) for d in dims]))


def _catalogue_kind(dims: Sequence[int]) -> str:
    return "_level int, node_id long, _parent long, _n long, _leaves long, " + ", ".join(f"_core{d}_{s} double" for d in dims for s in "lh") + f", _clips {CLIP_TYPE}"


def paged(data: DataFrame, dims: Sequence[int], leaf_cap: int, height: int, world: Sequence[tuple[float, float]], key: str, clip: Callable | None) -> DataFrame:
    """Records (``_level`` 0, with their leaf's ``node_id``) and catalogue rows (levels 1 to ``height``) in one table.

    Pages and directory nodes are cut within range partitions. Of a partition only the boxes of its nodes are held."""
    keyed = hilbert_key(data, world, dims)
    lows, highs = [f"x{d}_l" for d in dims], [f"x{d}_h" for d in dims]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields)
    names = [c.split()[0] for c in _catalogue_kind(dims).split(", _clips")[0].split(", ")] + ["_clips"]

    def numbers(t: pa.Table, columns: Sequence[str]) -> np.ndarray:
        return np.stack([t[c].to_numpy() for c in columns], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = np.int64(TaskContext.get().partitionId()) << np.int64(32)
        fields, made, held = None, 0, None
        nodes: list[tuple] = []

        def grouped(low, high, core_low, core_high, n, leaves, first: int, size: int):
            """Groups of ``size`` in a row: their catalogue numbers, and the clip points of the parts' boxes."""
            page = np.arange(len(low)) // size
            starts = np.arange(0, len(low), size)
            clips = clip(low, high, page, len(starts)) if clip else pa.nulls(len(starts), pa.list_(CLIP))
            add = lambda f, x: f.reduceat(x, starts)
            return add(np.minimum, low), add(np.maximum, high), add(np.maximum, core_low), add(np.minimum, core_high), add(np.add, n), add(np.add, leaves), clips, base + first + np.arange(len(starts))

        def rows_of(level: int, group: tuple, parent: np.ndarray | None) -> pa.Table:
            low, high, core_low, core_high, n, leaves, clips, ids = group
            count = len(ids)
            columns = {f.name: pa.nulls(count, f.type) for f in fields}
            for i, d in enumerate(dims):
                columns |= {f"x{d}_l": pa.array(low[:, i]), f"x{d}_h": pa.array(high[:, i])}
            columns |= {"_level": pa.array(np.full(count, level, np.int32)), "node_id": pa.array(ids), "_parent": pa.nulls(count, pa.int64()) if parent is None else pa.array(parent), "_n": pa.array(n), "_leaves": pa.array(leaves)}
            for i, d in enumerate(dims):
                columns |= {f"_core{d}_l": pa.array(core_low[:, i]), f"_core{d}_h": pa.array(core_high[:, i])}
            return pa.table(columns | {"_clips": clips})

        def pages(t: pa.Table) -> pa.Table:
            nonlocal made
            low, high = numbers(t, lows), numbers(t, highs)
            one = np.ones(t.num_rows, np.int64)
            group = grouped(low, high, low, high, one, one, made, leaf_cap)
            group[5][:] = 1
            made += len(group[7])
            nodes.append(group)
            out = t.append_column("_level", pa.array(np.zeros(t.num_rows, np.int32))).append_column("node_id", pa.array(group[7][np.arange(t.num_rows) // leaf_cap]))
            for name in names[2:]:
                out = out.append_column(name, pa.nulls(t.num_rows, pa.list_(CLIP) if name == "_clips" else pa.int64() if name in ("_parent", "_n", "_leaves") else pa.float64()))
            return out

        for b in batches:
            t = pa.Table.from_batches([b]).drop_columns(["hkey"])
            fields = fields or list(t.schema)
            held = t if held is None else pa.concat_tables([held, t])
            whole = held.num_rows // leaf_cap * leaf_cap
            if whole:
                yield from pages(held.slice(0, whole).combine_chunks()).to_batches()
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from pages(held.combine_chunks()).to_batches()
        if not nodes:
            return
        clips = [g[6] for g in nodes]
        group = (*(np.concatenate([g[i] for g in nodes]) for i in range(6)), pa.concat_arrays(clips), np.concatenate([g[7] for g in nodes]))
        for level in range(1, height + 1):
            up = grouped(*group[:6], 0, leaf_cap) if level < height else None
            yield from rows_of(level, group, None if up is None else up[7][np.arange(len(group[7])) // leaf_cap]).to_batches()
            group = up

    sorted_ = keyed.repartitionByRange("hkey", key).sortWithinPartitions("hkey", key)
    return sorted_.mapInArrow(run, f"{kinds}, {_catalogue_kind(dims)}")


class Index:
    """Leaves and catalogue of one table."""

    def __init__(self, spark, path: str, dims: Sequence[int], key: str):
        rows = spark.read.parquet(path)
        self.path, self.dims, self.key = path, tuple(dims), key
        inner = [c.split()[0] for c in _catalogue_kind(dims).split(", _clips")[0].split(", ")] + ["_clips"]
        self.leaves = rows.where("_level = 0").drop(*[c for c in inner if c != "node_id"])
        core = [f"_core{d}_{s}" for d in dims for s in "lh"]
        boxes = Box(dims).columns()
        #: A row per node of every level: level (1: leaves), node_id, parent_id, n (records below), leaves (below), box, core, clips.
        self.catalogue = rows.where("_level > 0").select(F.col("_level").alias("level"), "node_id", F.col("_parent").alias("parent_id"), F.col("_n").alias("n"), F.col("_leaves").alias("leaves"), *boxes, *[F.col(c).alias(c[1:]) for c in core], F.col("_clips").alias("clips"))

    @property
    def nodes(self) -> DataFrame:
        """The catalogue of the leaves."""
        return self.level(1)

    def level(self, level: int) -> DataFrame:
        return self.catalogue.where(F.col("level") == level).drop("level")

    @property
    def height(self) -> int:
        return self.catalogue.agg(F.max("level")).first()[0] or 1  # of the column of levels alone

    @classmethod
    def build(cls, data: DataFrame, dims: Sequence[int] = (0, 1), leaf_cap: int = LEAF_CAP, k: int | None = None, threshold: float = THRESHOLD, method: str | None = "stairline", key: str = "rid", path: str | None = None, height: int | None = None) -> "Index":
        """path: where the index is written; without one it goes to the shared folder, until ``close``. method: how clip
        points are found (None: no clips). height: the number of levels; by default the top one has at least 64 nodes."""
        spark, rows = data.sparkSession, data.where(ok(Box(dims)))
        found = rows.agg(F.count("*").alias("n"), *[f for d in dims for f in (F.min(center(Box(dims), d)).alias(f"a{d}"), F.max(center(Box(dims), d)).alias(f"b{d}"))]).first()
        if height is None:
            height, nodes = 1, found["n"] / leaf_cap
            while nodes >= 64 * leaf_cap:
                height, nodes = height + 1, nodes / leaf_cap
        world = [(found[f"a{d}"] or 0.0, found[f"b{d}"] or 0.0) for d in dims]
        clip = None if method is None else lambda low, high, page, n: clips_of_pages(low, high, page, n, k, threshold, method)
        path = path or f"{folder(spark)}/{uuid.uuid4().hex}"
        paged(rows, dims, leaf_cap, height, world, key, clip).write.mode("overwrite").partitionBy("_level").parquet(path)
        return cls.open(spark, path, dims, key)

    @classmethod
    def open(cls, spark, path: str, dims: Sequence[int] = (0, 1), key: str = "rid") -> "Index":
        spark.catalog.refreshByPath(path)
        return cls(spark, path, dims, key)

    def save(self, path: str) -> "Index":
        """Writes the index to another place, and opens it there."""
        spark = self.leaves.sparkSession
        spark.read.parquet(self.path).write.mode("overwrite").partitionBy("_level").parquet(path)
        return Index.open(spark, path, self.dims, self.key)

    def close(self) -> None:
        """Deletes what was written, if it went to the shared folder."""
        spark = self.leaves.sparkSession
        if self.path.startswith(folder(spark)):
            Index.drop(spark, self.path)

    def reorganized(self, **options) -> "Index":
        """Built anew from its records: full pages, fresh clip points (after inserts or deletes)."""
        return Index.build(self.leaves.drop("node_id"), self.dims, key=self.key, **options)

    @staticmethod
    def drop(spark, path: str) -> bool:
        """Removes a written index; False if there was none."""
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

    def _met(self, clipped: bool):
        """Whether a node (its columns) is read for a query (``q_`` columns): their boxes meet and no clip point rules it out."""
        met = intersects(Box(self.dims), Box(self.dims, "q_"))
        return met & ~clipped_away(Box(self.dims, "q_"), F.col("clips")) if clipped else met

    def _whole(self):
        """Whether all records of a node meet the query."""
        return every([(F.col(f"core{d}_l") <= F.col(f"q_x{d}_h")) & (F.col(f"core{d}_h") >= F.col(f"q_x{d}_l")) for d in self.dims])

    def _descend(self, queries: DataFrame, clipped: bool, stop: bool) -> tuple[DataFrame | None, DataFrame]:
        """(nodes wholly in their queries, leaves to read), as query columns ``q_…`` and node columns. With ``stop`` a branch ends
        where all its records meet the query. What each level leaves is kept, as it feeds both results."""
        height = self.height
        extra = (lambda node, query: ~clipped_away(query, F.col("a_clips"))) if clipped else None
        top = grid_join(self.level(height), queries, self.dims, extra=extra)
        met = top.select(*[F.col(f"b_{c}").alias(f"q_{c}") for c in queries.columns], *[F.col(f"a_{c}").alias(c) for c in self.level(height).columns])
        whole, wanted = None, [f"q_{c}" for c in queries.columns]
        if not stop and height == 1:
            return None, met
        for level in range(height, 0, -1):
            met = kept(met.drop("clips"))
            if stop:
                done = met.where(self._whole())
                whole = done if whole is None else whole.unionByName(done)
                met = met.where(~self._whole())
            if level > 1:
                below = self.level(level - 1)
                met = met.select(*wanted, F.col("node_id").alias("_up")).join(below, F.col("_up") == F.col("parent_id")).where(self._met(clipped)).drop("_up")
        return whole, met

    def visits(self, queries: DataFrame, qid: str = "qid", clipped: bool = True) -> DataFrame:
        """(qid, query box, node_id): the leaves that each query must read."""
        _, met = self._descend(queries.select(F.col(qid).alias("_id"), *Box(self.dims).columns()), clipped, False)
        return met.select(F.col("q__id").alias(qid), *[f"q_{c}" for c in Box(self.dims).columns()], "node_id")

    def matches(self, queries: DataFrame, qid: str = "qid", clipped: bool = True) -> DataFrame:
        """(qid, record columns) of every record that meets a query."""
        met = self.visits(queries, qid, clipped).join(self.leaves, "node_id")
        return met.where(intersects(Box(self.dims), Box(self.dims, "q_")))

    def _records(self, met: DataFrame) -> DataFrame:
        """Query columns and leaf of the records that meet their queries, among leaves to read."""
        wanted = [c for c in met.columns if c.startswith("q_")]
        boxes = self.leaves.select("node_id", *Box(self.dims).columns())
        return met.select(*wanted, "node_id").join(boxes, "node_id").where(intersects(Box(self.dims), Box(self.dims, "q_"))).select(*wanted, "node_id")

    def box_counts(self, queries: DataFrame, clipped: bool = True) -> DataFrame:
        """(box columns, n) of the distinct query boxes that meet records."""
        names = Box(self.dims).columns()
        whole, met = self._descend(queries.where(ok(Box(self.dims))).select(*names).distinct(), clipped, True)
        of = [f"q_{c}" for c in names]
        read = self._records(met).groupBy(*of).agg(F.count("*").alias("n"))
        return whole.select(*of, "n").unionByName(read).groupBy(*[F.col(f"q_{c}").alias(c) for c in names]).agg(F.sum("n").alias("n"))

    def region_counts(self, queries: DataFrame, qid: str = "qid", clipped: bool = True) -> DataFrame:
        """(qid, n), zeros included. Equal query boxes go down once."""
        names = Box(self.dims).columns()
        counts = self.box_counts(queries, clipped).withColumnsRenamed({c: f"_{c}" for c in names})
        joined = queries.select(qid, *names).join(counts, [F.col(c) == F.col(f"_{c}") for c in names], "left")
        return joined.select(qid, F.coalesce("n", F.lit(0)).cast("long").alias("n"))

    def join_count(self, other: "Index", clipped: bool = True) -> DataFrame:
        """One row, n: the number of intersecting pairs of records, by sending the other's distinct boxes down this index."""
        if self.dims != other.dims:
            raise ValueError("indexes of different dimensions")
        names = Box(self.dims).columns()
        counts = self.box_counts(other.leaves, clipped).withColumnsRenamed({c: f"_{c}" for c in names})
        times = other.leaves.groupBy(*names).agg(F.count("*").alias("_times"))
        met = times.join(counts, [F.col(c) == F.col(f"_{c}") for c in names])
        return met.agg(F.coalesce(F.sum(F.col("n") * F.col("_times")), F.lit(0)).cast("long").alias("n"))

    def access_stats(self, queries: DataFrame, qid: str = "qid", clipped: bool = True) -> DataFrame:
        """One row: leaf visits, those with a result, and the most useless visits of one query, over all queries (equal
        ones go down once and count as often as they occur). The leaves of a node that lies wholly in a query are visits with results."""
        names = Box(self.dims).columns()
        distinct = queries.where(ok(Box(self.dims))).groupBy(*names).agg(F.count("*").alias("times"))
        whole, met = self._descend(distinct, clipped, True)
        of = [f"q_{c}" for c in names] + ["q_times"]
        hits = self._records(met).groupBy(*of, "node_id").agg(F.lit(1).alias("u")).groupBy(*of).agg(F.count("*").alias("u"))
        parts = [whole.select(*of, F.col("leaves").alias("v"), F.col("leaves").alias("u")), met.groupBy(*of).agg(F.count("*").alias("v")).withColumn("u", F.lit(0).cast("long")), hits.select(*of, F.lit(0).cast("long").alias("v"), "u")]
        each = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*of).agg(F.sum("v").alias("v"), F.sum("u").alias("u"))
        return each.agg(F.sum(F.col("v") * F.col("q_times")).alias("leaf_visits"), F.sum(F.col("u") * F.col("q_times")).alias("useful_visits"), F.max(F.col("v") - F.col("u")).alias("worst_excess"))

    def join(self, other: "Index", clipped: bool = True) -> DataFrame:
        """All pairs of intersecting records (columns ``a_…``, ``b_…``): pairs of leaves first, whose common
        box must not be clipped away in either, then the records of the surviving pairs."""
        if self.dims != other.dims:
            raise ValueError("indexes of different dimensions")
        pairs = grid_join(self.nodes, other.nodes, self.dims, extra=(lambda a, b: ~self._cut(a, b)) if clipped else None).select("a_node_id", "b_node_id")
        from .joins import _prefixed

        left, right = _prefixed(self.leaves, "a_"), _prefixed(other.leaves, "b_")
        met = pairs.join(left, "a_node_id").join(right, "b_node_id").where(intersects(Box(self.dims, "a_"), Box(self.dims, "b_")))
        return met.drop("a_node_id", "b_node_id")

    def _cut(self, a: Box, b: Box):
        """Whether the intersection of the two leaves' boxes is clipped away in one of them."""
        common = _Common(self.dims, a, b)
        return clipped_away(common, F.col("a_clips")) | clipped_away(common, F.col("b_clips"))

    def describe(self) -> DataFrame:
        """One row: leaves, records, mean, least and most records a leaf."""
        return self.nodes.agg(F.count("*").alias("n_leaves"), F.sum("n").alias("n_records"), F.avg("n").alias("avg_fill"), F.min("n").alias("min_fill"), F.max("n").alias("max_fill"))

    def describe_levels(self) -> DataFrame:
        """A row per level: nodes, records and leaves below them, mean box volume, and clip points."""
        box = volume(Box(self.dims))
        return self.catalogue.groupBy("level").agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_records"), F.sum("leaves").alias("n_leaves"), F.avg(box).alias("avg_volume"), F.sum(F.coalesce(F.size("clips"), F.lit(0))).alias("n_clips"))


class _Common(Box):
    """The intersection of two column boxes, as a box."""

    def __init__(self, dims, a: Box, b: Box):
        super().__init__(tuple(dims))
        object.__setattr__(self, "_pair", (a, b))

    def low(self, d: int):
        return F.greatest(*[x.low(d) for x in self._pair])

    def high(self, d: int):
        return F.least(*[x.high(d) for x in self._pair])
