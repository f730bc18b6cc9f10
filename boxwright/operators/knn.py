"""Distance browsing, nearest and farthest neighbours, and orders by proximity. Ties go by ``rid``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import Box, center, distance
from .storage import kept


#: Cells of the bounding tables of ``_farthest_cells``: at most so many for the records and for the points.
CELLS = 1024


def browse(data: DataFrame, point: Sequence[float], dims: Sequence[int] = (0, 1), kind: str = "min", metric: str = "euclid", farthest: bool = False, start: float = 0.0, end: float | None = None, where: Column | None = None, k: int | None = None, key: str = "rid") -> DataFrame:
    """Records with ``dist`` in increasing (or with ``farthest`` decreasing) order.

    start: with 0 no bound, else dist >= start (farthest: <= start); end: dist <= end (farthest: >= end);
    Euclidean bounds are given as radii and compared squared. k: at most so many (a top-k, no full sort).
    """
    square = (lambda r: r * r) if metric == "euclid" else (lambda r: r)
    rows = (data if where is None else data.where(where)).withColumn("dist", distance(Box(dims), [F.lit(float(p)) for p in point], kind, metric))
    if start:
        rows = rows.where(F.col("dist") <= square(start) if farthest else F.col("dist") >= square(start))
    if end is not None:
        rows = rows.where(F.col("dist") >= square(end) if farthest else F.col("dist") <= square(end))
    rows = rows.orderBy(F.desc("dist") if farthest else F.asc("dist"), F.asc(key))
    return rows.limit(k) if k else rows


def _ranked(pairs: DataFrame, k: int, farthest: bool, qid: str, rid: str) -> DataFrame:
    order = Window.partitionBy(qid).orderBy(F.desc("dist") if farthest else F.asc("dist"), F.asc(rid))
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _first_of_equal(data: DataFrame, k: int, names: Sequence[str], rid: str) -> DataFrame:
    """The k least ``rid`` of each box: equal boxes are equally far from all points, so no other can be among k neighbours."""
    order = Window.partitionBy(*names).orderBy(rid)
    return data.select(rid, *names).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k).drop("_place")


def knn_scan(data: DataFrame, points: DataFrame, k: int, dims: Sequence[int] = (0, 1), kind: str = "min", metric: str = "euclid", farthest: bool = False, qid: str = "qid", rid: str = "rid") -> DataFrame:
    """(qid, rid, dist, rank) of the k nearest or farthest records of each point, by any kind of distance.

    Nearest: by ``knn_join``. Farthest: under the maximum and Manhattan metrics a distance is the largest of a few sums
    of a record's sides and the point's coordinates, so the k first records of each such sum, whatever the point, are
    all the candidates there are; under the Euclidean metric bounds between cells leave out most. Distances that
    are equal only after rounding may be ordered otherwise than by rid. points: qid and p0, p1, …; nulls are not allowed.
    """
    if not farthest:
        return knn_join(data, points, k, dims, metric, qid, rid, kind)
    left, right = data.select(rid, *Box(dims).columns()), points.select(qid, *[f"p{i}" for i in dims])
    d = distance(Box(dims), [F.col(f"p{i}") for i in dims], kind, metric)
    if metric == "euclid":
        pairs = _farthest_cells(_first_of_equal(left, k, Box(dims).columns(), rid), right, k, dims, kind, metric)
    else:
        found = None
        for f in _sums(dims, kind, metric):
            first = left.orderBy(F.desc(f), F.asc(rid)).limit(k)
            found = first if found is None else found.unionAll(first)
        one = found.distinct().agg(F.collect_list(F.struct(*left.columns)).alias("_found"))  # one row of at most k records a sum
        pairs = right.join(one.hint("broadcast"), F.lit(True)).select(*right.columns, F.inline("_found"))
    return _ranked(pairs.select(qid, rid, d.alias("dist")), k, farthest, qid, rid)


def _sums(dims: Sequence[int], kind: str, metric: str) -> list[Column]:
    """Parts of a record's distance that the point doesn't enter: the distance is the largest of them, each with a number of the point's."""
    box = Box(dims)
    sides = {"max": lambda d: [box.high(d), -box.low(d)], "center": lambda d: [center(box, d), -center(box, d)], "min": lambda d: [box.low(d), -box.high(d), F.lit(0.0)]}[kind]
    if metric == "maximum":
        return [s for d in dims for s in sides(d)]
    out = [F.lit(0.0)]
    for d in dims:
        out = [a + s for a in out for s in sides(d)]
    return out


def _reach(low: Sequence, high: Sequence, p: Sequence, kind: str, metric: str, least, most, zero):
    """(least, largest) distance of any point between p = (low, high) and any record with low and high sides in the given ranges, a range a dimension."""
    lower, upper = [], []
    for (l0, l1), (h0, h1), (a, b) in zip(low, high, p):
        if kind == "max":
            lower.append(most(h0 - b, a - l1, (h0 - l1) / 2))
            upper.append(most(h1 - a, b - l0))
        elif kind == "center":
            c0, c1 = (l0 + h0) / 2, (l1 + h1) / 2
            lower.append(most(c0 - b, a - c1, zero))
            upper.append(most(c1 - a, b - c0))
        else:
            lower.append(most(l0 - b, a - h1, zero))
            upper.append(most(l1 - a, b - h0, zero))
    return least(lower), least(upper)


def _farthest_cells(left: DataFrame, right: DataFrame, k: int, dims: Sequence[int], kind: str, metric: str) -> DataFrame:
    """Pairs that hold the k farthest records of each point. Records and points are put into at most ``CELLS`` cells
    each. For each cell of points, the cells of records of the largest least distance that hold k records give a
    bound; cells, and then records, that cannot reach it from there are left out. An equi-join on cells of points."""
    side = max(1, int(CELLS ** (1 / len(dims))))

    def celled(df: DataFrame, at: Sequence[Column], name: str) -> DataFrame:
        ends = df.agg(*[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(at) for f in (F.min, F.max)]).first()
        cell = F.lit(0)
        for i, c in enumerate(at):
            a, b = ends[f"min{i}"] or 0.0, ends[f"max{i}"] or 0.0
            step = (b - a) / side
            cell = cell * side + (F.least(F.floor((c - a) / step), F.lit(side - 1)) if step > 0 else F.lit(0))
        return df.withColumn(name, cell.cast("int"))

    records = celled(left, [center(Box(dims), d) for d in dims], "_r")
    spots = celled(right, [F.col(f"p{d}") for d in dims], "_p")
    r = records.groupBy("_r").agg(F.count("*").alias("n"), *[f(f"x{d}_{s}").alias(f"{f.__name__}{d}{s}") for d in dims for s in "lh" for f in (F.min, F.max)]).toPandas()
    p = spots.groupBy("_p").agg(*[f(f"p{d}").alias(f"{f.__name__}{d}") for d in dims for f in (F.min, F.max)]).toPandas()
    most = lambda *x: np.maximum.reduce(np.broadcast_arrays(*x))
    total = (lambda x: sum(v * v for v in x)) if metric == "euclid" else (lambda x: sum(x)) if metric == "manhattan" else (lambda x: most(*x))
    lows, highs = ([(r[f"min{d}{s}"].to_numpy()[None, :], r[f"max{d}{s}"].to_numpy()[None, :]) for d in dims] for s in "lh")
    lower, upper = _reach(lows, highs, [(p[f"min{d}"].to_numpy()[:, None], p[f"max{d}"].to_numpy()[:, None]) for d in dims], kind, metric, total, most, 0.0)
    spark, rows = left.sparkSession, []
    for i in range(len(p)):
        order = np.argsort(-lower[i], kind="stable")
        enough = np.searchsorted(np.cumsum(r["n"].to_numpy()[order]), k)
        bound = float(lower[i][order[enough]]) * (1 - 1e-9) if enough < len(order) else 0.0
        box = [float(p[f"{f}{d}"][i]) for d in dims for f in ("min", "max")]
        rows += [(int(p["_p"][i]), int(r["_r"][j]), bound, *box) for j in np.flatnonzero(upper[i] >= bound)]
    kinds = "_p int, _r int, _bound double, " + ", ".join(f"_{f}{d} double" for d in dims for f in ("a", "b"))
    near = spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in kinds.split(", ")]) if rows else [], kinds)  # at most CELLS ** 2 rows
    greatest = lambda *x: F.greatest(*x)
    columns = {"euclid": lambda x: sum((v * v for v in x[1:]), x[0] * x[0]), "manhattan": lambda x: sum(x[1:], x[0]), "maximum": lambda x: F.greatest(*x) if len(x) > 1 else x[0]}[metric]
    box = Box(dims)
    far = _reach([(box.low(d),) * 2 for d in dims], [(box.high(d),) * 2 for d in dims], [(F.col(f"_a{d}"), F.col(f"_b{d}")) for d in dims], kind, metric, columns, greatest, F.lit(0.0))[1]
    chosen = records.join(near, "_r").where(far >= F.col("_bound")).select("_p", *left.columns)
    return spots.join(chosen, "_p")


def knn_join(data: DataFrame, points: DataFrame, k: int, dims: Sequence[int] = (0, 1), metric: str = "euclid", qid: str = "qid", rid: str = "rid", kind: str = "min") -> DataFrame:
    """(qid, rid, dist, rank): the k nearest records of each point, by growing rings of cells.

    A point first looks for records within a radius that should hold 2 k of them if they lay evenly, by a grid
    join; no kind of distance is less than that to the nearest point of a box. A point is done when it found k within
    the radius, as none outside can be nearer; the others go on with four times the radius, which ends at the span
    of the data. Each round's results are kept in the shared folder. Of equal boxes only the k first by ``rid`` take part,
    and equal points are searched from once.
    """
    names, at = Box(dims).columns(), [f"p{i}" for i in dims]
    asked = points.select(qid, *at)
    left = kept(_first_of_equal(data, k, names, rid))
    places = kept(asked.select(*at).distinct().withColumn("_place", F.monotonically_increasing_id()))
    bound = left.agg(F.count("*").alias("n"), *[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.min, F.max)]).first()
    far = places.agg(*[f(p).alias(f"{f.__name__}_{p}") for p in at for f in (F.min, F.max)]).first()
    span, size = 0.0, 1.0
    if bound["n"] and far[0] is not None:
        span = max(max(bound[f"max_x{i}_h"], far[f"max_p{i}"]) - min(bound[f"min_x{i}_l"], far[f"min_p{i}"]) for i in dims)
        for i in dims:
            size *= max(bound[f"max_x{i}_h"] - bound[f"min_x{i}_l"], 1e-9)
    radius = max(0.5 * (2.0 * k * size / max(bound["n"], 1)) ** (1.0 / len(dims)), 1e-9)
    reach = 2 * span * (len(dims) if metric == "manhattan" else len(dims) ** 0.5)
    done, left_over = [], places
    while True:
        if radius >= reach or bound["n"] <= k:
            done.append(_ranked(_within(left, left_over, dims, reach, "_place", rid, metric, kind), k, False, "_place", rid))
            break
        limit = radius * radius if metric == "euclid" else radius
        ranked = kept(_ranked(_within(left, left_over, dims, radius, "_place", rid, metric, kind).where(F.col("dist") <= limit), k, False, "_place", rid))
        full = ranked.where(F.col("rank") == k).select("_place")
        done.append(ranked.join(full, "_place", "left_semi"))
        left_over = left_over.join(full, "_place", "left_anti")
        if left_over.isEmpty():
            break
        radius *= 4
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return asked.join(places, at).join(out, "_place").select(qid, rid, "dist", "rank")


def _within(data: DataFrame, points: DataFrame, dims: Sequence[int], radius: float, qid: str, rid: str, metric: str, kind: str) -> DataFrame:
    from .joins import grid_join

    around = points
    for i in dims:
        around = around.withColumns({f"x{i}_l": F.col(f"p{i}") - radius, f"x{i}_h": F.col(f"p{i}") + radius})
    pairs = grid_join(data, around, dims)
    d = distance(Box(dims, "a_"), [F.col(f"b_p{i}") for i in dims], kind, metric)
    return pairs.select(F.col(f"b_{qid}").alias(qid), F.col(f"a_{rid}").alias(rid), d.alias("dist"))


def proximity_sort(data: DataFrame, dims: Sequence[int] = (0, 1), origin: Sequence[float] | None = None, key: str = "rid") -> DataFrame:
    """All records by distance from the origin, with a global rank made without a single-partition window."""
    rows = data.withColumn("dist", distance(Box(dims), [F.lit(float(p)) for p in (origin or [0.0] * len(dims))]))
    return ranked_globally(rows, ["dist", key])


def ranked_globally(rows: DataFrame, order: Sequence[str], name: str = "rank") -> DataFrame:
    """``rows`` with their 1-based place in the order.

    They are range-partitioned, sorted and written once, each with its partition's number and its place there; counts
    of partitions, read back from what was written, give the rest. So no second evaluation, which could
    cut the ranges elsewhere, takes part, and any number of partitions gives the same ranks. The order must be total
    over distinct rows for the ranks to be reproducible."""
    placed = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    joined = placed.withColumn("_part", part).join(before.select("_part", "_before").hint("broadcast"), "_part")
    return joined.withColumn(name, F.col("_before") + place + 1).drop("_part", "_id", "_before")


def _chain(pdf: pd.DataFrame, dims: Sequence[int], starts: int | None, farthest: bool, move: bool, seed: int) -> np.ndarray:
    low = pdf[[f"x{d}_l" for d in dims]].to_numpy(float)
    high = pdf[[f"x{d}_h" for d in dims]].to_numpy(float)
    mid = (low + high) / 2
    left = np.ones(len(pdf), bool)
    rng = np.random.default_rng(seed)
    points = [(low.min(0) + high.max(0)) / 2] if starts is None else []
    out: list[int] = []
    rid = pdf["rid"].to_numpy()
    while left.any():
        if starts is not None and len(points) < starts:
            points.append(rng.uniform(low.min(0), high.max(0)))
        for j in range(len(points)):
            if not left.any():
                break
            gap = np.maximum(np.maximum(low - points[j], points[j] - high), 0)
            dist = np.where(left, (gap * gap).sum(1), -np.inf if farthest else np.inf)
            best = dist.max() if farthest else dist.min()
            pick = min(np.flatnonzero(dist == best), key=lambda i: rid[i])
            left[pick] = False
            out.append(pick)
            if move or starts is None:
                points[j] = mid[pick]
    return np.array(out)


def nearest_chain(data: DataFrame, dims: Sequence[int] = (0, 1), starts: int | None = None, farthest: bool = False, move: bool = True, seed: int = 1, group: str | None = None) -> DataFrame:
    """Greedy order: from the centre of the world repeatedly to the nearest record left (with ``starts``:
    from so many random points in turn). Each step depends on the one before, so a group is one task's
    work; give ``group`` to order the records of each group for itself. Meant for bounded groups."""
    names = Box(dims).columns()
    rows = data.select(*([group] if group else []), "rid", *names)
    if not group:
        rows = rows.withColumn("_all", F.lit(0))
    key = group or "_all"
    kind = dict(rows.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = _chain(pdf, dims, starts, farthest, move, seed)
        return pd.DataFrame({key: pdf[key].iloc[0], "rid": pdf["rid"].to_numpy()[order], "step": np.arange(1, len(order) + 1)})

    out = rows.groupBy(key).applyInPandas(run, f"{key} {kind}, rid long, step long")
    return out if group else out.drop("_all")


def query_boxes(data: DataFrame, points: DataFrame, counts: Column, most: int, dims: Sequence[int] = (0, 1), qid: str = "qid") -> DataFrame:
    """Query boxes made to hit about ``counts`` (a column over the points) records: for each point the least
    box that touches the near sides of so many maximum-metric nearest records."""
    near = knn_join(data, points, most, dims, "maximum", qid).join(points.withColumn("_want", counts), qid).where(F.col("rank") <= F.col("_want"))
    full = near.join(data.select("rid", *Box(dims).columns()), "rid")
    aggs = []
    for d in dims:
        p = F.col(f"p{d}")
        aggs += [F.min(F.least(p, F.col(f"x{d}_h"))).alias(f"x{d}_l"), F.max(F.greatest(p, F.col(f"x{d}_l"))).alias(f"x{d}_h")]
    return full.groupBy(qid).agg(*aggs)


def densify(data: DataFrame, g: int, dims: Sequence[int] = (0, 1), key: str = "rid", points: DataFrame | None = None) -> DataFrame:
    """Each record's g nearest records mapped into a cell around its centre: g times as many boxes, at the same density."""
    centers = data.select(F.col(key).alias("qid"), *[center(Box(dims), d).alias(f"p{d}") for d in dims]) if points is None else points
    near = knn_join(data, centers, g, dims).join(data.select(key, *Box(dims).columns()), key).join(centers, "qid")
    span = near.groupBy("qid").agg(*[F.greatest(F.max(F.abs(F.col(f"x{d}_l") - F.col(f"p{d}"))), F.max(F.abs(F.col(f"x{d}_h") - F.col(f"p{d}"))), F.lit(1e-12)).alias(f"_s{d}") for d in dims])
    scale = 1.0 / g ** (1.0 / len(dims))
    return near.join(span, "qid").select("qid", key, *[(F.col(f"p{d}") + (F.col(f"x{d}_{s}") - F.col(f"p{d}")) * scale).alias(f"x{d}_{s}") for d in dims for s in "lh"])
