"""Clip points: the empty corners of a node's box.

For each corner, coordinates are flipped so that the corner is the maximum of every dimension (low sides
negated). Skyline points are the entry corners no other dominates. A stairline point is the coordinatewise
least of two skyline points, kept when it cuts off more than ``threshold`` of the node's volume and no
third skyline point reaches it. Of a corner's points the one of the largest volume scores that volume,
every other its volume less its overlap with that one, and must stay over the threshold; the ``k`` best
of all corners (2 ** D by default) are a node's clip points. Nodes of zero volume have none.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import Box

THRESHOLD = 0.025
CLIP_TYPE = "array<struct<corner:int,p:array<double>,score:double>>"


def signed(low: np.ndarray, high: np.ndarray, corner: int) -> np.ndarray:
    """Entry corners with the corner's direction upwards in every dimension."""
    bits = np.array([corner >> d & 1 for d in range(low.shape[1])], bool)
    return np.where(bits, high, -low)


def skyline(points: np.ndarray) -> np.ndarray:
    """The distinct points that no other one reaches in every dimension."""
    p = np.unique(points, axis=0)
    if p.shape[1] == 2:  # sorted by the first coordinate: those above all later ones in the second
        later = np.maximum.accumulate(p[::-1, 1])[::-1]
        keep = np.ones(len(p), bool)
        keep[:-1] = p[:-1, 1] > later[1:]
        return p[keep]
    order = np.argsort(-p.sum(1), kind="stable")
    kept: list[np.ndarray] = []
    for x in p[order]:
        if not any((y >= x).all() for y in kept):
            kept.append(x)
    return np.array(kept)


def stairline(sky: np.ndarray, top: np.ndarray, node_volume: float, threshold: float) -> np.ndarray:
    if sky.shape[1] == 2:  # any two that aren't neighbours have a third point between them that reaches their least
        sky = sky[np.argsort(sky[:, 0])]
        at = np.minimum(sky[:-1], sky[1:])
        return at[np.prod(top - at, axis=1) > threshold * node_volume]
    found = []
    for i in range(len(sky)):
        for j in range(i + 1, len(sky)):
            s = np.minimum(sky[i], sky[j])
            others = np.ones(len(sky), bool)
            others[[i, j]] = False
            if np.prod(top - s) > threshold * node_volume and not (sky[others] >= s).all(1).any():
                found.append(s)
    return np.unique(np.array(found), axis=0) if found else np.zeros((0, sky.shape[1]))


def clips_of(low: np.ndarray, high: np.ndarray, k: int | None = None, threshold: float = THRESHOLD, method: str = "stairline") -> list[dict]:
    """The clip points of one node, best first."""
    dims = low.shape[1]
    node = float(np.prod(high.max(0) - low.min(0)))
    if node <= 0:
        return []
    out = []
    for corner in range(1 << dims):
        points = signed(low, high, corner)
        top = points.max(0)
        sky = skyline(points)
        if method == "stairline":
            at = stairline(sky, top, node, threshold)
        else:
            at = sky if len(sky) >= 3 else sky[:0]
        if not len(at):
            continue
        size = np.prod(top - at, axis=1)
        order = sorted(range(len(at)), key=lambda i: (-size[i], tuple(at[i])))
        best = order[0]
        both = np.prod(top - np.maximum(at, at[best]), axis=1)
        flip = np.array([1.0 if corner >> d & 1 else -1.0 for d in range(dims)])
        for i in order:
            score = size[i] if i == best else size[i] - both[i]
            if score > threshold * node:
                out.append({"corner": corner, "p": (at[i] * flip + 0.0).tolist(), "score": float(score)})
    out.sort(key=lambda c: (-c["score"], c["corner"], c["p"]))
    return out[: k if k is not None else 1 << dims]


def page_skylines(low: np.ndarray, high: np.ndarray, page: np.ndarray, corner: int) -> np.ndarray:
    """Places (of entries) of a plane corner's skyline in each page, pages ascending, then the first flipped coordinate descending."""
    s = signed(low, high, corner)
    order = np.lexsort((-s[:, 1], -s[:, 0], page))
    _, rank = np.unique(s[order, 1], return_inverse=True)
    key = page[order].astype(np.int64) * (len(page) + 1) + rank + 1  # a running maximum that starts anew with each page
    before = np.concatenate([[-1], np.maximum.accumulate(key)[:-1]]) if len(key) else key
    return order[key > np.maximum(before, page[order].astype(np.int64) * (len(page) + 1))]


def select_clips(corners: Sequence[tuple[np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray, k: int, threshold: float, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(page, corner, points, score) of the clip points in the plane of many pages at once, best first in each page.

    corners: for each corner the page and the flipped coordinates of its skyline points, as ``page_skylines``
    orders them; low, high: the pages' boxes."""
    volume = np.prod(high - low, axis=1)
    found: list[tuple] = []
    for corner, (page, sky) in enumerate(corners):
        top = signed(low, high, corner)
        if method == "stairline":  # two neighbours make a point; any others have a third between them
            pair = np.flatnonzero(page[1:] == page[:-1])
            at, of = np.stack([sky[pair + 1, 0], sky[pair, 1]], 1), page[pair]
            size = np.prod(top[of] - at, axis=1)
            keep = size > threshold * volume[of]
        else:
            at, of = sky, page
            size = np.prod(top[of] - at, axis=1)
            keep = np.bincount(page, minlength=len(low))[of] >= 3
        keep &= volume[of] > 0
        at, of, size = at[keep], of[keep], size[keep]
        order = np.lexsort((at[:, 1], at[:, 0], -size, of))
        at, of, size = at[order], of[order], size[order]
        first = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
        best = np.maximum.accumulate(np.where(first, np.arange(len(of)), 0)) if len(of) else np.zeros(0, int)
        score = np.where(first, size, size - np.prod(top[of] - np.maximum(at, at[best]), axis=1))
        keep = score > threshold * volume[of]
        flip = np.array([1.0 if corner >> d & 1 else -1.0 for d in (0, 1)])
        found.append((of[keep], np.full(keep.sum(), corner, np.int32), at[keep] * flip + 0.0, score[keep]))
    page, corner, at, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((at[:, 1], at[:, 0], corner, -score, page))
    page, corner, at, score = page[order], corner[order], at[order], score[order]
    place = np.arange(len(page)) - np.searchsorted(page, page)
    return page[place < k], corner[place < k], at[place < k], score[place < k]


def clip_arrays(n: int, page: np.ndarray, corner: np.ndarray, at: np.ndarray, score: np.ndarray) -> pa.Array:
    """The ``clips`` column of n pages."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(page, minlength=n))]).astype(np.int32)
    points = pa.ListArray.from_arrays(pa.array(np.arange(len(page) + 1, dtype=np.int32) * at.shape[1]), pa.array(at.reshape(-1)))
    items = pa.StructArray.from_arrays([pa.array(corner, pa.int32()), points, pa.array(score)], ["corner", "p", "score"])
    return pa.ListArray.from_arrays(pa.array(ends), items)


def clips_of_pages(low: np.ndarray, high: np.ndarray, page: np.ndarray, n: int, k: int | None = None, threshold: float = THRESHOLD, method: str = "stairline") -> pa.Array:
    """The ``clips`` column of n pages, each with at least one entry; page: the entries' pages, ascending. In the plane all pages go through together."""
    starts = np.searchsorted(page, np.arange(n))
    if low.shape[1] != 2:
        each = [clips_of(low[a:b], high[a:b], k, threshold, method) for a, b in zip(starts, [*starts[1:], len(page)])]
        flat = [(i, c) for i, clips in enumerate(each) for c in clips]
        return clip_arrays(n, np.array([i for i, _ in flat], int), np.array([c["corner"] for _, c in flat], np.int32), np.array([c["p"] for _, c in flat], float).reshape(-1, low.shape[1]), np.array([c["score"] for _, c in flat], float))
    corners = []
    for c in range(4):
        at = page_skylines(low, high, page, c)
        corners.append((page[at], signed(low[at], high[at], c)))
    return clip_arrays(n, *select_clips(corners, np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), 4 if k is None else k, threshold, method))


def build_clips(entries: DataFrame, dims: Sequence[int] = (0, 1), k: int | None = None, threshold: float = THRESHOLD, method: str = "stairline", node: str = "node_id") -> DataFrame:
    """(node, clips) of every node. In the plane the skylines are found by the engine (``corner_skylines``), so that a
    node may have any number of entries; its skylines, which are short, then travel as one row. In other dimensions a
    node is a page of entries, computed in one step."""
    names = [f"x{d}_{s}" for s in "lh" for d in dims]
    kind = dict(entries.dtypes)[node]
    if len(dims) != 2:
        n = len(dims)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            v = pdf[names].to_numpy(float)
            return pd.DataFrame({node: [pdf[node].iloc[0]], "clips": [clips_of(v[:, :n], v[:, n:], k, threshold, method)]})

        return entries.select(node, *names).groupBy(node).applyInPandas(run, f"{node} {kind}, clips {CLIP_TYPE}")
    point = F.struct(F.col("corner").alias("c"), *[F.col(f"s{d}").alias(f"s{i}") for i, d in enumerate(dims)])
    rows = corner_skylines(entries, dims, node).groupBy(node).agg(F.collect_list(point).alias("sky"))

    def run_pages(batches):
        for b in batches:
            lists = b.column("sky")
            flat = lists.flatten()
            c, at = flat.field("c").to_numpy(), np.stack([flat.field(f"s{i}").to_numpy() for i in (0, 1)], 1)
            page = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            order = np.lexsort((-at[:, 0], c, page))
            c, at, page = c[order], at[order], page[order]
            corners = [(page[c == i], at[c == i]) for i in range(4)]
            most = [np.maximum.reduceat(x, np.searchsorted(p, np.arange(b.num_rows))) if b.num_rows else x for p, x in corners]
            low, high = -most[0], most[3]
            clips = clip_arrays(b.num_rows, *select_clips(corners, low, high, 4 if k is None else k, threshold, method))
            yield pa.RecordBatch.from_arrays([b.column(node), clips], [node, "clips"])

    return rows.mapInArrow(run_pages, f"{node} {kind}, clips {CLIP_TYPE}")


def corner_skylines(entries: DataFrame, dims: Sequence[int] = (0, 1), node: str = "node_id") -> DataFrame:
    """(node, corner, s…): the skyline in flipped coordinates of each node and corner.

    In the plane: of each first coordinate the largest second one, added up before the shuffle; sorted by the first
    downwards, a point is on the skyline if its second is above all before it. Else by anti join."""
    rows = [F.struct(F.lit(c).alias("corner"), *[(F.col(f"x{d}_h") if c >> i & 1 else -F.col(f"x{d}_l")).alias(f"s{d}") for i, d in enumerate(dims)]) for c in range(1 << len(dims))]
    points = entries.select(node, F.inline(F.array(*rows)))
    if len(dims) == 2:
        s, t = (f"s{d}" for d in dims)
        tops = points.groupBy(node, "corner", s).agg(F.max(t).alias(t))
        ahead = Window.partitionBy(node, "corner").orderBy(F.desc(s)).rowsBetween(Window.unboundedPreceding, -1)
        before = F.max(t).over(ahead)
        return tops.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(t) > F.col("_before"))).drop("_before")
    points = points.distinct()
    other = points.select(F.col(node).alias("_n"), F.col("corner").alias("_c"), *[F.col(f"s{d}").alias(f"_s{d}") for d in dims])
    reach, beyond = F.lit(True), F.lit(False)
    for d in dims:
        reach = reach & (F.col(f"_s{d}") >= F.col(f"s{d}"))
        beyond = beyond | (F.col(f"_s{d}") > F.col(f"s{d}"))
    return points.join(other, (F.col(node) == F.col("_n")) & (F.col("corner") == F.col("_c")) & reach & beyond, "left_anti")


def clip_stats(nodes: DataFrame) -> DataFrame:
    """One row: nodes, clip points in all, mean and most per node, and their bytes (4 for the corner, 8 a coordinate)."""
    n = F.coalesce(F.size("clips"), F.lit(0))
    dims = F.coalesce(F.max(F.when(n > 0, F.size(F.get(F.col("clips"), F.lit(0))["p"]))), F.lit(0))
    return nodes.agg(F.count("*").alias("n_nodes"), F.sum(n).alias("n_clips"), F.avg(n.cast("double")).alias("avg_clips"), F.max(n).alias("max_clips"), (F.sum(n) * (4 + 8 * dims)).alias("n_bytes"))


def explode_clips(nodes: DataFrame, dims: Sequence[int] = (0, 1), node: str = "node_id") -> DataFrame:
    """A row per clip point: node, corner, p…, score."""
    return nodes.select(node, F.inline("clips")).select(node, "corner", *[F.get(F.col("p"), F.lit(i)).alias(f"p{d}") for i, d in enumerate(dims)], "score")


def entry_mbbs(entries: DataFrame, dims: Sequence[int] = (0, 1), node: str = "node_id") -> DataFrame:
    """The node catalogue without clips: node, n and box."""
    return entries.groupBy(node).agg(F.count("*").alias("n"), *[(F.min if s == "l" else F.max)(f"x{d}_{s}").alias(f"x{d}_{s}") for d in dims for s in "lh"])


