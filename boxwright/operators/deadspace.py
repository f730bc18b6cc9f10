"""Dead space: how much of a node's bounding shape no entry covers.

Measures of one node are computed together in one grouped step; a node is a page of entries.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clip import THRESHOLD, clips_of

PIXELS = 100


def union_area(low: np.ndarray, high: np.ndarray) -> float:
    """Exact area (volume) of the union of boxes by coordinate compression."""
    if not len(low):
        return 0.0
    edges = [np.unique(np.concatenate([low[:, d], high[:, d]])) for d in range(low.shape[1])]
    covered = np.zeros([max(len(e) - 1, 0) for e in edges], bool)
    for a, b in zip(low, high):
        covered[tuple(slice(np.searchsorted(e, a[d]), np.searchsorted(e, b[d])) for d, e in enumerate(edges))] = True
    sizes = np.ones(1)
    for e in edges:
        sizes = np.multiply.outer(sizes, np.diff(e))
    return float((sizes.reshape(covered.shape) * covered).sum())


def _pixels(base: np.ndarray, top: np.ndarray, pixels: int) -> np.ndarray:
    """Cells of a node's box a dimension: ``pixels`` along its longest side."""
    span = top - base
    return np.ceil(span * pixels / span.max()).astype(int)


def _counted(base: np.ndarray, top: np.ndarray, low: np.ndarray, high: np.ndarray, bounds: np.ndarray):
    """The number of boxes over each cell, after each box."""
    seen = np.zeros(bounds, np.int32)
    first = np.floor((low - base) / (top - base) * bounds).astype(int)
    last = np.floor((high - base) / (top - base) * bounds).astype(int)
    last = np.where((first == last) & (first != bounds), last + 1, last)
    for a, b in zip(first, last):
        seen[tuple(slice(x, y) for x, y in zip(a, b))] += 1
        yield seen


def pixel_coverage(low: np.ndarray, high: np.ndarray, pixels: int = PIXELS) -> tuple[float, float]:
    """(covered, covered twice or more) share of the node's box, in two or three dimensions, on a grid of ``pixels`` cells along its longest side."""
    base, top = low.min(0), high.max(0)
    seen = np.zeros(1)
    for seen in _counted(base, top, low, high, _pixels(base, top, pixels)):
        pass
    return float((seen > 0).mean()), float((seen > 1).mean())


def pixel_clipped(base: np.ndarray, top: np.ndarray, low: np.ndarray, high: np.ndarray, pixels: int = PIXELS) -> list[tuple[float, float]]:
    """(clipped away, clipped away twice or more) share of the node's box after each clip box, on the grid of ``pixel_coverage``."""
    return [(float((seen > 0).mean()), float((seen > 1).mean())) for seen in _counted(base, top, low, high, _pixels(base, top, pixels))]


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull of points in the plane, counter-clockwise."""
    p = sorted(set(map(tuple, points.tolist())))
    if len(p) < 3:
        return np.array(p)

    def half(seq):
        out: list[tuple[float, float]] = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def polygon_area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def enclosing_circle(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and radius of the least circle around points in the plane (incremental, on the hull)."""
    p = hull(points)
    rng = np.random.default_rng(0)
    p = p[rng.permutation(len(p))]
    c, r = p[0], 0.0

    def out(q):
        return np.hypot(*(q - c)) > r * (1 + 1e-12) + 1e-15

    for i in range(len(p)):
        if not out(p[i]):
            continue
        c, r = p[i], 0.0
        for j in range(i):
            if not out(p[j]):
                continue
            c, r = (p[i] + p[j]) / 2, float(np.hypot(*(p[i] - p[j])) / 2)
            for k in range(j):
                if out(p[k]):
                    a, b, d = p[i], p[j], p[k]
                    m = np.array([b - a, d - a]) * 2
                    c = np.linalg.solve(m, np.array([(b * b - a * a).sum(), (d * d - a * a).sum()]))
                    r = float(np.hypot(*(a - c)))
    return c, r


def rotated_box_area(p: np.ndarray) -> float:
    """Area of the least rectangle of any orientation around a convex polygon: one side lies on an edge of it."""
    best = np.inf
    for a, b in zip(p, np.roll(p, -1, axis=0)):
        u = (b - a) / np.hypot(*(b - a))
        s, t = p @ u, p @ np.array([-u[1], u[0]])
        best = min(best, (s.max() - s.min()) * (t.max() - t.min()))
    return float(best)


def _cross(u: np.ndarray, v: np.ndarray):
    return u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]


def corner_polygon_area(p: np.ndarray, corners: int) -> float:
    """Area of the least polygon of at most ``corners`` corners around a convex polygon (counter-clockwise).

    All edges of a least polygon but one lie on edges of the convex polygon, and the one that doesn't touches it
    at its own middle. The area added between two edges next to each other in the result is a cost of that pair,
    with or without a free edge between them, so the least sum over closed chains of edges is found step by step."""
    n = len(p)
    if n <= corners:
        return polygon_area(p)
    p = np.asarray(p, float)
    twice = np.concatenate([p, p, p[:1]])
    way = np.roll(p, -1, axis=0) - p
    inner = np.concatenate([[0.0], np.cumsum(_cross(twice[:-1], twice[1:]))])
    size = np.abs(p).max() ** 2 + 1e-300
    flush, free = np.full((n, n + 1), np.inf), np.full((n, n + 1), np.inf)  # from edge i over ``step`` edges on
    for i in range(n):
        for step in range(1, n):
            j = i + step
            start, stop, d, e = twice[i + 1], twice[j], way[i], way[j % n]
            det = float(_cross(d, e))
            own = inner[j] - inner[i + 1]
            if abs(det) < 1e-14 * np.hypot(*d) * np.hypot(*e):
                continue
            if det > 0:
                if step == 1:
                    flush[i, step] = 0.0
                else:
                    x = p[i] + d * (_cross(twice[j] - p[i], e) / det)
                    flush[i, step] = max(0.0, (_cross(start, x) + _cross(x, stop) - own) / 2)
                continue
            at = np.arange(i + 1, j + 1)  # where a free edge may touch
            v = twice[at]
            to = 2 * v - p[i] - twice[j]
            s, t = _cross(to, e) / det, _cross(d, to) / det
            a, b = p[i] + s[:, None] * d, twice[j] + t[:, None] * e
            left = np.minimum(_cross(b - a, twice[at - 1] - v), _cross(b - a, twice[at + 1] - v))
            good = (s >= 1) & (t <= 0) & (left >= -1e-12 * size)
            if good.any():
                free[i, step] = max(0.0, float(((_cross(start, a) + _cross(a, b) + _cross(b, stop) - own) / 2)[good].min()))
    best = np.inf
    for first in range(n):
        plain, one = (np.full((n + 1, n + 1), np.inf) for _ in range(2))
        for x in range(n):
            plain[x, x + 1 :] = flush[(first + x) % n, 1 : n + 1 - x]
            one[x, x + 1 :] = free[(first + x) % n, 1 : n + 1 - x]
        none = np.full(n + 1, np.inf)
        none[0] = 0.0
        some = np.full(n + 1, np.inf)
        for k in range(1, corners + 1):
            if k < corners:
                some_next = np.minimum((some[:, None] + plain).min(0), (none[:, None] + one).min(0))
                best = min(best, some_next[n])
            none, some = (none[:, None] + plain).min(0), some_next
            best = min(best, none[n])
    return polygon_area(p) + float(best)


def node_measures(low: np.ndarray, high: np.ndarray, k: int | None, threshold: float, method: str, pixels: int) -> dict:
    dims = low.shape[1]
    top = 1 << dims if k is None else k
    node = float(np.prod(high.max(0) - low.min(0)))
    out = {"volume": node, "n_entries": len(low), "n_clips": 0, "covered": None, "overlapped": None, "coverage": None, "circle": None, "hull": None, "rotated_box": None, "corners4": None, "corners5": None, "clipped": [node] * top, "clipped_pixels": [0.0] * top, "clipped_overlaps": [0.0] * top}
    if node <= 0:
        return out
    covered, twice = pixel_coverage(low, high, pixels)
    out |= {"covered": covered * node, "overlapped": twice * node}
    clips = clips_of(low, high, k, threshold, method)
    base, tops = low.min(0), high.max(0)
    boxes = []
    for c in clips:
        p, bits = np.array(c["p"]), np.array([c["corner"] >> d & 1 for d in range(dims)], bool)
        boxes.append((np.where(bits, p, base), np.where(bits, tops, p)))
    areas = [node - union_area(np.array([b[0] for b in boxes[:i]]), np.array([b[1] for b in boxes[:i]])) for i in range(1, len(boxes) + 1)]
    out |= {"n_clips": len(clips), "clipped": (areas + [areas[-1] if areas else node] * top)[:top]}
    if boxes:
        shares = pixel_clipped(base, tops, np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes]), pixels)
        for j, name in enumerate(("clipped_pixels", "clipped_overlaps")):
            each = [x[j] * node for x in shares]
            out[name] = (each + each[-1:] * top)[:top]
    if dims == 2:
        corners = np.concatenate([np.stack([a[:, 0], b[:, 1]], 1) for a in (low, high) for b in (low, high)])
        p = hull(corners)
        _, r = enclosing_circle(corners)
        out |= {"coverage": union_area(low, high), "circle": float(np.pi * r * r), "hull": polygon_area(p), "rotated_box": rotated_box_area(p), "corners4": corner_polygon_area(p, 4), "corners5": corner_polygon_area(p, 5)}
    return out


SCHEMA = "volume double, n_entries long, n_clips long, covered double, overlapped double, coverage double, circle double, hull double, rotated_box double, corners4 double, corners5 double, clipped array<double>, clipped_pixels array<double>, clipped_overlaps array<double>"


def dead_space(entries: DataFrame, dims: Sequence[int] = (0, 1), k: int | None = None, threshold: float = THRESHOLD, method: str = "stairline", pixels: int = PIXELS, node: str = "node_id") -> DataFrame:
    """A row per node: volume, pixel and exact coverage, volumes of the bounding shapes (2-D) and after 1..k clips, and
    the volume that the clips take away (``clipped_pixels``) and take twice (``clipped_overlaps``) by pixels. Boxes that a node holds more
    than twice travel as two: no measure but the number of entries tells them apart."""
    names = [f"x{d}_{s}" for s in "lh" for d in dims]
    n, kind = len(dims), dict(entries.dtypes)[node]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, times = pdf[names].to_numpy(float), pdf["_times"].to_numpy()
        v = np.repeat(v, np.minimum(times, 2), axis=0)
        return pd.DataFrame([{node: pdf[node].iloc[0]} | node_measures(v[:, :n], v[:, n:], k, threshold, method, pixels) | {"n_entries": int(times.sum())}])

    boxes = entries.groupBy(node, *names).agg(F.count("*").alias("_times"))
    return boxes.groupBy(node).applyInPandas(run, f"{node} {kind}, {SCHEMA}")


def dead_shares(measures: DataFrame, clips: int) -> DataFrame:
    """Per node, per cent of dead space: of the box by pixels, of the other shapes by exact coverage (2-D), and
    what is left of the box's after 1..k clips, as a share of the box. Means over nodes are means of these
    shares (group by level to roll them up)."""
    exact = F.coalesce("coverage", "covered")
    shapes = {f"{s}_dead": (F.col(s) - exact) / F.col(s) * 100 for s in ("circle", "hull", "rotated_box", "corners4", "corners5")}
    boxes = {f"clipped{i + 1}": (F.get(F.col("clipped"), F.lit(i)) - F.col("covered")) / F.col("volume") * 100 for i in range(clips)}
    return measures.where("volume > 0").withColumns({"mbb_dead": (F.col("volume") - F.col("covered")) / F.col("volume") * 100, **shapes, **boxes})
