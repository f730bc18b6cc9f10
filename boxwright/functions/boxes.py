"""Box schema and column expressions.

A box has columns ``x{d}_l`` and ``x{d}_h`` (double) for each dimension d: flat columns, so that scans
get predicates pushed and unused dimensions pruned. All intervals are closed; a point has ``l = h``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Interval = tuple[float, float]


@dataclass(frozen=True)
class Box:
    """A literal box, or with ``prefix`` the box columns of a table or alias."""

    dims: Sequence[int] = (0, 1)
    prefix: str = ""
    values: Sequence[Interval] | None = None

    @staticmethod
    def of(values: Sequence[Interval], dims: Sequence[int] | None = None) -> "Box":
        return Box(tuple(dims if dims is not None else range(len(values))), "", tuple((float(a), float(b)) for a, b in values))

    def low(self, d: int) -> Column:
        return F.lit(self.values[list(self.dims).index(d)][0]) if self.values else F.col(f"{self.prefix}x{d}_l")

    def high(self, d: int) -> Column:
        return F.lit(self.values[list(self.dims).index(d)][1]) if self.values else F.col(f"{self.prefix}x{d}_h")

    def columns(self) -> list[str]:
        return [f"{self.prefix}x{d}_{s}" for d in self.dims for s in "lh"]


def every(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if not parts else reduce(lambda a, b: a & b, parts)


def same_dims(a: Box, b: Box) -> Sequence[int]:
    if tuple(a.dims) != tuple(b.dims):
        raise ValueError(f"boxes of different dimensions: {a.dims} and {b.dims}")
    return a.dims


def intersects(a: Box, b: Box) -> Column:
    return every([(a.low(d) <= b.high(d)) & (a.high(d) >= b.low(d)) for d in same_dims(a, b)])


def equals(a: Box, b: Box) -> Column:
    return every([(a.low(d) == b.low(d)) & (a.high(d) == b.high(d)) for d in same_dims(a, b)])


def encloses(a: Box, b: Box) -> Column:
    """a contains all of b."""
    return every([(a.low(d) <= b.low(d)) & (a.high(d) >= b.high(d)) for d in same_dims(a, b)])


def contained(a: Box, b: Box) -> Column:
    """a lies in b."""
    return encloses(b, a)


def overlaps(a: Box, b: Box) -> Column:
    """Common interior: touching doesn't count."""
    return every([(a.low(d) < b.high(d)) & (a.high(d) > b.low(d)) for d in same_dims(a, b)])


def contains_point(a: Box, point: Sequence[float]) -> Column:
    return every([(a.low(d) <= F.lit(float(p))) & (a.high(d) >= F.lit(float(p))) for d, p in zip(a.dims, point)])


def on_edge(a: Box, point: Sequence[float]) -> Column:
    """The point is in the box and on its boundary."""
    at = [(a.low(d) == F.lit(float(p))) | (a.high(d) == F.lit(float(p))) for d, p in zip(a.dims, point)]
    return contains_point(a, point) & reduce(lambda x, y: x | y, at)


def any_box(test, a: Box, boxes: Sequence[Box]) -> Column:
    """``test`` holds between ``a`` and one of the boxes at least."""
    return reduce(lambda x, y: x | y, [test(a, b) for b in boxes])


def ok(a: Box) -> Column:
    """l <= h in every dimension."""
    return every([a.low(d) <= a.high(d) for d in a.dims])


def extent(a: Box, d: int) -> Column:
    return a.high(d) - a.low(d)


def center(a: Box, d: int) -> Column:
    return (a.low(d) + a.high(d)) / 2


def volume(a: Box) -> Column:
    return reduce(lambda x, y: x * y, [extent(a, d) for d in a.dims])


def overlap_volume(a: Box, b: Box) -> Column:
    """Volume of the intersection, 0 if there is none."""
    return reduce(lambda x, y: x * y, [F.greatest(F.least(a.high(d), b.high(d)) - F.greatest(a.low(d), b.low(d)), F.lit(0.0)) for d in same_dims(a, b)])


def combined(a: Box, b: Box) -> dict[str, Column]:
    """The least box around both."""
    return {f"x{d}_{s}": (F.least(a.low(d), b.low(d)) if s == "l" else F.greatest(a.high(d), b.high(d))) for d in a.dims for s in "lh"}


def _sum(parts: Sequence[Column], metric: str) -> Column:
    """``metric``: euclid (squared), manhattan or maximum, of per-dimension gaps."""
    if metric == "euclid":
        return reduce(lambda a, b: a + b, [p * p for p in parts])
    if metric == "manhattan":
        return reduce(lambda a, b: a + b, list(parts))
    if metric == "maximum":
        return F.greatest(*parts) if len(parts) > 1 else parts[0]
    raise ValueError(f"unknown metric {metric}")


def distance(a: Box, point: Sequence[Column], kind: str = "min", metric: str = "euclid") -> Column:
    """Distance of a point to a box: its nearest point (min), centre (center) or farthest corner (max). Euclid: squared."""
    if kind == "min":
        gaps = [F.greatest(a.low(d) - p, p - a.high(d), F.lit(0.0)) for d, p in zip(a.dims, point)]
    elif kind == "center":
        gaps = [F.abs(p - center(a, d)) for d, p in zip(a.dims, point)]
    elif kind == "max":
        gaps = [F.greatest(a.high(d) - p, p - a.low(d)) for d, p in zip(a.dims, point)]
    else:
        raise ValueError(f"unknown kind {kind}")
    return _sum(gaps, metric)


def corner(a: Box, code: int) -> list[Column]:
    """Corner ``code``: bit d set takes the high side of dimension d."""
    return [a.high(d) if code >> i & 1 else a.low(d) for i, d in enumerate(a.dims)]


def clipped_away(query: Box, clips: Column) -> Column:
    """Whether a clip point shows that no entry of a node meets the query: in every dimension the query
    lies strictly on the corner's side of the point. clips: array<struct<corner int, p array<double>, ...>>."""

    def beyond(c: Column) -> Column:
        tests = []
        for i, d in enumerate(query.dims):
            at = F.get(c["p"], F.lit(i))
            tests.append(F.when(c["corner"].bitwiseAND(F.lit(1 << i)) > 0, at < query.low(d)).otherwise(at > query.high(d)))
        return every(tests)

    return F.coalesce(F.exists(clips, beyond), F.lit(False))
