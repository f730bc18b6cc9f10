"""Spatial and theta joins.

``grid_join`` turns an intersection join into an equi-join. Boxes are put on a ladder of grids whose
cells double from level to level; a box's own level is the lowest where it spans at most ``1 + 2 ** SPAN_POWER`` cells
per gridded axis, so a box makes a bounded number of entries a level, however large it is. A pair meets at
the coarser of its two own levels: the finer box is entered there too. Of the cells that both cover, the one
holding the lower corner of their intersection reports the pair. Levels that neither side has are skipped.

A dimension in which one box must lie within the other gives two axes, on which the inner box is a point (its
low and its high side) and the outer one an interval; so containment narrows the candidates, too. Cell widths
come from numbers, extents and spans of both sides: those of the least estimated work, entries and
candidates together. A side whose boxes occur ``REPEATS`` times on average or more joins with its distinct boxes,
and its records come back by their box afterwards. Catalyst picks the physical joins; adaptive execution splits
skewed cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.boxes import Box, every, intersects

Test = Callable[[Box, Box], Column]

#: A box spans at most 1 + 2 ** SPAN_POWER cells an axis at its own level; an entry costs about as much as so many candidates.
SPAN_POWER, ENTRY = 2, 24.0
REPEATS = 3.0


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def _exponent(x: Column) -> Column:
    """The least power of two that holds an extent, as its exponent; points get that of the least double."""
    return F.when(x > 0, F.ceil(F.log2(x))).otherwise(-1074).cast("int")


def _level(prefix: str, powers: Sequence[int]) -> Column:
    over = [_exponent(F.col(f"{prefix}_g{i}h") - F.col(f"{prefix}_g{i}l")) - k - SPAN_POWER for i, k in enumerate(powers)]
    return F.greatest(*over, F.lit(0))


def _size(power: int, levels: Sequence[int]) -> Column:
    return F.lit(2.0 ** (power + levels[0])) if len(levels) == 1 else F.pow(F.lit(2.0), F.col("_lv") + power)


def _entered(df: DataFrame, prefix: str, powers: Sequence[int], levels: Sequence[int]) -> DataFrame:
    out = df
    if len(levels) > 1:
        out = out.withColumn(f"{prefix}_own", _level(prefix, powers))
        out = out.withColumn("_lv", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col(f"{prefix}_own"))))
    for i, k in enumerate(powers):
        size = _size(k, levels)
        out = out.withColumn(f"_c{i}", F.explode(F.sequence(F.floor(F.col(f"{prefix}_g{i}l") / size), F.floor(F.col(f"{prefix}_g{i}h") / size))))
    return out


def _axes(df: DataFrame, prefix: str, dims: Sequence[int], within: Sequence[int], inner: bool) -> DataFrame:
    """``df`` with the intervals of each axis as ``_g0l, _g0h, _g1l, …`` behind the prefix; boxes with a null or l > h go."""
    box = Box(dims, prefix)
    sides = []
    for d in dims:
        low, high = box.low(d), box.high(d)
        sides += ([(low, low), (high, high)] if inner else [(low, high)] * 2) if d in within else [(low, high)]
    return df.where(every([box.low(d) <= box.high(d) for d in dims])).withColumns({f"{prefix}_g{i}{s}": x for i, pair in enumerate(sides) for s, x in zip("lh", pair)})


def profile(df: DataFrame, prefix: str, n: int, dims: Sequence[int]) -> Row:
    """One row of one pass: rows, about how many distinct boxes, mean extent and span of each axis, and which exponents of extents occur together."""
    extent = [F.col(f"{prefix}_g{i}h") - F.col(f"{prefix}_g{i}l") for i in range(n)]
    exponents = F.struct(*[_exponent(e).alias(f"e{i}") for i, e in enumerate(extent)])
    parts = [f for i in range(n) for f in (F.avg(extent[i]).alias(f"m{i}"), F.min(f"{prefix}_g{i}l").alias(f"a{i}"), F.max(f"{prefix}_g{i}h").alias(f"b{i}"))]
    distinct = F.approx_count_distinct(F.xxhash64(*Box(dims, prefix).columns())).alias("boxes")
    return df.agg(F.count("*").alias("rows"), distinct, *parts, F.collect_set(exponents).alias("exponents")).first()  # a few hundred groups of exponents at most


def cell_powers(sides: Sequence[Row], n: int) -> list[int]:
    """The cell width of each axis as a power of two: of those from a quarter of the larger mean extent up, the set
    with the fewest entries (each as dear as ``ENTRY`` candidates) and candidates, if boxes lie evenly in the span."""
    mean = [[r[f"m{i}"] or 0.0 for r in sides] for i in range(n)]
    span = [max(max((r[f"b{i}"] or 0.0) for r in sides) - min((r[f"a{i}"] or 0.0) for r in sides), 1e-300) for i in range(n)]
    least = [math.ceil(math.log2(max(m) / (1 << SPAN_POWER))) if max(m) > 0 else math.floor(math.log2(s)) - 20 for m, s in zip(mean, span)]
    most = [max(k, math.ceil(math.log2(s))) for k, s in zip(least, span)]

    def work(powers: Sequence[int]) -> float:
        entries, cells = [float(min(r["rows"], r["boxes"])) for r in sides], 1.0
        for i, k in enumerate(powers):
            size = 2.0**k
            entries = [e * (1 + m / size) for e, m in zip(entries, mean[i])]
            cells *= max(1.0, span[i] / size)
        return ENTRY * sum(entries) + entries[0] * entries[1] / cells

    best = list(most)
    for _ in range(4):  # one axis after the other, until nothing changes
        before = list(best)
        for i in range(n):
            best[i] = min(range(least[i], most[i] + 1), key=lambda k: (work([*best[:i], k, *best[i + 1 :]]), -k))
        if best == before:
            break
    return best


def grid_join(a: DataFrame, b: DataFrame, dims: Sequence[int] = (0, 1), grid: Sequence[int] | None = None, cell: Sequence[float] | None = None, extra: Test | None = None, test: Test = intersects, within: Sequence[int] = ()) -> DataFrame:
    """Pairs (columns ``a_…`` and ``b_…``) for which ``test`` holds; it must imply intersection.

    within: dimensions in which a's box must lie in b's, besides; grid: the dimensions to grid (the first two of
    ``dims``, and those of ``within``); cell: the cell widths of its axes, rounded up to powers of two (from the data).
    One pass over each side comes before the join, for the profiles. Boxes with a null or l > h meet nothing.
    """
    grid = list(grid if grid is not None else [d for i, d in enumerate(dims) if i < 2 or d in within])
    n = len(grid) + len(set(grid) & set(within))
    left, right = _prefixed(a, "a_"), _prefixed(b, "b_")
    x, y = _axes(left, "a_", grid, within, True), _axes(right, "b_", grid, within, False)
    sides = [profile(x, "a_", n, dims), profile(y, "b_", n, dims)]
    # extra conditions may use other columns than the box, so that boxes can't stand for records
    whole = [left if extra is None and r["rows"] >= REPEATS * r["boxes"] > 0 else None for r, left in zip(sides, (left, right))]
    if whole[0] is not None:
        x = _axes(left.select(*Box(dims, "a_").columns()).distinct(), "a_", grid, within, True)
    if whole[1] is not None:
        y = _axes(right.select(*Box(dims, "b_").columns()).distinct(), "b_", grid, within, False)
    powers = [math.ceil(math.log2(c)) for c in cell] if cell is not None else cell_powers(sides, n)
    levels = sorted({max(0, *(e[f"e{i}"] - k - SPAN_POWER for i, k in enumerate(powers))) for r in sides for e in r["exponents"]}) or [0]
    x = _entered(x, "a_", powers, levels)
    y = _entered(y, "b_", powers, levels).withColumnsRenamed({"_lv": "_lv2", **{f"_c{i}": f"_e{i}" for i in range(n)}})
    boxes = Box(dims, "a_"), Box(dims, "b_")
    same = [F.col(f"_c{i}") == F.col(f"_e{i}") for i in range(n)]
    met = test(*boxes)
    for d in within:
        met = met & (boxes[0].low(d) >= boxes[1].low(d)) & (boxes[0].high(d) <= boxes[1].high(d))
    if extra:
        met = met & extra(*boxes)
    if len(levels) > 1:
        same.append(F.col("_lv") == F.col("_lv2"))
        met = met & (F.greatest("a__own", "b__own") == F.col("_lv"))
    first = every([F.floor(F.greatest(f"a__g{i}l", f"b__g{i}l") / _size(k, levels)) == F.col(f"_c{i}") for i, k in enumerate(powers)])
    out = x.join(y, every(same) & met & first)
    for side, prefix in zip(whole, ("a_", "b_")):
        if side is not None:
            names = Box(dims, prefix).columns()
            out = out.withColumnsRenamed({c: f"_{c}" for c in names}).join(side, [F.col(f"_{c}") == F.col(c) for c in names])
    return out.select(*left.columns, *right.columns)


def theta_join(a: DataFrame, b: DataFrame, on: Callable[[], Column]) -> DataFrame:
    """The general join on any condition over ``a_…`` and ``b_…`` columns; equalities in it are used by Catalyst."""
    return _prefixed(a, "a_").join(_prefixed(b, "b_"), on())


def join_count(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("n"))
