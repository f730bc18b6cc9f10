"""Numbers of intersecting boxes without making the pairs.

An interval meets another unless it ends before it: [meets] = [l <= query's h] - [h < query's l]. In one or two
dimensions the product of these is a signed sum of dominance counts, how many points (a corner of each box)
lie below a point (a corner of the query). A dominance count is split by quantiles of both coordinates into

* whole cells below and to the left, from a prefix sum over a histogram of at most ``BUCKETS`` squared cells,
* the strip of the query's first bucket, and
* the part of its second bucket's strip that lies in lower first buckets,

so that a corner and a query enter two strips each, whatever the size of boxes and results. Strips are
counted by a wavelet matrix, in (points + queries) x log(points) steps. Equal corners are added up before
anything is shuffled by place, and a strip of many corners or queries is dealt into units of at most ``UNIT``
of each, since counts of parts add up; so a hot place is never one task's work.

Boxes with a null or with l > h in a used dimension meet nothing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box, ok
from .storage import kept

#: Buckets a coordinate at most: the histogram on the driver and its broadcast have 4 x BUCKETS ** 2 numbers (8 MB).
BUCKETS = 512
#: Corners a bucket should have at least, and corners or queries of a unit at most.
FILL, UNIT = 8192, 1 << 19


def count_below(a: np.ndarray, v: np.ndarray, w: np.ndarray, qa: np.ndarray, qv: np.ndarray, strict_a: bool, strict_v: bool) -> np.ndarray:
    """For each query the weight of the points with a <= qa and v <= qv (strict: <), by a wavelet matrix of the ranks of v."""
    order = np.argsort(a, kind="stable")
    end = np.searchsorted(a[order], qa, "left" if strict_a else "right")
    values, rank = np.unique(v, return_inverse=True)
    least = np.searchsorted(values, qv, "left" if strict_v else "right")
    now, weight = rank[order], w[order]
    start, total = np.zeros(len(qa), np.int64), np.zeros(len(qa), np.int64)
    for bit in reversed(range(len(values).bit_length())):
        one = (now >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        below = np.concatenate([[0], np.cumsum(np.where(one, 0, weight))])
        up = (least >> bit & 1).astype(bool)
        total += np.where(up, below[end] - below[start], 0)
        start = np.where(up, zeros[-1] + start - zeros[start], zeros[start])
        end = np.where(up, zeros[-1] + end - zeros[end], zeros[end])
        move = np.concatenate([np.flatnonzero(~one), np.flatnonzero(one)])
        now, weight = now[move], weight[move]
    return total


def _mixed(columns: Sequence[np.ndarray]) -> np.ndarray:
    """A number at random for each row, from its values alone."""
    out = np.zeros(len(columns[0]), np.uint64)
    for x in columns:
        out = (out ^ (x + 0.0).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(2)).astype(np.int64)


def box_counts(data: DataFrame, queries: DataFrame, dims: Sequence[int] = (0, 1)) -> DataFrame:
    """(box columns, n): the distinct query boxes and how many records meet each; boxes that meet none may be absent."""
    if len(dims) not in (1, 2):
        raise ValueError("counts without pairs are for one or two dimensions")
    flat = len(dims) == 1
    names = Box(dims).columns()
    first, second = dims[0], dims[-1]

    def corner(c: int, query: bool):
        side = [("hl" if query else "lh")[c >> i & 1] for i in (0, 1)]
        return F.col(f"x{first}_{side[0]}"), F.lit(0.0) if flat else F.col(f"x{second}_{side[1]}")

    families = (0, 1) if flat else (0, 1, 2, 3)
    made = [F.struct(F.lit(c).alias("c"), corner(c, False)[0].alias("u"), corner(c, False)[1].alias("v")) for c in families]
    points = kept(data.where(ok(Box(dims))).select(F.inline(F.array(*made))).groupBy("c", "u", "v").agg(F.count("*").alias("w")))
    sizes = {r["c"]: r for r in points.groupBy("c").agg(F.count("*").alias("n")).collect()}  # a row per family
    most = max((r["n"] for r in sizes.values()), default=0)
    buckets = max(1, min(BUCKETS, most // FILL))
    parts = [i / buckets for i in range(1, buckets)]
    cuts = {c: (np.zeros(0), np.zeros(0)) for c in families}
    if parts:
        for r in points.groupBy("c").agg(*[F.percentile_approx(x, parts, 10 * BUCKETS).alias(x) for x in "uv"]).collect():
            cuts[r["c"]] = np.unique(np.array(r["u"])), np.unique(np.array(r["v"]))

    def places(c: np.ndarray, u: np.ndarray, v: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """Buckets hold the points up to and with their cut; a strict query of just a cut's value belongs to the bucket that ends there."""
        at = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
        for f, pair in cuts.items():
            mine = c == f
            for out, cut, x in zip(at, pair, (u, v)):
                out[mine] = np.searchsorted(cut, x[mine], "left")
        return at

    def placed(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            c, u, v = (t[x].to_numpy() for x in ("c", "u", "v"))
            bu, bv = places(c, u, v, False)
            for name, x in (("bu", bu), ("bv", bv)):
                t = t.append_column(name, pa.array(x, pa.int32()))
            yield from t.to_batches()

    placed_points = points.mapInArrow(placed, "c int, u double, v double, w long, bu int, bv int")
    whole, held = np.zeros((4, buckets, buckets), np.int64), np.zeros((4, buckets, buckets), np.int64)
    cells = placed_points.groupBy("c", "bu", "bv").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toArrow()  # at most 4 x BUCKETS ** 2 rows
    at = tuple(cells[x].to_numpy() for x in ("c", "bu", "bv"))
    whole[at], held[at] = cells["w"].to_numpy(), cells["n"].to_numpy()
    below = np.zeros((4, buckets + 1, buckets + 1), np.int64)
    below[:, 1:, 1:] = whole.cumsum(1).cumsum(2)

    wanted = queries.where(ok(Box(dims))).select(*names).distinct()
    asked = [F.struct(F.lit(c).alias("c"), corner(c, True)[0].alias("u"), corner(c, True)[1].alias("v")) for c in families]
    rows = wanted.select(*names, F.inline(F.array(*asked)))
    kinds = ", ".join(f"{n} double" for n in names)

    def strips(batches):
        """The histogram part of each count, and the query's two strips."""
        for b in batches:
            t = pa.Table.from_batches([b])
            c, u, v = (t[x].to_numpy() for x in ("c", "u", "v"))
            bu, bv = places(c, u, v, True)
            base = below[c, bu, buckets] if flat else below[c, bu, bv]
            for name, x in (("bu", bu), ("bv", bv)):
                t = t.append_column(name, pa.array(x, pa.int32()))
            yield from t.append_column("base", pa.array(base, pa.int64())).to_batches()

    placed_queries = rows.mapInArrow(strips, f"{kinds}, c int, u double, v double, bu int, bv int, base long")
    axes = (("u", "bu"),) if flat else (("u", "bu"), ("v", "bv"))
    load = {}
    if buckets > 1 or most > UNIT:
        for k, (_, place) in enumerate(axes):
            for r in placed_queries.groupBy("c", place).agg(F.count("*").alias("n")).collect():  # a row per strip
                load[k, r["c"], r[place]] = -(-r["n"] // UNIT)
    else:
        n = -(-max(1, wanted.count()) // UNIT)
        load = {(k, c, 0): n for k in range(len(axes)) for c in families}
    split_p = [-(-held.sum(2 - k) // UNIT) for k in range(2)]  # units by corners of each strip

    def unit(kind: int, place: str, query: bool):
        """Rows with the units they enter: points one part of the corners and all parts of the queries, queries the other way round."""
        table = {(c, s): (max(1, int(split_p[kind][c, s])), load.get((kind, c, s), 1)) for c in families for s in range(buckets)}
        split = {k: n for k, n in table.items() if n != (1, 1)}

        def enter(batches):
            for b in batches:
                t = pa.Table.from_batches([b])
                c, s, u, v = (t[x].to_numpy() for x in ("c", place, "u", "v"))
                n = np.ones((len(c), 2), np.int64)
                for (f, strip), parts in split.items():
                    n[(c == f) & (s == strip)] = parts
                own, other = (n[:, 1], n[:, 0]) if query else (n[:, 0], n[:, 1])
                part = _mixed([t[x].to_numpy() for x in names] if query else [u, v]) % own
                again = np.repeat(np.arange(len(c)), other)
                turn = np.arange(len(again)) - np.repeat(np.cumsum(other) - other, other)
                t = t.take(pa.array(again))
                pc, qc = (turn, part[again]) if query else (part[again], turn)
                first_part = pa.array(turn == 0)
                a = t["u"] if place == "bu" else t["bu"].cast(pa.float64())
                if query:
                    w = pa.compute.if_else(first_part, t["base"], pa.scalar(0, pa.int64())) if kind == 0 else pa.array(np.zeros(len(again), np.int64))
                    boxes = [t[x] for x in names]
                else:
                    w, boxes = t["w"], [pa.nulls(len(again), pa.float64())] * len(names)
                columns = [t["c"], pa.array(np.full(len(again), kind), pa.int32()), t[place], pa.array(pc, pa.int32()), pa.array(qc, pa.int32()), pa.array(np.full(len(again), query)), a, t["v"], w, *boxes]
                yield from pa.table([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns], ["c", "kind", "strip", "pc", "qc", "q", "a", "v", "w", *names]).to_batches()

        schema = f"c int, kind int, strip int, pc int, qc int, q boolean, a double, v double, w long, {kinds}"
        return (placed_queries if query else placed_points).mapInArrow(enter, schema)

    entries = None
    for k, (_, place) in enumerate(axes):
        for q in (False, True):
            more = unit(k, place, q)
            entries = more if entries is None else entries.unionAll(more)

    def count(table: pa.Table) -> pa.Table:
        is_query = table["q"].to_numpy()
        c, kind = table["c"][0].as_py(), table["kind"][0].as_py()
        a, v, w = (table[x].to_numpy() for x in ("a", "v", "w"))
        p = ~is_query
        strict = bool(c & 1), bool(c >> 1 & 1)
        n = count_below(a[p], v[p], w[p], a[is_query], v[is_query], strict[0] if kind == 0 else True, strict[1]) + w[is_query]
        sign = -1 if (c & 1) ^ (c >> 1 & 1) else 1
        return table.filter(table["q"]).select(names).append_column("n", pa.array(n * sign, pa.int64()))

    counted = entries.groupBy("c", "kind", "strip", "pc", "qc").applyInArrow(count, f"{kinds}, n long")
    return counted.groupBy(*names).agg(F.sum("n").alias("n"))
