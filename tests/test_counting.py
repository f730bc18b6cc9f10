"""Counts without pairs, against brute force: buckets, units, hot places, nulls, bad boxes, repeated rows, empty tables."""

import random

import numpy as np
import pytest

from boxwright.operators import counting, joins, select
from boxwright.operators.joins import grid_join
from test_boxes import frame, meets, random_boxes, schema


def test_count_below():
    rng = np.random.default_rng(1)
    for n, m, top in ((0, 5, 4), (1, 3, 2), (40, 30, 6), (200, 100, 1000)):
        a, v, w = rng.integers(0, top, n).astype(float), rng.integers(0, top, n).astype(float), rng.integers(1, 9, n)
        qa, qv = rng.integers(-1, top + 1, m).astype(float), rng.integers(-1, top + 1, m).astype(float)
        for sa in (False, True):
            for sv in (False, True):
                want = [int(w[(a < x if sa else a <= x) & (v < y if sv else v <= y)].sum()) for x, y in zip(qa, qv)]
                assert counting.count_below(a, v, w, qa, qv, sa, sv).tolist() == want


@pytest.mark.parametrize("dims", [1, 2])
@pytest.mark.parametrize("fill, unit", [(8192, 1 << 19), (9, 1 << 19), (13, 7)])
def test_batch_counts(spark, monkeypatch, dims, fill, unit):
    monkeypatch.setattr(counting, "FILL", fill)
    monkeypatch.setattr(counting, "UNIT", unit)
    a, q = random_boxes(31, 300, dims, 30, 5), random_boxes(32, 90, dims, 30, 5)
    a += [a[0]] * 60 + [((3, 3),) * dims] * 50
    q += [q[0]] * 9
    data, queries = frame(spark, a), frame(spark, q, "qid")
    names = data.columns[1:]
    bad = spark.createDataFrame([(900, *[None] * len(names)), (901, *[5.0, 1.0] * dims), (902, None, *[3.0] * (len(names) - 1))], schema(dims))
    data, queries = data.unionByName(bad), queries.unionByName(bad.withColumnRenamed("rid", "qid"))
    want = {j: sum(meets(x, y) for x in a) for j, y in enumerate(q, 1)} | {900: 0, 901: 0, 902: 0}
    where = tuple(range(dims))
    assert {r.qid: r.n for r in select.batch_counts(data, queries, dims=where).collect()} == want
    assert {r.qid for r in select.hit_queries(data, queries, dims=where).collect()} == {k for k, n in want.items() if n}
    assert {r.qid for r in select.hit_queries(data, queries, dims=where, missing=True).collect()} == {k for k, n in want.items() if not n}
    assert select.intersection_count(data, queries, where).first().n == sum(want.values())
    none = data.limit(0)
    assert {r.n for r in select.batch_counts(none, queries, dims=where).collect()} == {0}
    assert select.batch_counts(data, queries.limit(0), dims=where).count() == 0 and select.intersection_count(none, queries, where).first().n == 0


def test_three_dimensions_and_conditions(spark):
    a, q = random_boxes(33, 120, 3, 12, 4), random_boxes(34, 60, 3, 12, 8)
    data, queries = frame(spark, a + a[:20]), frame(spark, q, "qid")
    want = {j: sum(meets(x, y) for x in a + a[:20]) for j, y in enumerate(q, 1)}
    assert {r.qid: r.n for r in select.batch_counts(data, queries, dims=(0, 1, 2)).collect()} == want
    inside = {j: sum(meets(x, y) and y[0][0] <= x[0][0] and x[0][1] <= y[0][1] for x in a + a[:20]) for j, y in enumerate(q, 1)}
    assert {r.qid: r.n for r in select.batch_counts(data, queries, dims=(0, 1, 2), within=[0]).collect()} == inside
    assert select.intersection_count(data, queries, (0, 1, 2), within=[0]).first().n == sum(inside.values()) > 0


@pytest.mark.parametrize("within", [[0], [1], [0, 1]])
@pytest.mark.parametrize("span", [0, 2])
def test_within(spark, monkeypatch, within, span):
    monkeypatch.setattr(joins, "SPAN_POWER", span)
    rng = random.Random(3)
    a = random_boxes(35, 150) + [((x, x), (y, y)) for x, y in [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(50)]]
    b = random_boxes(36, 80, size=15)
    got = [(r.a_rid, r.b_rid) for r in grid_join(frame(spark, a), frame(spark, b), within=within).collect()]
    want = {(i, j) for i, x in enumerate(a, 1) for j, y in enumerate(b, 1) if meets(x, y) and all(y[d][0] <= x[d][0] and x[d][1] <= y[d][1] for d in within)}
    assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("repeats", [0.5, 2.0])
def test_repeated_boxes(spark, monkeypatch, repeats):
    monkeypatch.setattr(joins, "REPEATS", repeats)
    a, b = random_boxes(41, 40) * 4, random_boxes(42, 30) + random_boxes(42, 3) * 20
    data, other = frame(spark, a), frame(spark, b).withColumnRenamed("rid", "x9")
    got = [(r.a_rid, r.b_x9) for r in grid_join(data, other).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, x in enumerate(a, 1) for j, y in enumerate(b, 1) if meets(x, y)}
    inside = [(r.a_rid, r.b_x9) for r in grid_join(data, other, within=[1]).collect()]
    assert set(inside) == {(i, j) for i, j in got if b[j - 1][1][0] <= a[i - 1][1][0] and a[i - 1][1][1] <= b[j - 1][1][1]} and len(inside) == len(set(inside))
    assert grid_join(data.limit(0), other).count() == 0 and grid_join(data, other.limit(0)).count() == 0
