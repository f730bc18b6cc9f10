"""Toy fixtures with published or hand-checked values, and properties on random boxes."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxwright.functions.boxes import Box, clipped_away, intersects
from boxwright.operators import clip, deadspace, generate, knn, select, stats, updates
from boxwright.operators.index import Index, hilbert, leaf_capacity
from boxwright.operators.joins import grid_join

T1 = [((1.5, 4), (3, 4)), ((8, 10), (1, 3)), ((3, 5.5), (1, 2)), ((6, 7), (0, 4)), ((4, 7), (6.5, 8)), ((2, 3), (6.5, 9)), ((0, 1), (5, 6))]
T2 = [((0, 2.5), (3.75, 4.75)), ((1.5, 5), (2, 3)), ((3, 5.5), (0.25, 1.5)), ((6, 7), (0, 3.5)), ((7.25, 8.5), (0.5, 2)), ((1.75, 3), (6, 8.5)), ((3.5, 6.5), (6, 7.25))]
T2_NODES = {1: [4, 3, 5, 2, 1], 2: [7, 6]}


def schema(dims, key="rid"):
    return f"{key} long, " + ", ".join(f"x{d}_{s} double" for d in range(dims) for s in "lh")


def frame(spark, boxes, key="rid"):
    return spark.createDataFrame([(i, *(float(v) for iv in b for v in iv)) for i, b in enumerate(boxes, 1)], schema(len(boxes[0]), key))


def random_boxes(seed, n, dims=2, span=40, size=6):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        b = []
        for _ in range(dims):
            low = rng.randint(0, span)
            b.append((low, low + (rng.randint(0, size) if rng.random() < 0.95 else span)))
        out.append(tuple(b))
    return out


def meets(a, b):
    return all(x[0] <= y[1] and x[1] >= y[0] for x, y in zip(a, b))


def arrays(boxes):
    v = np.array(boxes, float)
    return v[:, :, 0], v[:, :, 1]


def test_root_skyline_of_the_toy_tree():
    leaves = [[T1[i - 1] for i in (4, 3, 2, 1, 7)], [T1[i - 1] for i in (5, 6)]]
    low, high = np.array([arrays(x)[0].min(0) for x in leaves]), np.array([arrays(x)[1].max(0) for x in leaves])
    flip = [np.array([1 if c >> d & 1 else -1 for d in range(2)]) for c in range(4)]
    sky = [sorted(map(tuple, (clip.skyline(clip.signed(low, high, c)) * flip[c] + 0.0).tolist())) for c in range(4)]
    assert sky == [[(0, 0)], [(10, 0)], [(0, 6), (2, 9)], [(7, 9), (10, 6)]]
    found = {(c["corner"], tuple(c["p"])): c["score"] for c in clip.clips_of(low, high)}
    assert found == {(3, (7.0, 6.0)): 9.0, (2, (2.0, 6.0)): 6.0}


def test_dead_space_row(spark):
    entries = [(n, *(float(v) for iv in T2[i - 1] for v in iv)) for n, ids in T2_NODES.items() for i in ids]
    data = spark.createDataFrame(entries, "node_id long, x0_l double, x0_h double, x1_l double, x1_h double")
    root = clip.entry_mbbs(data).select(F.lit(0).cast("long").alias("node_id"), *Box().columns())
    shares = deadspace.dead_shares(deadspace.dead_space(data.unionByName(root)), 4)
    names = ["mbb_dead", "circle_dead", "hull_dead", "rotated_box_dead", "corners4_dead", "corners5_dead", "clipped1", "clipped2", "clipped3", "clipped4"]
    row = shares.agg(F.sum("n_clips").alias("n"), *[F.avg(c).alias(c) for c in names]).first()
    assert row["n"] == 7
    for name, want in zip(names, [44.810, 65.002, 32.261, 44.264, 37.674, 34.638, 22.8767, 14.8955, 12.7283, 10.8707]):
        assert row[name] == pytest.approx(want, abs=6e-4), name


def test_nearest_of_low_corners(spark):
    points = spark.createDataFrame([(1, 0.0, 7.0), (2, 8.0, 5.0), (3, 1.0, 0.5)], "qid long, p0 double, p1 double")
    want = [(1, 6, 3.0625), (1, 1, 5.0625), (1, 7, 12.25), (2, 4, 3.25), (2, 7, 3.25), (2, 5, 9.0), (3, 2, 2.5), (3, 3, 4.0), (3, 1, 10.5625)]
    for f in (knn.knn_scan, knn.knn_join):
        got = f(frame(spark, T2), points, 3).orderBy("qid", "rank").collect()
        assert [(r.qid, r.rid, r.dist) for r in got] == want


GAPS = {"min": lambda l, h, p: max(l - p, p - h, 0.0), "center": lambda l, h, p: abs(p - (l + h) / 2), "max": lambda l, h, p: max(h - p, p - l)}
TOTALS = {"euclid": lambda g: sum(x * x for x in g), "manhattan": sum, "maximum": max}


@pytest.mark.parametrize("metric", TOTALS)
@pytest.mark.parametrize("kind", GAPS)
def test_neighbours_of_all_kinds(spark, kind, metric):
    boxes = random_boxes(21, 90) + random_boxes(22, 3) * 20
    at = [(i % 23, float(i % 23) - 3, float(3 * (i % 23) % 47)) for i in range(25)]  # repeated points, some far outside
    at = [(i, x, y) for i, (_, x, y) in enumerate(at)] + [(99, 500.0, -300.0)]
    points = spark.createDataFrame(at, "qid long, p0 double, p1 double")
    for farthest in (False, True):
        want = []
        for q, *p in at:
            d = sorted(((-1 if farthest else 1) * TOTALS[metric]([GAPS[kind](*b[j], p[j]) for j in (0, 1)]), i) for i, b in enumerate(boxes, 1))
            want += [(q, i, abs(x), n) for n, (x, i) in enumerate(d[:4], 1)]
        got = knn.knn_scan(frame(spark, boxes), points, 4, kind=kind, metric=metric, farthest=farthest)
        assert sorted(tuple(r) for r in got.select("qid", "rid", "dist", "rank").collect()) == sorted(want)
        assert knn.knn_scan(frame(spark, boxes).limit(0), points, 4, kind=kind, metric=metric, farthest=farthest).count() == 0
        assert knn.knn_scan(frame(spark, boxes), points.limit(0), 4, kind=kind, metric=metric, farthest=farthest).count() == 0
        few = knn.knn_scan(frame(spark, boxes[:2]), points, 4, kind=kind, metric=metric, farthest=farthest)
        assert few.count() == 2 * len(at)


@pytest.mark.parametrize("advisory", ["1k", "64m"])
def test_global_ranks_at_any_partitioning(spark, advisory):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        wide = spark.range(400_000).select(F.xxhash64("id").alias("a"), (F.col("id") % 7).alias("b"), "id", *[F.concat(F.lit("x" * 40), F.col("id").cast("string")).alias(f"w{i}") for i in range(2)])
        got = knn.ranked_globally(wide, ["b", "id"])
        assert got.count() == 400_000
        r = got.agg(F.count_distinct("rank").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high")).first()
        assert tuple(r) == (400_000, 1, 400_000)
        per = -(-400_000 // 7)
        first = 400_000 - 7 * (per - 1)  # the remainders below this have one more row
        place = F.col("b") * (per - 1) + F.least(F.col("b"), F.lit(first)) + (F.col("id") - F.col("b")) / 7 + 1
        assert got.where(F.col("rank") != place).count() == 0
        assert generate.every_kth(wide, 10, "id").count() == 40_000
        assert generate.every_kth(wide, 10, "id").where("id % 10 <> 9").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_toy_statistics(spark):
    data = frame(spark, T2)
    assert tuple(stats.mbb(data).first()) == (0.0, 8.5, 0.0, 8.5)
    assert {(r.a_rid, r.b_rid) for r in grid_join(data, data).collect()} == {(i, i) for i in range(1, 8)}
    counts = spark.createDataFrame([(n,) for n in (0, 0, 7, 1, 7, 0, 1, 0, 1, 1)], "n long")
    row = select.batch_stats(counts).first()
    assert (row.allfound, row.emptyquery, row.min_n, row.max_n, row.avg_n) == (18, 4, 0, 7, 1.8)


@pytest.mark.parametrize("dims", [1, 2, 3])
@pytest.mark.parametrize("cell", [None, 0.7, 1000.0])
def test_grid_join_is_the_theta_join(spark, dims, cell):
    a, b = random_boxes(1, 150, dims), random_boxes(2, 90, dims)
    got = [(r.a_rid, r.b_rid) for r in grid_join(frame(spark, a), frame(spark, b), tuple(range(dims)), cell=None if cell is None else [cell] * min(dims, 2)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, x in enumerate(a, 1) for j, y in enumerate(b, 1) if meets(x, y)}


@pytest.mark.parametrize("method", ["stairline", "skyline"])
@pytest.mark.parametrize("dims", [2, 3])
def test_clips_never_prune_a_hit(dims, method):
    rng = random.Random(dims)
    pruned = 0
    for t in range(150):
        boxes = random_boxes(t, rng.randint(2, 9), dims, 12, 4)
        low, high = arrays(boxes)
        clips = clip.clips_of(low, high, 99, 0.025, method)
        for q in random_boxes(t + 1000, 20, dims, 16, 2):
            cut = any(all((c["p"][d] < q[d][0]) if c["corner"] >> d & 1 else (c["p"][d] > q[d][1]) for d in range(dims)) for c in clips)
            pruned += cut
            assert not (cut and any(meets(b, q) for b in boxes))
    assert pruned


@pytest.mark.parametrize("method", ["stairline", "skyline"])
def test_clips_of_many_pages(spark, method):
    rng = random.Random(4)
    pages = [random_boxes(t, rng.randint(1, 9), 2, 12, 4) for t in range(120)] + [[((1, 1), (0, 5))] * 3]
    low, high = arrays([b for p in pages for b in p])
    number = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    want = [clip.clips_of(*arrays(p), 3, 0.025, method) for p in pages]
    assert clip.clips_of_pages(low, high, number, len(pages), 3, 0.025, method).to_pylist() == want and any(want)
    entries = spark.createDataFrame([(int(n), *map(float, (a[0], b[0], a[1], b[1]))) for n, a, b in zip(number, low, high)], "node_id long, x0_l double, x0_h double, x1_l double, x1_h double")
    got = {r.node_id: [c.asDict() for c in r.clips] for r in clip.build_clips(entries, k=3, method=method).collect()}
    assert [got[i] for i in range(len(pages))] == want


def test_clip_expression(spark):
    rows = spark.createDataFrame([(1, [(3, [2.0, 2.0], 1.0)])], f"id int, clips {clip.CLIP_TYPE}")
    for box, want in (([(3, 4), (3, 4)], True), ([(2, 4), (3, 4)], False), ([(3, 4), (1, 4)], False)):
        assert rows.select(clipped_away(Box.of(box), F.col("clips")).alias("c")).first().c is want


def test_index_paths_agree(spark, tmp_path):
    a, q = random_boxes(5, 400, 2), random_boxes(6, 80, 2)
    data, queries = frame(spark, a), frame(spark, q, "qid")
    want = {j: sum(meets(x, y) for x in a) for j, y in enumerate(q, 1)}
    index = Index.build(data, leaf_cap=9, path=str(tmp_path / "index"))
    assert {r.qid: r.n for r in index.region_counts(queries).collect()} == want
    assert {r.qid: r.n for r in index.region_counts(queries, clipped=False).collect()} == want
    assert {r.qid: r.n for r in select.batch_counts(data, queries).collect()} == want
    assert updates.inconsistent(index.nodes, index.leaves).count() == 0
    on, off = index.access_stats(queries).first(), index.access_stats(queries, clipped=False).first()
    assert on.useful_visits == off.useful_visits and on.leaf_visits <= off.leaf_visits
    for height in (1, 2, 3):  # levels of the catalogue: the same counts, visits and records, and sound directory nodes
        tall = Index.build(data, leaf_cap=5, height=height)
        flat = Index.build(data, leaf_cap=5, height=1)
        assert {r.qid: r.n for r in tall.region_counts(queries).collect()} == want
        for clipped in (True, False):
            assert tall.access_stats(queries, clipped=clipped).first() == flat.access_stats(queries, clipped=clipped).first()
            assert tall.visits(queries, clipped=clipped).count() == flat.visits(queries, clipped=clipped).count()
            assert tall.matches(queries, clipped=clipped).count() == sum(want.values())
        assert tall.join_count(Index.build(queries.withColumnRenamed("qid", "rid"), leaf_cap=5)).first().n == sum(want.values())
        levels = {r.level: r for r in tall.describe_levels().collect()}
        assert sorted(levels) == list(range(1, height + 1)) and {r.n_records for r in levels.values()} == {len(a)} and {r.n_leaves for r in levels.values()} == {levels[1].n_nodes}
        below = tall.catalogue.where("level < " + str(height)).select(F.col("parent_id").alias("node_id"), (F.col("level") + 1).alias("level"), "n", *Box().columns())
        for level in range(2, height + 1):
            up = below.where(F.col("level") == level).groupBy("node_id").agg(F.sum("n").alias("n"), F.min("x0_l").alias("x0_l"), F.max("x0_h").alias("x0_h"), F.min("x1_l").alias("x1_l"), F.max("x1_h").alias("x1_h"))
            assert sorted(map(tuple, up.collect())) == sorted(map(tuple, tall.level(level).select(*up.columns).collect()))
        tall.close()
    held = Index.build(data, leaf_cap=9)
    again = held.save(str(tmp_path / "saved")).reorganized(leaf_cap=20)
    held.close()
    assert {r.qid: r.n for r in again.region_counts(queries).collect()} == want and again.describe().first().n_records == len(a)
    assert leaf_capacity(4096, 3) == 72
    other = Index.build(frame(spark, q), leaf_cap=5)
    for clipped in (True, False):
        assert {(r.a_rid, r.b_rid) for r in index.join(other, clipped).collect()} == {(i, j) for i, x in enumerate(a, 1) for j, y in enumerate(q, 1) if meets(x, y)}
    assert Index.drop(spark, str(tmp_path / "index")) and not Index.drop(spark, str(tmp_path / "index"))


def test_degenerate_boxes(spark):
    points = [((i % 5, i % 5), (2, 2)) for i in range(30)]
    index = Index.build(frame(spark, points), leaf_cap=4)
    assert index.nodes.agg(F.sum(F.size("clips")).alias("n")).first().n == 0
    assert index.region_counts(frame(spark, [((0, 4), (2, 2)), ((9, 9), (9, 9))], "qid")).orderBy("qid").collect()[0].n == 30


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_pushdown(spark, tmp_path):
    frame(spark, T2).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = select.region_query(spark.read.parquet(str(tmp_path / "t")), Box.of([(0, 1), (0, 1)])).select("rid")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(x0_l,1.0)" in plan and "GreaterThanOrEqual(x1_h,0.0)" in plan


def test_updates(spark):
    data = frame(spark, [((0, 1), (0, 1)), ((0, 1), (0, 1)), ((2, 3), (2, 3))])
    new = frame(spark, [((5, 6), (5, 6)), ((5, 6), (5, 6)), ((2, 3), (2, 3))]).withColumn("rid", F.col("rid") + 10)
    assert sorted(r.rid for r in updates.insert_unique(data, new, "rid").collect()) == [1, 2, 3, 11]
    assert sorted((r.rid, r.stored) for r in updates.refused(data.withColumn("info", F.col("rid")), new.withColumn("info", F.col("rid")), "rid", "info").collect()) == [(12, 11), (13, 3)]
    gone = frame(spark, [((0, 1), (0, 1)), ((9, 9), (9, 9))])
    assert sorted(r.rid for r in updates.delete(data, gone, "rid").collect()) == [2, 3]
    assert updates.insert(data, new).count() == 6


def test_browse_bounds(spark):
    data = frame(spark, [((i, i), (0, 0)) for i in range(10)])
    dist = lambda **o: [r.dist for r in knn.browse(data, [0, 0], **o).collect()]
    assert dist(start=3, end=5) == [9, 16, 25] and dist(start=5, end=3, farthest=True) == [25, 16, 9]
    assert dist(k=2) == [0, 1] and dist(k=2, farthest=True) == [81, 64] and len(dist()) == 10
    assert dist(metric="manhattan", end=2) == [0, 1, 2] and dist(kind="max", k=1) == [0]


def test_orders(spark):
    data = frame(spark, random_boxes(9, 60))
    chain = knn.nearest_chain(data).orderBy("step").collect()
    assert sorted(r.rid for r in chain) == list(range(1, 61)) and [r.step for r in chain] == list(range(1, 61))
    multi = knn.nearest_chain(data, starts=3, seed=4)
    assert sorted(r.rid for r in multi.collect()) == list(range(1, 61)) and multi.collect() == knn.nearest_chain(data, starts=3, seed=4).collect()
    ranked = knn.ranked_globally(data, ["x0_l", "rid"]).collect()
    assert [r["rid"] for r in sorted(ranked, key=lambda r: r["rank"])] == [r["rid"] for r in sorted(ranked, key=lambda r: (r["x0_l"], r["rid"]))]


def test_generators(spark):
    parcels = generate.parcels(spark, 7).collect()
    assert len(parcels) == 128
    assert sum((r.x0_h - r.x0_l) * (r.x1_h - r.x1_l) for r in parcels) == pytest.approx(1)
    assert grid_join(generate.parcels(spark, 5), generate.parcels(spark, 5), test=lambda a, b: intersects(a, b) & (a.low(0) < b.high(0)) & (a.high(0) > b.low(0)) & (a.low(1) < b.high(1)) & (a.high(1) > b.low(1))).count() == 32
    assert generate.uni(spark, 500, area=5.0).collect() == generate.uni(spark, 500, area=5.0).collect()
    assert generate.par(spark, 5).count() == 32 and generate.clusters(spark, 3, 10, along=True).count() == 80
    share = np.mean([[int(v * 2) for v in (r.x0_l, r.x1_l)] for r in generate.bit(spark, 4000).collect()])
    assert share == pytest.approx(0.3, abs=0.03)
    halves = generate.scale_area(frame(spark, [((0, 4), (0, 2))]), 0.25).first()
    assert tuple(halves)[1:] == (1.0, 3.0, 0.5, 1.5)
    moved = generate.dither(frame(spark, [((0, 1), (0, 1))] * 50), 0.2, [1, 1]).collect()
    assert all(abs(r.x0_l) <= 0.2 and r.x0_h - r.x0_l == pytest.approx(1) for r in moved)
    assert [r.rid for r in generate.every_kth(frame(spark, random_boxes(3, 21)), 5).orderBy("rid").collect()] == [5, 10, 15, 20]
    with pytest.raises(ValueError):
        generate.project(frame(spark, T1), (4,), (0, 1))


def test_query_boxes_hit_about_k(spark):
    data = generate.uni(spark, 2000)
    points = generate.uni(spark, 40, seed=9).select(F.col("rid").alias("qid"), F.col("x0_l").alias("p0"), F.col("x1_l").alias("p1"))
    boxes = knn.query_boxes(data, points, F.lit(10), 10)
    counts = [r.n for r in select.batch_counts(data, boxes).collect()]
    assert len(counts) == 40 and 10 <= np.mean(counts) <= 20


def test_densify_is_brute_force(spark):
    boxes = random_boxes(51, 60)
    scale = 1 / 2**0.5
    want = []
    for i, q in enumerate(boxes, 1):
        p = [(a + b) / 2 for a, b in q]
        near = sorted((sum(max(a - x, x - b, 0) ** 2 for (a, b), x in zip(o, p)), j) for j, o in enumerate(boxes, 1))[:2]
        want += [(i, j, *[x + (v - x) * scale for iv, x in zip(boxes[j - 1], p) for v in iv]) for _, j in near]
    assert sorted(map(tuple, knn.densify(frame(spark, boxes), 2).collect())) == sorted(want)


def test_workload_boxes_touch_the_wanted_records(spark):
    points = [((i * 7 % 31, i * 7 % 31), (i * 11 % 23, i * 11 % 23)) for i in range(160)]
    data = frame(spark, points)
    got = generate.workload(data, 4, each=5).collect()
    assert sorted(r.qid for r in got) == list(range(10, 161, 10))
    counts = {r.qid: r.n for r in select.batch_counts(data, spark.createDataFrame(got)).collect()}
    for r in got:
        p = [points[r.qid - 1][d][0] for d in (0, 1)]
        near = sorted((max(abs(o[d][0] - p[d]) for d in (0, 1)), j) for j, o in enumerate(points, 1))
        boxes = []
        for want in range(2, 7):
            some = [points[j - 1] for _, j in near[:want]]
            boxes.append(tuple(f(p[d], *[o[d][0] for o in some]) for d in (0, 1) for f in (min, max)))
        assert (r.x0_l, r.x0_h, r.x1_l, r.x1_h) in boxes and counts[r.qid] >= 2


def test_shuffled_order(spark):
    data = frame(spark, random_boxes(61, 300))
    one, again, other = ([r.rid for r in generate.shuffled(d, seed).collect()] for d, seed in ((data, 1), (data.repartition(7), 1), (data, 2)))
    assert one == again != other and sorted(one) == sorted(other) == list(range(1, 301))
    assert abs(np.corrcoef(one, range(300))[0, 1]) < 0.2


def test_errors(spark):
    with pytest.raises(ValueError):
        intersects(Box((0,)), Box((0, 1)))
    with pytest.raises(ValueError):
        select.modify(frame(spark, T1), Box.of([(0, 1), (0, 1)]), {"x0_l": F.lit(0)})
    with pytest.raises(ValueError):
        stats.duplicate_values(frame(spark, T1))
    with pytest.raises(ValueError):
        Index.build(frame(spark, T1)).join(Index.build(frame(spark, [((0, 1),)]), dims=(0,)))


def test_shapes():
    rng = np.random.default_rng(1)
    for _ in range(30):
        p = rng.random((12, 2))
        h = deadspace.hull(p)
        c, r = deadspace.enclosing_circle(p)
        assert (np.hypot(*(p - c).T) <= r * (1 + 1e-9)).all()
        area = deadspace.polygon_area(h)
        assert area <= deadspace.corner_polygon_area(h, 5) + 1e-12 <= deadspace.corner_polygon_area(h, 4) + 2e-12
        assert area <= deadspace.rotated_box_area(h) <= np.prod(p.max(0) - p.min(0)) + 1e-12
    low, high = arrays([((0, 2), (0, 2)), ((1, 3), (1, 3))])
    assert deadspace.union_area(low, high) == 7.0


def test_least_corner_polygons():
    """Against all choices of edges, with or without one free edge through any point of the boundary at any angle."""
    import itertools

    rng = np.random.default_rng(7)
    for trial in range(25):
        h = deadspace.hull(rng.random((int(rng.integers(6, 16)), 2)) * [1, 3])
        n = len(h)
        lines = [(h[i], h[(i + 1) % n] - h[i]) for i in range(n)]
        for corners in (4, 5):
            if n <= corners:
                assert deadspace.corner_polygon_area(h, corners) == deadspace.polygon_area(h)
                continue
            got = deadspace.corner_polygon_area(h, corners)
            assert deadspace.polygon_area(h) <= got * (1 + 1e-12)
            tries = [list(c) for k in range(3, corners + 1) for c in itertools.combinations(lines, k)]
            for v in range(n):  # supporting lines at the corners, at ten angles each
                into, out = h[v] - h[v - 1], h[(v + 1) % n] - h[v]
                free = [(h[v], into / np.hypot(*into) * (1 - f) + out / np.hypot(*out) * f) for f in np.linspace(0.05, 0.95, 10)]
                if trial < 6:
                    tries += [[*c, f] for c in itertools.combinations(lines, corners - 1) for f in free]
            for some in tries:
                some = sorted(some, key=lambda l: np.arctan2(l[1][1], l[1][0]))
                at = []
                for (a, d), (b, e) in zip(some, some[1:] + some[:1]):
                    det = d[0] * e[1] - d[1] * e[0]
                    if det <= 1e-12:
                        break
                    at.append(a + d * (((b - a)[0] * e[1] - (b - a)[1] * e[0]) / det))
                else:
                    assert got <= deadspace.polygon_area(np.array(at)) * (1 + 1e-9)


def test_pixel_clips():
    base, top = np.zeros(2), np.array([10.0, 10.0])
    shares = deadspace.pixel_clipped(base, top, np.array([[0.0, 0.0], [0.0, 0.0]]), np.array([[5.0, 2.0], [2.0, 5.0]]), 10)
    assert shares == [(0.1, 0.0), (0.16, 0.04)]
    three = deadspace.pixel_clipped(np.zeros(3), np.full(3, 4.0), np.array([[0.0, 0, 0]]), np.array([[2.0, 2, 2]]), 4)
    assert three == [(0.125, 0.0)]
    low, high = np.array([[0.0, 0, 0], [2, 2, 2]]), np.array([[2.0, 2, 2], [4, 4, 4]])
    assert deadspace.pixel_coverage(low, high, 4) == (0.25, 0.0)


def test_set_unique(spark):
    start = updates.Records(frame(spark, [((0, 1), (0, 1)), ((0, 1), (0, 1))]))
    new = frame(spark, [((0, 1), (0, 1)), ((2, 3), (2, 3)), ((2, 3), (2, 3))]).withColumn("rid", F.col("rid") + 10)
    assert sorted(r.rid for r in start.insert(new).data.collect()) == [1, 2, 11, 12, 13]
    once = start.set_unique().insert(new)
    assert sorted(r.rid for r in once.data.collect()) == [1, 2, 12]
    assert sorted(r.rid for r in once.delete(new.limit(1)).set_unique(False).insert(new).data.collect()) == [2, 11, 12, 12, 13]


def test_tree_utilisation(spark, monkeypatch):
    from boxwright.plans import catalogue

    n, cap, built = 100, 9, []

    class Kept(Index):
        @classmethod
        def build(cls, data, *args, **options):
            built.append(Index.build(data, *args, leaf_cap=cap, **options))
            return built[-1]

    monkeypatch.setattr(catalogue, "li", lambda s, d: frame(s, random_boxes(21, n)))
    monkeypatch.setattr(catalogue, "Index", Kept)
    got = catalogue.QUERIES["tree_utilisation"](spark, "").first()
    parts = Counter(r.node_id >> 32 for r in built[0].leaves.collect())
    fills = [min(cap, c - at) for c in parts.values() for at in range(0, c, cap)]  # full pages and the rest, in each range
    assert got.asDict() == {"n_leaves": len(fills), "n_records": n, "avg_fill": pytest.approx(n / len(fills)), "min_fill": min(fills), "max_fill": max(fills)}
