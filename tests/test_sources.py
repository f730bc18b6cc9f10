"""Readers and writers round trip."""

import struct

from pyspark.sql import functions as F

from boxwright.operators.clip import build_clips
from boxwright.sources import boxfiles
from test_boxes import T2, T2_NODES, frame

DUMP = """name: toy.RSF
numbOfDimensions:  2
dirPageSize:   256
dataPageSize:   256
-----
l:     1
p:     0 DIR
n:     1
b:  0.0  8.5
    0.0  8.5
s:  1.0  2.0
    3.0  4.0
e:  0.0000000000000000e+00  8.5000000000000000e+00
    0.0000000000000000e+00  4.7500000000000000e+00 ->     1 DAT
l:     0
p:     1 DAT <-     0
n:     2
e:  6.0  7.0
    0.0  3.5 ->     4 REC
e:  3.0  5.5
    0.25  1.5 ->     3 REC
"""


def entries(spark):
    rows = [(n, 0, None, i, "REC", *(float(v) for iv in T2[i - 1] for v in iv)) for n, ids in T2_NODES.items() for i in ids]
    return spark.createDataFrame(rows, "node_id long, level int, parent_id long, child long, kind string, x0_l double, x0_h double, x1_l double, x1_h double")


def test_binary(spark, tmp_path):
    raw = b"".join(struct.pack("<4d", *(v for iv in b for v in iv)) for b in T2)
    (tmp_path / "a.bin").write_bytes(raw)
    got = boxfiles.read_binary(spark, str(tmp_path / "a.bin"), 2).orderBy("rid").collect()
    assert got == frame(spark, T2).collect()
    assert [r.rid for r in boxfiles.read_binary(spark, str(tmp_path / "a.bin"), 2, 3, 5).orderBy("rid").collect()] == [3, 4, 5]
    for big in (False, True):
        boxfiles.write_binary(frame(spark, T2), str(tmp_path / f"out{big}"), 2, big)
        parts = b"".join(p.read_bytes() for p in sorted((tmp_path / f"out{big}").glob("*.bin")))
        assert parts == (raw if not big else b"".join(struct.pack(">4d", *(v for iv in b for v in iv)) for b in T2))
        again = boxfiles.read_binary(spark, str(tmp_path / f"out{big}"), 2, big_endian=big)
        assert {tuple(r)[1:] for r in again.collect()} == {tuple(r)[1:] for r in got}


def test_text(spark, tmp_path):
    (tmp_path / "a.rs").write_text("".join(f"{a} {b}\n" for box in T2 for a, b in box))
    assert boxfiles.read_text(spark, str(tmp_path / "a.rs"), 2).orderBy("rid").collect() == frame(spark, T2).collect()
    boxfiles.write_text(frame(spark, T2), str(tmp_path / "out"), 2)
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [tuple(map(float, x.split())) for x in lines] == [tuple(map(float, iv)) for b in T2 for iv in b]


def test_dump(spark, tmp_path):
    (tmp_path / "toy.ASC").write_text(DUMP)
    rows = boxfiles.read_dump(spark, str(tmp_path / "toy.ASC")).orderBy("node_id", "child").collect()
    assert [(r.node_id, r.level, r.parent_id, r.child, r.kind, r.x0_l, r.x1_h) for r in rows] == [(0, 1, None, 1, "DAT", 0.0, 4.75), (1, 0, 0, 3, "REC", 3.0, 1.5), (1, 0, 0, 4, "REC", 6.0, 3.5)]
    boxfiles.write_dump(entries(spark), str(tmp_path / "out"), "toy", 2)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    _, nodes = boxfiles.parse_dump(text)
    assert {n["node_id"]: {e["child"]: [tuple(map(float, iv)) for iv in e["box"]] for e in n["entries"]} for n in nodes} == {n: {i: [tuple(map(float, iv)) for iv in T2[i - 1]] for i in ids} for n, ids in T2_NODES.items()}


def test_clip_and_level_dumps(spark, tmp_path):
    nodes = build_clips(entries(spark))
    lines = {r.node_id: r.value for r in boxfiles.clip_lines(nodes).collect()}
    assert set(lines) == {1, 2} and lines[2].startswith("2: ") and lines[2].endswith(");")
    boxfiles.write_clips(nodes, str(tmp_path / "clips"))
    boxfiles.write_levels(entries(spark).withColumn("level", F.lit(1)), str(tmp_path / "levels"))
    assert spark.read.parquet(str(tmp_path / "levels")).count() == 7


def test_measures_and_layouts(spark, tmp_path):
    from boxwright.operators.deadspace import dead_space

    boxfiles.write_measures(dead_space(entries(spark)), str(tmp_path / "m"))
    assert spark.read.option("sep", " ").option("header", True).csv(str(tmp_path / "m")).count() == 2
    row = boxfiles.swap_layout(spark.createDataFrame([(1, 5.0, 2.0, 3.0, 4.0)], "rid long, a double, b double, c double, d double"), 2, ["a", "b", "c", "d"]).first()
    assert (row.x0_l, row.x0_h, row.x1_l, row.x1_h) == (3.0, 5.0, 2.0, 4.0)
    point = boxfiles.points_to_boxes(spark.createDataFrame([(1, 2, 3)], "rid long, a int, b int"), ["a", "b"]).first()
    assert tuple(point) == (1, 2.0, 2.0, 3.0, 3.0)
    text = boxfiles.format_doubles(spark.createDataFrame([(0.1,)], "v double"), ["v"])
    assert text.first().v == "1.000000000000000e-01" and boxfiles.parse_doubles(text, ["v"]).first().v == 0.1


def test_vtk(spark, tmp_path):
    boxfiles.write_vtk(frame(spark, T2), str(tmp_path / "v"), 2)
    lines = [x for p in sorted((tmp_path / "v").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines[4] == "POINTS 28 double" and [[float(v) for v in x.split()] for x in lines[5:9]] == [[0, 3.75, 0], [2.5, 3.75, 0], [0, 4.75, 0], [2.5, 4.75, 0]]
    assert lines[33] == "CELLS 7 35" and lines[34] == "4 0 1 2 3" and lines[41] == "CELL_TYPES 7" and len(lines) == 49
