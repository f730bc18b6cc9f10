"""Box files: binary and text records, tree dumps and clip dumps."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.knn import ranked_globally

_HEADER_END = re.compile(r"^-{3,}\s*$")


def read_binary(spark: SparkSession, path: str, dims: int, begin: int = 1, end: int = 0, big_endian: bool = False) -> DataFrame:
    """Records of ``dims`` pairs of doubles without gaps: rid (1-based, along the file) and box. begin..end: a range of
    records, 0 for the last. Files are cut at record borders, so large ones are read in parallel."""
    jvm, width = spark._jvm, 16 * dims
    records = spark._jsparkSession.createDataset(spark._jsc.binaryRecords(path, width).rdd(), jvm.org.apache.spark.sql.Encoders.BINARY())
    rows = DataFrame(records.toDF(), spark).select(F.col("value").alias("raw"), F.monotonically_increasing_id().alias("_id"))
    # files are cut alike at each reading, in the order of their bytes: numbers of a partition's records give the places of the next ones
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    raw = rows.withColumn("_part", part).join(before.select("_part", "_before").hint("broadcast"), "_part").select((F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("rid"), "raw")
    raw = raw.where((F.col("rid") >= begin) & (F.lit(end <= 0) | (F.col("rid") <= end)))
    names = [f"x{d}_{s}" for d in range(dims) for s in "lh"]
    kind = ">f8" if big_endian else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.frombuffer(b"".join(b.column("raw").to_pylist()), kind).reshape(-1, 2 * dims).astype(float)
            yield pa.RecordBatch.from_arrays([b.column("rid"), *(pa.array(values[:, i]) for i in range(2 * dims))], ["rid", *names])

    return raw.mapInArrow(run, "rid long, " + ", ".join(f"{n} double" for n in names))


def write_binary(data: DataFrame, path: str, dims: int, big_endian: bool = False, order: str = "rid") -> None:
    """Part files of gap-free records in the order of ``order``; concatenated by name they are one box file."""
    names = [f"x{d}_{s}" for d in range(dims) for s in "lh"]
    kind = ">f8" if big_endian else "<f8"
    rows = data.select(order, *names).repartitionByRange(order).sortWithinPartitions(order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], 1).astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary())], ["raw"])

    _save_raw(rows.mapInArrow(pack, "raw binary"), path)


def _save_raw(packed: DataFrame, path: str) -> None:
    """One file per partition, written by the executors: ``path`` must be a folder that all of them mount."""
    import os

    def save(index: int, rows) -> Iterator[int]:
        os.makedirs(path, exist_ok=True)
        target = os.path.join(path, f"part-{index:05d}.bin")
        with open(f"{target}.tmp", "wb") as f:
            for r in rows:
                f.write(r[0])
        os.replace(f"{target}.tmp", target)  # a task that is run again replaces the same file
        yield index

    packed.rdd.mapPartitionsWithIndex(save).count()


def read_text(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """One ``l h`` pair per line, ``dims`` lines a box."""
    lines = spark.read.text(path).withColumn("_file", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id()).where(F.trim("value") != "")
    numbered = ranked_globally(lines, ["_file", "_id"], "_n")
    parts = F.split(F.trim("value"), r"\s+")
    cells = numbered.select(F.floor((F.col("_n") - 1) / dims).alias("_r"), ((F.col("_n") - 1) % dims).alias("_d"), parts[0].cast("double").alias("l"), parts[1].cast("double").alias("h"))
    one = cells.groupBy("_r").agg(*[F.max(F.when(F.col("_d") == d, F.col(s))).alias(f"x{d}_{s}") for d in range(dims) for s in "lh"])
    return one.select((F.col("_r") + 1).cast("long").alias("rid"), *[f"x{d}_{s}" for d in range(dims) for s in "lh"])


def write_text(data: DataFrame, path: str, dims: int, order: str = "rid", form: str = "%.15e") -> None:
    lines = F.array(*[F.format_string(f"{form} {form}", f"x{d}_l", f"x{d}_h") for d in range(dims)])
    data.repartitionByRange(order).sortWithinPartitions(order).select(F.explode(lines).alias("value")).write.mode("overwrite").text(path)


def swap_layout(data: DataFrame, dims: int, names: Sequence[str]) -> DataFrame:
    """Corner columns (all of one corner, then all of the other, in any orientation) to ``x{d}_l, x{d}_h``."""
    out = {}
    for d in range(dims):
        a, b = F.col(names[d]), F.col(names[dims + d])
        out |= {f"x{d}_l": F.least(a, b), f"x{d}_h": F.greatest(a, b)}
    return data.withColumns(out).drop(*names)


def points_to_boxes(data: DataFrame, names: Sequence[str]) -> DataFrame:
    return data.withColumns({f"x{d}_{s}": F.col(n).cast("double") for d, n in enumerate(names) for s in "lh"}).drop(*names)


def parse_dump(text: str) -> tuple[dict, list[dict]]:
    """(header, nodes) of one tree dump: each node has id, level, parent and entries (box, child id, kind)."""
    lines = text.splitlines()
    header, at = {}, 0
    while at < len(lines) and not _HEADER_END.match(lines[at]):
        name, _, value = lines[at].partition(":")
        header[name.strip()] = value.strip()
        at += 1
    dims = int(header["numbOfDimensions"])
    tokens = [line.split() for line in lines[at + 1 :] if line.strip()]
    nodes: list[dict] = []
    i = 0
    while i < len(tokens):
        tag = tokens[i][0]
        if tag == "l:":
            nodes.append({"level": int(tokens[i][1]), "entries": []})
        elif tag == "p:":
            node = nodes[-1]
            node["node_id"] = int(tokens[i][1])
            node["parent_id"] = int(tokens[i][4]) if "<-" in tokens[i] else None
        elif tag == "e:":
            rows = [tokens[i][1:3], *(tokens[i + d][:2] for d in range(1, dims))]
            last = tokens[i + dims - 1]
            arrow = last.index("->")
            nodes[-1]["entries"].append({"box": [(float(a), float(b)) for a, b in rows], "child": int(last[arrow + 1]), "kind": last[arrow + 2]})
            i += dims - 1
        elif tag in ("b:", "s:"):  # box of the node at its split, the following dimensions on lines of their own
            while i + 1 < len(tokens) and not tokens[i + 1][0].endswith(":"):
                i += 1
        i += 1
    return header, nodes


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A row per entry of the dumps under ``path``: file, node_id, level, parent_id, child, kind and box columns."""
    texts = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    first = texts.select(F.regexp_extract("value", r"numbOfDimensions:\s*(\d+)", 1).cast("int").alias("d")).first()
    dims = int(first["d"])
    names = [f"x{d}_{s}" for d in range(dims) for s in "lh"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, file in zip(b.column("value").to_pylist(), b.column("file").to_pylist()):
                _, nodes = parse_dump(text)
                rows = [{"file": file, "node_id": n["node_id"], "level": n["level"], "parent_id": n["parent_id"], "child": e["child"], "kind": e["kind"]} | {f"x{d}_{s}": e["box"][d][j] for d in range(dims) for j, s in enumerate("lh")} for n in nodes for e in n["entries"]]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("file", pa.string()), ("node_id", pa.int64()), ("level", pa.int32()), ("parent_id", pa.int64()), ("child", pa.int64()), ("kind", pa.string()), *((n, pa.float64()) for n in names)]))

    return texts.mapInArrow(run, "file string, node_id long, level int, parent_id long, child long, kind string, " + ", ".join(f"{n} double" for n in names))


def dump_lines(entries: DataFrame, name: str, dims: int, page: tuple[int, int] = (4096, 4096)) -> DataFrame:
    """(ord, value): the text lines of a dump, ordered by ``ord``; nodes by level from the top, then by id."""
    head = entries.sparkSession.createDataFrame([(i, v) for i, v in enumerate([f"name: {name}", f"numbOfDimensions:  {dims}", f"dirPageSize: {page[0]:5d}", f"dataPageSize: {page[1]:5d}", "-----"])], "i int, value string").select(F.struct(F.lit(-(1 << 31)).alias("a"), F.lit(0).cast("long").alias("b"), F.col("i").cast("long").alias("c"), F.lit(0).alias("d")).alias("ord"), "value")
    of = lambda level: F.when(level > 0, "DIR").otherwise("DAT")
    nodes = entries.groupBy("node_id", "level", "parent_id").agg(F.count("*").alias("n"))
    up = F.when(F.col("parent_id").isNotNull(), F.format_string(" <- %5d", F.col("parent_id"))).otherwise("")
    tops = F.array(F.format_string("l: %5d", F.col("level")), F.concat(F.format_string("p: %5d ", F.col("node_id")), of(F.col("level")), up), F.format_string("n: %5d", F.col("n")))
    node_lines = nodes.select("level", "node_id", F.posexplode(tops).alias("d", "value")).select(F.struct((-F.col("level")).alias("a"), F.col("node_id").alias("b"), F.lit(-1).cast("long").alias("c"), "d").alias("ord"), "value")
    parts = [F.format_string("%s  %.16e  %.16e%s", F.lit("e:" if d == 0 else "  "), f"x{d}_l", f"x{d}_h", F.format_string(" -> %5d %s", "child", "kind") if d == dims - 1 else F.lit("")) for d in range(dims)]
    entry_lines = entries.select("level", "node_id", "child", F.posexplode(F.array(*parts)).alias("d", "value")).select(F.struct((-F.col("level")).alias("a"), F.col("node_id").alias("b"), F.col("child").alias("c"), "d").alias("ord"), "value")
    return head.unionByName(node_lines).unionByName(entry_lines)


def write_dump(entries: DataFrame, path: str, name: str, dims: int) -> None:
    """Part files that in the order of their names are one dump."""
    dump_lines(entries, name, dims).repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)


def clip_lines(nodes: DataFrame) -> DataFrame:
    """(node_id, value): one line a node with clip points, ``node: corner (x y …); …``."""
    one = F.transform("clips", lambda c: F.concat(F.lit(" "), c["corner"].cast("string"), F.lit(" ("), F.array_join(F.transform(c["p"], lambda x: F.format_string("%f", x)), " "), F.lit(");")))
    return nodes.where(F.size("clips") > 0).select("node_id", F.concat(F.col("node_id").cast("string"), F.lit(":"), F.array_join(one, "")).alias("value"))


def write_clips(nodes: DataFrame, path: str) -> None:
    clip_lines(nodes).repartitionByRange("node_id").sortWithinPartitions("node_id").select("value").write.mode("overwrite").text(path)


def write_levels(nodes: DataFrame, path: str) -> None:
    """Directory boxes (level 1 and up), a folder per level."""
    nodes.where("level >= 1").write.mode("overwrite").partitionBy("level").parquet(path)


def write_measures(measures: DataFrame, path: str) -> None:
    """Space-separated node measures; lists become one column per item."""
    most = measures.select(F.max(F.size("clipped"))).first()[0] or 0
    lists = {c: f"{c}{{}}_volume" if c == "clipped" else f"{c}{{}}" for c, kind in measures.dtypes if kind.startswith("array")}
    flat = measures.select(*[c for c in measures.columns if c not in lists], *[F.get(F.col(c), F.lit(i)).alias(name.format(i + 1)) for c, name in lists.items() for i in range(most)])
    flat.write.mode("overwrite").option("sep", " ").option("header", True).csv(path)


def format_doubles(data: DataFrame, names: Sequence[str], form: str = "%.15e") -> DataFrame:
    return data.withColumns({n: F.format_string(form, F.col(n)) for n in names})


def parse_doubles(data: DataFrame, names: Sequence[str]) -> DataFrame:
    return data.withColumns({n: F.trim(F.col(n)).cast("double") for n in names})


def vtk_lines(data: DataFrame, dims: int, title: str = "boxes") -> DataFrame:
    """(ord, value): the boxes as a legacy VTK unstructured grid of pixels (2-D) or voxels (3-D), numbered by rid."""
    if dims not in (2, 3):
        raise ValueError("VTK output takes two or three dimensions")
    corners, kind = 1 << dims, 8 if dims == 2 else 11
    rows = ranked_globally(data, ["rid"], "_n")
    n = rows.count()
    spark = data.sparkSession
    place = lambda part, a, b: F.struct(F.lit(part).alias("part"), a.alias("a"), b.alias("b")).alias("ord")
    zero = F.lit(0).cast("long")

    def heading(part: int, lines: list[str]) -> DataFrame:
        return spark.createDataFrame(list(enumerate(lines)), "i int, value string").select(place(part, F.col("i").cast("long"), zero), "value")

    def text(c: int) -> Column:
        at = [F.format_string("%.15e", F.col(f"x{d}_h" if c >> d & 1 else f"x{d}_l")) for d in range(dims)]
        return F.concat_ws(" ", *at, *[F.lit("0")] * (3 - dims))

    points = rows.select("_n", F.posexplode(F.array(*[text(c) for c in range(corners)])).alias("c", "value")).select(place(1, F.col("_n"), F.col("c").cast("long")), "value")
    cells = rows.select(place(3, F.col("_n"), zero), F.concat_ws(" ", F.lit(str(corners)), *[((F.col("_n") - 1) * corners + c).cast("string") for c in range(corners)]).alias("value"))
    types = rows.select(place(5, F.col("_n"), zero), F.lit(str(kind)).alias("value"))
    out = heading(0, ["# vtk DataFile Version 3.0", title, "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n * corners} double"])
    for part in (points, heading(2, [f"CELLS {n} {n * (corners + 1)}"]), cells, heading(4, [f"CELL_TYPES {n}"]), types):
        out = out.unionByName(part)
    return out


def write_vtk(data: DataFrame, path: str, dims: int) -> None:
    """Part files that in the order of their names are one VTK file."""
    vtk_lines(data, dims).repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.mode("overwrite").text(path)
