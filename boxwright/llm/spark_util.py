"""What the operators share on the Spark side: saved tables, sizes, and groups that stream through Arrow."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_bytes(docs: DataFrame) -> int:
    """About the bytes of ``docs`` as compressed files: Spark's estimate for a plain scan, which reads nothing;
    for any other plan, whose estimate can be far off, half the measured length of its texts."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    if all(re.match(r"[\s:+\-|]*(Relation|Project|Filter)\b", line) for line in plan.toString().splitlines() if line.strip()):
        return int(str(plan.stats().sizeInBytes()))
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` in a stream that is sorted by it, each as one table; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    value = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key))
        ends = pa.compute.run_end_encode(keys).run_ends.to_pylist() if b.num_rows else []
        at = 0
        for end in ends:
            k = keys[at].as_py()
            if held and k != value:
                yield pa.Table.from_batches(held)
                held = []
            value = k
            held.append(b.slice(at, end - at))
            at = end
    if held:
        yield pa.Table.from_batches(held)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared folder of ``spark.checkpoint.dir`` and read again: cuts the lineage, survives lost executors.

    The tables of an application stay, as lazy results may still read them, until ``drop_saved``."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes one saved table, when nothing will read it any more."""
    spark, folder = df.sparkSession, _folder(df.sparkSession)
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/") in name:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_saved(spark: SparkSession) -> None:
    """Deletes what this application has saved; for when its results have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_boxwright_folder", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = context._boxwright_folder = tempfile.mkdtemp(prefix="checkpoint-")
    return f"{folder.rstrip('/')}/boxwright/{context.applicationId}"
