"""Tables kept between the steps of an operator, in the shared folder of ``spark.checkpoint.dir``.

A kept table cuts the lineage and survives lost executors, and it holds one set of rows for all its readers: a
column such as a partition's number, which a second evaluation could make otherwise, stays as it was written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder. Without ``spark.checkpoint.dir`` a local session makes one of its own; a cluster needs the setting."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or getattr(context, "_boxwright_kept", None)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = context._boxwright_kept = tempfile.mkdtemp(prefix="boxwright-")
    return f"{base.rstrip('/')}/boxwright-kept/{context.applicationId}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once and read again."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Deletes what this application has kept; for when results that may still read it have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
