"""The folder that all executors share, tables written there, and files on the stores that pyarrow reaches."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session (tests) sets its own; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "framequarry")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A folder name of its own below shared_dir; the folder goes when the driver ends."""
    path = f"{shared_dir(spark)}/fq-{label}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here, and a lost executor costs nothing."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._fq_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes stored() tables that nothing will read again."""
    for df in tables:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._fq_path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of an Arrow batch where rows carry data: a worker holds a batch as Arrow and as objects, both that came and that goes.
BATCH_BYTES = 1 << 21


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS and viewfs, S3, GCS), and the path there."""
    uri = re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]://", "s3://", uri))
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
