"""The folder that driver and executors share, for tables that a step writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; on a local master without it (tests), under a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="spark-records-")
        _OWN[app] = found
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stream_of(spark: SparkSession, path: str, files_at_once: int | None = None):
    """A stream of a Parquet table, which may be a folder or a single file."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    parent, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(parent)
