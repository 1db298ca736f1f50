"""Shared helpers: the shared folder, written tables, row keys and bounded Arrow slices."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where a key must not be null.
NULL_KEY = -(2**63)
#: Text bytes that one Python step handles at once.
SLICE_BYTES = 4 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-scriptorium-")
        found = _OWN[app]
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later steps survive the loss of executors."""
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(BATCH_ROWS)
    small_batches(df.sparkSession)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(BATCH_ROWS, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, once nothing reads them any more."""
    for df in tables:
        for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it; works for every scheme that pyarrow knows."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most so many rows to Python at once: texts are long, and a worker holds whole batches."""
    if int(spark.conf.get(BATCH_ROWS)) > rows:
        spark.conf.set(BATCH_ROWS, str(rows))


def key_of(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_KEY))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about `most` bytes of the column, and one row at least."""
    sizes = [len(x) if x is not None else 0 for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()] if batch.nbytes > most else []
    begin = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Strings of a column, nulls as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of a column, nulls as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).to_pylist()]


def schema_of(df: DataFrame, extra: str) -> str:
    """DDL of df's columns and then of the extra ones."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), extra])


def with_columns(batch: pa.RecordBatch, extra: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *extra.values()], names=[*batch.schema.names, *extra])


def runs(batches: Iterator[pa.RecordBatch], column: str, most_rows: int | None = None) -> Iterator[tuple[object, pa.Table]]:
    """Rows of a partition that is sorted by the column, as one table for each run of equal values (or for a part of it)."""
    held: list[pa.RecordBatch] = []
    value, rows = None, 0
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(column)).to_pylist()
        begin = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[begin]:
                continue
            if held and (value != keys[begin] or (most_rows and rows >= most_rows)):
                yield value, pa.Table.from_batches(held)
                held, rows = [], 0
            value = keys[begin]
            held.append(batch.slice(begin, i - begin))
            rows += i - begin
            begin = i
    if held:
        yield value, pa.Table.from_batches(held)


_MODEL: dict[str, object] = {}


def model(name: str, build: Callable[[], object]):
    """The one heavy object that a Python worker keeps: workers outlive tasks, and the next operator brings its own."""
    if name not in _MODEL:
        _MODEL.clear()
        _MODEL[name] = build()
    return _MODEL[name]


def tidied(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """step, giving free memory back to the system at its end, as its worker stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes

        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run


def put_file(uri: str, fill: Callable[[object], None]) -> None:
    """Write one file; its name must be new for each attempt, so that a lost attempt leaves only an unnamed orphan."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        fill(out)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; an absolute path is taken as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
