"""Token counts by a separator scan over flat, unindexed token files.

A file is cut into blocks of a fixed size. Each task searches its block for the end-of-document id with numpy; a prefix scan over
the blocks of a file then tells each block how many documents ended before it and where the last one did, which stitches
the documents that lie across blocks.

Cases: null and empty texts hold the separator alone (0 ids); ids after the last separator are an unfinished document
(complete = false); a file without ids gives no row; repeated rows are documents of their own; extra columns are left aside.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import filesystem, model, slices, texts_of, tidied, tokenizer_path, written

FILE_BYTES = 128 << 20
BLOCK_IDS = 1 << 20


def plain_encoder(vocabulary: str):
    """A rank file's encoder; special strings in a text are ordinary text, so the separator can't come from a text."""
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_flat(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 50256, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Append each document's ids and the separator to raw files of unsigned 16-bit ids, without a shuffle.

    Returns the order in which they were written: key, file, nth. The scan doesn't use it.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = model(f"ranks {vocabulary}", lambda: plain_encoder(vocabulary)), np.array([end_id], "<u2").tobytes()
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        out, name, at, nth = None, "", 0, 0
        for whole in batches:
            for batch in slices(whole, text):
                rows = []
                for t in texts_of(batch, text):
                    if out is None or at >= file_bytes:
                        if out:
                            out.close()
                        name, at, nth = f"{uuid.uuid4().hex}.bin", 0, 0
                        out = fs.open_output_stream(f"{folder}/{name}")
                    raw = np.array(encoder.encode_ordinary(t), "<u2").tobytes() + end
                    out.write(raw)
                    rows.append((name, nth))
                    at, nth = at + len(raw), nth + 1
                yield pa.RecordBatch.from_pydict({key: batch.column(0), "file": pa.array([r[0] for r in rows]), "nth": pa.array([r[1] for r in rows], pa.int64())})
        if out:
            out.close()

    kind = docs.schema[key].dataType.simpleString()
    return written(docs.select(key, text).mapInArrow(tidied(encode), f"`{key}` {kind}, file string, nth long"), "order")


def scan(spark: SparkSession, path: str, files: list[str], end_id: int = 50256, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Documents of flat files of 16-bit ids: file, nth (in its file), start (ids before it, separators too), n_tokens (without the separator), complete."""
    folder = filesystem(path)[1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                ids = fs_of(path).get_file_info(f"{folder}/{file}").size // 2
                n = -(-ids // block_ids)
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * n, pa.string()), "block": pa.array(range(n), pa.int64()), "ids": pa.array([ids] * n, pa.int64())})

    # tasks ask for the sizes of the files; a row for each block
    tasks = max(1, min(10_000, len(files)))
    blocks = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks).mapInArrow(cut, "file string, block long, ids long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = block * block_ids
                with fs_of(path).open_input_file(f"{folder}/{file}") as f:
                    found = np.flatnonzero(np.frombuffer(f.read_at(2 * min(block_ids, ids - at), 2 * at), "<u2") == end_id) + at
                last = at + block_ids >= ids
                yield pa.RecordBatch.from_pydict({"file": [file], "block": pa.array([block], pa.int64()), "found": pa.array([found], pa.list_(pa.int64())), "ends": pa.array([len(found)], pa.int64()), "last_end": pa.array([int(found[-1]) if len(found) else None], pa.int64()), "ids": pa.array([ids if last else None], pa.int64())})

    # written, as both the prefix scan and the documents need it: one number for each document
    found = written(blocks.repartition(min(10_000, 16 * tasks)).mapInArrow(tidied(search), "file string, block long, found array<long>, ends long, last_end long, ids long"), "ends")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select("file", "block", "ends", "last_end").select("file", "block", F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max("last_end").over(earlier), F.lit(-1)).alias("previous"))
    both = found.join(stitched, ["file", "block"])
    inside = both.select("file", "before", F.posexplode("found").alias("i", "end"), "previous", "found").select("file", (F.col("before") + F.col("i")).alias("nth"), (F.when(F.col("i") == 0, F.col("previous")).otherwise(F.expr("get(found, i - 1)")) + 1).alias("start"), "end", F.lit(True).alias("complete"))
    tail = both.where("ids is not null and greatest(coalesce(last_end, -1), previous) < ids - 1").select("file", (F.col("before") + F.col("ends")).alias("nth"), (F.greatest(F.coalesce("last_end", F.lit(-1)), "previous") + 1).alias("start"), F.col("ids").alias("end"), F.lit(False).alias("complete"))
    return inside.unionByName(tail).select("file", "nth", "start", (F.col("end") - F.col("start")).alias("n_tokens"), "complete")


def fs_of(path: str):
    return filesystem(path)[0]
