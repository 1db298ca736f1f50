"""Token-ID output: raw id payloads in shard files, and a minimal perfect hash index from document keys to places in them.

Layout under a folder: data/*.ids (a 16-byte header, then ids as unsigned little-endian 16- or 32-bit integers, documents
in ascending key order), entries/ (Parquet: key, copy, shard, offset, n_tokens) and index/*.npz (a minimal perfect hash
function for each part of the keys, with a stored 32-bit fingerprint, shard, offset and length in each slot).

A lookup hashes the key to its index part and to one slot there, compares the fingerprint, and reads one byte range.

Cases: null and empty texts hold the end id alone; a null key is stored as the least key; rows that share a key are
copies 0, 1, ... of it, in file order, each with its own slot; extra columns are left aside; an empty table gives no
files and an empty index; long texts are bounded by one row's size only. A lost task leaves files that no entry names.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import filesystem, key_of, put_file, runs, slices, texts_of, tidied, written
from scriptorium.llm.encoding import library_encoder

MAGIC = b"TIDS"
HEADER = 16
#: A data file is closed at this size, an index part holds about so many keys.
SHARD_BYTES = 64 << 20
PART_KEYS = 1 << 18
GAMMA = 2.0
MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15], np.uint64)


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each hash for a seed."""
    h = h + np.uint64(int(MIX[2]) * (seed + 1) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * MIX[0]
    h = (h ^ (h >> np.uint64(27))) * MIX[1]
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash function over distinct 64-bit hashes.

    Level after level, keys that are alone in their cell of a bit array keep that cell; the others go on to the next. The
    slot of a key is the number of cells kept before its own.
    """

    def __init__(self, words: list[np.ndarray]):
        self.bits = words
        counts = [np.bitwise_count(w).astype(np.int64) for w in words]
        self.before = [np.concatenate([[0], np.cumsum(c)]) for c in counts]
        self.base = np.concatenate([[0], np.cumsum([int(c.sum()) for c in counts])]).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        words, level = [], 0
        while len(hashes):
            cells = max(64, -(-int(len(hashes) * GAMMA) // 64) * 64)
            at = (mixed(hashes, level) % np.uint64(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            hashes = hashes[~alone[at]]
            level += 1
            if level > 200:
                raise ValueError("two keys have the same 64-bit hash")
        return cls(words)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 for some of those that were not among the keys."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, w in enumerate(self.bits):
            if not len(left):
                break
            at = (mixed(hashes[left], level) % np.uint64(len(w) * 64)).astype(np.int64)
            word, bit = w[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.base[level] + self.before[level][at >> 6] + lower)[hit]
            left = left[~hit]
        return out


def key_hashes(keys: np.ndarray, copies: np.ndarray, seed: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(keys.astype(np.int64).view(np.uint64), seed) ^ copies.astype(np.int64).view(np.uint64) * MIX[2], seed + 7)


@dataclass
class TokenStore:
    """A written store: its folder, the data files in key order with the ids before each, and the index parts."""

    path: str
    files: list[str]
    starts: list[int]
    parts: dict[int, str]
    n_parts: int
    width: int

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/entries")


def write(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES, part_keys: int = PART_KEYS) -> TokenStore:
    """Encode whole texts and write data files, entries and index under path (a URI of a folder that all machines share)."""
    spark = docs.sparkSession
    ranged = docs.select(key_of(key).alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(vocabulary)
        end, most = np.array([end_id], encoder.dtype).tobytes(), shard_bytes // encoder.dtype.itemsize
        out, name, roll, at = None, "", -1, 0
        fs, folder = filesystem(f"{path}/data")
        fs.create_dir(folder, recursive=True)
        for whole in batches:
            for batch in slices(whole, "text"):
                coded = encoder.encode(texts_of(batch))
                rows = []
                for ids in coded:
                    if out is None or at >= most:
                        if out:
                            out.close()
                        name, roll, at = f"{uuid.uuid4().hex}.ids", roll + 1, 0
                        out = fs.open_output_stream(f"{folder}/{name}")
                        out.write(MAGIC + struct.pack("<BB10x", 1, encoder.dtype.itemsize))
                    out.write(ids.tobytes() + end)
                    rows.append((name, roll, at, len(ids) + 1))
                    at += len(ids) + 1
                names, rolls, offsets, sizes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"key": batch.column(0), "tie": batch.column(1), "file": pa.array(names), "roll": pa.array(rolls, pa.int64()), "offset": pa.array(offsets, pa.int64()), "n_tokens": pa.array(sizes, pa.int64())})
        if out:
            out.close()

    width = 2 if library_encoder(vocabulary).dtype.itemsize == 2 else 4
    coded = written(ranged.mapInArrow(tidied(encode), "key long, tie long, file string, roll long, offset long, n_tokens long"), "entries")
    # one row for each data file: a file is full at shard_bytes, so this list is small beside the data
    found = coded.groupBy("file", "roll").agg(F.min(F.struct("key", "tie")).alias("first"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).orderBy("first", "roll").collect()
    files = [r["file"] for r in found]
    starts = np.concatenate([[0], np.cumsum([r["tokens"] for r in found], dtype=np.int64)]).tolist()
    shards = spark.createDataFrame([(r["file"], i, s) for i, (r, s) in enumerate(zip(found, starts))], "file string, shard int, base long")
    placed = coded.join(shards, "file").select("key", "shard", "offset", "n_tokens", (F.col("base") + F.col("offset")).alias("start"))
    first = placed.groupBy("key").agg(F.min("start").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeated = placed.join(first.select("key", "first"), "key", "left")
    number = F.row_number().over(_window("key", "slab"))
    slab = F.when(F.col("first").isNotNull(), F.col("shard"))
    per_slab = repeated.where("first is not null").groupBy("key", "shard").agg(F.count("*").alias("rows")).withColumn("before", F.sum("rows").over(_before("key", "shard")))
    alone = repeated.where("first is null").select("key", F.lit(0).cast("long").alias("copy"), "shard", "offset", "n_tokens")
    copies = repeated.where("first is not null").withColumn("slab", slab).withColumn("n", number).join(per_slab.select("key", "shard", "before"), ["key", "shard"]).select("key", (F.col("n") - 1 + F.coalesce("before", F.lit(0))).alias("copy"), "shard", "offset", "n_tokens")
    alone.unionByName(copies).write.option("compression", "zstd").parquet(f"{path}/entries")
    rows = sum(r["rows"] for r in found)
    n_parts = max(1, -(-rows // part_keys))
    parts = _build(spark.read.parquet(f"{path}/entries"), path, n_parts)
    return TokenStore(path, files, starts[:-1], parts, n_parts, width)


def _window(key: str, slab: str):
    from pyspark.sql import Window

    return Window.partitionBy(key, slab).orderBy("offset")


def _before(key: str, shard: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)


def part_of(n_parts: int):
    return F.pmod(F.xxhash64("key", "copy"), F.lit(n_parts)).cast("int")


def _build(entries: DataFrame, path: str, n_parts: int) -> dict[int, str]:
    """Write the index part of each group of about PART_KEYS keys; returns the parts' files (a row for each part)."""

    def build(table: pa.Table) -> pa.Table:
        keys, copies = table["key"].to_numpy(), table["copy"].to_numpy()
        hashes = key_hashes(keys, copies)
        function = PerfectHash.build(hashes)
        slots = function.slots(hashes)
        placed = {"fingerprint": (key_hashes(keys, copies, 1) >> np.uint64(32)).astype("<u4"), "shard": table["shard"].to_numpy().astype("<u4"), "offset": table["offset"].to_numpy().astype("<u8"), "n_tokens": table["n_tokens"].to_numpy().astype("<u8")}
        arrays = {k: np.empty_like(v) for k, v in placed.items()}
        for k, v in placed.items():
            arrays[k][slots] = v
        part, name = table["part"][0].as_py(), f"{uuid.uuid4().hex}.npz"
        buffer = io.BytesIO()
        np.savez(buffer, **arrays, **{f"level{i}": w for i, w in enumerate(function.bits)})
        put_file(f"{path}/index/{name}", lambda out: out.write(buffer.getvalue()))
        return pa.table({"part": pa.array([part], pa.int32()), "file": [name]})

    spread = entries.select(part_of(n_parts).alias("part"), "key", "copy", "shard", "offset", "n_tokens")
    return {r["part"]: r["file"] for r in written(spread.groupBy("part").applyInArrow(build, "part int, file string"), "index").collect()}


def _load(path: str, name: str) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    fs, at = filesystem(f"{path}/index/{name}")
    with fs.open_input_file(at) as f:
        stored = np.load(io.BytesIO(f.read()))
        arrays = {k: stored[k] for k in stored.files}
    levels = sorted((k for k in arrays if k.startswith("level")), key=lambda k: int(k[5:]))
    return PerfectHash([arrays.pop(k) for k in levels]), arrays


def lookup(store: TokenStore, wanted: DataFrame) -> DataFrame:
    """Places of wanted keys (key, copy): key, copy, shard, offset, n_tokens. Keys that the store doesn't hold give no row."""
    path, parts = store.path, store.parts

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in runs(batches, "part", most_rows=1 << 18):
            if part not in parts:
                continue
            function, arrays = _load(path, parts[part])
            keys, copies = table["key"].to_numpy(), table["copy"].to_numpy()
            slots = function.slots(key_hashes(keys, copies))
            good = (slots >= 0) & (arrays["fingerprint"][slots] == (key_hashes(keys, copies, 1) >> np.uint64(32)).astype("<u4"))
            slots = slots[good]
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys[good]), "copy": pa.array(copies[good]), **{k: pa.array(arrays[k][slots].astype(np.int64)) for k in ("shard", "offset", "n_tokens")}})

    placed = wanted.select(F.col("key").cast("long").alias("key"), F.col("copy").cast("long").alias("copy")).withColumn("part", part_of(store.n_parts))
    return placed.repartition("part").sortWithinPartitions("part").mapInArrow(tidied(find), "key long, copy long, shard long, offset long, n_tokens long")


def read(store: TokenStore, places: DataFrame, digests: bool = False) -> DataFrame:
    """Payloads at places that lookup found: key, copy, start (ids of all documents before), n_tokens, ids (array<long>) or ids_crc32."""
    path, files, starts, dtype = store.path, store.files, store.starts, np.dtype(f"<u{store.width}")
    merge = 4 << 20

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in runs(batches, "shard", most_rows=1 << 14):
            fs, at = filesystem(f"{path}/data/{files[shard]}")
            offsets, sizes = table["offset"].to_numpy(), table["n_tokens"].to_numpy()
            payloads: list[np.ndarray] = []
            with fs.open_input_file(at) as f:
                head = f.read_at(HEADER, 0)
                if head[:4] != MAGIC or head[5] != dtype.itemsize:
                    raise ValueError(f"{at} is not a token file of this store")
                begin = 0
                while begin < len(offsets):  # ranges that lie together are read at once
                    end = begin + 1
                    while end < len(offsets) and offsets[end] == offsets[end - 1] + sizes[end - 1] and (offsets[end] + sizes[end] - offsets[begin]) * dtype.itemsize <= merge:
                        end += 1
                    n = int(offsets[end - 1] + sizes[end - 1] - offsets[begin])
                    raw = np.frombuffer(f.read_at(n * dtype.itemsize, HEADER + int(offsets[begin]) * dtype.itemsize), dtype)
                    if len(raw) != n:
                        raise ValueError(f"{at} ends within a document")
                    payloads += [raw[offsets[i] - offsets[begin] : offsets[i] - offsets[begin] + sizes[i]] for i in range(begin, end)]
                    begin = end
            out = {"key": pc.cast(table["key"], pa.int64()).combine_chunks(), "copy": table["copy"].combine_chunks(), "start": pa.array(offsets + starts[shard]), "n_tokens": pa.array(sizes)}
            if digests:
                out["ids_crc32"] = pa.array([zlib.crc32(x.astype("<u4")) for x in payloads], pa.int64())
            else:
                out["ids"] = pa.array([x.astype(np.int64) for x in payloads], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    # a few files share a partition; within one, reads go forward
    return places.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(tidied(load), "key long, copy long, start long, n_tokens long, " + ("ids_crc32 long" if digests else "ids array<long>"))


def save_manifest(store: TokenStore) -> None:
    """Keep what open_store needs beside the data."""
    text = json.dumps({k: v for k, v in store.__dict__.items() if k != "path"})
    put_file(f"{store.path}/store.json", lambda out: out.write(text.encode()))


def open_store(path: str) -> TokenStore:
    fs, at = filesystem(f"{path}/store.json")
    with fs.open_input_file(at) as f:
        kept = json.loads(f.read())
    return TokenStore(path, **kept | {"parts": {int(k): v for k, v in kept["parts"].items()}})
