"""WARC archives in Zstandard: a leading skippable frame holds the dictionary, then each record is a frame of its own.

Writing: pages with equal payloads (the UTF-8 bytes of the html, null: empty) are grouped by SHA-256 and length; the one with the
smallest page_id is a response record, the others are revisit records that refer to it. Reading streams an archive frame by
frame, checks the record's version line, required headers, block length, end of record and payload digest, and gives a row for
each record, with its faults.

Cases: a null page_id takes part in its group but never is the smallest, unless all are null (then all are responses); rows that
repeat the smallest page_id are all responses; payloads shorter than min_revisit bytes are all responses; an empty table gives
no archives; extra columns are left aside. Groups of any size only meet in counts and in a join that can be split.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import filesystem, new_path, slices, tidied, written

#: Magic number of the skippable frame that holds a dictionary, and of a dictionary and a frame (fixed values of the formats).
DICTIONARY_FRAME, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
ARCHIVE_BYTES = 128 << 20
#: The dictionary is trained on at most so many pages, each cut to so many characters.
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 16_384, 64 << 10
VERSION = "WARC/1.1"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
MOST_HEADER = 64 << 10
DATE = "2024-01-01T00:00:00Z"


def train_dictionary(pages: DataFrame, html: str = "html") -> bytes:
    """A dictionary from a bounded sample of pages; empty where the sample is too small to train on."""
    import zstandard

    sample = [r[0].encode() for r in pages.select(F.substring(F.col(html), 1, SAMPLE_CHARS)).where(F.col(html).isNotNull()).limit(SAMPLE_ROWS).collect() if r[0]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, unique: str) -> bytes:
    """The response record of a page, or the revisit record that refers to the page `first`."""
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{unique}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = " ".join((url or "urn:none").split())
    fields = {"WARC-Record-ID": name, "WARC-Date": DATE, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest_of(payload)}", "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if first is None:
        return record_bytes("response", fields, http + payload)
    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{first}>"}
    return record_bytes("revisit", fields, http)


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> list[str]:
    """Write archives under path (a URI of a folder that all machines share); returns their names."""
    dictionary = train_dictionary(pages, html)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    # both sides of the join come from the same narrow columns; only duplicated payloads have a row on the right
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    first = narrow.where(F.col("n") >= min_revisit).groupBy("digest", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("digest", "n", "first")
    placed = rows.join(first, ["digest", "n"], "left").select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True) if dictionary else zstandard.ZstdCompressor(level=3, write_content_size=True)
        fs, folder = filesystem(path)
        fs.create_dir(folder, recursive=True)
        out, name, size, n = None, "", 0, 0
        for whole in batches:
            for batch in slices(whole, "payload"):
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or size >= archive_bytes:
                        if out:
                            out.close()
                            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})
                        name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                        out = fs.open_output_stream(f"{folder}/{name}")
                        info = compressor.compress(record_bytes("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC file version 1.1\r\n"))
                        lead = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary + info
                        out.write(lead)
                        size = len(lead)
                    frame = compressor.compress(page_record(row[0], row[1], row[2] or b"", row[3], str(uuid.uuid4())))
                    out.write(frame)
                    size, n = size + len(frame), n + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([n], pa.int64())})

    # one row for each archive
    return sorted(r["file"] for r in written(placed.mapInArrow(tidied(pack), "file string, records long"), "archives").collect())


class Frames:
    """The decoded frames of one archive, read forward in chunks; at most one record is held."""

    def __init__(self, stream, chunk: int = 1 << 20):
        self.stream, self.chunk, self.held = stream, chunk, b""

    def _fill(self, n: int) -> bool:
        while len(self.held) < n:
            more = self.stream.read(self.chunk)
            if not more:
                return False
            self.held += more
        return True

    def __iter__(self) -> Iterator[tuple[bytes, str]]:
        """Each frame's bytes and a fault ('' if there is none); a damaged frame ends the archive, as the next can't be found."""
        import zstandard

        decompressor = zstandard.ZstdDecompressor()
        if self._fill(8) and struct.unpack("<I", self.held[:4])[0] == DICTIONARY_FRAME:
            size = struct.unpack("<I", self.held[4:8])[0]
            if not self._fill(8 + size):
                yield b"", "dictionary frame cut short"
                return
            raw, self.held = self.held[8 : 8 + size], self.held[8 + size :]
            if len(raw) >= 4 and struct.unpack("<I", raw[:4])[0] == FRAME:  # the dictionary may itself be compressed
                raw = decompressor.decompressobj().decompress(raw)
            if raw:
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        while self._fill(4):
            magic = struct.unpack("<I", self.held[:4])[0]
            if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
                if not self._fill(8) or not self._fill(8 + struct.unpack("<I", self.held[4:8])[0]):
                    yield b"", "skippable frame cut short"
                    return
                self.held = self.held[8 + struct.unpack("<I", self.held[4:8])[0] :]
                continue
            one, out = decompressor.decompressobj(), io.BytesIO()
            try:
                while True:
                    out.write(one.decompress(self.held))
                    self.held = one.unused_data if one.eof else b""
                    if one.eof:
                        break
                    if not self._fill(1):
                        yield out.getvalue(), "frame cut short"
                        return
            except zstandard.ZstdError as e:
                yield out.getvalue(), f"frame: {e}"
                return
            yield out.getvalue(), ""
        if self.held:
            yield b"", "bytes after the last frame"


def parse_record(raw: bytes, fault: str = "") -> dict:
    """Fields of one record, with `faults`: what is wrong with its version, headers, lengths or digest."""
    faults = [fault] if fault else []
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or len(head) > MOST_HEADER:
        faults.append("header without end")
    if not lines[0].startswith("WARC/1."):
        faults.append("version line")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            faults.append("header line")
        fields[name.strip().lower()] = value.strip()
    faults += [f"no {k}" for k in REQUIRED if k not in fields]
    size = fields.get("content-length", "")
    n = int(size) if size.isascii() and size.isdigit() else -1
    block = rest[: max(n, 0)]
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        faults.append("block length")
    kind = fields.get("warc-type", "")
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    stated = next((x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    payload_bytes = int(stated) if stated.isdigit() else len(payload)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and http and payload_bytes != len(payload):
        faults.append("payload length")
    if kind == "response" and digest and digest != digest_of(payload):
        faults.append("payload digest")
    number = lambda x, lead: int(x[len(lead) :].rstrip(">")) if x.startswith(lead) and x[len(lead) :].rstrip(">").lstrip("-").isdigit() else None
    return {"page_id": number(fields.get("x-page-id", ""), ""), "url": fields.get("warc-target-uri"), "record_type": kind, "payload_bytes": payload_bytes, "payload_digest": digest or None, "refers_to": number(fields.get("warc-refers-to", ""), "<urn:page:"), "payload": payload if kind == "response" else None, "faults": faults}


KINDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(), "faults": pa.list_(pa.string())}


def read(spark: SparkSession, path: str, files: list[str], payloads: bool = True) -> DataFrame:
    """A row for each response or revisit record of the archives, and for each damaged one (record_type '')."""
    kinds = KINDS if payloads else {k: v for k, v in KINDS.items() if k != "payload"}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{folder}/{name}") as stream:
                    for raw, fault in Frames(stream):
                        row = parse_record(raw, fault)
                        if row["record_type"] in ("response", "revisit") or row["faults"]:
                            held.append(row)
                            size += len(row["payload"] or b"") * payloads + 300
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in held], t) for k, t in kinds.items()})
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in held], t) for k, t in kinds.items()})

    schema = ", ".join(f"{k} {'array<string>' if k == 'faults' else {pa.int64(): 'long', pa.string(): 'string', pa.binary(): 'binary'}[t]}" for k, t in kinds.items())
    names = spark.createDataFrame([(f,) for f in files], "file string")
    return names.repartition(max(1, min(len(files), 100_000))).mapInArrow(tidied(unpack), schema)


def archive(pages: DataFrame) -> DataFrame:
    """Write pages to new archives in the shared folder and read them back, without payloads."""
    path = new_path(pages.sparkSession, "warc")
    return read(pages.sparkSession, path, write(pages, path), payloads=False)
