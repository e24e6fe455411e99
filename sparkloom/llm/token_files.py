"""Token-ID files: one independent zstandard frame a document, a trailing seek table, checksums.

A file holds, in ascending order of id, a frame with the ids of each document (little-endian, of 16 bits
where the vocabulary allows, else of 32), then a skippable frame with that width and the document ids, then the seek table of the public seekable
zstandard format: for each frame its two sizes and the low half of the XXH64 of its content. A reader
opens the tail, then reads and decompresses only the frames asked for.

A folder has files and a manifest, a Parquet table that Spark commits as a whole. A task that is run
again writes another file; only files that the manifest names count.

Defined results: a null text counts as empty; the end id alone makes its frame; a null ``doc_id`` sorts
before all others; rows of one id are in the order of a hash of their texts, then of the texts; very long texts make one
long frame; repeated rows give repeated frames; extra columns, of any name, aren't looked at; no rows give an empty manifest
and no rows."""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm.bpe import WORD_BPE, LibraryEncoder
from sparkloom.llm.common import once_a_worker, slices

# Fixed values of the public seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 1 << 7

INDEX = 0x184D2A50
NO_ID = -(1 << 63)
MANIFEST = "part long, file string, first_id long, last_id long, n_docs long, n_tokens long"


def library(path: str, width: int) -> LibraryEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core
    return once_a_worker(("library", path, width), lambda: LibraryEncoder(path, width))


@functools.cache
def id_width(path: str, end_id: int | None) -> int:
    return 2 if max(Tokenizer.from_file(path).get_vocab_size(), end_id or 0) < 1 << 16 else 4


class FileWriter:
    """Appends frames to a stream; what it keeps of each is 20 bytes."""

    def __init__(self, out, width: int = 4, level: int = 1):
        self.out, self.width, self.compressor = out, width, zstandard.ZstdCompressor(level=level)
        self.entries = bytearray()
        self.doc_ids = bytearray()

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: unsigned integers of ``width`` bytes."""
        frame = self.compressor.compress(ids)
        self.out.write(frame)
        self.entries += struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
        self.doc_ids += struct.pack("<q", NO_ID if doc_id is None else doc_id)

    def finish(self) -> None:
        n = len(self.entries) // 12
        self.out.write(struct.pack("<IIB", INDEX, len(self.doc_ids) + 1, self.width) + self.doc_ids)
        self.entries += struct.pack("<III", 9 + len(self.doc_ids), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        self.out.write(struct.pack("<II", SKIPPABLE, len(self.entries) + 9) + self.entries)
        self.out.write(struct.pack("<IBI", n + 1, CHECKSUMS, SEEKABLE))


class FileReader:
    """Random access to the documents of a file."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.size()
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        table = np.frombuffer(self.at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.lengths, self.sums = (table[:-1, k].astype(np.int64) for k in range(3))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        index = self.at(int(self.starts[-1]) + 8, 8 * (n - 1) + 1)
        self.width, self.doc_ids = index[0], np.frombuffer(index[1:], "<i8")
        self.decompressor = zstandard.ZstdDecompressor()

    def at(self, start: int, length: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(length)

    def document(self, k: int) -> bytes:
        """The ids as unsigned 32-bit integers."""
        content = self.decompressor.decompress(self.at(int(self.starts[k]), int(self.sizes[k])))
        if len(content) != self.lengths[k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return content if self.width == 4 else np.frombuffer(content, "<u2").astype("<u4").tobytes()


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = 1) -> None:
    """Encode ``docs(doc_id, text)`` and write token files in ascending order of doc_id to ``folder``."""
    path = path or public_tokenizers.path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        width = id_width(path, end_id)
        end = b"" if end_id is None else int(end_id).to_bytes(width, "little")
        encoder, writer, name, first, last, part, tokens, n = library(path, width), None, f"{uuid.uuid4().hex}.ids.zst", None, None, 0, 0, 0
        for b in slices(batches):
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode_batch(b.column(1).to_pylist()), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer, first, part = FileWriter(out, width), doc_id, b.column(2)[0].as_py()
                writer.add(doc_id, ids + end)
                tokens, last, n = tokens + (len(ids) + len(end)) // width, doc_id, n + 1
        if writer:
            writer.finish()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "n_docs": [n], "n_tokens": [tokens]})

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, ids (binary) of the documents of ``folder``, or of those asked for.

    ``start`` counts the ids of all documents before. Files without an id asked for aren't opened, and
    of the others only the frames asked for are decompressed."""
    wanted = None if doc_ids is None else np.array(sorted(doc_ids), dtype=np.int64)
    asked = lambda first, last: wanted is None or np.searchsorted(wanted, NO_ID if first is None else first) < np.searchsorted(wanted, NO_ID if last is None else last, "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start, first, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not asked(first, last):
                    continue
                with fs.open_input_file(f"{base}/{name}") as stream:
                    reader = FileReader(stream)
                    starts = start + np.concatenate([[0], np.cumsum(reader.lengths // reader.width)])
                    chosen = np.arange(len(reader.doc_ids)) if wanted is None else np.flatnonzero(np.isin(reader.doc_ids, wanted))
                    for some in np.array_split(chosen, max(1, len(chosen) // 512)):
                        ids = [None if x == NO_ID else x for x in reader.doc_ids[some].tolist()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, pa.int64()), pa.array(starts[some], pa.int64()), pa.array([reader.document(k) for k in some.tolist()], pa.binary())],
                            ["doc_id", "start", "ids"],
                        )

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row a file: as many as there were partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "start", "first_id", "last_id").repartition(n, "file").mapInArrow(run, "doc_id long, start long, ids binary")


def token_spans(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of ``read(doc_id, start, ids)``."""
    return read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
