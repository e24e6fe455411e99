"""Packing by powers of two: each document is cut into pieces of binary length, and equal lengths share a bucket.

A document of n ids gives as many pieces of ``most`` ids as fit, then one piece for each bit of the rest, largest
first. A piece is a sequence by itself: its length is a power of two, so it needs no padding, and no sequence crosses
documents. The sequences of a bucket, that is of one length, are numbered without gaps, longest bucket first, within it
by input partition and place there; so a reader takes a batch of one length as a range of ids. Texts are not
shuffled: each partition counts its pieces by length, and only these counts are summed up over partitions.

Defined results: a null or empty text is the end id alone; repeated rows and rows of one id are documents of their own; a
null doc_id stays null; very long texts give many pieces; extra columns, of any name, are not looked at; no rows give no rows.
The same files read in the same partitions give the same numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.bpe import WORD_BPE
from sparkloom.llm.common import slices, written
from sparkloom.llm.token_files import id_width, library

LONGEST = 4096
#: Rows and bytes of ids that a task gives out at once.
ROWS, BYTES = 8192, 8 << 20
#: Partitions are one row each; up to so many go to all executors, more are joined by a shuffle.
BROADCAST_PARTS = 1_000_000


def binary_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The lengths of the pieces of n ids."""
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if n % longest >> k & 1]


def cut_pieces(docs: DataFrame, path: str | None = None, end_id: int | None = 2, longest: int = LONGEST) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, part, nth (of its length in its partition)."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    path = path or public_tokenizers.path(WORD_BPE)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = id_width(path, end_id)
        end = b"" if end_id is None else int(end_id).to_bytes(width, "little")
        encoder = library(path, width)
        seen = dict.fromkeys((1 << k for k in range(longest.bit_length())), 0)

        def batch(rows: list[tuple], of: pa.RecordBatch) -> pa.RecordBatch:
            at, start, length, ids, tokens, nth = zip(*rows, strict=True)
            at = pa.array(at)
            return pa.RecordBatch.from_arrays(
                [of.column(0).take(at), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), of.column(2).take(at), pa.array(nth, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "part", "nth"],
            )

        for b in slices(batches):
            rows: list[tuple] = []
            held = 0
            for k, raw in enumerate(encoder.encode_batch(b.column(1).to_pylist())):
                ids = np.frombuffer(raw + end, f"<u{width}").astype("<u4").tobytes()
                n = len(ids) // 4
                start = 0
                for length in binary_lengths(n, longest):
                    rows.append((k, start, length, ids[4 * start : 4 * (start + length)], n, seen[length]))
                    seen[length] += 1
                    start += length
                    held += 4 * length
                    if len(rows) >= ROWS or held >= BYTES:
                        yield batch(rows, b)
                        rows, held = [], 0
            if rows:
                yield batch(rows, b)

    source = docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    return source.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, part long, nth long")


def pack(docs: DataFrame, path: str | None = None, end_id: int | None = 2, longest: int = LONGEST) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset (0, as a piece fills its sequence) of each piece of ``docs(doc_id, text)``."""
    pieces = written(cut_pieces(docs, path, end_id, longest), "packing-pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("length").orderBy("part")  # a row a partition
    counts = counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    buckets = counts.groupBy("length").agg(F.sum("n").alias("total"))  # a row a power of two
    longer = Window.orderBy(F.desc("length"))
    buckets = buckets.select("length", (F.sum("total").over(longer) - F.col("total")).alias("bucket"))
    firsts = counts.join(F.broadcast(buckets), "length").select("length", "part", (F.col("bucket") + F.col("before")).alias("first"))
    firsts = firsts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "first"))).alias("firsts"))
    firsts = written(firsts, "packing-firsts")
    if firsts.count() <= BROADCAST_PARTS:
        firsts = F.broadcast(firsts)
    sequence = F.element_at("firsts", F.col("length")) + F.col("nth")
    return pieces.join(firsts, "part").select("doc_id", "start", "length", "ids", "doc_tokens", sequence.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
