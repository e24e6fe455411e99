"""SimHash near-dedup with covering locality-sensitive hashing.

Bit i of a fingerprint has the vector m(i) = i mod (2^(r+1)-1) + 1 of r+1 bits. Table v, for each v
but 0, keeps the bits whose m(i) has an odd product with v. The at most r vectors of the bits in which
two fingerprints differ don't span all r+1 dimensions, so some v is orthogonal to all of them: in that
table the two agree. So every pair within the radius collides in some table.

Defined results: a null text counts as empty and has fingerprint 0, linked like any other; a null
``doc_id`` takes part, and is the id of a component only where it has no other; texts that share an id each
have their own fingerprint and component; very long texts are read whole; repeated rows give repeated rows;
other columns of the input, of any name, are not looked at; no rows give no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import first_rows, join_counted, slices, text_bytes, written
from sparkloom.llm.components import connected_components

#: Buckets with more fingerprints than this are compared in pairs of blocks of about this many.
BLOCK = 512
#: Within groups of up to so many, all neighbours in the order are compared at once.
FEW = 6


def simhash(text: bytes, width: int = 4, seed: int = 42) -> int:
    """64-bit fingerprint; ``bytes.lower`` and ``bytes.split`` know ASCII only, as wanted."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(joined, seed)]
    else:
        hashes = [digest(joined[a:z], seed) for a, z in zip(starts, ends[width - 1 :], strict=False)]
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        octets = np.array(hashes[k : k + 8192], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([simhash(x, width) for x in text_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def covering_masks(radius: int) -> list[int]:
    """The bits that each table keeps, as signed 64-bit integers."""
    n = 2 ** (radius + 1) - 1
    masks = [sum(1 << i for i in range(64) if bin((i % n + 1) & v).count("1") % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def forest(fps: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect what links within the radius connect: each reached once, from a reached one."""
    rest = fps
    while len(rest):
        reached, rest = [rest[0]], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                reached.extend(found)
                yield from ((int(x), int(y)) for y in found)


def group_links(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of fingerprints that lie in groups, one after another."""
    begins = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.concatenate([begins, [len(groups)]]))
    a, b = [], []
    small = np.repeat(sizes <= FEW, sizes)
    for lag in range(1, min(FEW, len(fps))):
        at = np.flatnonzero((groups[lag:] == groups[:-lag]) & small[lag:])
        at = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= radius]
        a.append(fps[at])
        b.append(fps[at + lag])
    for k in np.flatnonzero(sizes > FEW):
        if links := list(forest(np.unique(fps[begins[k] : begins[k] + sizes[k]]), radius)):
            pairs = np.array(links, np.uint64)
            a.append(pairs[:, 0])
            b.append(pairs[:, 1])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))


def links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints ``fp`` (of a written table) that connect what all links connect.

    A bucket of up to ``block`` fingerprints is one group. A larger one is dealt into blocks, and each
    pair of its blocks is a group, so that no group holds more than about two blocks whatever the
    bucket; every pair of a bucket meets in some group. A group gives at most a forest, not its pairs."""
    total = distinct.count()
    tables = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)])
    keyed = distinct.select("fp", F.posexplode(tables).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("rows", F.col("n"))
    met = join_counted(keyed, sizes, ["t", "key"], "rows", total * len(covering_masks(radius))).select("fp", F.xxhash64("t", "key").alias("bucket"), F.ceil(F.col("n") / block).alias("blocks"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp", F.lit("block")), "blocks"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = met.withColumn("other", F.explode(other))
    group = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            groups = np.concatenate([groups, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0  # the last group may go on
            if whole:
                yield pairs(groups[:whole], fps[:whole])
                groups, fps = groups[whole:], fps[whole:]
        if len(groups):
            yield pairs(groups, fps)

    def pairs(groups: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = group_links(groups, fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    dealt = met.select(group.alias("grp"), "fp").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "a long, b long")


def placed(of_fp: DataFrame, radius: int, block: int) -> DataFrame:
    """``of_fp`` (a written table, a row a fingerprint ``fp``, with ``first``) with ``first`` of its component in its place."""
    found = connected_components(links(of_fp.select("fp"), radius, block))
    in_component = of_fp.join(found, of_fp["fp"] == found["node"], "left").withColumn("component", F.coalesce("component", "fp")).drop("node")
    least = in_component.groupBy("component").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("fps"))
    return join_counted(in_component.drop("first"), least, ["component"], "fps", of_fp.count()).withColumnRenamed("least", "first")


def near_components(docs: DataFrame, radius: int = 4, width: int = 4, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id of each row: the smallest doc_id reachable over links."""
    each = written(fingerprints(docs, width), "simhash")
    # of equal fingerprints one stands for all
    of_fp = written(each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    rows = join_counted(each, placed(of_fp, radius, block).drop("component"), ["fp"], "n", each.count())
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_representatives(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: that with the smallest doc_id, a null last, and
    then with the smallest SHA-256 of its text; of rows with one id and text any.

    A component is known by its key, not by an id, so that components whose rows have no id, or one id,
    each keep a row. Texts are not moved to pick the rows; a component's rows combine before the shuffle."""
    sha = F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)
    each = written(fingerprints(docs.select(F.struct("doc_id", sha.alias("sha")).alias("doc_id"), "text"), width), "simhash")
    first = F.min(F.struct(F.col("doc_id.doc_id").isNull().alias("last"), "doc_id.doc_id", "doc_id.sha"))
    of_fp = written(each.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    # equal texts have one fingerprint, so id and hash belong to one component
    stay = placed(of_fp, radius, BLOCK).where("fp = component").select(F.col("first.doc_id").alias("stays"), F.col("first.sha").alias("stays_sha"))
    return first_rows(docs, sha, stay)
