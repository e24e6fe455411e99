"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    A session on one machine may have none and gets a local one; a cluster must name its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What a Python worker keeps from task to task.
_kept: dict = {}


def once_a_worker(name, make):
    """What ``make`` gives, made once in a Python worker and kept until another operator needs the memory."""
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    _kept.clear()


#: Of ``total`` rows, at most so many keys can each have more than a share of 1 in as many.
HEAVY = 1024


def join_counted(rows: DataFrame, values: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``values``, a row a key, whose column ``count`` says how many of the ``total`` rows have the key.

    Keys of more than total / HEAVY rows are few, so their values are broadcast and their rows stay where they
    are; all other rows meet their values by a shuffle, in which no key is heavy. The hint keeps Spark from broadcasting
    either side by its size, which it sets too low after an explode."""
    heavy = values.where(F.col(count) > total / HEAVY)
    spread = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return spread.unionByName(rest.hint("merge").join(values, keys)).drop(count)


def as_doc(docs: DataFrame) -> Column:
    """All columns in one named ``doc``, so that no name of theirs meets another; ``doc.*`` gives them back."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def first_rows(docs: DataFrame, sha: Column, stay: DataFrame) -> DataFrame:
    """One row of ``docs`` with all its columns for each ``stays``, ``stays_sha`` (id and hash of a text) of ``stay``; ``sha`` is the hash of a row.

    One key of both, never null, so that texts move once, for the join and for what of equal rows stays."""
    def key(id_: Column, sha: Column) -> Column:
        return F.sha2(F.concat_ws(":", sha, id_.cast("string")), 256).alias("key")

    rows = docs.select(as_doc(docs), key(F.col("doc_id"), sha))
    return rows.join(stay.select(key(F.col("stays"), F.col("stays_sha"))), "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few whole texts are held as Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
