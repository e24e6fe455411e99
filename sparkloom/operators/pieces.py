"""Ordered texts of groups of any size, as numbered pieces of bounded length or as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.scan import LONG_GROUP, Ordered

#: Characters of a piece.
PIECE = 1 << 20


def text_pieces(
    df: DataFrame, by: list[str], value: Column, order_by: list[str], sep: str = "", before: str = "", after: str = "", most: int = PIECE, long_group: int = LONG_GROUP, name: str = "text"
) -> DataFrame:
    """by, piece, text: the values of each group in order, joined by ``sep``, in pieces of ``most`` characters, the last of a group what is left.

    One after another, the pieces from number 0 are ``before``, the joined values and ``after``. Null values are left out; a group without
    any has no piece. A value knows by a running sum where it begins, and gives a part to each piece that it reaches into, so a task
    never holds more than a piece of a group."""
    valued = df.withColumn("_v", value.cast("string")).where("_v is not null").select(*by, *[c for c in order_by if c not in by], "_v")
    placed = Ordered(valued, by, order_by, long_group).add(_prior=("lag", F.lit(1)), _next=("lead", F.lit(1)))
    head = F.when(F.col("_prior").isNull(), F.lit(before)).otherwise(F.lit(sep))
    tail = F.when(F.col("_next").isNull(), F.lit(after)).otherwise(F.lit(""))
    whole = F.concat(head, F.col("_v"), tail)
    placed = placed.add(_at=("sum_before", F.length(whole).cast("long")))
    rows = placed.done().select(*by, F.coalesce("_at", F.lit(0)).alias("_at"), whole.alias("_v")).where("_v != ''")
    pieces = F.sequence(F.floor(F.col("_at") / most), F.floor((F.col("_at") + F.length("_v") - 1) / most))
    parts = rows.withColumn("piece", F.explode(pieces))
    first = F.greatest(F.col("piece") * most - F.col("_at"), F.lit(0))
    parts = parts.withColumn("_part", F.expr("_v").substr((first + 1).cast("int"), F.lit(most).cast("int")))
    end = (F.col("piece") + 1) * most - F.greatest(F.col("_at"), F.col("piece") * most)
    parts = parts.withColumn("_part", F.col("_part").substr(F.lit(1), end.cast("int")))
    joined = F.array_join(F.sort_array(F.collect_list(F.struct("_at", "_part")))["_part"], "")
    return parts.groupBy(*by, "piece").agg(joined.alias(name))


def write_texts(df: DataFrame, by: str, text: str, order_by: list[str], path: str, sep: str, ranges: int | None = None) -> None:
    """A folder for each group with its texts in order, each followed by ``sep``; read in the order of their names, the files of a folder
    are the texts of the group. A task writes a range of the order, row by row."""
    ranged = df.select(by, text, *[c for c in order_by if c not in (by, text)]).repartitionByRange(*([ranges] if ranges else []), by, *order_by).sortWithinPartitions(by, *order_by)
    ranged.select(by, text).write.partitionBy(by).option("lineSep", sep).text(path)


def read_texts(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """path, start, number, text of the texts in files, which ``sep`` ends; path, start and number give their order. A file may be read by several tasks."""
    raw = spark.read.option("lineSep", sep).text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("number"), F.col("value").alias("text"))
