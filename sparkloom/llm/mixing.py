"""Mixing sources to target weights: repetition rates by source, hash-seeded Bernoulli copies.

Defined results: a null text has size 0; the null source is a source of its own, last in order;
a source without words has target and rate 0; repeated rows each take part on their own: equal ids and texts are numbered, and
each number draws for itself, so rows without an id come near the target too; the words of very long texts are all counted;
extra columns, of any name, pass through; no rows give no rows. Reruns agree; of over ALIKE rows with one id and text, under
other input partitions, others of them may be taken twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import as_doc, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Sources are one row each; up to so many go to all executors, more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
#: Rows with one id and text that one task numbers.
ALIKE = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def hash_draw(row: Column, seed: int) -> Column:
    """0 to 1 (exclusive) from the first 32 bits of an MD5 of what names the row, which other engines have as well."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), row)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def row_names(sized: DataFrame) -> DataFrame:
    """``sized`` with ``name``: id, MD5 of the text and the number among the rows that have both alike.

    Only names that occur twice or more are numbered: up to ALIKE rows by one window, more by one in each input partition."""
    name = F.concat_ws(":", F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("doc.text"), F.lit(""))))
    named = sized.withColumn("name", name)
    twice = written(named.groupBy("name").agg(F.count(F.lit(1)).alias("alike")).where("alike > 1"), "mix-alike")
    number = twice.count()
    if not number:
        return named.withColumn("name", F.concat("name", F.lit(":1")))
    few = F.broadcast(twice) if number <= BROADCAST_SOURCES else twice
    marked = named.join(few, "name", "left")
    alone = marked.where("alike is null").withColumn("name", F.concat("name", F.lit(":1")))
    part = F.when(F.col("alike") > ALIKE, F.spark_partition_id()).otherwise(0)
    several = marked.where("alike is not null").withColumn("part", part)
    place = F.row_number().over(Window.partitionBy("name", "part").orderBy("size"))
    several = several.withColumn("number", place).withColumn("name", F.concat_ws(":", "name", F.when(F.col("part") > 0, F.col("part")), "number"))
    return alone.drop("alike").unionByName(several.drop("alike", "part", "number"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size, target, rate from ``sizes(source, source_size)``.

    Resharing the excess by weight until no source is above ``most`` times its size ends where
    target = min(most * size, level * weight) for one level. Capped are the sources with the least
    size to weight; of the possible counts of these the first whose level caps no further source holds."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick).withColumn("ratio", F.col("source_size") * F.lit(most) / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(whole)["level"]
    out = levels.withColumn("target", F.least(F.col("source_size") * F.lit(most), F.col("weight") * F.coalesce(level, F.lit(0.0))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return out.select("source", "source_size", "target", rate.alias("rate"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """doc (all columns of a row of ``docs``), size, source_size, target and copies, the times that the mix emits the row."""
    sized = docs.select(as_doc(docs), F.col("source").alias("from_source"), word_count(F.col("text")).alias("size"))
    sums = sized.groupBy(F.col("from_source").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sums, weights, most), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    floor = F.floor("rate")
    copies = floor + (hash_draw(F.col("name"), seed) < F.col("rate") - floor).cast("long")
    joined = row_names(sized).join(targets, F.col("from_source").eqNullSafe(F.col("source")))
    return joined.select("doc", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The rows of the mix, each document repeated as often as drawn, with the columns of ``docs``."""
    plan = mix_plan(docs, weights, most, seed).where("copies > 0")
    return plan.select("doc", F.explode(F.expr("sequence(1L, copies)"))).select("doc.*")
