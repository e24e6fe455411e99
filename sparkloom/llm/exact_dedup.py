"""Exact dedup: groups by a 128-bit content hash, byte comparison inside groups, smallest id stays.

Defined results: a null text counts as empty; empty texts are equal to each other; a null ``doc_id``
sorts after all others; of several rows with the same id and text exactly one stays; very long texts are
compared whole; other columns of the input, of any name, are not looked at and stay as they are; no rows
give no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import first_rows, join_counted, written

#: Groups that are broadcast.
FEW = 1_000_000
#: White space but for the space itself.
OTHER_WHITE = "\t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; only texts with longer runs meet a pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in OTHER_WHITE:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def content_hash(norm: Column) -> Column:
    """128 bits as binary."""
    return F.unhex(F.md5(norm))


def exact_dedup(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row of ``docs(doc_id, text)``.

    Groups are keyed by hash and then by the bytes of the text, so that texts with colliding hashes
    stay apart. Copies combine before the shuffle, in which a text of any number of copies moves once
    a partition; the rows themselves move as hashes only, those of very large groups not at all."""
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("h", hash_of(F.col("norm")))
    sha = F.sha2("norm", 256).alias("text_sha256")
    each = written(norm.select("doc_id", "h", sha, F.monotonically_increasing_id().alias("row")), "exact-rows")
    total = each.count()
    groups = norm.groupBy("h", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups.select("h", sha, "keep_id", "group_size", F.col("group_size").alias("n")), "exact-groups")
    rows = join_counted(each, groups, ["h", "text_sha256"], "n", total)
    # of rows with one id and text, one stays; there are none where ids are unique
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h", "text_sha256").agg(F.min("row").alias("first"), F.max("group_size").alias("n"), F.count(F.lit(1)).alias("same")).where("same > 1")
    first = written(first.drop("same"), "exact-firsts")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    if not first.limit(1).count():
        return rows.withColumn("kept", stays).select(names)
    alike = rows.join(F.broadcast(first.select("h", "text_sha256")) if first.count() <= FEW else first.select("h", "text_sha256"), ["h", "text_sha256"], "left_anti")
    alike = alike.withColumn("kept", stays)
    one = join_counted(rows, first, ["h", "text_sha256"], "n", total).withColumn("kept", stays & (F.col("row") == F.col("first")))
    return alike.select(names).unionByName(one.select(names))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stay = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("stays"), F.col("text_sha256").alias("stays_sha"))
    return first_rows(docs, F.sha2(normalised(F.col("text")), 256), stay)
