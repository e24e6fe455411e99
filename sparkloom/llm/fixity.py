"""Merkle fixity audit of WARC replicas.

Records are hashed; the hashes of the records that begin in one range of offsets make a node, and up to
FANOUT neighbouring ranges a node of the next level, up to one root a file. Two replicas are compared
root by root, and only below nodes that differ are their children compared, down to the records.

Defined results: a record in one replica only is ``missing`` (from the second) or ``extra``; one at the
same offset with other bytes is ``changed``; null fields of a page count as empty; pages of one id are
ordered by url and content; repeated rows are records of their own; extra columns aren't looked at;
files that agree, and so also empty tables, give no rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import written

PAGES_PER_FILE, RANGE, FANOUT = 512, 1 << 16, 16


def warc_records(pages: DataFrame) -> DataFrame:
    """file, offset, length, page_id, record: a response record for each page, some hundred pages a file."""
    url, html = (F.coalesce(c, F.lit("")) for c in ("url", "html"))
    page_id = F.coalesce("page_id", F.lit(-1)).cast("long")
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"),
    )
    made = pages.select(F.floor(page_id / PAGES_PER_FILE).cast("long").alias("file"), page_id.alias("page_id"), record.alias("record"))
    made = made.withColumn("length", F.octet_length("record").cast("long"))
    before = Window.partitionBy("file").orderBy("page_id", "record").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))


def leaves(records: DataFrame) -> DataFrame:
    """file, offset, length, page_id, digest of each record."""
    return records.select("file", "offset", "length", "page_id", F.sha2("record", 256).alias("digest"))


def tree(leaf: DataFrame, height: int) -> DataFrame:
    """level, file, node, digest; level 0 has a node for each range, the level ``height`` one for each file."""

    def above(children: DataFrame) -> DataFrame:
        return children.groupBy("file", "node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("part")), ","), 256).alias("digest"))

    number = lambda c: F.lpad(F.col(c).cast("string"), 20, "0")  # noqa: E731  so that text sorts as numbers do
    part = F.concat_ws(":", number("offset"), F.col("length").cast("string"), "digest")
    level = above(leaf.select("file", F.floor(F.col("offset") / RANGE).alias("node"), part.alias("part")))
    levels = [level.select(F.lit(0).alias("level"), "*")]
    for k in range(1, height + 1):
        child = F.concat_ws(":", number("node"), "digest")
        level = above(level.select("file", F.floor(F.col("node") / FANOUT).alias("node"), child.alias("part")))
        levels.append(level.select(F.lit(k).alias("level"), "*"))
    out = levels[0]
    for x in levels[1:]:
        out = out.union(x)
    return out


def fixity_audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """file, offset, page_id, damage, first_sha256, second_sha256 of each record in which the replicas differ.

    first, second: file, offset, length, page_id, record."""
    a, b = (written(leaves(x), "fixity-leaves") for x in (first, second))
    end = max(x.agg(F.coalesce(F.max("offset"), F.lit(0))).first()[0] for x in (a, b))
    height = max(1, math.ceil(math.log(end // RANGE + 1, FANOUT)))
    trees = [written(tree(x, height), "fixity-tree") for x in (a, b)]

    def unlike(level: int, parents: DataFrame | None) -> DataFrame:
        """file, node of the nodes of a level that differ, of those below differing parents."""
        sides = [t.where(F.col("level") == level).select("file", "node", F.col("digest").alias(f"d{k}")) for k, t in enumerate(trees)]
        if parents is not None:
            own = parents.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
            sides = [s.join(own, (s["file"] == own["_f"]) & (F.floor(s["node"] / FANOUT) == own["_n"]), "left_semi") for s in sides]
        return sides[0].join(sides[1], ["file", "node"], "full").where(~F.col("d0").eqNullSafe(F.col("d1"))).select("file", "node")

    found = unlike(height, None)
    for level in range(height - 1, -1, -1):
        found = unlike(level, found)
    own = found.select(F.col("file").alias("_f"), F.col("node").alias("_n"))
    sides = [
        x.join(own, (x["file"] == own["_f"]) & (F.floor(x["offset"] / RANGE) == own["_n"]), "left_semi")
        .select("file", "offset", F.col("page_id").alias(f"p{k}"), F.col("digest").alias(f"d{k}"))
        for k, x in enumerate((a, b))
    ]
    both = sides[0].join(sides[1], ["file", "offset"], "full").where(~F.col("d0").eqNullSafe(F.col("d1")))
    damage = F.when(F.col("d1").isNull(), "missing").when(F.col("d0").isNull(), "extra").otherwise("changed")
    return both.select(
        "file", "offset", F.coalesce("p0", "p1").alias("page_id"), damage.alias("damage"), F.col("d0").alias("first_sha256"), F.col("d1").alias("second_sha256")
    )


def damaged(records: DataFrame) -> DataFrame:
    """A second replica to audit: of records with certain hashes of the id, some have one character of
    the middle overwritten and some are lost; offsets stay those of the file."""
    draw = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("long") % 64
    middle = F.floor(F.char_length("record") / 2).cast("int")
    return records.where(draw != 1).withColumn("record", F.when(draw == 0, F.overlay("record", F.lit("~"), middle, F.lit(1))).otherwise(F.col("record")))
