"""I-Match fingerprints in DataFrame functions: distinct terms within an idf band, in order, hashed
once for each of several randomised subsets of the lexicon.

A subset holds each term of the lexicon with a chance of 1 in its rate, so subsets of a low rate keep a
few terms of a short text and those of a high rate a few terms of a long one. The likeness of two
fingerprints is the share of subsets with equal hashes among those that hold a term of either text.

Defined results: a null text counts as empty; a text without a term in any subset is hashed by its
terms in the band or else by all its terms, so empty texts are alike; a null ``doc_id`` sorts last, and
rows with one id by a hash of their text; a lone document is its own next; very long texts are read whole;
repeated rows give repeated rows; other columns, of any name, aren't looked at; no rows give no rows."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import written

#: Shares of all documents that a term of the lexicon is found in.
BAND = (0.001, 0.3)
#: Rates of the subsets, and how many there are of each.
RATES, EACH = (64, 128, 256, 512), 16
#: A lexicon has at most (mean number of distinct terms) / BAND[0] terms. Beyond this it isn't broadcast.
BROADCAST_TERMS = 2_000_000
#: Terms in more than this share of all documents, (mean number of distinct terms) / HEAVY_SHARE at most, are heavy keys.
HEAVY_SHARE = 0.01
#: What xxhash64 gives for an empty array.
NONE = 42


def terms(text: Column) -> Column:
    """Distinct runs of letters and digits in lower case."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """term_hash of the terms within the band, df (documents with it) and n (all), from all of ``docs(text)``."""
    found = docs.select(F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
    n = docs.count()
    kept = found.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(band[0] * n, band[1] * n))
    return kept.groupBy(F.xxhash64("term").alias("term_hash")).agg(F.max("df").alias("df")).withColumn("n", F.lit(n))


def slot(x: Column, s: int) -> Column:
    """What a term's hash draws for the s-th rate, from bits of its own; the term is in subset k if it draws k."""
    return F.shiftright(x, 14 * s).bitwiseAND(RATES[s] - 1)


def in_subsets(kept: Column, s: int) -> Column:
    """The hashes that lie in any subset of the s-th rate, a quarter of all or less."""
    return F.filter(kept, lambda x: slot(x, s) < EACH)


def subset_hashes(by_rate: list[Column]) -> Column:
    """One hash for each subset, from the sorted hashes of terms that ``in_subsets`` gives for each rate."""
    def drawn(s: int, k: int):
        return lambda x: slot(x, s) == k

    return F.array(*[F.xxhash64(F.filter(kept, drawn(s, k))) for s, kept in enumerate(by_rate) for k in range(EACH)])


def fingerprint(raw: Column, kept: Column, whole: Column) -> Column:
    """``raw``, or without a term in any subset the hash of the terms in the band, or else of all terms."""
    instead = F.when(F.size(kept) > 0, F.xxhash64(kept)).otherwise(whole)
    return F.when(F.exists(raw, lambda x: x != NONE), raw).otherwise(F.array_repeat(instead, len(RATES) * EACH))


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != NONE)), lambda x: x))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != NONE) | (y != NONE)), lambda x: x))
    return same.cast("double") / either


def order_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def ranged(docs: DataFrame, parts: int) -> DataFrame:
    """``docs`` with _bucket, a range of ids, and with _ghost 0; besides, in each bucket with _ghost 1 the
    documents that follow its last one in descending order of id (for the last bucket, the first of all).

    So what follows a document is found within its bucket, and no task holds more than a few buckets.
    The largest id of each bucket comes from Spark's own range partitioning of the ids; these, one number a
    bucket, go by the driver and into the plan as one constant, which is searched in two steps."""
    key = order_key()
    dealt = docs.select(key.alias("k")).repartitionByRange(parts, "k").groupBy(F.spark_partition_id()).agg(F.max("k").alias("k"))
    bounds = sorted(r.k for r in dealt.select("k").collect())
    own = docs.withColumn("_ghost", F.lit(0))
    if not bounds:
        return own.withColumn("_bucket", F.lit(0))
    step = math.isqrt(len(bounds))
    coarse, fine = (F.from_json(F.lit(json.dumps(x)), "array<bigint>") for x in (bounds[::step], bounds))
    block = F.greatest(F.size(F.filter(coarse, lambda b: b < key)) - 1, F.lit(0)) * step
    own = own.withColumn("_bucket", block + F.size(F.filter(F.slice(fine, block + 1, step), lambda b: b < key)))
    # the largest of a bucket follows the last of the bucket above; the largest of all that of the lowest
    ghosts = own.where(F.element_at(fine, F.col("_bucket") + 1) == key)
    return own.unionByName(ghosts.withColumns({"_ghost": F.lit(1), "_bucket": ((F.col("_bucket") + 1) % len(bounds)).cast("int")}))


def with_terms(rows: DataFrame, known: DataFrame, terms_known: int) -> DataFrame:
    """``rows`` with term_hash, that of the lexicon or null; many terms are joined by a shuffle, the most frequent of them broadcast."""
    if terms_known <= BROADCAST_TERMS:
        return rows.join(F.broadcast(known.select("term_hash")), F.col("_h") == F.col("term_hash"), "left")
    heavy = F.broadcast(known.where(F.col("df") > HEAVY_SHARE * F.col("n")).select("term_hash"))
    met = rows.join(heavy, F.col("_h") == F.col("term_hash"))
    rest = rows.join(heavy, F.col("_h") == F.col("term_hash"), "left_anti").join(known.select("term_hash"), F.col("_h") == F.col("term_hash"), "left")
    return met.unionByName(rest)


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    Whole texts move once, to their bucket; all else happens there, as later steps group by bucket first."""
    spark = docs.sparkSession
    known = written(lexicon(docs), "imatch-lexicon")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = Window.partitionBy("_bucket").orderBy("_ghost", order_key().desc(), F.xxhash64("text"), "text")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    paired = ranged(texts, parts).select(
        "*", F.row_number().over(order).alias("_row"), F.lead("text").over(order).alias("_next")
    ).select(
        "_bucket", "_ghost", "_row", "doc_id", n.cast("long").alias("n_chars"), "text",
        F.concat(F.left("text", n - half), F.left(F.coalesce("_next", F.lit("")), half)).alias("_edited"),
    )
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(c).alias("t")) for k, c in enumerate(("text", "_edited"))])
    each = paired.select("_bucket", "_row", "_ghost", "doc_id", "n_chars", F.unhex(F.sha2("_edited", 256)).alias("_sha"), F.explode(sides).alias("_of"))
    each = each.withColumn("_terms", terms(F.col("_of.t"))).withColumn("_whole", F.xxhash64(F.array_sort("_terms"), F.lit("all")))
    rows = each.select("_bucket", "_row", "_ghost", "doc_id", "n_chars", "_sha", "_of.side", "_whole", F.explode_outer("_terms").alias("_term"))
    rows = with_terms(rows.withColumn("_h", F.xxhash64("_term")), known, known.count())
    per_side = [
        x for k in (0, 1) for x in (
            F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("term_hash")))).alias(f"_kept{k}"),
            F.max(F.when(F.col("side") == k, F.col("_whole"))).alias(f"_whole{k}"),
        )
    ]
    grouped = rows.groupBy("_bucket", "_row", "_ghost", "doc_id", "n_chars", "_sha").agg(*per_side)
    # each step's columns are used many times in the next, so Spark keeps the steps apart
    base = ("_bucket", "_row", "_ghost", "doc_id", "n_chars", "_sha")
    parts = grouped.select("*", *[in_subsets(F.col(f"_kept{k}"), s).alias(f"_in{k}_{s}") for k in (0, 1) for s in range(len(RATES))])
    raw = parts.select(*base, "_kept0", "_whole0", "_kept1", "_whole1", *[subset_hashes([F.col(f"_in{k}_{s}") for s in range(len(RATES))]).alias(f"_raw{k}") for k in (0, 1)])
    prints = raw.select(*base, *[fingerprint(F.col(f"_raw{k}"), F.col(f"_kept{k}"), F.col(f"_whole{k}")).alias(c) for k, c in enumerate(("_a", "_b"))])
    after = Window.partitionBy("_bucket").orderBy("_row")
    return prints.withColumn("_c", F.lead("_a").over(after)).where("_ghost = 0").select(
        "doc_id", "n_chars", F.lower(F.hex("_sha")).alias("edited_sha256"), as_text(F.col("_a")).alias("fingerprint"),
        as_text(F.col("_b")).alias("edited_fingerprint"), likeness(F.col("_a"), F.col("_b")).alias("near_edited"),
        likeness(F.col("_a"), F.col("_c")).alias("near_next"),
    )
