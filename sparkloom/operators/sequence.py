"""Windows over ordered rows: splits, flags, packing, peaks, segments, paced release, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.scan import LONG_GROUP, Ordered
from sparkloom.operators.spread import join_counted


def split_rows(df: DataFrame, n: int, k: int, order_by: list[str]) -> DataFrame:
    """Chunk ``k`` of ``n`` even ones in order, as NTILE numbers them.

    Rows are numbered within ranges of the first order column, whose counts are summed, so no task
    sorts the whole table."""
    numbered = with_row_number(df, order_by)
    total = df.count()
    size, more = divmod(total, n)
    low = (k - 1) * size + min(k - 1, more)
    return numbered.where(F.col("_row").between(low + 1, low + size + (k <= more))).drop("_row")


def in_ranges(df: DataFrame, order_by: list[str], parts: int = 64) -> DataFrame:
    """``df`` with _bucket, its range of the order columns (nulls first). The bounds of the ranges come from a
    bounded random sample; they only decide how even the work is."""
    keys = F.struct(*order_by)
    sample = sorted_sample(df.select(*order_by), order_by, parts * 32)
    bounds = [sample[len(sample) * i // parts] for i in range(1, parts)] if sample else []
    kinds = [df.schema[c].dataType for c in order_by]
    fixed = [F.struct(*[F.lit(v).cast(k).alias(c) for c, v, k in zip(order_by, b, kinds, strict=True)]) for b in dict.fromkeys(map(tuple, bounds))]
    return df.withColumn("_bucket", F.size(F.filter(F.array(*fixed), lambda b: b < keys)) if fixed else F.lit(0))


def running(df: DataFrame, order_by: list[str], value: Column, name: str, parts: int = 64) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row in the order: within ranges, to which the sums of
    the ranges before are added; so no task sees the whole table."""
    ranged = in_ranges(df, order_by, parts)
    sums = ranged.groupBy("_bucket").agg(F.sum(value).alias("_n"))  # one row a range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_bucket", before.alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(F.broadcast(sums), "_bucket").withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")


def with_row_number(df: DataFrame, order_by: list[str], parts: int = 64) -> DataFrame:
    """``df`` with _row, its number from 1 in the order (nulls first)."""
    return running(df, order_by, F.lit(1).cast("long"), "_row", parts)


def sorted_sample(df: DataFrame, order_by: list[str], n: int) -> list:
    return df.orderBy(F.rand(1)).limit(n).orderBy(*order_by).collect()


def split_columns(df: DataFrame, n: int, k: int, keys: list[str]) -> DataFrame:
    """Chunk ``k`` of ``n`` of the columns: keys in each, the rest spread evenly, the first chunks one more."""
    rest = [c for c in df.columns if c not in keys]
    if not keys or not rest or n > len(rest):
        raise ValueError("needs a key and at least one other column for each chunk")
    size, more = divmod(len(rest), n)
    low = (k - 1) * size + min(k - 1, more)
    return df.select(*keys, *rest[low : low + size + (k <= more)])


def minmax_flags(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """minmax: ``M`` on the largest of each group, ``m`` on the smallest; the largest wins where they are equal. Rows of large groups
    stay where they are."""
    keyed = df.withColumn("_key", F.to_json(F.struct(*by)))  # null and empty differ
    ends = keyed.groupBy("_key").agg(F.max(value).alias("_max"), F.min(value).alias("_min"), F.count(F.lit(1)).alias("_rows"))
    met = join_counted(keyed, ends, ["_key"], "_rows", df.count())
    flag = F.when(F.col(value) == F.col("_max"), "M").when(F.col(value) == F.col("_min"), "m").otherwise("")
    return met.withColumn("minmax", flag).drop("_key", "_max", "_min")


def pack_rows(df: DataFrame, by: list[str], order: list[str], slot: str, long_group: int = LONG_GROUP) -> DataFrame:
    """row_no: a new output row begins where the slot is not after the one before."""
    rows = Ordered(df, by, order, long_group).add(_prior=("lag", F.col(slot)))
    begins = (F.col("_prior").isNull() | (F.col(slot) <= F.col("_prior"))).cast("int")
    return rows.add(row_no=("sum", begins)).done("_prior")


def find_peaks(df: DataFrame, by: list[str], order: str, value: str, refine: bool = True, long_group: int = LONG_GROUP) -> DataFrame:
    """Rows above both neighbours; refined, with the offset (in steps, within one) and value of the parabola's top."""
    sided = Ordered(df, by, [order], long_group).add(_l=("lag", F.col(value)), _r=("lead", F.col(value))).done()
    peaks = sided.where((F.col(value) > F.col("_l")) & (F.col(value) > F.col("_r")))
    if refine:
        bend = F.col("_l") - 2 * F.col(value) + F.col("_r")
        offset = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (F.col("_l") - F.col("_r")) / bend))
        peaks = peaks.withColumn("peak_offset", offset).withColumn("peak_value", F.col(value) - 0.25 * (F.col("_l") - F.col("_r")) * F.col("peak_offset"))
    return peaks.drop("_l", "_r")


def number_first_seen(df: DataFrame, key: str, order: str, start: int = 1) -> DataFrame:
    """number: keys numbered by first appearance; repeated keys keep their number. Rows of frequent keys stay where they are."""
    first = df.groupBy(key).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    total = df.count()
    numbered = with_row_number(first, ["_first", key]).select(key, (F.col("_row") + (start - 1)).cast("int").alias("number"), "_rows")
    return join_counted(df, numbered, [key], "_rows", total)


def range_labels(df: DataFrame, by: list[str], order: str, chapter: str, verse: str) -> DataFrame:
    """label ``c1:v1–c2:v2`` from the first and last row of each group."""
    part = lambda f: F.concat_ws(":", f(chapter, order), f(verse, order))
    return df.groupBy(*by).agg(F.concat(part(F.min_by), F.lit("–"), part(F.max_by)).alias("label"))


def segments(
    cuts: DataFrame, by: list[str], end: str, resume: str, total: Column, trim: bool = True, start_pad: float = 0.0, end_pad: float = 0.0, long_group: int = LONG_GROUP
) -> DataFrame:
    """segment_start, segment_end from silences between items: each row has the ``end`` of its item and where
    the next may ``resume``. Untrimmed, segments meet at the middle of a silence; trimmed, they keep the pads.
    Starts never run backwards; the last segment ends at ``total``."""
    middle = (F.col(end) + F.col(resume)) / 2
    close = F.least(F.col(end) + end_pad, F.col(resume)) if trim else middle
    reopen = F.greatest(F.col(resume) - start_pad, F.col(end)) if trim else middle
    rows = Ordered(cuts, by, [end], long_group).add(_next=("lead", F.lit(1)), _start=("max_before", reopen)).done()
    out = rows.withColumn("segment_start", F.coalesce("_start", F.lit(0.0)))
    last = F.when(F.col("_next").isNull(), total).otherwise(close)
    return out.withColumn("segment_end", F.greatest(F.col("segment_start"), last)).drop("_next", "_start")


def md5_draw(*parts: Column | str) -> Column:
    """0 to 2**32 - 1 from the first 32 bits of an MD5 over the parts joined by colons, which other engines have as well."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def running_offset(df: DataFrame, by: list[str], order: str, low: float, high: float, seed: int = 1, long_group: int = LONG_GROUP) -> DataFrame:
    """offset: the sum of the steps of the rows before, each drawn from [low, high) by a hash of its key."""
    draw = md5_draw(F.lit(seed), *by, order) % 1_000_000 / 1_000_000.0
    rows = Ordered(df, by, [order], long_group).add(_before=("sum_before", low + draw * (high - low))).done()
    return rows.withColumn("offset", F.coalesce("_before", F.lit(0.0))).drop("_before")


def pace(df: DataFrame, by: list[str], order: str, due: str, step: int, last: int | None = None, long_group: int = LONG_GROUP) -> DataFrame:
    """tick: items in order on a grid of ``step``, one a tick at most, none before it is due; with ``last``,
    items past that time are dropped. In closed form tick i is i + max over j <= i of (due j - j)."""
    rows = Ordered(df, by, [order], long_group).add(_n=("sum", F.lit(1).cast("long")))
    rows = rows.add(_need=("max", F.ceil(F.col(due) / step) - (F.col("_n") - 1))).done()
    out = rows.withColumn("tick", (F.col("_n") - 1 + F.col("_need")) * step).drop("_n", "_need")
    return out if last is None else out.where(F.col("tick") <= last)


def sample_exact(df: DataFrame, n: int, key: list[str], seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows, each as likely as any other, the same ones on each run; a top-k that each task bounds."""
    return df.orderBy(md5_draw(F.lit(seed), *key), *key).limit(n)


def top_with_fallback(df: DataFrame, by: list[str], score: str, order: list, share: float = 0.05, least: int = 3, fallback: int = 10) -> DataFrame:
    """Rows whose score is over ``share``; where fewer than ``least`` are, the first ``fallback`` by score."""
    w = Window.partitionBy(*by)
    out = df.withColumns({"_n": F.row_number().over(w.orderBy(F.desc(score), *order)), "_over": F.sum((F.col(score) > share).cast("int")).over(w)})
    return out.where(((F.col("_over") >= least) & (F.col(score) > share)) | ((F.col("_over") < least) & (F.col("_n") <= fallback))).drop("_n", "_over")


def failures_since_success(runs: DataFrame, by: str, order: str, status: str, good: str = "completed", bad: tuple[str, ...] = ("failed", "error")) -> DataFrame:
    """failures after the last good run of each key, in one shuffle."""
    last_good = F.max(F.when(F.col(status) == good, F.col(order))).over(Window.partitionBy(by))
    later = F.col("_good").isNull() | (F.col(order) > F.col("_good"))
    return runs.withColumn("_good", last_good).groupBy(by).agg(F.sum((later & F.col(status).isin(*bad)).cast("long")).alias("failures"))
