"""Profiles that are kept and merged: what is known of a table is a row a column of bounded size, and an append adds its own.

Counts, missing values, least and greatest are exact. Distinct values come from a HyperLogLog sketch (standard error 1.04 / 2**(bits / 2)),
quantiles of numbers from a KLL sketch, and frequent values from a sketch of counts (off by less than 3.5 x rows / tracked). No value
moves to another task; each has one sketch a column. ``operators.profile`` gives all exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.diff import as_text

#: Sizes of the sketches: bits of a hash, nodes, values.
BITS, NODES, TRACKED = 12, 800, 8192
EXACT = {"rows": F.sum, "missing": F.sum, "min_value": F.min, "max_value": F.max, "max_length": F.max}


def sketched(df: DataFrame) -> DataFrame:
    """column, rows, missing, min_value, max_value, max_length, and the sketches distincts, numbers and frequent."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    texts = df.select(*[as_text(df, c).alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    number = F.when(F.col("column").isin(*numeric), F.col("value").cast("double")) if numeric else F.lit(None).cast("double")
    found = texts.withColumn("number", number).groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value").isNull()).alias("missing"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.max(F.char_length("value")).alias("max_length"),
        F.hll_sketch_agg("value", F.lit(BITS)).alias("distincts"), F.kll_sketch_agg_double("number", F.lit(NODES)).alias("numbers"), F.expr(f"approx_top_k_accumulate(value, {TRACKED})").alias("frequent"),
    )
    return found


def merged(sketches: DataFrame) -> DataFrame:
    """One row a column from the rows of any number of parts, which came in at any time."""
    sums = [how(c).alias(c) for c, how in EXACT.items()]
    return sketches.groupBy("column").agg(*sums, F.hll_union_agg("distincts").alias("distincts"), F.kll_merge_agg_double("numbers").alias("numbers"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent"))


def estimated(sketches: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), top_n: int = 5) -> DataFrame:
    """column, rows, missing, min_value, max_value, max_length, distinct_values, quantiles (null without numbers), top_values (value, n), top_error."""
    some = F.kll_sketch_get_n_double("numbers") > 0
    at = F.array(*[F.lit(float(q)) for q in quantiles])
    top = F.transform(F.expr(f"approx_top_k_estimate(frequent, {top_n})"), lambda x: F.struct(x["item"].alias("value"), x["count"].alias("n")))
    error = F.ceil(F.lit(3.5) * (F.col("rows") - F.col("missing")) / TRACKED)
    return sketches.select("column", *EXACT, F.hll_sketch_estimate("distincts").alias("distinct_values"), F.when(some, F.kll_sketch_get_quantile_double("numbers", at)).alias("quantiles"), F.filter(top, lambda x: x["value"].isNotNull()).alias("top_values"), error.alias("top_error"))
