"""Grouped summaries beyond plain aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.pieces import PIECE, text_pieces
from sparkloom.operators.scan import LONG_GROUP
from sparkloom.operators.sequence import with_row_number


def list_agg(df: DataFrame, by: list[str], value: Column, order: Column, sep: str = ", ", name: str = "items") -> DataFrame:
    """Values of each group as one text, in order. For groups that a row can hold; ``text_pieces`` takes any."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.cast("string").alias("v"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), sep).alias(name))


def table_row(cols: list[str]) -> Column:
    cell = F.concat(*[F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>")) for c in cols])
    return F.concat(F.lit("<tr>"), cell, F.lit("</tr>"))


def messages(df: DataFrame, by: list[str], cols: list[str], order: Column, name: str = "message") -> DataFrame:
    """The rows of each group as one HTML table body."""
    return list_agg(df, by, table_row(cols), order, "", name)


def dimension(df: DataFrame, col: str, key: str = "id") -> DataFrame:
    """Distinct values with a surrogate key in their order."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    return with_row_number(values, [col]).withColumn(key, F.col("_row").cast("int")).drop("_row")


def numbered_pivot(df: DataFrame, key: str, value: str, order: list, name: str, most: int = 1000) -> DataFrame:
    """The values of each key as columns ``name_1`` to ``name_n``, n being the size of the largest group; more than ``most`` is an error."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if n > most:
        raise ValueError(f"a key has {n} values, which is too wide a table")
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.groupBy(key).agg(*[F.max(F.when(F.col("_n") == k, F.col(value))).alias(f"{name}_{k}") for k in range(1, n + 1)])


def presence_matrix(df: DataFrame, row: str, col: str, values: list | None = None, most: int = 1000) -> DataFrame:
    """``x`` or blank for each pair of a row and one of the values: those given, or all there are; more than ``most`` is an error."""
    if values is None:
        values = sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect())
    if len(values) > most:
        raise ValueError("too many values for columns")
    return df.groupBy(row).agg(*[F.coalesce(F.max(F.when(F.col(col) == v, "x")), F.lit("")).alias(str(v)) for v in values])


def accuracy_rollup(answers: DataFrame, early: int = 5) -> DataFrame:
    """kind, section, seen, asked, correct, accuracy, coverage: by section, by kind (the first sections
    are semantic, the rest syntactic) and in total. answers: section, section_no, known, correct."""
    kind = F.when(F.col("section_no") <= early, "semantic").otherwise("syntactic")
    out = answers.withColumn("kind", kind).rollup("kind", "section").agg(
        F.count(F.lit(1)).alias("asked"), F.sum(F.col("known").cast("int")).alias("seen"), F.sum((F.col("known") & F.col("correct")).cast("int")).alias("correct")
    )
    return out.withColumns({"accuracy": F.try_divide(F.col("correct"), F.col("seen")), "coverage": F.try_divide(F.col("seen"), F.col("asked"))})


def json_map(df: DataFrame, key: str, order: str, fields: list[str], most: int = PIECE, long_group: int = LONG_GROUP) -> DataFrame:
    """field, piece, mapping: for each field a JSON text of key to value, in pieces of ``most`` characters; blanks are skipped, the later of
    equal keys wins."""
    texts = df.select(key, order, *[F.col(f).cast("string").alias(f) for f in fields])
    long = texts.unpivot([key, order], fields, "field", "value").where("value is not null and value != ''")
    last = long.groupBy("field", F.col(key).cast("string").alias("_k")).agg(F.max_by("value", order).alias("value"))
    entry = F.to_json(F.create_map("_k", "value"))
    entry = F.substring(entry, F.lit(2), F.length(entry) - 2)
    return text_pieces(last, ["field"], entry, ["_k"], ",", "{", "}", most, long_group, "mapping")


def run_summary(runs: DataFrame, by: str, start: str, seconds: str) -> DataFrame:
    """First and last start, least, most, mean and deviation of durations, number of runs."""
    r = lambda c: F.round(c, 2)
    return runs.groupBy(by).agg(
        F.min(start).alias("first_start"), F.max(start).alias("last_start"), F.min(seconds).alias("min_seconds"), F.max(seconds).alias("max_seconds"),
        r(F.avg(seconds)).alias("avg_seconds"), r(F.stddev_samp(seconds)).alias("stdev_seconds"), F.count(F.lit(1)).alias("runs"),
    )
