"""Column profiles, inferred types, key and clustering advice, DDL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.diff import as_text


def profile(df: DataFrame, top_n: int = 5) -> DataFrame:
    """column, rows, missing, distinct_values, max_length, min_value, max_value, is_unique, top_values: one row a column.

    All comes from one count of the values of each column."""
    texts = df.select(*[as_text(df, c).alias(c) for c in df.columns])
    counted = value_counts(texts)
    stats = counted.groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("distinct_values"),
        F.max(F.char_length("value")).alias("max_length"), F.min("value").alias("min_value"), F.max("value").alias("max_value"),
    )
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    rows = F.broadcast(every).join(stats, "column", "left") if df.isEmpty() else stats
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("rows", "missing", "distinct_values")})
    rows = rows.withColumn("is_unique", (F.col("missing") == 0) & (F.col("distinct_values") == F.col("rows")))
    return rows.join(ranked_values(counted, top_n), "column", "left").withColumn("top_values", F.coalesce("top_values", F.array().cast("array<string>")))


def value_counts(texts: DataFrame) -> DataFrame:
    """column, value, n."""
    return texts.unpivot([], texts.columns, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(texts: DataFrame, n: int) -> DataFrame:
    return ranked_values(value_counts(texts), n)


def ranked_values(counted: DataFrame, n: int) -> DataFrame:
    """column, top_values: the most frequent, ties by value. Each task keeps ``n`` a column before the last ranking."""
    ranked = counted.where("value is not null").withColumn("k", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("k") <= n)
    return ranked.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("top_values"))


#: One value in so many, by its hash, is looked at first to find columns that repeat some.
LOOKED_AT = 64


def unique_columns(df: DataFrame) -> DataFrame:
    """column, is_unique of each column, as ``profile`` tells it: no nulls and no value twice.

    A share of the values shows most columns that repeat some; only the others are counted whole."""
    texts = df.select(*[as_text(df, c).alias(c) for c in df.columns])
    some = texts.unpivot([], texts.columns, "column", "value").where(F.col("value").isNull() | (F.pmod(F.xxhash64("value"), F.lit(LOOKED_AT)) == 0))
    repeated = {r.column for r in some.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or value is null").select("column").distinct().collect()}
    rest = [c for c in texts.columns if c not in repeated]
    single = {r.column: r.single for r in value_counts(texts.select(*[F.col(f"`{c}`") for c in rest])).groupBy("column").agg(F.max("n").alias("most")).select("column", (F.col("most") == 1).alias("single")).collect()} if rest else {}
    return df.sparkSession.createDataFrame([(c, c not in repeated and single.get(c, True)) for c in texts.columns], "column string, is_unique boolean")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """duplicates: rows after the first of each group of equal rows."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def quality_lists(profiled: DataFrame) -> DataFrame:
    """column, issue: mostly missing or constant."""
    issue = F.when(F.col("missing") >= 0.5 * F.col("rows"), "mostly missing").when(F.col("distinct_values") <= 1, "constant")
    return profiled.select("column", issue.alias("issue")).where("issue is not null")


# Texts that count as boolean, formats tried for times.
BOOLEAN = ("0", "1", "true", "false", "yes", "no", "y", "n", "t", "f")
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss")
#: What begins each text of the formats.
TIME = r"^([-+]?\d{4,}-\d\d-\d\d|\d\d/\d\d/)"
UUID = r"(?i)^\{?[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}\}?$"


def infer_types(df: DataFrame) -> dict[str, str]:
    """SQL type of each column read as text; one aggregate, then a decision on its single row. Booleans come
    before times, times before numbers."""
    def share(cond: Column, col: Column) -> Column:
        return F.avg(F.when(col.isNotNull(), F.coalesce(cond, F.lit(False)).cast("int")))

    aggs = []
    for i, c in enumerate(df.columns):
        v = F.nullif(F.trim(as_text(df, c)), F.lit(""))
        number = F.when(~v.rlike("[A-DF-Za-df-z]"), v.try_cast("decimal(38,10)"))  # a failed cast costs more than a look
        time = F.when(v.rlike(TIME), F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in FORMATS]))
        scale = F.char_length(F.regexp_replace(F.regexp_extract(v, r"\.(\d+)$", 1), "0+$", ""))
        aggs += [
            share(v.rlike(UUID), v).alias(f"u{i}"), share(F.lower(v).isin(*BOOLEAN), v).alias(f"b{i}"), share(time.isNotNull(), v).alias(f"t{i}"),
            share(number.isNotNull(), v).alias(f"n{i}"), F.min(number).alias(f"a{i}"), F.max(number).alias(f"z{i}"), F.max(scale).alias(f"s{i}"),
            F.max(F.char_length(F.regexp_extract(v, r"^[-+]?0*(\d*)", 1))).alias(f"p{i}"), F.max(F.char_length(v)).alias(f"l{i}"),
        ]
    row = df.agg(*aggs).first()
    return {c: decided(*[row[f"{x}{i}"] for x in "ubtnazspl"]) for i, c in enumerate(df.columns)}


def decided(uuid, boolean, time, number, least, most, scale, digits, length) -> str:
    if uuid is None:
        return "NVARCHAR(255)"
    if uuid >= 0.95:
        return "UNIQUEIDENTIFIER"
    if boolean >= 0.99:
        return "BIT"
    if time >= 0.95:
        return "DATETIME2(3)"
    if number >= 0.99:
        if not scale:
            for name, low, high in (("TINYINT", 0, 255), ("SMALLINT", -(2**15), 2**15 - 1), ("INT", -(2**31), 2**31 - 1), ("BIGINT", -(2**63), 2**63 - 1)):
                if low <= least and most <= high:
                    return name
        precision = digits + (scale or 0)
        return f"DECIMAL({max(1, precision)},{scale or 0})" if precision <= 38 else "FLOAT"
    return f"NVARCHAR({length})" if length <= 4000 else "NVARCHAR(MAX)"


def spreadsheet_types(df: DataFrame) -> dict[str, str]:
    """INT, FLOAT, or NVARCHAR(255) for any column with text."""
    row = df.agg(*[
        x for i, c in enumerate(df.columns) for v in [F.nullif(F.trim(as_text(df, c)), F.lit(""))]
        for x in (F.bool_and(v.rlike(r"^[-+]?\d+$")).alias(f"i{i}"), F.bool_and(v.try_cast("double").isNotNull()).alias(f"f{i}"))
    ]).first()
    return {c: "INT" if row[f"i{i}"] else "FLOAT" if row[f"f{i}"] else "NVARCHAR(255)" for i, c in enumerate(df.columns)}


#: Fixed value: texts that may be longer are no keys.
WIDEST_KEY = 200


def may_be_key(kind: str) -> bool:
    """Neither a float, nor a decimal with a scale, nor a wide text."""
    scaled = kind.startswith("DECIMAL") and not kind.endswith(",0)")
    wide = kind.startswith("NVARCHAR") and kind[9:-1].isdigit() and int(kind[9:-1]) > WIDEST_KEY
    return kind != "FLOAT" and not scaled and not wide


def key_candidates(profiled: DataFrame, types: dict[str, str]) -> list[tuple[str, int]]:
    """Columns without nulls or repeated values that may be keys, and their score, best first; reads one row a column."""
    out = []
    for r in profiled.where("is_unique").collect():
        kind, name = types[r.column], r.column.strip().lower()
        if may_be_key(kind):
            points = {100: name == "id", 60: name.endswith("id") and name != "id", 50: "guid" in name or "uuid" in name, 20: kind in ("TINYINT", "SMALLINT", "INT", "BIGINT"), 15: kind == "UNIQUEIDENTIFIER"}
            out.append((r.column, 10 + sum(n for n, holds in points.items() if holds)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def report_rows(df: DataFrame, name: str, order: str) -> DataFrame:
    """section, line_no, line: an exploration report on a table as rows; ``line`` is Markdown, so the lines in order are the report.

    Its input is the profile, a row a column, and the first values by ``order`` as examples."""
    spark = df.sparkSession
    profiled, types = profile(df).collect(), infer_types(df)
    by_name = {r.column: r for r in profiled}
    rows = max((r.rows for r in profiled), default=0)
    keys = [c for c, _ in key_candidates(spark.createDataFrame(profiled, profile(df.limit(0)).schema), types)] if profiled else []
    first = df.orderBy(order).limit(5).select(*[as_text(df, c).alias(c) for c in df.columns]).collect()
    escape = lambda x: str(x).replace("|", "\\|").replace("\n", " ").strip()
    ranged = ("TINYINT", "SMALLINT", "INT", "BIGINT", "DECIMAL", "FLOAT", "DATETIME2")
    lines = [("overview", f"# EDA Notes: {name}"), ("overview", f"- Rows: **{rows:,}**"), ("overview", f"- Columns: **{len(df.columns):,}**"), ("overview", f"- Primary key (chosen / suggested): **{keys[0]}**" if keys else "- Primary key: **(none)**")]
    lines += [("columns", "| Column | Type | Nullable | Missing % | Distinct | Example values | Notes |"), ("columns", "|---|---:|:---:|---:|---:|---|---|")]
    for c in df.columns:
        r = by_name[c]
        notes = ["PK candidate"] * (c in keys) + [f"max_len={r.max_length}"] * (r.max_length is not None) + [f"min={r.min_value}", f"max={r.max_value}"] * (r.min_value is not None and types[c].startswith(ranged))
        examples = ", ".join(dict.fromkeys(str(x[c]) for x in first if x[c] is not None))
        lines.append(("columns", f"| `{escape(c)}` | {types[c]} | {'YES' if r.missing else 'NO'} | {100 * r.missing / max(rows, 1):.2f}% | {r.distinct_values:,} | {escape(examples)} | {escape('; '.join(notes))} |"))
    for r in sorted(profiled, key=lambda r: (-r.missing, r.column)):
        if rows and r.missing >= 0.5 * rows:
            lines.append(("quality", f"- `{r.column}`: {100 * r.missing / rows:.1f}% missing"))
    lines += [("quality", f"- `{r.column}` has one value (e.g., `{escape(r.min_value)}`)") for r in (by_name[c] for c in df.columns) if r.distinct_values == 1]
    lines.append(("quality", f"- Duplicate rows (exact): **{duplicate_rows(df).first()[0]:,}**"))
    lines.append(("quality", f"- Candidate key columns: {', '.join(f'`{c}`' for c in keys) or '*(none found by heuristics)*'}"))
    return spark.createDataFrame([(s, k, x) for k, (s, x) in enumerate(lines, 1)], "section string, line_no int, line string")


def cluster_advice(profiled: DataFrame, key: str | None = None) -> DataFrame:
    """Columns worth clustering or bucketing by: present in most rows, neither constant nor unique."""
    share = F.col("distinct_values") / F.col("rows")
    fit = (F.col("missing") < 0.5 * F.col("rows")) & (F.col("distinct_values") > 1) & ~F.col("is_unique")
    return profiled.where(fit & (F.col("column") != F.lit(key or ""))).select("column", F.when(share < 0.01, "partition").when(share < 0.5, "cluster").otherwise("bucket").alias("advice"))


SPARK_TYPES = {"TINYINT": "SMALLINT", "SMALLINT": "SMALLINT", "INT": "INT", "BIGINT": "BIGINT", "BIT": "BOOLEAN", "FLOAT": "DOUBLE"}


def create_table_ddl(name: str, types: dict[str, str], required: set[str] = frozenset()) -> str:
    def spark(kind: str) -> str:
        return SPARK_TYPES.get(kind) or (kind if kind.startswith("DECIMAL") else "TIMESTAMP" if kind.startswith("DATETIME") else "STRING")

    body = ",\n".join(f"  `{c}` {spark(k)}{' NOT NULL' if c in required else ''}" for c, k in types.items())
    return f"CREATE TABLE `{name}` (\n{body}\n)"
