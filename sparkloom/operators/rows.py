"""Filters with two ports, routing, row validation and constraint audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_filter(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows; a null condition rejects."""
    sure = F.coalesce(cond, F.lit(False))
    return df.where(cond), df.where(~sure)


def route(df: DataFrame, col: str, ports: dict, default: str) -> DataFrame:
    """``df`` with the name of the port that each row takes; one filter a port gives its rows."""
    out = F.lit(default)
    for value, name in reversed(ports.items()):
        out = F.when(F.col(col) == value, name).otherwise(out)
    return df.withColumn("port", out)


def override(arg: Column, col: Column) -> Column:
    """The argument, unless it says ``default``."""
    return F.when(arg == "default", col).otherwise(arg)


def coerce_status(col: Column, allowed: list[str], other: str = "inactive") -> Column:
    return F.when(col.isin(allowed), col).otherwise(other)


def validate_rows(
    df: DataFrame, rules: list[tuple[str, Column]], dedup_key: list[str], order: str, repairs: dict[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected ones with a ``reason``.

    Repairs come first. Of the rules, pairs of a reason and the condition that a good row meets, the first
    that fails names the reason. Of rows alike in ``dedup_key`` without regard to case the first stays."""
    fixed = df.withColumns(repairs or {})
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), text) for text, ok in rules], F.lit(None).cast("string"))
    marked = fixed.withColumn("reason", reason)
    alike = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in dedup_key]
    first = F.row_number().over(Window.partitionBy("_bad", *alike).orderBy(order))
    marked = marked.withColumn("_bad", F.col("reason").isNotNull()).withColumn("_n", first)
    marked = marked.withColumn("reason", F.when((F.col("_n") > 1) & ~F.col("_bad"), "duplicate").otherwise(F.col("reason"))).drop("_bad", "_n")
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def constraint_audit(df: DataFrame, checks: dict[str, Column], unique: list[list[str]], refs: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """constraint, violations: rows failing a check, keys seen twice, values without a parent."""
    parts = [df.where(~ok).agg(F.lit(f"check {name}").alias("constraint"), F.count(F.lit(1)).alias("violations")) for name, ok in checks.items()]
    for cols in unique:
        twice = df.groupBy(*cols).count().where("count > 1")
        parts.append(twice.agg(F.lit(f"unique {', '.join(cols)}").alias("constraint"), F.count(F.lit(1)).alias("violations")))
    for col, (parent, key) in refs.items():
        orphans = df.where(F.col(col).isNotNull()).join(parent, F.col(col) == parent[key], "left_anti")
        parts.append(orphans.agg(F.lit(f"reference {col}").alias("constraint"), F.count(F.lit(1)).alias("violations")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def header_problems(names: list[str]) -> list[str]:
    """What is wrong with the names of columns: empty, made up by a reader, or twice without regard to case."""
    found, seen = [], set()
    for k, name in enumerate(names):
        plain = (name or "").strip()
        if not plain or plain.lower().startswith("unnamed") or plain.startswith("_c") and plain[2:].isdigit():
            found.append(f"column {k + 1} has no name")
        elif plain.lower() in seen:
            found.append(f"{plain} is there twice")
        seen.add(plain.lower())
    return found


def header_problem_list(names: Column) -> Column:
    """The same for heads of files as arrays, a row a file."""
    plain = F.transform(names, lambda x: F.trim(F.coalesce(x, F.lit(""))))
    unnamed = lambda x: (x == "") | F.lower(x).startswith("unnamed") | x.rlike("^_c[0-9]+$")

    def problem(x: Column, k: Column) -> Column:
        before = F.exists(F.slice(plain, F.lit(1), k), lambda y: F.lower(y) == F.lower(x))
        return F.when(unnamed(x), F.concat(F.lit("column "), (k + 1).cast("string"), F.lit(" has no name"))).when(before, F.concat(x, F.lit(" is there twice")))

    return F.filter(F.transform(plain, problem), lambda x: x.isNotNull())


def expected_vs_actual(expected: DataFrame, actual: DataFrame, validation_id: int, run_at: str) -> DataFrame:
    """One row for the log of runs: status, rows only in either result."""
    lack = expected.exceptAll(actual).agg(F.count(F.lit(1)).alias("missing_rows"))
    more = actual.exceptAll(expected).agg(F.count(F.lit(1)).alias("extra_rows"))
    ok = (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0)
    return lack.join(more, F.lit(True)).select(
        F.lit(validation_id).alias("validation_id"), F.when(ok, "passed").otherwise("failed").alias("status"),
        "missing_rows", "extra_rows", F.lit(run_at).cast("timestamp").alias("run_at"),
    )
