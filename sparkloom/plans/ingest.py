"""Warehouse loads and their bookkeeping: reloads, run history, freshness, schedule, candidates, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import boundary_diff, schedule_time, status_label
from sparkloom.operators.aggregate import table_row
from sparkloom.operators.diff import fingerprints_match, upsert
from sparkloom.operators.pieces import PIECE, text_pieces
from sparkloom.operators.sequence import failures_since_success


def exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def ensure_table(source: DataFrame, path: str) -> None:
    """An empty table with the schema of the source, where there is none."""
    if not exists(source.sparkSession, path):
        source.limit(0).write.parquet(path)


def partial_replace(target: DataFrame, staging: DataFrame, cond: Column) -> DataFrame:
    """Rows of the target that the condition doesn't hold, and all of staging."""
    return target.where(~F.coalesce(cond, F.lit(False))).unionByName(staging)


def reload_from_first_id(target: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows from the first id of the new file on are replaced."""
    first = new.agg(F.min(key).alias("_first"))
    return target.join(F.broadcast(first), F.col(key) < F.col("_first")).drop("_first").unionByName(new)


def changed_groups(source: DataFrame, target: DataFrame, by: str) -> DataFrame:
    """Groups whose fingerprints differ, to be loaded again."""
    return fingerprints_match(source, target, by).where(~F.col("is_matching")).select(by)


def load_table(source: DataFrame, target: str, next_target: str, cond: Column | None = None) -> bool:
    """Write the next version of a table to a new path: whole, or with the rows of a condition replaced.
    Returns False, and writes nothing, if both sides already agree."""
    spark = source.sparkSession
    ensure_table(source, target)
    now = spark.read.parquet(target)
    wanted = source if cond is None else source.where(cond)
    held = now if cond is None else now.where(cond)
    if fingerprints_match(wanted, held).first().is_matching:
        return False
    (wanted if cond is None else partial_replace(now, wanted, cond)).write.parquet(next_target)
    return True


def record_runs(objects: DataFrame, stats: DataFrame) -> DataFrame:
    """Objects with counts, checksum and times of their latest run: refreshed if completed, verified if it agreed."""
    new = stats.select("id", "numrows", "checksum", F.when(F.col("is_matching"), F.col("at")).alias("verified"), F.when(F.col("status") == "completed", F.col("at")).alias("refreshed"))
    joined = objects.alias("o").join(new.alias("n"), "id", "left")
    cols = ("numrows", "checksum", "verified", "refreshed")
    return joined.select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in cols else F.col("id" if c == "id" else f"o.{c}") for c in objects.columns])


def latest_run(runs: DataFrame) -> DataFrame:
    """object_id, last_status, last_time."""
    return runs.groupBy("object_id").agg(F.max_by("status", F.struct("statustime", "run_id")).alias("last_status"), F.max("statustime").alias("last_time"))


def freshness(objects: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Objects with their last run, failures since success, hours since they were verified and refreshed, next time."""
    failing = failures_since_success(runs, "object_id", "statustime", "status")
    out = objects.join(latest_run(runs), objects["id"] == F.col("object_id"), "left").drop("object_id")
    out = out.join(failing, out["id"] == failing["object_id"], "left").drop("object_id")
    return out.withColumns({
        "failures": F.coalesce("failures", F.lit(0).cast("long")), "hours_since_verified": boundary_diff("hour", F.col("verified"), now),
        "hours_since_refreshed": boundary_diff("hour", F.col("refreshed"), now), "next_time": schedule_time(F.col("verified"), F.col("modified"), F.col("frequency")),
    })


def schedule(fresh: DataFrame) -> DataFrame:
    return fresh.withColumn("label", status_label(F.col("status"), F.col("verified"), F.col("numrows"), F.col("last_status")))


def candidates(fresh: DataFrame, now: Column, lookahead_min: int = 50) -> DataFrame:
    """Active objects that were never run, whose last run did not complete, or that are due within the look-ahead."""
    due = F.col("next_time") <= now + F.expr(f"interval {lookahead_min} minutes")
    never, broken = F.col("last_status").isNull(), F.col("last_status").isin("failed", "error")
    return fresh.where((F.col("status") == "active") & (never | broken | due))


def due_objects(objects: DataFrame, now: Column, lookahead_min: int = 50) -> DataFrame:
    ahead = F.unix_timestamp(now) + lookahead_min * 60
    return objects.where(ahead > F.unix_timestamp("refreshed") + F.col("frequency") * 3600)


def alerts(fresh: DataFrame, max_failures: int = 3, most: int = PIECE) -> DataFrame:
    """last_status, piece, message: a message for each last status with the objects that failed too often, in pieces of ``most`` characters."""
    failing = fresh.where(F.col("failures") > max_failures)
    return text_pieces(failing, ["last_status"], table_row(["name", "failures"]), ["id"], most=most, name="message")


def update_objects(objects: DataFrame, listed: DataFrame) -> DataFrame:
    return upsert(objects, listed, ["id"], ["name", "frequency", "status", "modified", "numrows"])


def security_extract(principals: DataFrame, assignments: DataFrame, database: str = "all") -> tuple[DataFrame, DataFrame]:
    """Users of one database or all, and the assignments of those users; passwords are no part of it."""
    users = principals if database == "all" else principals.where(F.col("db") == database)
    own = assignments if database == "all" else assignments.where(F.col("db") == database)
    return users.distinct(), own.join(users, ["db", "principal"], "left_semi").distinct()


def backup(df: DataFrame, folder: str, name: str, stamp: str, cond: Column | None = None) -> str:
    path = f"{folder}/{name}-{stamp}"
    (df if cond is None else df.where(cond)).write.parquet(path)
    return path
