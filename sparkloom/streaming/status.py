"""Streams of status events: failures since the last success, alerts in windows, a bounded sample of each window."""

from __future__ import annotations

import heapq
import itertools
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.sequence import md5_draw
from sparkloom.sources.files import shared_folder


def failure_runs(events: DataFrame, key: str, ts: str, ok: Column, late: str = "1 hour") -> DataFrame:
    """key, last_success, last_event, failures: after each micro-batch, for each key met in it, the failures since its
    last success. State is three numbers a key. Events come in any order inside a batch; one that is older than what
    its key has already seen is counted as if it came now. A null ``ok`` is a failure."""
    slim = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.coalesce(ok, F.lit(False)).alias("ok")).withWatermark("ts", late)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        success, last, failures = state.get if state.exists else (None, None, 0)
        win, latest, fails = None, None, []  # of this batch
        for b in batches:
            latest = max(x for x in (latest, b["ts"].max()) if x is not None)
            good = b.loc[b["ok"], "ts"]
            if len(good):
                win = good.max() if win is None else max(win, good.max())
            bad = b.loc[~b["ok"], "ts"]
            fails = [x for x in [*fails, *bad] if win is None or x > win]
        if win is not None:
            success, failures = int(win.value // 1000), 0
        failures += len(fails)
        last = max(int(latest.value // 1000), last or -(1 << 62))
        state.update((success, last, failures))
        yield pd.DataFrame({"key": [k[0]], "last_success": pd.array([success], dtype="Int64"), "last_event": [last], "failures": [failures]})

    out = "key string, last_success long, last_event long, failures long"
    found = slim.groupBy("key").applyInPandasWithState(step, out, "last_success long, last_event long, failures long", "update", GroupStateTimeout.NoTimeout)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("last_success", "last_event")})


def window_failures(events: DataFrame, key: str, ts: str, ok: Column, width: str = "1 hour", late: str = "1 hour", more_than: int = 3) -> DataFrame:
    """window_start, key, failures of windows with more failures than allowed, emitted when the watermark has passed."""
    bad = events.where(~F.coalesce(ok, F.lit(False))).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counted = bad.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("failures"))
    return counted.where(F.col("failures") > more_than).select(F.col("w.start").alias("window_start"), key, "failures")


def window_sample(events: DataFrame, ts: str, row_id: str, k: int = 100, width: str = "1 hour", late: str = "1 hour", seed: int = 1, parts: int = 16) -> DataFrame:
    """window_start, draw, ``row_id`` (as text): of each window that the watermark has passed, in each of ``parts`` parts of its
    rows the ``k`` with the least MD5 draws; ``cut_sample`` makes of these the sample. State is k numbers and ids a part, so a
    window of many rows is no task's alone, and reruns agree."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    part = F.pmod(F.xxhash64(row_id), F.lit(parts)).alias("part")
    slim = timed.select("_ts", F.window("_ts", width)["start"].alias("w"), F.window("_ts", width)["end"].alias("e"), part, md5_draw(F.lit(seed), row_id).alias("draw"), F.col(row_id).cast("string").alias("id"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        draws, ids = state.get if state.exists else ([], [])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"window_start": [key[0]] * len(ids), "draw": draws, row_id: ids})
            return
        least, end = list(zip(draws, ids, strict=True)), None
        for b in batches:
            least = heapq.nsmallest(k, itertools.chain(least, zip(b["draw"].tolist(), b["id"].tolist(), strict=True)))
            end = b["e"].max()
        state.update(([d for d, _ in least], [i for _, i in least]))
        state.setTimeoutTimestamp(max(int(end.value // 1_000_000) - 1, state.getCurrentWatermarkMs() + 1))

    out, kept = f"window_start timestamp, draw long, {row_id} string", "draws array<long>, ids array<string>"
    return slim.groupBy("w", "part").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def cut_sample(found: DataFrame, row_id: str, k: int = 100) -> DataFrame:
    """window_start, ``row_id``: a uniform sample of ``k`` rows of each window, or all if it has fewer."""
    w = Window.partitionBy("window_start").orderBy("draw", row_id)
    return found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select("window_start", row_id)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now and read what it wrote. Batches are written whole under their number,
    so one that is run again replaces itself; column ``batch`` holds the number."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    sink: Callable[[DataFrame, int], None] = write
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.schema(f"{stream.schema.simpleString()[7:-1].replace(':', ' ')}, batch long").parquet(f"{base}/out")
