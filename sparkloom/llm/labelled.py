"""Labelled rows to learn from, and the fit of scores to probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import written


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled documents outside the held-out fold, picked by a hash.

    A document with several labels counts as 1 if any is; rows without id or label are left out. Only
    the ids of the sample, a bounded number, are sent to the executors."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).where(~is_held_out(folds, held_out))
    picked = written(known.orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(most), f"labelled-{label}")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id")


def is_held_out(folds: int, held_out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % folds == held_out


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float, float, float]:
    """mean, scale, slope and intercept of p = 1 / (1 + exp(-(slope * (x - mean) / scale + intercept)))."""
    if len(x) == 0:
        return 0.0, 1.0, 0.0, 0.0
    mean, scale = float(np.mean(x)), float(np.std(x)) or 1.0
    design, w = np.column_stack([(x - mean) / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (p - y) + ridge * w
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, float(w[0]), float(w[1])


def logistic(x: np.ndarray, fit: tuple[float, float, float, float]) -> np.ndarray:
    mean, scale, slope, intercept = fit
    return 1 / (1 + np.exp(-np.clip(slope * (x - mean) / scale + intercept, -30, 30)))


def rising_fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing step function nearest to y, for np.interp; equal x are one, then neighbours that fall are pooled."""
    each, place = np.unique(x, return_inverse=True)
    pools: list[list[float]] = []
    for a, b, m in zip(each.tolist(), np.bincount(place, y, len(each)).tolist(), np.bincount(place, minlength=len(each)).tolist(), strict=True):
        pools.append([b, m, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, z = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], z]
    at = [p for _, _, a, z in pools for p in (a, z)]
    value = [s / n for s, n, _, _ in pools for _ in range(2)]
    return np.array(at), np.array(value)
