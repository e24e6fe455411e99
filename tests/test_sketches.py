"""Kept sketches: merged in any order they stay within their bounds of the exact profile."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import sketches as sk


def test_appends_stay_within_bounds(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([None, *(["hot"] * 5), f"v{k}"]), round(rng.gauss(0, 10), 3), None) for k in range(20_000)]
    df = spark.createDataFrame(rows, "id long, s string, x double, n int")
    parts = [df.where(F.col("id") % 4 == k) for k in range(4)]
    kept = sk.sketched(parts[0])
    for p in parts[1:]:  # an append at a time
        kept = sk.merged(kept.unionByName(sk.sketched(p)))
    got = {r.column: r for r in sk.estimated(kept).collect()}
    whole = {r.column: r for r in sk.estimated(sk.sketched(df)).collect()}
    for c, exact in (("id", 20_000), ("s", len({r[1] for r in rows} - {None})), ("x", len({r[2] for r in rows})), ("n", 0)):
        assert abs(got[c].distinct_values - exact) <= 0.05 * exact and got[c].rows == 20_000
        assert (got[c].missing, got[c].min_value, got[c].max_value) == (whole[c].missing, whole[c].min_value, whole[c].max_value)
    xs = sorted(r[2] for r in rows)
    for q, v in zip((0.25, 0.5, 0.75), got["x"].quantiles, strict=True):
        assert abs(sum(x <= v for x in xs) / len(xs) - q) < 0.01
    hot = sum(r[1] == "hot" for r in rows)
    assert got["s"].top_values[0].value == "hot" and abs(got["s"].top_values[0].n - hot) <= got["s"].top_error
    assert got["s"].quantiles is None and got["n"].quantiles is None and got["n"].top_values == []


def test_no_rows(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert sk.sketched(df).count() == 0
    some = sk.sketched(spark.createDataFrame([("x", 1.0)], "a string, b double"))
    assert {r.column: r.rows for r in sk.estimated(sk.merged(sk.sketched(df).unionByName(some))).collect()} == {"a": 1, "b": 1}
