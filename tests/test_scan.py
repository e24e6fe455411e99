"""Segmented scans and pieces of text: one long group over many ranges equals the window."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import pieces, sequence
from sparkloom.operators.scan import KINDS, Ordered


@pytest.fixture(scope="module")
def table(spark):
    """A hot group, one of nulls, and small ones; null values and null places."""
    rng = random.Random(6)
    groups = ["hot"] * 8 + [None, "a", "b"]
    data = [(rng.choice(groups), None if k == 3 else k, rng.choice([None, *range(50)]), rng.random()) for k in range(3000)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "g string, k int, v int, x double").repartition(6).cache()


@pytest.mark.parametrize("by", [["g"], []])
def test_scan_equals_the_window(spark, table, by):
    measures = {kind: (kind, F.col("v")) for kind in KINDS}
    cut = Ordered(table, by, ["k"], long_group=100)
    assert cut.cut and cut.rows.where("g = 'hot'").select("_range").distinct().count() > 15
    plain = Ordered(table, by, ["k"])
    assert not plain.cut
    names = ["g", "k", *KINDS]
    assert sorted(cut.add(**measures).done().select(names).collect(), key=str) == sorted(plain.add(**measures).done().select(names).collect(), key=str)
    w = Window.partitionBy(*by).orderBy("k")
    want = table.select("k", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.lag("v").over(w).alias("l"))
    assert sorted(cut.add(s=("sum", F.col("v")), l=("lag", F.col("v"))).done().select("k", "s", "l").collect(), key=str) == sorted(want.collect(), key=str)


def test_operators_on_long_groups(table):
    """Each operator gives the same rows whether its groups are cut or not."""
    t = table.where("k is not null and v is not null")
    runs = [
        lambda n: sequence.pack_rows(t, ["g"], ["k"], "v", n), lambda n: sequence.find_peaks(t, ["g"], "k", "v", True, n),
        lambda n: sequence.pace(t, ["g"], "k", "v", 5, None, n), lambda n: sequence.running_offset(t, ["g"], "k", 1.0, 2.0, 1, n).withColumn("offset", F.round("offset", 6)),
        lambda n: sequence.segments(t.withColumn("r", F.col("k") + F.col("v") % 3), ["g"], "k", "r", F.col("k") + 9, False, 0.0, 0.0, n),
    ]
    for run in runs:
        assert sorted(map(str, run(50).collect())) == sorted(map(str, run(10**9).collect()))


def test_minmax_flags_with_nulls(spark):
    rows = [("a", 1), ("a", 3), ("a", 3), (None, 5), (None, 2), ("", 7), ("", None)]
    got = sorted(map(str, sequence.minmax_flags(spark.createDataFrame(rows, "g string, v int"), ["g"], "v").select("g", "v", "minmax").collect()))
    want = [("a", 1, "m"), ("a", 3, "M"), ("a", 3, "M"), (None, 5, "M"), (None, 2, "m"), ("", 7, "M"), ("", None, "")]
    assert got == sorted(f"Row(g={g!r}, v={v}, minmax={f!r})" for g, v, f in want)


@pytest.mark.parametrize(("most", "long_group"), [(7, 10), (1, 10), (50, 10**9), (10**6, 10)])
def test_text_pieces(spark, most, long_group):
    rng = random.Random(most)
    rows = [(rng.choice(["hot", "hot", None, "b"]), k, rng.choice([None, "", "é", "words 漢字", "x" * 120])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k int, v string").repartition(5)
    got = {}
    for r in pieces.text_pieces(df, ["g"], F.col("v"), ["k"], "; ", "<", ">", most, long_group).orderBy("piece").collect():
        assert 0 < len(r.text) <= most and r.piece == len(got.setdefault(r.g, []))
        assert not got[r.g] or len(got[r.g][-1]) == most
        got[r.g].append(r.text)
    want = {g: "<" + "; ".join(v for h, _, v in rows if h == g and v is not None) + ">" for g in ("hot", None, "b")}
    assert {g: "".join(p) for g, p in got.items()} == want


def test_texts_as_files(spark, tmp_path):
    rows = [(g, k, f"{g}{k}\n") for g in ("hot", "b") for k in range(200 if g == "hot" else 3)]
    pieces.write_texts(spark.createDataFrame(rows, "g string, k int, v string").repartition(4), "g", "v", ["k"], str(tmp_path / "t"), "|", 6)
    for g in ("hot", "b"):
        files = sorted((tmp_path / "t" / f"g={g}").glob("part-*"))
        assert "".join(f.read_text() for f in files) == "".join(f"{v}|" for h, _, v in rows if h == g)
    assert len(list((tmp_path / "t/g=hot").glob("part-*"))) > 1
    assert pieces.read_texts(spark, str(tmp_path / "t"), "|").count() == len(rows)
