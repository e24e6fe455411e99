"""Versioned tables: replace, partial replace, groups, lost and competing writers."""

import pytest
from pyspark.sql import functions as F

from sparkloom.plans.versions import CONDITIONS, Conflict, Version, VersionedTable

SCHEMA = "id int, g string, v double"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_replace_and_skip(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    a = rows(spark, (1, "x", 1.0), (2, None, None))
    assert table.load(a) == {"version": 1, "changed": True, "num_rows": 2}
    assert table.load(a.select("v", "id", "g")) == {"version": 1, "changed": False, "num_rows": 2}
    old = table.read()
    assert table.load(rows(spark, (3, "y", 2.0)))["version"] == 2
    assert ids(old) == ids(table.read(1)) == [1, 2] and ids(table.read()) == [3] and ids(table.read(0)) == []
    assert table.load(a.limit(0)) == {"version": 3, "changed": True, "num_rows": 0} and ids(table.read()) == []


def test_partial_replace(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.load(rows(spark, (1, "x", 1.0), (2, "y", 1.0), (3, None, 1.0)))
    source = rows(spark, (4, "x", 1.0), (5, "y", 1.0))
    assert table.load(source, "g = 'x'") == {"version": 2, "changed": True, "num_rows": 1}
    assert ids(table.read()) == [2, 3, 4]  # rows of which the condition is null stay
    for k in range(CONDITIONS + 2):
        table.load(rows(spark, (10 + k, "x", float(k))), "g = 'x'")
    assert ids(table.read()) == [2, 3, 11 + CONDITIONS]
    assert max(len(p["without"]) for p in table.version().parts) <= CONDITIONS


def test_changed_groups_only(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    first = rows(spark, (1, "x", 1.0), (2, "y", 1.0), (3, None, 1.0), (4, "gone", 1.0), (5, "a/b=c", 1.0))
    assert table.load_groups(first, "g")["changed"] == 5
    before = {p["group"]: p["folder"] for p in table.version().parts}
    second = rows(spark, (1, "x", 1.0), (2, "y", 2.0), (3, None, 1.0), (5, "a/b=c", 1.0), (6, "new", 1.0))
    assert table.load_groups(second, "g") == {"version": 2, "changed": 3, "num_rows": 2}
    after = {p["group"]: p["folder"] for p in table.version().parts}
    assert sum(before.get(g) == f for g, f in after.items()) == 3 and len(after) == 5
    assert {tuple(r) for r in table.read().collect()} == {tuple(r) for r in second.collect()}
    assert table.load_groups(second, "g")["changed"] == 0
    with pytest.raises(ValueError, match="kept by"):
        table.load_groups(second, "id")


def test_a_writer_that_fails_midway(spark, tmp_path):
    """The old version stays, the next load gives whole rows, and the lost folder is swept."""
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.load(rows(spark, (1, "x", 1.0)))
    held = table.read()

    @F.udf("double")
    def fails(k):
        if k == 90:
            raise RuntimeError("lost")
        return float(k)

    source = spark.range(100).repartition(10).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("g"), fails("id").alias("v"))
    with pytest.raises(Exception, match="lost"):
        table.commit(Version(2, table.version().schema, None, table.stage(source, table.version())))
    assert ids(held) == ids(table.read()) == [1] and table.numbers() == [0, 1]
    folders = {p.name for p in (tmp_path / "t/data").iterdir()}
    assert len(folders) == 2  # the old one and what the lost writer left
    good = source.select("id", "g", F.col("id").cast("double").alias("v"))
    assert table.load(good) == {"version": 2, "changed": True, "num_rows": 100}
    assert table.sweep() == []  # it may be another writer's
    named = {p["folder"] for n in table.numbers() for p in table.version(n).parts}
    assert set(table.sweep(older_than_s=0)) == folders - named and ids(held) == [1] and len(ids(table.read())) == 100
    assert table.sweep(keep=1, older_than_s=0) and table.numbers() == [2] and len(ids(table.read())) == 100


def test_two_writers(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    table.load(rows(spark, (1, "x", 1.0)))
    now = table.version()
    mine, other = table.stage(rows(spark, (2, "x", 1.0)), now), table.stage(rows(spark, (3, "x", 1.0)), now)
    table.commit(Version(2, now.schema, None, other))
    with pytest.raises(Conflict):
        table.commit(Version(2, now.schema, None, mine))
    assert ids(table.read()) == [3] and not list((tmp_path / "t/log").glob("draft-*"))
