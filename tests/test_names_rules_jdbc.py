"""Unique names, rule tables and a database source against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import names
from sparkloom.operators.rules import Rule, validate_sheet
from sparkloom.plans import security
from sparkloom.sources import jdbc


def test_object_names(spark):
    cases = {"a!": "a", "!!": "obj", "_a__b_": "a_b", " 1 x": "1_x", "é": "obj", "a-b c": "a_b_c", "": "obj"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", names.object_name(F.col("t")).alias("n"), names.bracketed(F.lit("a]b")).alias("b"), names.literal(F.lit("it's")).alias("l"))
    rows = df.collect()
    assert {r.t: r.n for r in rows} == cases and rows[0].b == "[a]]b]" and rows[0].l == "'it''s'"


@pytest.mark.parametrize("long_group", [10, 10**9])
def test_unique_names_equal_the_loop(spark, long_group):
    """Row by row, with bases that are others' numbered names, and names in use."""
    for seed in range(3):
        rng = random.Random(seed)
        bases = rng.choices(["x", "x", "x_2", "x_3", "x_2_2", "y", "y" * 20, "z"], k=120)
        used = {"x_5", "y", "y_4", "x_2_3"}
        taken, want = set(used), []
        for b in bases:
            b, k = b[:12], 1
            while (name := b if k == 1 else f"{b[: 12 - 1 - len(str(k))]}_{k}") in taken:
                k += 1
            taken.add(name)
            want.append(name)
        df = spark.createDataFrame(list(enumerate(bases)), "i int, b string").repartition(4)
        got = names.unique_names(df, "b", "i", spark.createDataFrame([(u,) for u in used], "name string"), 12, long_group)
        assert [r.name for r in sorted(got.collect(), key=lambda r: r.i)] == want


def test_unique_names_of_no_rows(spark):
    assert names.unique_names(spark.createDataFrame([], "i int, b string"), "b", "i").count() == 0


def test_each_kind_of_rule(spark):
    rules = [
        Rule("default", "a", "A"), Rule("upper", "a"), Rule("yes_no", "w", "false"), Rule("required", "b", reason="no b"), Rule("one_of", "a", "A|B", "a?"), Rule("required_if", "c", "a=B", "no c"), Rule("whole", "n", reason="n?"),
        Rule("longest", "b", "3", "long"), Rule("known", "b", "t", "b?"), Rule("repair", "c", "c1|c0", "c is c0"), Rule("clear", "w", "a=B", "no w"), Rule("forget", "n", "a<>A"),
    ]
    rows = [
        (1, None, "x", None, "1", " Yes "), (2, "b", "x", "c1", "2", "1"), (3, "b", "x", " ", "3", ""), (4, "z", "x", "", "4", ""), (5, "a", " ", "", "", ""), (6, "a", "x", "c1", "n", ""), (7, "a", "xxxx", "", "7", ""),
        (8, "a", "q", "", "8", ""), (9, "A", "X ", "c1", "9", "t"), (9, "A", "x", "c1", "9", "t"),
    ]
    good, bad = validate_sheet(spark.createDataFrame(rows, "i int, a string, b string, c string, n string, w string"), rules, ["a", "b", "c"], "i", {"t": spark.createDataFrame([("x",), ("X",), ("x",)], "b string")})
    assert sorted((r.i, r.a, r.b, r.c, r.n, r.w, tuple(r.repairs)) for r in good.collect())[:2] == [(1, "A", "x", "c0", "1", True, ("c is c0",)), (2, "B", "x", "c1", None, False, ("no w",))]
    assert good.count() == 3 and sorted((r.i, r.reason) for r in bad.collect()) == [(3, "no c"), (4, "a?"), (5, "no b"), (6, "n?"), (7, "long"), (8, "b?"), (9, "duplicate")]
    with pytest.raises(ValueError, match="no rule of kind"):
        validate_sheet(good, [Rule("fly", "a")], ["a"], "i")


def test_sheets(spark):
    cols = ["LoginName", "LoginType", "PasswordMode", "Password", "PasswordHash"]
    rows = [("a", "sql", "", "pw", ""), ("b", "SQL", "hashed", "", ""), ("c", "windows", "", "", ""), ("d", "x", "", "", ""), ("A ", "sql", "plain", "z", ""), ("e", "SQL", "odd", "", "")]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in cols))
    good, bad = security.validate(df, "Logins", "i")
    assert sorted((r.LoginName, r.PasswordMode, r.Password) for r in good.collect()) == [("a", "PLAIN", "pw"), ("c", None, None)]
    assert sorted((r.i, r.reason) for r in bad.collect()) == [(1, "no hash"), (3, "kind unknown"), (4, "duplicate"), (5, "password mode unknown")]
    ends = spark.createDataFrame([(1, "e", "database_mirroring", "5022", "broken", "", "", "des", "", ""), (2, "f", "tsql", "1", "", "", "", "", "", ""), (3, "g", "DATABASE_MIRRORING", "x", "", "", "", "", "", "")],
        "i int, EndpointName string, EndpointType string, Port string, State string, Role string, Encryption string, Algorithm string, Authentication string, OwnerLogin string")
    good, bad = security.validate(ends, "Endpoints", "i")
    assert [(r.State, r.Role, r.Algorithm, r.OwnerLogin, r.repairs) for r in good.collect()] == [("STARTED", "ALL", "AES", "sa", ["state taken as STARTED", "algorithm taken as AES"])]
    assert sorted((r.i, r.reason) for r in bad.collect()) == [(2, "kind unknown"), (3, "port is no number")]
    with pytest.raises(ValueError, match="lacks"):
        security.validate(ends.drop("Port"), "Endpoints", "i")


@pytest.fixture(scope="module")
def database(spark):
    """A skewed column with nulls."""
    url = "jdbc:derby:memory:tests;create=true"
    rng = random.Random(1)
    rows = [(k, None if k % 17 == 0 else rng.choice([rng.random() * 10, 1e6 * rng.random() ** 8]), rng.choice("xy")) for k in range(2000)]
    jdbc.write_jdbc(spark.createDataFrame(rows, "id int, v double, g string").coalesce(2), url, "t", driver=jdbc.DERBY, createTableColumnTypes="g VARCHAR(8)")
    jdbc.write_jdbc(spark.createDataFrame([(k, 7, None) for k in range(5)], "id int, v int, w int").coalesce(1), url, "same", driver=jdbc.DERBY)
    return url, rows


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_ranges_of_a_database_table(spark, database, parts):
    url, rows = database
    read = jdbc.read_jdbc(spark, url, "t", None, '"v"', parts, driver=jdbc.DERBY)
    assert sorted(map(tuple, read.collect()), key=lambda r: r[0]) == rows  # every row once, nulls too
    by_value = jdbc.read_jdbc(spark, url, "t", None, '"id"', parts, driver=jdbc.DERBY)
    sizes = [r.n for r in by_value.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) <= 2000 / parts * 1.3 and sum(sizes) == 2000


def test_conditions_go_to_the_database(spark, database):
    url, rows = database
    read = jdbc.read_jdbc(spark, url, "t", "\"g\" = 'x'", '"v"', 4, driver=jdbc.DERBY).where("id > 1000")
    assert sorted(r.id for r in read.collect()) == [r[0] for r in rows if r[2] == "x" and r[0] > 1000]
    plan = read._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThan(id,1000)" in plan and "PushedFilters" in plan
    assert jdbc.read_jdbc(spark, url, "same", None, '"v"', 4, driver=jdbc.DERBY).count() == jdbc.read_jdbc(spark, url, "same", None, '"w"', 4, driver=jdbc.DERBY).count() == 5
    assert jdbc.read_jdbc(spark, url, "same", "\"v\" > 9", '"v"', 4, driver=jdbc.DERBY).count() == 0 and jdbc.read_jdbc(spark, url, "same", driver=jdbc.DERBY).count() == 5
