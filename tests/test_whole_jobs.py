"""Whole jobs: nothing that an earlier form of a query did is left out."""


def test_file_places_have_all_rules(spark):
    """Every bucket, domain and word of the rules that the query first had."""
    from pyspark.sql import functions as F

    from sparkloom.catalog_text import ALL_FILES
    from sparkloom.functions import text as tx

    names = {
        "x.jpeg": "Images", "x.avi": "Video", "x.flac": "Audio", "x.msi": "Software", "x.7z": "Archives", "x.dacpac": "Backups", "x.oxps": "Logs", "thesis.md": "Reading", "x.epub": "Reading",
        "clover.doc": "Work", "housing.epub": "Work", "residence.doc": "Work/Student", "wsdl.yaml": "Data/Integrations", "transformer.tsv": "Data/AI-ML", "log4shell.doc": "Work/Security", "sso.doc": "Work/Identity", "x.doc": None,
    }
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.place for r in rows.select("name", tx.file_place(F.col("name"), ALL_FILES).alias("place")).collect()} == names


def test_file_place_query_has_all_rules():
    from sparkloom.catalog import ORACLES

    assert all(f"'{x}'" in ORACLES["f11_file_place"] for x in ("webp", "appinstaller", "oxps", "xlsb", "jics", "springer", "positivepay", "candidacy", "AI-ML", "Integrations"))


def test_kept_sketches_without_a_frequent_value(spark, tmp_path):
    """So many values that the sketches of some columns surely know none to be frequent."""
    from pyspark.sql import functions as F

    from sparkloom.catalog_more import a5_kept_sketches

    k = F.col("id")
    cols = {"o_orderkey": k, "o_custkey": k % 9999, "o_orderstatus": F.lit("O"), "o_totalprice": k * 1.5, "o_orderdate": F.timestamp_seconds(k), "o_orderpriority": F.concat(F.lit("1-"), (k % 5).cast("string"))}
    spark.range(120_000).select(*[v.alias(c) for c, v in cols.items()]).write.parquet(f"{tmp_path}/orders.parquet")
    got = a5_kept_sketches(spark, str(tmp_path)).collect()
    assert len(got) == 6 and all(r.distinct_near and r.median_near and r.top_near for r in got)


def test_counts_of_context_pairs_equal_the_pairs(spark, monkeypatch):
    """Over several pieces, with lines of one word, none, null keys and words beyond ASCII."""
    from pyspark.sql import functions as F

    from sparkloom.operators import vectors

    rows = [(k if k else None, [[f"wörd{(k * j) % 7}" for j in range(k % 9)], [], ["one"], ["a", "b"] * (k % 5)]) for k in range(60)]
    lines = spark.createDataFrame(rows, "doc long, lines array<array<string>>")
    want = {(r.center, r.context): r.n for r in vectors.context_pairs(lines, "doc", 4, 3).groupBy("center", "context").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {(r.center, r.context): r.n for r in vectors.context_pair_counts(lines, "doc", 4, 3).collect()} == want and len(want) > 20


def test_phrases_of_rows_with_one_key(spark):
    """Texts that share an id, or have none, keep a row each; runs of pairs go two by two; equal texts too."""
    from sparkloom.operators import vectors

    rows = [(1, [["a", "b", "a", "b", "c"], [], ["b"]]), (1, [["c", "a", "b"]]), (None, [["a", "b"]]), (2, [["a", "b"]]), (2, [["a", "b"]]), (3, [["a"], ["b"]]), (4, [[]])]
    lines = spark.createDataFrame(rows, "doc long, lines array<array<string>>")
    pairs = spark.createDataFrame([("a", "b", 9.0), ("b", "a", 9.0)], "word string, next string, score double")
    got = sorted(((r.doc, r.lines) for r in vectors.join_phrases(lines, "doc", pairs).collect()), key=str)
    want = [(1, [["a_b", "a_b", "c"], ["b"]]), (1, [["c", "a_b"]]), (None, [["a_b"]]), (2, [["a_b"]]), (2, [["a_b"]]), (3, [["a"], ["b"]])]
    assert got == sorted(want, key=str)


def test_unique_columns_equal_the_profile(spark):
    from sparkloom.operators import profile as pf

    rows = [(k, k // 2, None if k == 7 else k, "a-b" if k % 2 else f"{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, twice long, hole long, `a.text` string")
    for some in (df, df.limit(0), df.where("id = 7")):
        plain = some.withColumnRenamed("a.text", "text")
        want = {r.column: r.is_unique for r in pf.profile(plain).collect()}
        assert {r.column: r.is_unique for r in pf.unique_columns(plain).collect()} == want


def test_remainders_and_shapes_of_any_length(spark):
    """Digests of up to 64 digits; values longer than the digits that replace theirs."""
    from pyspark.sql import functions as F

    from sparkloom.operators import pii

    digest = "f" * 40 + "0123456789abcdef01234567"
    got = spark.range(1).select(pii.modulo(F.lit(digest), 36_500).alias("a"), pii.modulo(F.lit(digest[:15]), 97).alias("b"), pii.keep_shape(F.lit("7-" * 70), F.lit(digest)).alias("c"), pii.digits(F.lit(digest), 64).alias("d")).first()
    assert (got.a, got.b) == (int(digest, 16) % 36_500, int(digest[:15], 16) % 97)
    assert got.c == "".join("-" if k % 2 else got.d[k % 64] for k in range(140))


def test_only_values_of_heavy_keys_are_broadcast(spark):
    """Spark knows nothing of how many rows an explode makes, and took the exploded rows of a small table for small."""
    from pyspark.sql import functions as F

    from sparkloom.llm import common, simhash
    from sparkloom.operators import spread

    distinct = common.written(spark.range(2000).select((F.col("id") * 7919).alias("fp")), "fps")
    plan = simhash.links(distinct)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 2 and "SortMergeJoin" in plan
    rows = distinct.select("fp", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("k"))
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("fp").alias("s"))
    for how in (common.join_counted, spread.join_counted):
        got = how(rows, counted, ["k"], "n", 100_000_000)
        assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 2
        assert got.count() == 100_000 and got.select("s").distinct().count() == 1


def test_kept_sketches_move_no_values_to_their_column(spark, sf_dir):
    """There are few columns, so a join by column would hold all values of one in a task; also where Spark broadcasts nothing by its size."""
    from sparkloom.catalog_more import a5_kept_sketches

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a5_kept_sketches(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Expand" in plan and "BroadcastHashJoin" in plan


def test_context_pairs_move_a_row_a_center(spark):
    """Not a row a pair; also a center whose contexts are all words."""
    from pyspark.sql import functions as F

    from sparkloom.operators import vectors

    rows = [(k, [["all", f"w{k % 50}", "all", f"v{k % 40}"], [f"w{k % 7}"]]) for k in range(400)]
    lines = spark.createDataFrame(rows, "doc long, lines array<array<string>>")
    got = vectors.context_pair_counts(lines, "doc", 3, 1)
    moved = [x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
    assert len(moved) == 1 and "context" not in moved[0]
    want = vectors.context_pairs(lines, "doc", 3, 1).groupBy("center", "context").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert vectors.context_pair_counts(lines.limit(0), "doc").count() == 0


def test_texts_stay_while_phrases_are_few(spark, monkeypatch):
    """No text moves; the same lines as by the shuffle that many pairs need."""
    from sparkloom.operators import vectors

    words = ["a", "b", "é", "a_b", "'"]
    rows = [(k, [[words[(k * j + j * j) % 5] for j in range(k % 11)], [], [words[k % 5]]]) for k in range(200)]
    lines = spark.createDataFrame(rows, "doc long, lines array<array<string>>")
    pairs = spark.createDataFrame([("a", "b", 9.0), ("b", "é", 9.0), ("é", "é", 9.0), ("a_b", "'", 9.0)], "word string, next string, score double")
    few = vectors.join_phrases(lines, "doc", pairs)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(vectors, "FEW", 0)
    many = vectors.join_phrases(lines, "doc", pairs)
    assert "Exchange" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 200
    assert vectors.join_phrases(lines, "doc", pairs.limit(0)).count() == 200
