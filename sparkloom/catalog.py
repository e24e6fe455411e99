"""All queries of the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import aggregate as ag
from sparkloom.operators import diff as df_
from sparkloom.operators import rows as rw
from sparkloom.operators import sequence as sq
from sparkloom.operators.scan import Ordered
from sparkloom.plans import ingest as ing
from sparkloom.shared import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- two versions of orders -------------------------------------------------------------------------------------


def orders_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    prev = t(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    kept = prev.where(key % 97 != 0).withColumns({
        "o_orderstatus": F.when(key % 89 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority": F.when(key % 83 != 0, F.col("o_orderpriority")),
    })
    return prev, kept.unionByName(prev.where(key % 101 == 0).withColumn("o_orderkey", key + 10_000_000))


ORDERS = """WITH curr AS (
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate,
        CASE WHEN o_orderkey % 83 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0
    UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 101 = 0),
texts AS (SELECT 'p' AS side, o_orderkey AS k, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_totalprice::DECIMAL(38,4)::VARCHAR AS o_totalprice,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders
    UNION ALL SELECT 'c', o_orderkey, o_custkey::VARCHAR, o_orderstatus, o_totalprice::DECIMAL(38,4)::VARCHAR,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderpriority FROM curr),
p AS (SELECT * FROM texts WHERE side = 'p'), c AS (SELECT * FROM texts WHERE side = 'c'),
b AS (SELECT coalesce(c.k, p.k) AS o_orderkey, CASE WHEN p.k IS NULL THEN 'Added' WHEN c.k IS NULL THEN 'Deleted' ELSE 'Changed' END AS change_type,
    p.o_custkey AS p1, c.o_custkey AS c1, p.o_orderstatus AS p2, c.o_orderstatus AS c2, p.o_totalprice AS p3, c.o_totalprice AS c3,
    p.o_orderdate AS p4, c.o_orderdate AS c4, p.o_orderpriority AS p5, c.o_orderpriority AS c5 FROM p FULL JOIN c ON p.k = c.k)
"""
CELLS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
WIDE = ", ".join(f"CASE WHEN p{i} IS DISTINCT FROM c{i} THEN coalesce(p{i}, 'NULL') || ' <--> ' || coalesce(c{i}, 'NULL') ELSE '' END AS {c}" for i, c in enumerate(CELLS, 1))
UNLIKE = " OR ".join(f"p{i} IS DISTINCT FROM c{i}" for i in range(1, 6))
LIST = " UNION ALL ".join(
    f"SELECT o_orderkey, change_type, '{c}' AS changed_column, coalesce(p{i}, 'NULL') AS previous_value, coalesce(c{i}, 'NULL') AS current_value FROM b WHERE p{i} IS DISTINCT FROM c{i}"
    for i, c in enumerate(CELLS, 1)
)


@query(f"{ORDERS} SELECT o_orderkey, change_type, {WIDE} FROM b WHERE change_type <> 'Changed' OR {UNLIKE}")
def j3_diff_wide(spark, sf_dir):
    return df_.diff_wide(*orders_pair(spark, sf_dir), ["o_orderkey"])


@query(f"{ORDERS} {LIST}")
def j4_diff_list(spark, sf_dir):
    return df_.diff_list(*orders_pair(spark, sf_dir), ["o_orderkey"])


@query(f"""{ORDERS} SELECT count(*) AS total_keys, count(*) FILTER (change_type = 'Added') AS added, count(*) FILTER (change_type = 'Deleted') AS deleted,
    count(*) FILTER (change_type = 'Changed' AND ({UNLIKE})) AS changed, (SELECT count(*) FROM ({LIST})) AS cell_diffs,
    count(*) FILTER (change_type = 'Changed' AND NOT ({UNLIKE})) AS unchanged FROM b""")
def j5_diff_summary(spark, sf_dir):
    return df_.diff_summary(*orders_pair(spark, sf_dir), ["o_orderkey"])


@query(f"{ORDERS} SELECT * FROM ({LIST}) WHERE o_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def j6_diff_restricted(spark, sf_dir):
    prev, curr = orders_pair(spark, sf_dir)
    return df_.diff_list(prev, curr, ["o_orderkey"], prev.where("o_totalprice > 200000"))


@query("""WITH k AS (SELECT o_orderkey FROM orders UNION SELECT o_orderkey + 10000000 FROM orders WHERE o_orderkey % 101 = 0) SELECT count(*) AS total_keys FROM k""")
def a18_union_key_count(spark, sf_dir):
    return df_.union_key_count(*orders_pair(spark, sf_dir), ["o_orderkey"])


HASHED = """('0x' || substr(md5(concat_ws('|', coalesce('v' || o_orderkey::VARCHAR, 'n'), coalesce('v' || o_custkey::VARCHAR, 'n'), coalesce('v' || o_orderstatus, 'n'),
    coalesce('v' || o_totalprice::DECIMAL(38,4)::VARCHAR, 'n'), coalesce('v' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), 'n'), coalesce('v' || o_orderpriority, 'n'))), 1, 15))::BIGINT"""
PRINT = f"count(*) AS num_rows, bit_xor({HASHED}) AS checksum_xor, sum({HASHED})::DECIMAL(38,0) AS checksum_sum"


@query(f"SELECT {PRINT} FROM orders")
def a1_fingerprint(spark, sf_dir):
    return df_.fingerprint(t(spark, sf_dir, "orders"))


@query(f"""{ORDERS}, f AS (SELECT {PRINT} FROM orders), g AS (SELECT {PRINT} FROM curr)
    SELECT f.num_rows AS a_num_rows, f.checksum_xor AS a_checksum_xor, f.checksum_sum AS a_checksum_sum, g.num_rows AS b_num_rows, g.checksum_xor AS b_checksum_xor,
    g.checksum_sum AS b_checksum_sum, f.num_rows = g.num_rows AND f.checksum_xor = g.checksum_xor AND f.checksum_sum = g.checksum_sum AS is_matching FROM f, g""")
def a2_fingerprints_match(spark, sf_dir):
    return df_.fingerprints_match(*orders_pair(spark, sf_dir))


@query(f"""{ORDERS}, f AS (SELECT o_orderstatus AS s, {PRINT} FROM orders GROUP BY 1), g AS (SELECT o_orderstatus AS s, {PRINT} FROM curr GROUP BY 1)
    SELECT coalesce(f.s, g.s) AS o_orderstatus, f.num_rows IS NOT DISTINCT FROM g.num_rows AND f.checksum_xor IS NOT DISTINCT FROM g.checksum_xor
    AND f.checksum_sum IS NOT DISTINCT FROM g.checksum_sum AS is_matching FROM f FULL JOIN g ON f.s = g.s""")
def a3_fingerprint_by_group(spark, sf_dir):
    return df_.fingerprints_match(*orders_pair(spark, sf_dir), "o_orderstatus").select("o_orderstatus", "is_matching")


@query("SELECT DISTINCT o_orderpriority FROM orders")
def a4_group_list(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority")


# --- desired and actual customers -------------------------------------------------------------------------------


def customers_pair(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.where(k % 13 != 0), c.where(k % 11 != 0).withColumn("c_mktsegment", F.when(k % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment")))


CUSTOMERS = """WITH d AS (SELECT * FROM customer WHERE c_custkey % 13 <> 0),
a AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 11 <> 0)"""
RECONCILED = f"""{CUSTOMERS}, r AS (SELECT c_custkey, 'MISSING' AS mismatch_type, NULL::VARCHAR AS property, NULL::VARCHAR AS desired_value, NULL::VARCHAR AS actual_value FROM d WHERE c_custkey NOT IN (SELECT c_custkey FROM a)
    UNION ALL SELECT c_custkey, 'EXTRA', NULL, NULL, NULL FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM d)
    UNION ALL SELECT c_custkey, 'PROPERTY', 'c_mktsegment', coalesce(d.c_mktsegment, ''), coalesce(a.c_mktsegment, '') FROM d JOIN a USING (c_custkey) WHERE coalesce(d.c_mktsegment, '') <> coalesce(a.c_mktsegment, ''))"""


@query(f"{RECONCILED} SELECT * FROM r")
def j7_j8_reconcile(spark, sf_dir):
    return df_.reconcile(*customers_pair(spark, sf_dir), ["c_custkey"], ["c_mktsegment", "c_name"])


@query(f"""{RECONCILED} SELECT *, CASE mismatch_type WHEN 'MISSING' THEN 'ADD ' || c_custkey WHEN 'EXTRA' THEN 'DROP ' || c_custkey
    ELSE 'ALTER ' || c_custkey || ' SET ' || property || ' = ' || desired_value END AS command FROM r""")
def l17_remediation(spark, sf_dir):
    found = df_.reconcile(*customers_pair(spark, sf_dir), ["c_custkey"], ["c_mktsegment"])
    return df_.remediation(found, {"MISSING": "ADD {c_custkey}", "EXTRA": "DROP {c_custkey}", "PROPERTY": "ALTER {c_custkey} SET {property} = {desired_value}"})


@query(f"""{CUSTOMERS} SELECT coalesce(d.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'a' WHEN d.c_custkey IS NULL THEN 'b' ELSE 'both' END AS side
    FROM d FULL JOIN a ON d.c_custkey = a.c_custkey""")
def j2_intersect3(spark, sf_dir):
    parts = df_.intersect3(*customers_pair(spark, sf_dir), ["c_custkey"])
    a, both, b = (p.select("c_custkey", F.lit(s).alias("side")) for p, s in zip(parts, ("a", "both", "b"), strict=True))
    return a.unionByName(both).unionByName(b)


@query(f"""{CUSTOMERS} SELECT coalesce(d.c_custkey, a.c_custkey) AS c_custkey, coalesce(d.c_name, a.c_name) AS c_name, coalesce(d.c_nationkey, a.c_nationkey) AS c_nationkey,
    coalesce(d.c_acctbal, a.c_acctbal) AS c_acctbal, CASE WHEN a.c_custkey IS NOT NULL THEN a.c_mktsegment ELSE d.c_mktsegment END AS c_mktsegment FROM d FULL JOIN a ON d.c_custkey = a.c_custkey""")
def l13_upsert(spark, sf_dir):
    return df_.upsert(*customers_pair(spark, sf_dir), ["c_custkey"], ["c_mktsegment"])


@query("""SELECT DISTINCT n.n_nationkey, s.seg FROM nation n, (SELECT DISTINCT c_mktsegment AS seg FROM customer) s
    EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 5000""")
def j9_missing_from_product(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    current = c.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("seg"))
    return df_.missing_from_product(t(spark, sf_dir, "nation"), c.select(F.col("c_mktsegment").alias("seg")).distinct(), current, ["n_nationkey", "seg"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j10_without_partner(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return t(spark, sf_dir, "customer").join(o, F.col("c_custkey") == o["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query("SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j1_hash_join(spark, sf_dir):
    o, c, n, r = (t(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"])  # small: Spark broadcasts what it measures to be so
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(places, c["c_nationkey"] == places["n_nationkey"]).select("o_orderkey", "n_name", "r_name")


@query("""SELECT c_custkey, o.o_orderkey AS last_order, o.o_orderdate AS last_date FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
    max(o_orderdate) AS o_orderdate FROM orders GROUP BY o_custkey) o ON c_custkey = o.o_custkey""")
def j11_latest_per_key(spark, sf_dir):
    last = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_order"), F.max("o_orderdate").alias("last_date"))
    return t(spark, sf_dir, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "last_order", "last_date")


@query("SELECT c_custkey, c_acctbal > 0 AS accepted FROM customer")
def p1_split_filter(spark, sf_dir):
    yes, no = rw.split_filter(t(spark, sf_dir, "customer"), F.col("c_acctbal") > 0)
    return yes.select("c_custkey", F.lit(True).alias("accepted")).unionByName(no.select("c_custkey", F.lit(False).alias("accepted")))


@query("""SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS port, count(*) AS n FROM orders GROUP BY 1, 2""")
def p3_route(spark, sf_dir):
    return rw.route(t(spark, sf_dir, "orders"), "o_orderstatus", {"F": "finished", "O": "open"}, "other").groupBy("o_orderpriority", "port").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'inactive' END AS status, CASE WHEN o_orderpriority = 'default' THEN 'x' ELSE o_orderpriority END AS arg FROM orders""")
def p5_p6_override_and_coerce(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", rw.coerce_status(F.col("o_orderstatus"), ["F", "O"]).alias("status"), rw.override(F.col("o_orderpriority"), F.lit("x")).alias("arg"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS ymd, year(o_orderdate) AS year, strftime(o_orderdate, '%m') AS month2, strftime(o_orderdate, '%d') AS day2,
    (dayofweek(o_orderdate) + 1) || '-' || dayname(o_orderdate) AS weekday FROM orders""")
def p7_date_parts(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(k) for k, c in tx.date_parts(F.col("o_orderdate")).items()])


@query("""WITH r AS (SELECT *, CASE WHEN p_retailprice IS NULL OR p_retailprice <= 0 THEN 'price' WHEN p_size < 5 THEN 'size' END AS reason FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY reason IS NOT NULL, lower(p_brand), lower(p_type), p_size ORDER BY p_partkey) AS n FROM r)
    SELECT p_partkey, CASE WHEN reason IS NULL AND n > 1 THEN 'duplicate' ELSE reason END AS reason FROM n""")
def q1_validate_rows(spark, sf_dir):
    good, bad = rw.validate_rows(t(spark, sf_dir, "part"), [("price", F.col("p_retailprice") > 0), ("size", F.col("p_size") >= 5)], ["p_brand", "p_type", "p_size"], "p_partkey")
    return good.select("p_partkey", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("p_partkey", "reason"))


@query("""SELECT 'check status' AS "constraint", count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS violations FROM orders
    UNION ALL SELECT 'unique o_custkey', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'reference o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def q2_constraint_audit(spark, sf_dir):
    c = t(spark, sf_dir, "customer").where("c_acctbal > 0")
    return rw.constraint_audit(t(spark, sf_dir, "orders"), {"status": F.col("o_orderstatus").isin("F", "O")}, [["o_custkey"]], {"o_custkey": (c, "c_custkey")})


@query(f"""{ORDERS}, m AS (SELECT count(*) AS n FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM curr)), x AS (SELECT count(*) AS n FROM (SELECT * FROM curr EXCEPT ALL SELECT * FROM orders))
    SELECT 1 AS validation_id, CASE WHEN m.n = 0 AND x.n = 0 THEN 'passed' ELSE 'failed' END AS status, m.n AS missing_rows, x.n AS extra_rows, TIMESTAMP '2024-01-01' AS run_at FROM m, x""")
def q4_expected_vs_actual(spark, sf_dir):
    return rw.expected_vs_actual(*orders_pair(spark, sf_dir), 1, "2024-01-01 00:00:00")


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier")
def u1_gather(spark, sf_dir):
    n, r, s = (t(spark, sf_dir, x).select(F.col(c).alias("name")) for x, c in (("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name")))
    return n.unionByName(r).unionByName(s)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def u2_union_distinct(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def u3_except(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).subtract(t(spark, sf_dir, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_custkey, c_name, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey")
def u4_keyed_intersection(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    return t(spark, sf_dir, "customer").join(s, F.col("c_custkey") == s["s_suppkey"]).select("c_custkey", "c_name", "s_name")


# --- aggregates -------------------------------------------------------------------------------------------------


@query("""SELECT o_orderpriority, min(o_orderdate) AS first_start, max(o_orderdate) AS last_start, min(o_custkey) AS min_seconds, max(o_custkey) AS max_seconds,
    round(avg(o_custkey), 2) AS avg_seconds, round(stddev_samp(o_custkey), 2) AS stdev_seconds, count(*) AS runs FROM orders GROUP BY 1""")
def a11_run_summary(spark, sf_dir):
    return ag.run_summary(t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_custkey")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ', ' ORDER BY o_orderdate, o_orderkey) AS items FROM orders GROUP BY 1")
def a12_list_agg(spark, sf_dir):
    return ag.list_agg(t(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderkey"), F.struct("o_orderdate", "o_orderkey"))


@query("""SELECT l_orderkey, string_agg('<tr><td>' || l_linenumber || '</td><td>' || l_partkey || '</td><td>' || l_returnflag || '</td></tr>', '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS message FROM lineitem GROUP BY 1""")
def a13_messages(spark, sf_dir):
    return ag.messages(t(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_returnflag"], F.struct("l_linenumber", "l_partkey", "l_suppkey"))


@query("SELECT p_type, (row_number() OVER (ORDER BY p_type))::INTEGER AS id FROM (SELECT DISTINCT p_type FROM part WHERE p_type IS NOT NULL)")
def a14_dimension(spark, sf_dir):
    return ag.dimension(t(spark, sf_dir, "part"), "p_type")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, 'order_' || row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS name FROM orders)
    SELECT o_custkey, name, o_orderkey AS value FROM r""")
def a15_numbered_pivot(spark, sf_dir):
    """The wide table, read back as a row a value."""
    wide = ag.numbered_pivot(t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"], "order")
    return wide.unpivot("o_custkey", [c for c in wide.columns if c != "o_custkey"], "name", "value").where("value is not null")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_nationkey, " + ", ".join(f"coalesce(max(CASE WHEN c_mktsegment = '{s}' THEN 'x' END), '') AS {s}" for s in SEGMENTS) + " FROM customer GROUP BY 1")
def a16_presence_matrix(spark, sf_dir):
    return ag.presence_matrix(t(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@query("""WITH a AS (SELECT n_name AS section, CASE WHEN n_nationkey < 5 THEN 'semantic' ELSE 'syntactic' END AS kind, c_custkey % 4 <> 0 AS known, c_custkey % 3 = 0 AS correct FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT kind, section, count(*) AS asked, sum(known::INT)::BIGINT AS seen, sum((known AND correct)::INT)::BIGINT AS correct, sum((known AND correct)::INT) / nullif(sum(known::INT), 0) AS accuracy,
    sum(known::INT) / count(*) AS coverage FROM a GROUP BY ROLLUP (kind, section)""")
def a17_accuracy_rollup(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    asked = t(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == n["n_nationkey"])
    return ag.accuracy_rollup(asked.select(F.col("n_name").alias("section"), (F.col("n_nationkey") + 1).alias("section_no"), (F.col("c_custkey") % 4 != 0).alias("known"), (F.col("c_custkey") % 3 == 0).alias("correct")))


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 0")
def a20_distinct_active(spark, sf_dir):
    return t(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_mktsegment", "c_nationkey").distinct()


@query("""WITH l AS (SELECT 'o_orderstatus' AS field, o_custkey AS k, o_orderkey AS o, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_custkey, o_orderkey, o_orderpriority FROM orders),
    m AS (SELECT field, k, arg_max(v, o) AS v FROM l GROUP BY 1, 2),
    w AS (SELECT field, '{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k::VARCHAR) || '}' AS mapping FROM m GROUP BY 1)
    SELECT field, piece, substr(mapping, piece * 5000 + 1, 5000) AS mapping FROM w, unnest(range((length(mapping) + 4999) // 5000)) u(piece)""")
def a21_json_map(spark, sf_dir):
    return ag.json_map(t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"], 5000)


# --- windows ----------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS k FROM orders) WHERE k = 3")
def w1_split_rows(spark, sf_dir):
    return sq.split_rows(t(spark, sf_dir, "orders"), 7, 3, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def w2_split_columns(spark, sf_dir):
    return sq.split_columns(t(spark, sf_dir, "orders"), 3, 2, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("""SELECT o_orderkey, sum(o_custkey) OVER w::BIGINT AS running, (sum(o_custkey) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS before,
    (row_number() OVER w)::INTEGER AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""".replace("OVER w::BIGINT", "OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT"))
def w3_w5_running(spark, sf_dir):
    o = Ordered(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    out = o.add(running=("sum", F.col("o_custkey")), before=("sum_before", F.col("o_custkey")), n=("sum", F.lit(1)))
    return out.done().select("o_orderkey", "running", "before", F.col("n").cast("int").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice = max(p_retailprice) OVER w THEN 'M' WHEN p_retailprice = min(p_retailprice) OVER w THEN 'm' ELSE '' END AS minmax FROM part WINDOW w AS (PARTITION BY p_brand)""")
def w6_minmax_flags(spark, sf_dir):
    return sq.minmax_flags(t(spark, sf_dir, "part"), ["p_brand"], "p_retailprice").select("p_partkey", "minmax")


@query("""WITH s AS (SELECT *, lag(o_custkey) OVER w AS p FROM (SELECT o_orderkey, o_orderdate, year(o_orderdate) AS y, o_custkey % 10 AS o_custkey FROM orders) WINDOW w AS (PARTITION BY y ORDER BY o_orderdate, o_orderkey))
    SELECT o_orderkey, (sum(CASE WHEN p IS NULL OR o_custkey <= p THEN 1 ELSE 0 END) OVER (PARTITION BY y ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::BIGINT AS row_no FROM s""")
def w7_pack_rows(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"), (F.col("o_custkey") % 10).alias("slot"))
    return sq.pack_rows(o, ["y"], ["o_orderdate", "o_orderkey"], "slot").select("o_orderkey", "row_no")


HOURLY = """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*)::BIGINT AS v FROM events GROUP BY 1, 2), s AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour))"""


def hourly(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("v"))


@query(f"""{HOURLY} SELECT event_type, hour, v, round(greatest(-1.0, least(1.0, 0.5 * (l - r) / (l - 2 * v + r)))::DOUBLE, 6) AS peak_offset,
    round((v - 0.25 * (l - r) * greatest(-1.0, least(1.0, 0.5 * (l - r) / (l - 2 * v + r))))::DOUBLE, 6) AS peak_value FROM s WHERE v > l AND v > r""")
def w8_w9_peaks(spark, sf_dir):
    found = sq.find_peaks(hourly(spark, sf_dir), ["event_type"], "hour", "v")
    return found.select("event_type", "hour", "v", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("peak_offset", "peak_value")])


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) AS p FROM orders GROUP BY 1), n AS (SELECT o_custkey, (row_number() OVER (ORDER BY p, o_custkey) + 4)::INTEGER AS number FROM f)
    SELECT o_orderkey, number FROM orders JOIN n USING (o_custkey)""")
def w10_number_first_seen(spark, sf_dir):
    return sq.number_first_seen(t(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", 5).select("o_orderkey", "number")


@query("""SELECT l_orderkey, min_by(l_partkey, l_linenumber) || ':' || min_by(l_suppkey, l_linenumber) || '–' || max_by(l_partkey, l_linenumber) || ':' || max_by(l_suppkey, l_linenumber) AS label
    FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY 1""")
def w11_range_labels(spark, sf_dir):
    first = t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    return sq.range_labels(first, ["l_orderkey"], "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH e AS (SELECT user_id, epoch(date_trunc('second', ts))::DOUBLE AS x, event_id FROM events), c AS (SELECT user_id, x AS e, x + 1 + event_id % 5 AS r FROM (SELECT user_id, x, max(event_id) AS event_id FROM e GROUP BY 1, 2)),
    m AS (SELECT *, CASE WHEN lead(e) OVER w IS NULL THEN e + 100 ELSE (e + r) / 2 END AS close, (e + r) / 2 AS reopen FROM c WINDOW w AS (PARTITION BY user_id ORDER BY e)),
    s AS (SELECT *, coalesce(max(reopen) OVER (PARTITION BY user_id ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS segment_start FROM m)
    SELECT user_id, segment_start, greatest(segment_start, close) AS segment_end FROM s""")
def w12_segments(spark, sf_dir):
    e = t(spark, sf_dir, "events").groupBy("user_id", F.unix_timestamp(F.date_trunc("second", "ts")).cast("double").alias("e")).agg(F.max("event_id").alias("i"))
    cuts = e.select("user_id", "e", (F.col("e") + 1 + F.col("i") % 5).alias("r"))
    return sq.segments(cuts, ["user_id"], "e", "r", F.col("e") + 100, trim=False).select("user_id", "segment_start", "segment_end")


@query("""SELECT o_orderkey, round(coalesce(sum(10 + ('0x' || substr(md5('1:' || o_custkey || ':' || o_orderkey), 1, 8))::BIGINT % 1000000 / 1000000.0 * 10)
    OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE, 5) AS "offset" FROM orders""")
def w13_running_offset(spark, sf_dir):
    return sq.running_offset(t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", 10.0, 20.0).select("o_orderkey", F.round("offset", 5).alias("offset"))


@query("""WITH i AS (SELECT o_orderkey, o_custkey, row_number() OVER w - 1 AS i, o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT o_orderkey, ((i + max(ceil(o_totalprice / 50000) - i) OVER (PARTITION BY o_custkey ORDER BY i))* 50000)::BIGINT AS tick FROM i""")
def j17_pace(spark, sf_dir):
    return sq.pace(t(spark, sf_dir, "orders").withColumn("o", F.struct("o_orderdate", "o_orderkey")), ["o_custkey"], "o", "o_totalprice", 50_000).select("o_orderkey", F.col("tick").cast("long").alias("tick"))


@query("SELECT (row_number() OVER (ORDER BY o_custkey, o_orderkey DESC))::BIGINT AS place, o_orderkey, o_custkey FROM orders")
def o1_sort(spark, sf_dir):
    """Each row with its place after the sort: the rows before it in its sorted partition, and those of the partitions before."""
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").orderBy("o_custkey", F.desc("o_orderkey"))
    rows = written(rows.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("at") - F.shiftleft("part", 33) + 1
    return rows.join(F.broadcast(before), "part").select(place.alias("place"), "o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders ORDER BY ('0x' || substr(md5('1:' || o_orderkey), 1, 8))::BIGINT, o_orderkey LIMIT 100")
def o2_sample_exact(spark, sf_dir):
    return sq.sample_exact(t(spark, sf_dir, "orders"), 100, ["o_orderkey"]).select("o_orderkey")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY share DESC, o_orderkey) AS n, sum((share > 0.1)::INT) OVER (PARTITION BY o_custkey) AS over_ FROM s)
    SELECT o_custkey, o_orderkey FROM r WHERE (over_ >= 3 AND share > 0.1) OR (over_ < 3 AND n <= 10)""")
def o3_top_with_fallback(spark, sf_dir):
    from pyspark.sql import Window

    s = t(spark, sf_dir, "orders").withColumn("share", F.col("o_totalprice") / F.sum("o_totalprice").over(Window.partitionBy("o_custkey")))
    return sq.top_with_fallback(s, ["o_custkey"], "share", ["o_orderkey"], 0.1).select("o_custkey", "o_orderkey")


# --- text -------------------------------------------------------------------------------------------------------

STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOPWORDS)
STRIPPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', chr(10), 'g'), '`[^`]*`', ' ', 'g'), '!\[[^\]]*\]\([^\)]+\)', ' ', 'g'), '\[([^\]]+)\]\([^\)]+\)', '\1', 'g'), '<[^>]+>', ' ', 'g')"""
SQL_WORDS = f"SELECT unnest(regexp_extract_all(translate(lower({STRIPPED}), '-_', '  '), '[a-z0-9]+(?:''[a-z0-9]+)*')) AS term FROM documents"


@query(f"SELECT term, count(*) AS count, term IN ({STOPS}) AS is_stopword FROM ({SQL_WORDS}) GROUP BY 1")
def a8_word_counts(spark, sf_dir):
    return tx.term_counts(t(spark, sf_dir, "documents"), "text")


IRREGULAR = "MAP {" + ", ".join("'" + k.replace("'", "''") + f"': '{v}'" for k, v in tx.IRREGULAR.items()) + "}"


@query(f"""WITH w AS (SELECT term AS w, length(term) AS n, count(*) AS c FROM ({SQL_WORDS}) GROUP BY ALL), s AS (SELECT *, left(w, n - 3) AS stem FROM w),
    l AS (SELECT c, coalesce({IRREGULAR}[w], CASE WHEN n > 4 AND suffix(w, 'ies') AND NOT suffix(w, 'eies') THEN stem || 'y' WHEN n > 3 AND (suffix(w, 'ses') OR suffix(w, 'xes') OR suffix(w, 'zes')) THEN left(w, n - 2)
        WHEN n > 2 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, n - 1) WHEN n > 4 AND suffix(w, 'ied') THEN stem || 'y' WHEN n > 3 AND suffix(w, 'ed') THEN left(w, n - 2)
        WHEN n > 4 AND suffix(w, 'ing') THEN CASE WHEN length(stem) > 3 AND right(stem, 1) = left(right(stem, 2), 1) THEN left(stem, length(stem) - 1) ELSE stem END ELSE w END) AS term FROM s)
    SELECT term, sum(c)::BIGINT AS count, term IN ({STOPS}) AS is_stopword FROM l GROUP BY 1""")
def a9_lemma_counts(spark, sf_dir):
    return tx.term_counts(t(spark, sf_dir, "documents"), "text", "lemma")


@query()
def a10_morpheme_counts(spark, sf_dir):
    return tx.term_counts(t(spark, sf_dir, "documents"), "text", "morpheme")


@query(f"SELECT doc_id, trim({STRIPPED}, ' ') AS body FROM documents")
def f1_strip_markup(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.trim(tx.strip_markup(F.col("text"))).alias("body"))


@query('''SELECT doc_id, regexp_replace(translate(regexp_replace(translate(lower(text), '’′‘`“”«»', repeat(chr(39), 4) || repeat(chr(34), 4)), '([.,()!?;/:])', ' \\1 ', 'g'), '"*_|-', '     '), '[0-9]', ' ', 'g') AS body FROM documents''')
def f5_normalise_corpus(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.normalise_corpus(F.col("text")).alias("body"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS b FROM pages)
    SELECT page_id, trim(regexp_replace(translate(replace(replace(replace(replace(replace(replace(b, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), chr(160), ' '),
        '[ \t\r\n]+', ' ', 'g'), ' ') AS body FROM p""")
def f7_html_text(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", tx.html_text(F.col("html")).alias("body"))


@query("SELECT event_id, (event_id % 240000 // 10000) * 3600 + (event_id // 100 % 100) * 60 + event_id % 100 AS seconds, strftime(ts, '%a, %Y-%m-%d') AS label, hour(ts) || ':' || lpad(minute(ts)::VARCHAR, 2, '0') AS clock FROM events")
def f15_f19_times(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.select("event_id", tx.hhmmss_seconds(F.col("event_id") % 240_000).alias("seconds"), tx.date_label(F.col("ts")).alias("label"), tx.clock_label(F.col("ts")).alias("clock"))


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def f15_day_and_time(spark, sf_dir):
    """Times taken apart into the two numbers of a job log, and put together again."""
    ts = F.col("ts").cast("timestamp")
    day, time = F.date_format(ts, "yyyyMMdd").cast("int"), (F.hour(ts) * 10_000 + F.minute(ts) * 100 + F.second(ts)).cast("int")
    return t(spark, sf_dir, "events").select("event_id", tx.day_and_time(day, time).alias("at"))


@query("""WITH e AS (SELECT event_id, ts FROM events), w AS (SELECT event_id, unnest([
    {'name': 'Today', 'a': date_trunc('day', ts), 'b': date_trunc('day', ts) + INTERVAL 1 DAY},
    {'name': 'ThisWeek', 'a': date_trunc('day', ts) - to_days(dayofweek(ts)::INT), 'b': date_trunc('day', ts) + to_days(7 - dayofweek(ts)::INT)},
    {'name': 'ThisMonth', 'a': date_trunc('month', ts), 'b': date_trunc('month', ts) + INTERVAL 1 MONTH}, {'name': 'ThisHour', 'a': date_trunc('hour', ts), 'b': date_trunc('hour', ts) + INTERVAL 1 HOUR},
    {'name': 'FourHours', 'a': ts - INTERVAL 2 HOUR, 'b': ts + INTERVAL 2 HOUR}, {'name': 'Centered 2 hour', 'a': ts - INTERVAL 2 HOUR, 'b': ts + INTERVAL 2 HOUR},
    {'name': 'Forward 3 day', 'a': ts, 'b': ts + INTERVAL 3 DAY}, {'name': 'Backward 10 minute', 'a': ts - INTERVAL 10 MINUTE, 'b': ts}]) AS w FROM e)
    SELECT event_id, w.name AS name, w.a AS begins, w.b AS ends FROM w""")
def f16_all_windows(spark, sf_dir):
    """The eight kinds of windows around each event."""
    ts = F.col("ts").cast("timestamp")
    kinds = ("Today", "ThisWeek", "ThisMonth", "ThisHour", "FourHours", "Centered 2 hour", "Forward 3 day", "Backward 10 minute")
    each = F.array(*[F.struct(F.lit(k).alias("name"), a.alias("begins"), b.alias("ends")) for k in kinds for a, b in (tx.time_window(k, ts),)])
    return t(spark, sf_dir, "events").select("event_id", F.inline(each))


@query("""SELECT event_id, date_diff('hour', ts, TIMESTAMP '2024-06-01 12:30:00') AS hours, date_diff('minute', ts, TIMESTAMP '2024-06-01 12:30:00') AS minutes,
    date_trunc('day', ts) AS today, date_trunc('month', ts) AS month_start, date_trunc('month', ts) + INTERVAL 1 MONTH AS month_end, date_trunc('day', ts) - to_days(dayofweek(ts)::INT) AS week_start FROM events""")
def f16_f17_windows(spark, sf_dir):
    now = F.lit("2024-06-01 12:30:00").cast("timestamp")
    ts = F.col("ts").cast("timestamp")
    month, week, today = (tx.time_window(x, ts) for x in ("ThisMonth", "ThisWeek", "Today"))
    return t(spark, sf_dir, "events").select(
        "event_id", tx.boundary_diff("hour", ts, now).alias("hours"), tx.boundary_diff("minute", ts, now).alias("minutes"),
        today[0].alias("today"), month[0].alias("month_start"), month[1].alias("month_end"), week[0].alias("week_start"),
    )


# --- ingestion --------------------------------------------------------------------------------------------------


def run_log(spark, sf_dir):
    """objects and runs, from events: a user is an object, an event a run."""
    e = t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_id") % 3 == 0, "completed").when(F.col("event_id") % 3 == 1, "failed").otherwise("running")
    runs = e.select(F.col("user_id").alias("object_id"), F.col("event_id").alias("run_id"), status.alias("status"), F.col("ts").alias("statustime"))
    objects = e.groupBy(F.col("user_id").alias("id")).agg(
        F.concat(F.lit("object "), F.first("user_id").cast("string")).alias("name"), F.when(F.first("user_id") % 5 == 0, "inactive").otherwise("active").alias("status"),
        (F.first("user_id") % 48).cast("int").alias("frequency"), F.min("ts").alias("modified"), F.max(F.when(F.col("event_id") % 7 == 0, F.col("ts"))).alias("verified"),
        F.max(F.when(F.col("event_id") % 3 == 0, F.col("ts"))).alias("refreshed"), F.count(F.lit(1)).alias("numrows"),
    )
    return objects, runs


NOW = "2024-06-01 12:30:00"
FRESH = f"""WITH runs AS (SELECT user_id AS object_id, event_id AS run_id, ts AS statustime, CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status FROM events),
objects AS (SELECT user_id AS id, 'object ' || user_id AS name, CASE WHEN user_id % 5 = 0 THEN 'inactive' ELSE 'active' END AS status, (user_id % 48)::INT AS frequency, min(ts) AS modified,
    max(CASE WHEN event_id % 7 = 0 THEN ts END) AS verified, max(CASE WHEN event_id % 3 = 0 THEN ts END) AS refreshed, count(*) AS numrows FROM events GROUP BY user_id),
last AS (SELECT object_id, arg_max(status, (statustime, run_id)) AS last_status, max(statustime) AS last_time FROM runs GROUP BY 1),
good AS (SELECT object_id, max(CASE WHEN status = 'completed' THEN statustime END) AS g FROM runs GROUP BY 1),
fails AS (SELECT object_id, count(*) FILTER ((g IS NULL OR statustime > g) AND status IN ('failed', 'error')) AS failures FROM runs JOIN good USING (object_id) GROUP BY 1),
fresh AS (SELECT o.*, last_status, last_time, failures, date_diff('hour', verified, TIMESTAMP '{NOW}') AS hours_since_verified, date_diff('hour', refreshed, TIMESTAMP '{NOW}') AS hours_since_refreshed,
    date_trunc('day', coalesce(verified, TIMESTAMP '1900-01-01')) + (date_trunc('second', modified) - date_trunc('day', modified)) + to_hours(frequency) AS next_time
    FROM objects o JOIN last ON id = last.object_id JOIN fails ON id = fails.object_id)"""


def fresh(spark, sf_dir):
    return ing.freshness(*run_log(spark, sf_dir), F.lit(NOW).cast("timestamp"))


@query(f"{FRESH} SELECT * FROM fresh")
def l9_freshness(spark, sf_dir):
    return fresh(spark, sf_dir)


@query(f"""{FRESH} SELECT id, status || '-' || CASE WHEN verified IS NULL AND last_status IS NULL THEN 'new' WHEN numrows = 0 THEN 'empty' WHEN verified IS NOT NULL THEN 'verified' ELSE last_status END AS label FROM fresh""")
def l10_p8_schedule(spark, sf_dir):
    return ing.schedule(fresh(spark, sf_dir)).select("id", "label")


@query(f"{FRESH} SELECT id FROM fresh WHERE status = 'active' AND (last_status IS NULL OR last_status IN ('failed', 'error') OR next_time <= TIMESTAMP '{NOW}' + INTERVAL 50 MINUTE)")
def l11_candidates(spark, sf_dir):
    return ing.candidates(fresh(spark, sf_dir), F.lit(NOW).cast("timestamp")).select("id")


@query(f"""{FRESH}, m AS (SELECT last_status, string_agg('<tr><td>' || name || '</td><td>' || failures || '</td></tr>', '' ORDER BY id) AS message FROM fresh WHERE failures > 1 GROUP BY 1)
    SELECT last_status, piece, substr(message, piece * 1000 + 1, 1000) AS message FROM m, unnest(range((length(message) + 999) // 1000)) u(piece)""")
def l12_w4_alerts(spark, sf_dir):
    return ing.alerts(fresh(spark, sf_dir), 1, 1000)


@query(f"{FRESH} SELECT id FROM objects WHERE epoch(TIMESTAMP '{NOW}') + 3000 > epoch(date_trunc('second', refreshed)) + frequency * 3600")
def l18_due_objects(spark, sf_dir):
    return ing.due_objects(run_log(spark, sf_dir)[0], F.lit(NOW).cast("timestamp")).select("id")


@query(f"""{ORDERS} SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE coalesce(NOT (o_custkey % 2 = 0), true) UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority FROM curr WHERE o_custkey % 2 = 0""")
def l4_partial_replace(spark, sf_dir):
    prev, curr = orders_pair(spark, sf_dir)
    cond = F.col("o_custkey") % 2 == 0
    return ing.partial_replace(prev, curr.where(cond), cond).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"""{ORDERS} SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < (SELECT min(o_orderkey) FROM curr WHERE o_orderkey > 500) UNION ALL SELECT o_orderkey, o_orderstatus FROM curr WHERE o_orderkey > 500""")
def l15_reload_from_first_id(spark, sf_dir):
    prev, curr = orders_pair(spark, sf_dir)
    return ing.reload_from_first_id(prev, curr.where("o_orderkey > 500"), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query(f"""{ORDERS}, f AS (SELECT o_orderstatus AS s, {PRINT} FROM orders GROUP BY 1), g AS (SELECT o_orderstatus AS s, {PRINT} FROM curr GROUP BY 1)
    SELECT coalesce(f.s, g.s) AS o_orderstatus FROM f FULL JOIN g ON f.s = g.s WHERE f.num_rows IS DISTINCT FROM g.num_rows OR f.checksum_xor IS DISTINCT FROM g.checksum_xor OR f.checksum_sum IS DISTINCT FROM g.checksum_sum""")
def l6_changed_groups(spark, sf_dir):
    prev, curr = orders_pair(spark, sf_dir)
    return ing.changed_groups(curr, prev, "o_orderstatus")
