"""Queries on files, loads, security rows, pseudonyms by column and types; files go through the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalog import FRESH, NOW, ORDERS, PRINT, SQL_WORDS, orders_pair, query, run_log, t
from sparkloom.catalog_more import KEY, hmac_sql
from sparkloom.catalog_text import pool_sql
from sparkloom.functions import text as tx
from sparkloom.operators import diff, pii
from sparkloom.operators import profile as pf
from sparkloom.plans import ingest as ing
from sparkloom.plans import security
from sparkloom.plans.versions import VersionedTable
from sparkloom.shared import fresh_path
from sparkloom.sources import files, jdbc

# --- files ------------------------------------------------------------------------------------------------------


@query("""SELECT DISTINCT c_nationkey AS nation, CASE WHEN c_nationkey % 3 = 1 THEN 'cp1252' ELSE 'utf-8' END AS encoding, CASE WHEN c_nationkey % 3 = 2 THEN 'CRLF' ELSE 'LF' END AS terminator
    FROM customer""")
def s3_terminators(spark, sf_dir):
    """A file or more for each nation, in one of two encodings, with one of two line ends."""
    path = fresh_path(spark, "terminators")
    c = t(spark, sf_dir, "customer").select("c_nationkey", F.concat("c_name", F.lit(" é")).alias("value"))
    for k, encoding in ((0, "UTF-8"), (1, "ISO-8859-1")):
        c.where(F.col("c_nationkey") % 3 == k).write.mode("append").partitionBy("c_nationkey").csv(path, header=True, encoding=encoding)
    c.where("c_nationkey % 3 = 2").withColumn("value", F.concat("value", F.lit("\r"))).write.mode("append").partitionBy("c_nationkey").text(path)
    found = files.encodings(spark, f"{path}/*")
    return found.select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("int").alias("nation"), "encoding", "terminator").distinct()


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name || ' é' AS c_name FROM customer")
def s2_s3_csv_encodings(spark, sf_dir):
    """Files in two encodings read together, each by the first that decodes it."""
    path = fresh_path(spark, "encodings")
    c = t(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" é")).alias("c_name"))
    for k, name in enumerate(("UTF-8", "ISO-8859-1")):
        c.where(F.col("c_custkey") % 2 == k).write.csv(f"{path}/part={k}", header=True, encoding=name)
    return files.read_csv(spark, f"{path}/*/*.csv").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name, c_nationkey::BIGINT AS home_nation, c_mktsegment AS home_segment FROM customer")
def s5_xml_round_trip(spark, sf_dir):
    path = fresh_path(spark, "rows") + ".xml"
    home = F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    files.write_any(t(spark, sf_dir, "customer").select("c_custkey", "c_name", home.alias("home")), path)
    return files.read_any(spark, path)


@query("SELECT l_orderkey, l_linenumber, l_quantity >= 25 AS rejected FROM lineitem")
def s8_write_with_rejects(spark, sf_dir):
    good, bad = fresh_path(spark, "good"), fresh_path(spark, "rejects")
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    files.append_with_rejects(rows, F.col("l_quantity") < 25, good, bad)
    both = [spark.read.parquet(p).select("l_orderkey", "l_linenumber", F.lit(k).alias("rejected")) for p, k in ((good, False), (bad, True))]
    return both[0].unionByName(both[1])


@query('SELECT c_custkey::VARCHAR AS id, c_name AS "displayName", c_nationkey::BIGINT AS "lastSignIn" FROM customer')
def s9_api_pages(spark, sf_dir):
    """Pages of at most a hundred users."""
    path = fresh_path(spark, "pages")
    user = F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("displayName"), F.struct(F.col("c_nationkey").alias("lastSignIn")).alias("signInActivity"))
    pages = t(spark, sf_dir, "customer").groupBy(F.floor(F.col("c_custkey") / 100).alias("page")).agg(F.collect_list(user).alias("value"))
    pages.select(F.lit("users").alias("@odata.context"), F.concat(F.lit("users?skip="), "page").alias("@odata.nextLink"), "value").write.json(path)
    return files.api_pages(spark.read.json(path))[0]


@query(r"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^ \t\r\n]+')) AS token FROM documents) GROUP BY 1")
def s10_token_lines(spark, sf_dir):
    path = fresh_path(spark, "lines")
    t(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text")).write.text(path)
    return files.read_lines(spark, path).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id::VARCHAR AS word, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings")
def s12_vector_text(spark, sf_dir):
    path = fresh_path(spark, "vectors")
    files.save_vectors(t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").alias("vec")), path, text=True)
    return files.load_vectors(spark, path, text=True).select("word", F.posexplode("vec").alias("i", "x")).select("word", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@query(f"SELECT term AS word, count(*) AS cn FROM ({SQL_WORDS}) GROUP BY 1 HAVING count(*) >= 5")
def s13_vocab_file(spark, sf_dir):
    path = fresh_path(spark, "vocab")
    counts = tx.term_counts(t(spark, sf_dir, "documents"), "text").where("count >= 5")
    files.save_vocab(counts.select(F.col("term").alias("word"), F.col("count").alias("cn")), path)
    return files.load_vocab(spark, path)


@query("""SELECT 'customer ' || o_custkey AS "Parent", 'order ' || o_orderkey AS "Child" FROM orders""")
def s15_edge_file(spark, sf_dir):
    path = fresh_path(spark, "edges")
    named = [F.concat(F.lit(f"{k} "), F.col(c).cast("string")).alias(n) for k, c, n in (("customer", "o_custkey", "parent"), ("order", "o_orderkey", "child"))]
    files.save_edges(t(spark, sf_dir, "orders").select(*named), path)
    return files.read_csv(spark, path, sep="\t", encoding="utf-8").select("Parent", "Child")


@query("""WITH c AS (SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) - 1)::INT AS cell, l_linenumber % 5 AS k, l_linenumber AS n FROM lineitem),
    b AS (SELECT *, CASE l_orderkey % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'python' WHEN 2 THEN 'sql-server' END AS book, CASE k WHEN 1 THEN 'python' WHEN 2 THEN 't-sql' WHEN 3 THEN 'r' END AS own FROM c)
    SELECT l_orderkey::VARCHAR AS path, cell, CASE WHEN k = 4 THEN 'markdown' ELSE 'code' END AS cell_type, book AS notebook_language, coalesce(own, book) AS language,
    k <> 4 AND (coalesce(own = 't-sql', false) OR (own IS NULL AND (coalesce(book IN ('sql', 'sql-server'), false) OR n % 2 = 0))) AS is_sql, CASE WHEN n % 2 = 0 THEN 'SELECT ' ELSE 'print ' END || n AS source FROM b""")
def s17_notebook_cells(spark, sf_dir):
    """An order is a notebook, its lines are the cells; both tell their languages in places of different depth, or not at all."""
    path = fresh_path(spark, "notebooks")
    n = F.col("l_linenumber")
    where = F.element_at(F.array(*[F.lit(x) for x in ("{}", '{"language":" Python ","vscode":{"languageId":"sql"}}', '{"language":"","dotnet_interactive":{"language":"T-SQL"}}', '{"custom":{"metadata":{"vscode":{"languageId":"R"}}}}', "{}")]), (n % 5 + 1).cast("int"))
    source = F.to_json(F.array(F.when(n % 2 == 0, "SELECT ").otherwise("print "), n.cast("string")))
    cell = F.concat(F.lit('{"cell_type":"'), F.when(n % 5 == 4, "markdown").otherwise("code"), F.lit('","metadata":'), where, F.lit(',"source":'), source, F.lit("}"))
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_returnflag", cell.alias("cell")).alias("c"))
    books = lines.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("c"))["cell"], ",").alias("cells"))
    told = ('{"custom":{"metadata":{"language_info":{"name":"SQL"}}},"language_info":{"name":"r"}}', '{"language_info":{"name":" "},"kernelspec":{"name":"Python","display_name":"x"}}', '{"metadata":{"kernelspec":{"display_name":"sql-server"}}}', "{}")
    head = F.element_at(F.array(*map(F.lit, told)), (F.col("l_orderkey") % 4 + 1).cast("int"))
    text = F.concat(F.lit('{"metadata":'), head, F.lit(',"cells":['), "cells", F.lit("]}"))
    books.select(F.col("l_orderkey").cast("string").alias("path"), text.alias("value")).write.parquet(path)
    return files.notebook_cells(spark.read.parquet(path))


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_custkey > 20")
def s7_jdbc_round_trip(spark, sf_dir):
    """A table written to the database that comes with Spark and read again in ranges of a column with nulls; one condition is given to the source, one to Spark."""
    url = f"jdbc:derby:memory:{fresh_path(spark, 'db').rsplit('/', 1)[1]};create=true"
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderstatus", "o_orderpriority")
    jdbc.write_jdbc(o.coalesce(4), url, "orders", driver=jdbc.DERBY, createTableColumnTypes="o_orderstatus VARCHAR(8), o_orderpriority VARCHAR(64)")
    read = jdbc.read_jdbc(spark, url, "orders", "\"o_orderstatus\" = 'O'", '"o_totalprice"', 4, driver=jdbc.DERBY)
    return read.where("o_custkey > 20").drop("o_orderstatus")


# --- sheets -----------------------------------------------------------------------------------------------------

ALLOWED = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, values in security.DATABASE_PERMISSIONS.items() for v in values) + ") a(scope, permission)"


@query(f"""WITH s AS (SELECT event_id, CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'ghost' ELSE 'role' || user_id % 5 END AS role, CASE event_id % 7 WHEN 1 THEN 'DENY' WHEN 2 THEN 'REVOKE' ELSE 'GRANT' END AS state,
    CASE event_id % 5 WHEN 0 THEN 'DATABASE' WHEN 1 THEN 'SCHEMA' WHEN 2 THEN 'OBJECT' WHEN 3 THEN 'SCHEMA' ELSE 'SERVER' END AS scope, CASE WHEN event_id % 3 > 0 THEN 'dbo' END AS schema,
    CASE WHEN event_id % 4 > 0 THEN 't' || user_id % 3 ELSE '' END AS object, list_extract(['SELECT', 'EXECUTE', 'CONNECT', 'CREATE TABLE', 'REFERENCES', ''], (event_id % 6 + 1)::INT) AS permission, event_id % 2 = 0 AS wgo FROM events),
    r AS (SELECT *, CASE WHEN role = '' THEN 'no RoleName' WHEN permission = '' THEN 'no Permission' WHEN role = 'ghost' THEN 'role not in Roles' WHEN state = 'REVOKE' THEN 'state unknown' WHEN scope = 'SERVER' THEN 'scope unknown'
        WHEN scope <> 'DATABASE' AND schema IS NULL THEN 'no schema' WHEN scope = 'OBJECT' AND object = '' THEN 'no object'
        WHEN NOT EXISTS (SELECT 1 FROM {ALLOWED} WHERE a.scope = s.scope AND a.permission = s.permission) THEN 'not for this scope' END AS reason, wgo AND state <> 'DENY' AS granted FROM s),
    n AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, role, state, scope, coalesce(schema, ''), object, permission, granted ORDER BY event_id) > 1 THEN 'duplicate' ELSE reason END AS why FROM r)
    SELECT event_id, why AS reason, granted AS with_grant, CASE WHEN wgo AND state = 'DENY' AND (reason IS NULL) THEN 'a denial grants nothing' ELSE '' END AS repairs FROM n""")
def q1_permission_sheet(spark, sf_dir):
    """A sheet of permissions made of events, by the rules of its table: defaults, allow-list by scope, roles of another sheet, repairs, duplicates."""
    i, pick = F.col("event_id"), lambda k, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % k + 1).cast("int"))
    e = t(spark, sf_dir, "events").select(
        "event_id", F.when(i % 11 == 0, " ").when(i % 11 == 1, "ghost").otherwise(F.concat(F.lit("role"), (F.col("user_id") % 5).cast("string"))).alias("RoleName"),
        pick(7, None, " deny ", "REVOKE", "Grant", "GRANT", "", "grant").alias("State"), pick(5, "database", "SCHEMA", "Object", " schema", "SERVER").alias("Scope"),
        F.when(i % 3 > 0, "dbo").alias("SchemaName"), F.when(i % 4 > 0, F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string"))).otherwise("").alias("ObjectName"),
        pick(6, "select", "EXECUTE", "CONNECT", "Create Table", "REFERENCES", "").alias("Permission"), F.when(i % 2 == 0, "Yes").otherwise("").alias("WithGrantOption"),
    )
    roles = t(spark, sf_dir, "events").select(F.lit("1").alias("n"), F.concat(F.lit("role"), (F.col("user_id") % 5).cast("string")).alias("RoleName")).distinct()
    good, bad = security.validate(e, "Permissions", "event_id", security.validate(roles, "Roles", "n")[0])
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
    return both.select("event_id", "reason", F.col("WithGrantOption").alias("with_grant"), F.array_join("repairs", ", ").alias("repairs"))


# --- rows and loads ---------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT p_partkey, upper(p_name), 0 FROM part")
def p2_p4_copy_and_override(spark, sf_dir):
    """One input to two outputs, one of them with fields replaced."""
    p = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return p.unionByName(p.withColumns({"p_name": F.upper("p_name"), "p_size": F.lit(0)}))


@query("SELECT o_orderkey, o_orderstatus, o_custkey FROM orders WHERE o_orderstatus <> 'F'")
def l2_l3_full_replace(spark, sf_dir):
    """A filtered source copied to staging, which then replaces the whole table by one new version."""
    folder = fresh_path(spark, "replace")
    table = VersionedTable(spark, f"{folder}/orders")
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    table.load(o)
    staging = ing.backup(o, folder, "staging", "1", F.col("o_orderstatus") != "F")
    table.load(spark.read.parquet(staging))
    return table.read()


@query(f"""{ORDERS} SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE coalesce(NOT (o_custkey % 2 = 0), true)
    UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority FROM curr WHERE o_custkey % 2 = 0""")
def l4_partial_load(spark, sf_dir):
    """The rows of a filter taken from the source; the others stay in the files where they are."""
    prev, curr = orders_pair(spark, sf_dir)
    table = VersionedTable(spark, fresh_path(spark, "partial"))
    table.load(prev)
    table.load(curr, "o_custkey % 2 = 0")
    return table.read().select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"""{ORDERS} SELECT o_orderkey, o_orderstatus, o_orderpriority, year(o_orderdate)::INT AS year, 2 AS version FROM curr WHERE year(o_orderdate) % 2 = 0
    UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, year(o_orderdate)::INT, 1 FROM orders WHERE year(o_orderdate) % 2 = 1""")
def l6_load_changed_groups(spark, sf_dir):
    """Orders kept by year, of which even years change; a load writes these alone, and each row tells the version whose files it is in."""
    prev, curr = (o.withColumn("year", F.year("o_orderdate")) for o in orders_pair(spark, sf_dir))
    curr = curr.where("year % 2 = 0").unionByName(prev.where("year % 2 = 1"))
    table = VersionedTable(spark, fresh_path(spark, "groups"))
    table.load_groups(prev, "year")
    table.load_groups(curr, "year")
    first = sorted({p["folder"].split("/")[0] for p in table.version(1).parts})
    version = F.when(F.regexp_extract(F.col("_metadata.file_path"), "/data/([0-9a-f]+)/", 1).isin(first), 1).otherwise(2)
    return table.read().select("o_orderkey", "o_orderstatus", "o_orderpriority", "year", version.alias("version"))


@query(f"""{FRESH} SELECT id, name, numrows, (SELECT sum(event_id) FROM events WHERE user_id = id)::BIGINT AS checksum,
    CASE WHEN id % 4 <> 0 THEN TIMESTAMP '{NOW}' ELSE verified END AS verified, CASE WHEN id % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE refreshed END AS refreshed FROM objects""")
def l7_l8_verify_and_record(spark, sf_dir):
    """Each user's events compared with a copy, and the outcome recorded with the user's object."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    copy = e.withColumn("event_type", F.when(F.col("user_id") % 4 == 0, "other").otherwise(F.col("event_type")))
    agree = diff.fingerprints_match(e, copy, "user_id").select("user_id", "is_matching")
    counts = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("numrows"), F.sum("event_id").alias("checksum"))
    status = F.when(F.col("user_id") % 3 == 0, "completed").otherwise("failed")
    stats = counts.join(agree, "user_id").select(F.col("user_id").alias("id"), "numrows", "checksum", "is_matching", status.alias("status"), F.lit(NOW).cast("timestamp").alias("at"))
    objects = run_log(spark, sf_dir)[0].withColumn("checksum", F.lit(None).cast("long"))
    return ing.record_runs(objects, stats).select("id", "name", "numrows", "checksum", "verified", "refreshed")


@query("""SELECT DISTINCT s.s_nationkey AS principal, 'role ' || (s_suppkey % 7) AS role FROM supplier s
    WHERE s_suppkey % 2 = 0 AND EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = s.s_nationkey)""")
def l16_security_extract(spark, sf_dir):
    """Roles of the users of one database: segments are databases, nations are users."""
    principals = t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("db"), F.col("c_nationkey").alias("principal"))
    db = F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY")
    roles = t(spark, sf_dir, "supplier").select(db.alias("db"), F.col("s_nationkey").alias("principal"), F.concat(F.lit("role "), (F.col("s_suppkey") % 7).cast("string")).alias("role"))
    return ing.security_extract(principals, roles, "BUILDING")[1].select("principal", "role")


# --- pseudonyms and types ---------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT *, '+1 555 0' || lpad(c_custkey::VARCHAR, 6, '0') AS phone FROM customer),
    d AS (SELECT *, {hmac_sql('c_custkey::VARCHAR')} AS dk, {hmac_sql('c_name')} AS dn, {hmac_sql('c_mktsegment')} AS dm, {hmac_sql('c_nationkey::VARCHAR')} AS dz, {hmac_sql('phone')} AS dp FROM c)
    SELECT c_custkey, left(dk, 18) AS customer_id, {pool_sql(pii.FIRST, 'dn')} AS first_name, {pool_sql(pii.LAST, 'dn')} AS last_name, {pool_sql(pii.CITIES, 'dm')} AS city,
        left(translate(dz || sha256(dz), 'abcdef', '012345'), 5) AS zip_code, left(dm, 16) AS note,
        array_to_string(list_transform(string_split(phone, ''), lambda x, i: CASE WHEN x BETWEEN '0' AND '9' THEN substr(translate(dp, 'abcdef', '012345'), i, 1) ELSE x END), '') AS phone FROM d""")
def i4_i5_tokens_by_column(spark, sf_dir):
    """What a column's name and then a value's look make of the token."""
    c = t(spark, sf_dir, "customer").withColumn("phone", F.concat(F.lit("+1 555 0"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")))
    of = {"customer_id": "c_custkey", "first_name": "c_name", "last_name": "c_name", "city": "c_mktsegment", "zip_code": "c_nationkey", "note": "c_mktsegment", "phone": "phone"}
    return c.select("c_custkey", *[pii.token(F.col(c).cast("string"), name, KEY).alias(name) for name, c in of.items()])


TYPED = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", CASE WHEN bool_and(regexp_full_match({c}::VARCHAR, '[-+]?[0-9]+')) THEN 'INT'
    WHEN bool_and(TRY_CAST({c}::VARCHAR AS DOUBLE) IS NOT NULL) THEN 'FLOAT' ELSE 'NVARCHAR(255)' END AS kind FROM orders""" for c in TYPED))  # fmt: skip
def t2_spreadsheet_types(spark, sf_dir):
    return spark.createDataFrame(list(pf.spreadsheet_types(t(spark, sf_dir, "orders").select(*TYPED)).items()), "column string, kind string")


@query("""SELECT concat_ws(chr(10), 'CREATE TABLE `orders` (', '  `o_orderkey` ' || CASE WHEN max(o_orderkey) < 32768 THEN 'SMALLINT' WHEN max(o_orderkey) < 2147483648 THEN 'INT' ELSE 'BIGINT' END
    || ' NOT NULL,', '  `o_orderstatus` STRING,', '  `o_orderdate` TIMESTAMP', ')') AS ddl FROM orders""")
def t5_create_table(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    types = pf.infer_types(o)
    keys = {c for c, _ in pf.key_candidates(pf.unique_columns(o.select("o_orderkey")), types)}
    return spark.createDataFrame([(pf.create_table_ddl("orders", types, keys),)], "ddl string")
