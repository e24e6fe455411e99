"""Queries on text and name functions, edges, notebooks, files, personal data by row, streams and word vectors."""

from __future__ import annotations

import ast
import uuid

from pyspark.sql import functions as F

from sparkloom.catalog import query, t
from sparkloom.catalog_more import KEY, hmac_sql
from sparkloom.functions import text as tx
from sparkloom.operators import aggregate as ag
from sparkloom.operators import diff, embed, names, pieces, pii, rows, trees, vectors
from sparkloom.operators import profile as pf
from sparkloom.plans import ingest as ing
from sparkloom.plans.versions import VersionedTable
from sparkloom.shared import fresh_path
from sparkloom.sources import files
from sparkloom.streaming import status

# --- text -------------------------------------------------------------------------------------------------------


def chain_sql(text: str, rules) -> str:
    """The same ordered rules for DuckDB; the fixed patterns are those of both engines."""
    for pattern, to in rules:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to.replace(chr(39), chr(39) * 2).replace('$1', chr(92) + '1')}', 'g')"
    return text


@query(f"SELECT page_id, {chain_sql('html', tx.WIKI)} AS clean FROM pages")
def f6_strip_wiki(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", tx.strip_wiki(F.col("html")).alias("clean"))


#: Turns of conversations as entries of a feed of tickets.
FEED = """CASE turn % 6 WHEN 0 THEN '<b>Changed Status from Open to Closed.</b> ' || text WHEN 1 THEN 'Assigned this to ' || role || ' today. ' || text WHEN 2 THEN 'Merged 3 tickets (x): ' || text || ' [Merged from T-' || turn || ']'
    WHEN 3 THEN 'Took primary responsibility from ' || role || '.' || text || '\\r\\n &lt;ok&gt; &quot;it&#39;s&quot; &amp;amp;' WHEN 4 THEN 'Reassigned it from A to B. Added a note.' || text ELSE text END"""


@query(f"SELECT conv_id, turn, {chain_sql(FEED, tx.TICKET)} AS clean FROM conversations")
def f8_ticket_rules(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", tx.clean_ticket(F.expr(FEED.replace("\\", "\\\\"))).alias("clean"))


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' AND p_size < 25 THEN replace(replace(p_name, 'red', 'rot'), 'bolt', 'Bolzen')
    WHEN p_brand = 'Brand#2' AND p_size >= 25 THEN replace(p_name, 'blue', 'blau') ELSE p_name END AS p_name FROM part""")
def f9_replace_by_key(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("large", F.col("p_size") >= 25)
    rules = {("Brand#1", False): [("red", "rot"), ("bolt", "Bolzen")], ("Brand#2", True): [("blue", "blau")]}
    return tx.replace_by_key(p, "p_name", ["p_brand", "large"], rules).select("p_partkey", "p_name")


@query("SELECT c_custkey, coalesce(n_name, 'Unknown') AS category FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def f10_category(spark, sf_dir):
    lookup = t(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("value"), F.col("n_name").alias("category"))
    return tx.category(t(spark, sf_dir, "customer"), "c_nationkey", lookup).select("c_custkey", "category")


#: Names of files made of the names of parts.
WORDS = "['paper', 'invoice', 'tuition', 'oauth', 'neural', 'jks', 'notes', 'revenue', 'course']"
ENDINGS = "['.pdf', '.MD', '.csv', '.png', '.mkv', '.ogg', '.iso', '.tgz', '.bak', '.log', '.sql', '.docx', '', '.json', '.txt', '.epub']"
FILE = f"p_name || ' ' || list_extract({WORDS}, (p_size % 9 + 1)::INT) || list_extract({ENDINGS}, (p_partkey % 16 + 1)::INT)"


def any_of(words, x: str = "f") -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def one_of(endings) -> str:
    return "e IN (" + ", ".join(f"'{x}'" for x in endings) + ")"


#: Where files go, as a user may say it in short.
FILES = tx.FileRules(
    buckets={"Images": ("png", "jpg", "gif"), "Video": ("mkv", "mp4"), "Audio": ("ogg", "mp3"), "Software": ("iso", "exe"), "Archives": ("tgz", "zip"), "Backups": ("bak",), "Logs": ("log",)},
    data=("csv", "json", "xml"), code=("sql", "ipynb"), books=("pdf", "epub"), notes=("md", "txt"), work=("tuition", "invoice", "ledger"), reading=("paper", "course", "book"),
    domains={"Finance": ("revenue", "invoice"), "Identity": ("oauth", "mail"), "Learning": ("neural", "vision"), "Security": ("jks", "cert")},
)
#: Where the files of the query go: all endings, words and domains.
ALL_FILES = tx.FileRules(
    buckets={
        "Images": ("png", "jpg", "jpeg", "gif", "bmp", "svg", "webp", "tiff"), "Video": ("mp4", "mov", "m4v", "mkv", "avi", "webm"), "Audio": ("mp3", "wav", "flac", "m4a", "aac", "ogg"),
        "Software": ("msi", "exe", "vsix", "appinstaller", "iso"), "Archives": ("zip", "7z", "tar", "gz", "tgz", "rar"), "Backups": ("bak", "dacpac", "ispac"), "Logs": ("log", "oxps"),
    },
    data=("csv", "tsv", "xlsx", "xls", "xlsm", "xlsb", "json", "xml", "yaml", "yml"), code=("sql", "ipynb"), books=("pdf", "epub"), notes=("md", "txt"),
    work=(
        "twu", "jenzabar", "clover", "salesforce", "integration", "student", "housing", "enrollment", "finance", "trial", "tuition", "vena", "payee", "reconcile", "ledger", "gl", "ar", "ap",
        "ssrs", "db", "backup", "prod", "test", "staging", "aq", "j1", "jics", "entra", "active directory", "email",
    ),
    reading=("paper", "article", "report", "guide", "handbook", "book", "thesis", "proceedings", "cvpr", "arxiv", "pnas", "nature", "springer", "oreilly"),
    domains={
        "Finance": ("finance", "gl", "ledger", "trial", "balance", "tuition", "revenue", "ar ", " ap", "payee", "positivepay", "t2202", "t4a", "vena"),
        "Student": ("student", "housing", "residence", "enrol", "enroll", "candidacy", "course"),
        "Identity": ("entra", "adp", "active directory", "email", "sso", "ldap", "oauth"),
        "Integrations": ("clover", "jenzabar", "salesforce", "wsdl", "sftp", "ssis", "api"),
        "AI-ML": ("ai", "ml", "llm", "neural", "graph", "rag", "nlp", "vision", "transformer"),
        "Security": ("security", "log4shell", "cert", "rsa", "key", "jks"),
    },
)


@query(f"""WITH n AS (SELECT p_partkey, lower({FILE}) AS f FROM part), x AS (SELECT *, CASE WHEN contains(f, '.') THEN regexp_extract(f, '\\.([^.]+)$', 1) ELSE '' END AS e FROM n)
    SELECT p_partkey, CASE {' '.join(f"WHEN {one_of(v)} THEN '{k}'" for k, v in ALL_FILES.buckets.items())} WHEN {one_of(ALL_FILES.books)} AND NOT {any_of(ALL_FILES.work)} THEN 'Reading' WHEN {one_of(ALL_FILES.notes)} AND {any_of(ALL_FILES.reading)} THEN 'Reading'
    WHEN {any_of(ALL_FILES.work)} OR {one_of(ALL_FILES.code)} THEN 'Work' ELSE CASE WHEN {one_of(ALL_FILES.data)} THEN 'Data/' ELSE 'Work/' END || CASE {' '.join(f"WHEN {any_of(v)} THEN '{k}'" for k, v in ALL_FILES.domains.items())} END END AS place FROM x""")
def f11_file_place(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, ast.literal_eval(values))), (k + 1).cast("int"))
    path = F.concat(F.lit("/in.box/"), "p_name", F.lit(" "), pick(WORDS, F.col("p_size") % 9), pick(ENDINGS, F.col("p_partkey") % 16))
    return t(spark, sf_dir, "part").select("p_partkey", tx.file_place(path, ALL_FILES).alias("place"))


@query(r"""SELECT p_partkey, regexp_extract(replace(p_name, ' ', '_'), '^([^_]+)', 1) AS snake, regexp_extract(replace(p_name, ' ', '.'), '^([^.]+)', 1) AS dotted,
    regexp_extract(p_brand, '^([A-Z]?[a-z0-9]+)', 1) AS camel FROM part""")
def f12_name_prefix(spark, sf_dir):
    name = F.col("p_name")
    snake, dotted = tx.name_prefix(F.replace(name, F.lit(" "), F.lit("_"))), tx.name_prefix(F.replace(name, F.lit(" "), F.lit(".")), ".")
    return t(spark, sf_dir, "part").select("p_partkey", snake.alias("snake"), dotted.alias("dotted"), tx.name_prefix(F.col("p_brand"), "camel").alias("camel"))


CODE = "'SELECT a FROM ' || replace(p_name, ' ', '_') || ' -- FROM x' || chr(10) || '/* INTO y */ JOIN ' || p_type || CASE WHEN p_size % 2 = 0 THEN ';INSERT INTO log' || p_size || ' EXEC @v' ELSE '' END"


def code(spark, sf_dir):
    """Invented SQL texts from the names of parts."""
    return t(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(CODE.replace("chr(10)", "char(10)")).alias("body"))


@query(rf"SELECT p_partkey, regexp_replace({CODE}, '(--[^\n]*(\n|$))|((?s)/\*.*?\*/)', ' ', 'g') AS body FROM part")
def f13_strip_sql_comments(spark, sf_dir):
    return code(spark, sf_dir).select("p_partkey", tx.strip_sql_comments(F.col("body")).alias("body"))


#: Texts of documents, as they are, as comments, and in statements.
CELL = """CASE doc_id % 7 WHEN 0 THEN text WHEN 1 THEN '-- note' || chr(10) || text WHEN 2 THEN '/* ' || text || ' */ select ' || doc_id WHEN 3 THEN text || chr(10) || ' Go ' || chr(10)
    WHEN 4 THEN ' ' || chr(10) || '%%tsql ' || text WHEN 5 THEN 'x := Select' || chr(10) || text || ' from y' ELSE '#!connect mssql ' || text END"""


@query(rf"""WITH c AS (SELECT doc_id, regexp_replace({CELL}, '^[ \t\n\x0B\f\r]+', '') AS body FROM documents),
    d AS (SELECT *, regexp_extract(body, '^([^\r\n]*)', 1) AS line, regexp_replace(body, '^(?:[ \t\n\x0B\f\r]+|--[^\n]*(?:\n|$)|/\*(?s:.*?)\*/)+', '') AS code FROM c)
    SELECT doc_id, regexp_matches(line, '(?i)^(%%sql|%%tsql|%%mssql|%sql|%tsql|%mssql|#!sql(?:[-_]\S+)?|#!tsql(?:[-_]\S+)?|#!mssql(?:[-_]\S+)?)\b') OR regexp_matches(line, '(?i)^#!connect\s+(?:mssql|sql|sqlserver)\b')
        OR (code <> '' AND (regexp_matches(code, '(?i)^(?:;\s*)?(select|with|insert|update|delete|merge|create|alter|drop|truncate|exec(?:ute)?|declare|use|begin|if|while|set|grant|revoke|deny|backup|restore|dbcc|commit|rollback)\b')
            OR regexp_matches(code, '(?im)^\s*go\s*$') OR (regexp_matches(code, '(?i)\bselect\b') AND regexp_matches(code, '(?i)\bfrom\b')))) AS is_sql FROM d""")
def f20_looks_like_sql(spark, sf_dir):
    cell = F.expr(CELL.replace("chr(10)", "char(10)"))
    return t(spark, sf_dir, "documents").select("doc_id", tx.looks_like_sql(cell).alias("is_sql"))


@query("""SELECT p_partkey, 'read' AS mode, replace(p_name, ' ', '_') AS target FROM part UNION SELECT p_partkey, 'read', p_type FROM part
    UNION SELECT p_partkey, 'write', 'log' || p_size FROM part WHERE p_size % 2 = 0""")
def f29_sql_targets(spark, sf_dir):
    return tx.sql_targets(code(spark, sf_dir), "p_partkey", "body")


@query("SELECT DISTINCT p_partkey AS parent, 'x' AS child WHERE false UNION ALL SELECT p_partkey, 'log' || p_size FROM part WHERE p_size % 2 = 0".replace("WHERE false", "FROM part WHERE false"))
def g1_write_edges(spark, sf_dir):
    """Edges from code to what it writes."""
    return tx.sql_targets(code(spark, sf_dir), "p_partkey", "body").where("mode = 'write'").select(F.col("p_partkey").alias("parent"), F.col("target").alias("child"))


@query("SELECT event_id, event_id % 2 = 0 AS is_uuid FROM events")
def f21_is_uuid(spark, sf_dir):
    h = F.md5(F.col("event_id").cast("string"))
    made = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return t(spark, sf_dir, "events").select("event_id", tx.is_uuid(F.when(F.col("event_id") % 2 == 0, made).otherwise(h)).alias("is_uuid"))


@query(r"""WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' ' || p_type || '!!' WHEN 1 THEN '_' || p_brand || '__' || (p_size % 3) WHEN 2 THEN '#%' || p_size || ' ]' ELSE '?!' END AS text FROM part),
    o AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(trim(text), '[^A-Za-z0-9_]+', '_', 'g'), '__+', '_', 'g'), '^_|_$', '', 'g') AS safe FROM n),
    b AS (SELECT *, CASE WHEN safe = '' THEN 'obj' ELSE safe END AS base FROM o), k AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM b),
    m AS (SELECT *, CASE WHEN base = 'obj' AND k >= 3 THEN k + 1 ELSE k END AS number FROM k)
    SELECT p_partkey, base || CASE WHEN number = 1 THEN '' ELSE '_' || number END AS name, '[' || replace(text, ']', ']]') || ']' AS quoted,
    chr(39) || replace(text || chr(39), chr(39), chr(39) || chr(39)) || chr(39) AS literal FROM m""")
def f22_object_name(spark, sf_dir):
    """Names made of texts, each given once, also beside a name that is taken already."""
    text = F.expr("CASE p_size % 4 WHEN 0 THEN concat(' ', p_type, '!!') WHEN 1 THEN concat('_', p_brand, '__', p_size % 3) WHEN 2 THEN concat('#%', p_size, ' ]') ELSE '?!' END")
    p = t(spark, sf_dir, "part").select("p_partkey", text.alias("text")).withColumn("base", names.object_name(F.col("text")))
    named = names.unique_names(p, "base", "p_partkey", spark.createDataFrame([("obj_3",)], "name string"))
    return named.select("p_partkey", "name", names.bracketed(F.col("text")).alias("quoted"), names.literal(F.concat("text", F.lit("'"))).alias("literal"))


@query("SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN '2024-01-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') END AS date FROM part")
def f23_front_matter(spark, sf_dir):
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"))
    head = F.concat(F.lit('---\ntitle: "'), "p_name", F.lit('"\ndate: '), day, F.lit("\n---\n# other\n"))
    parts = tx.front_matter(F.when(F.col("p_size") % 2 == 0, head).otherwise(F.concat(F.lit("text\n# "), "p_name", F.lit(" \nmore"))))
    return t(spark, sf_dir, "part").select("p_partkey", *[c.alias(k) for k, c in parts.items()])


@query(r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?s)<div[^>]*class="[^"]*\bad\b[^"]*"[^>]*>(.*?)</div>', 1),
    lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))), '|') AS labels FROM pages""")
def f24_labels_of_class(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.array_join(tx.labels_of_class(F.col("html"), "ad", "div"), "|").alias("labels"))


@query("SELECT p_partkey, p_name || ' ok' AS line FROM part")
def f25_strip_ansi(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", tx.strip_ansi(F.concat(F.lit("\x1b[1;31m"), "p_name", F.lit("\x1b[0m ok\x1b[K"))).alias("line"))


@query("SELECT p_partkey, rtrim(translate(base64(encode(p_name)), '+/', '-_'), '=') AS packed, p_name AS back FROM part")
def f26_url_base64(spark, sf_dir):
    packed = tx.url_base64(F.encode("p_name", "utf-8"))
    return t(spark, sf_dir, "part").select("p_partkey", packed.alias("packed"), F.decode(tx.unurl_base64(packed), "utf-8").alias("back"))


@query("""WITH y AS (SELECT *, last_value(CASE WHEN event_id % 7 = 0 THEN 2001 + event_id % 100 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS year FROM events), e AS (SELECT *, unnest(CASE WHEN event_id % 2 = 0 THEN ['new', 'full'] ELSE ['first', 'last'] END) AS phase FROM y)
    SELECT event_id, year::INT AS year, phase, month(ts)::INT AS month, day(ts)::INT AS day, strftime(ts, '%H:%M') AS time, CASE WHEN phase IN ('new', 'first') AND event_id % 3 = 0 THEN 'T' ELSE '' END AS code FROM e WHERE year IS NOT NULL""")
def f27_phase_events(spark, sf_dir):
    """Lines of a table of moon phases, each with two phases, some with the year that holds until the next."""
    event = F.date_format("ts", "MMM d HH:mm")
    first = F.rpad(F.concat(event, F.when(F.col("event_id") % 3 == 0, " T").otherwise("")), 18, " ")
    head = F.rpad(F.when(F.col("event_id") % 7 == 0, F.concat(F.lit(" "), (F.col("event_id") % 100 + 2001).cast("string"))).otherwise(""), 6, " ")
    line = F.concat(head, F.when(F.col("event_id") % 2 == 0, F.concat(first, F.lit(" " * 18))).otherwise(F.concat(F.lit(" " * 18), first, F.lit(" " * 16))), event)
    e = t(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"))
    return tx.phase_events(e, "line", "event_id", ["user_id"]).drop("user_id")


@query("""SELECT event_id, (2001 + event_id % 99)::INT AS year, month(ts)::INT AS month, day(ts)::INT AS day, CASE event_id % 5 WHEN 0 THEN 'T' WHEN 1 THEN 'A' WHEN 2 THEN 'P' ELSE 'A' END AS code FROM events WHERE event_id % 5 < 4""")
def f27_eclipse_days(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("T", "Am", "Pb", "H3", "N"))), (F.col("event_id") % 5 + 1).cast("int"))
    row = F.concat(F.lit("no. 12 "), (F.col("event_id") % 99 + 2001).cast("string"), F.date_format("ts", " MMM dd HH:mm:ss"), F.lit(" 64  12  127 "), kind, F.lit(" -n 0.5"))
    return tx.eclipse_days(t(spark, sf_dir, "events").select("event_id", row.alias("text")), ["event_id"], "text")


@query("""WITH e AS (SELECT *, last_value(CASE WHEN event_id % 7 = 0 THEN 2001 + event_id % 100 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS year, 350000 + event_id * 37 % 60000 AS a, 356000 + event_id * 91 % 50000 AS b FROM events),
    d AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN [a] ELSE [b, a] END AS ds FROM e) SELECT event_id, year::INT AS year, list_extract(list_filter(ds, lambda x: x < 390000), 1)::INT AS perigee, list_extract(list_filter(ds, lambda x: x >= 390000), 1)::INT AS apogee FROM d WHERE year IS NOT NULL""")
def f27_distance_rows(spark, sf_dir):
    i = F.col("event_id")
    day = F.date_format("ts", "MMM d HH:mm ")
    one, two = F.concat(day, (i * 37 % 60_000 + 350_000).cast("string")), F.concat(day, (i * 91 % 50_000 + 356_000).cast("string"))
    line = F.concat(F.when(i % 7 == 0, F.concat((i % 100 + 2001).cast("string"), F.lit("  "))).otherwise("   "), one, F.when(i % 4 == 0, " M 12.5").otherwise(""), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("  "), two)))
    rows = tx.distance_rows(t(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line")), "line", "event_id", ["user_id"])
    return rows.select("event_id", "year", F.col("perigee.distance").alias("perigee"), F.col("apogee.distance").alias("apogee"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'Z' WHEN left(c_mktsegment, 1) = 'H' THEN 'A' ELSE left(c_mktsegment, 1) END AS code FROM customer")
def f28_override_code(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    listed = c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("key"), F.lit("Z").alias("code"))
    return tx.override_code(c, "c_custkey", "c_mktsegment", listed).select("c_custkey", F.col("c_mktsegment").alias("code"))


@query("""WITH p AS (SELECT p_partkey, unnest(['slow', 'fast', 'bright', 'dark']) AS v FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY md5('1:' || p_partkey || ':' || v), v) AS k FROM p),
    i AS (SELECT p_partkey, string_agg(v, ', ' ORDER BY k) AS items FROM r WHERE k <= ('0x' || substr(md5('1:' || p_partkey), 1, 8))::BIGINT % 3 + 1 GROUP BY 1)
    SELECT p_partkey, items, trunc(p_retailprice * 0.75)::BIGINT AS frame FROM i JOIN part USING (p_partkey)""")
def f30_drawn_items(spark, sf_dir):
    """Items for each part, and its price, kept as a text, scaled to a frame number."""
    frame = tx.scaled(F.col("p_retailprice").cast("string"), 0.75)
    return t(spark, sf_dir, "part").select("p_partkey", tx.drawn_items(F.col("p_partkey"), ["slow", "fast", "bright", "dark"]).alias("items"), frame.alias("frame"))


@query("SELECT c_custkey, 'S-1-5-21-' || c_custkey || '-' || c_nationkey AS sid FROM customer")
def f14_sid_text(spark, sf_dir):
    def little(x):
        h = F.lpad(F.hex(x.cast("long")), 8, "0")
        return F.concat(*[F.substring(h, k, 2) for k in (7, 5, 3, 1)])

    raw = F.concat(F.lit("0103000000000005"), little(F.lit(21)), little(F.col("c_custkey")), little(F.col("c_nationkey")))
    return t(spark, sf_dir, "customer").select("c_custkey", tx.sid_text(F.unhex(raw)).alias("sid"))


@query("""SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 10 HOUR + to_hours((o_orderkey % 48)::INT) AS next_time FROM orders""")
def f18_schedule_time(spark, sf_dir):
    modified = F.lit("2020-05-05 10:00:00").cast("timestamp")
    return t(spark, sf_dir, "orders").select("o_orderkey", tx.schedule_time(F.col("o_orderdate"), modified, F.col("o_orderkey") % 48).alias("next_time"))


# --- joins, edges, trees ----------------------------------------------------------------------------------------


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n, o_custkey FROM orders) SELECT n, o_custkey AS a, o_orderkey AS b FROM n")
def j14_zip_lists(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    a = o.select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("a"))
    return trees.zip_lists(a, o.select((F.col("o_orderkey") * 3).alias("n"), F.col("o_orderkey").alias("b")), "n").withColumn("n", F.col("n").cast("long"))


PERMS = """WITH p AS (SELECT user_id AS login, event_type AS db, event_id % 4 AS schema_id, event_id % 9 AS object_id, CASE WHEN event_id % 50 = 0 THEN 'DENY' ELSE 'GRANT' END AS state, event_id FROM events),
    d AS (SELECT * FROM p WHERE state = 'DENY')"""


def perms(spark, sf_dir):
    state = F.when(F.col("event_id") % 50 == 0, "DENY").otherwise("GRANT")
    return t(spark, sf_dir, "events").select(F.col("user_id").alias("login"), F.col("event_type").alias("db"), (F.col("event_id") % 4).alias("schema_id"), (F.col("event_id") % 9).alias("object_id"), state.alias("state"), "event_id")


@query(f"""{PERMS}, s AS (SELECT event_id, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.login = p.login AND d.db = p.db AND d.schema_id = p.schema_id) THEN 0
    WHEN EXISTS (SELECT 1 FROM d WHERE d.login = p.login AND d.object_id = p.object_id) THEN 1 END AS deny_scope FROM p WHERE state = 'GRANT') SELECT * FROM s WHERE deny_scope IS NOT NULL""")
def j15_deny_by_scope(spark, sf_dir):
    return diff.deny_conflicts(perms(spark, sf_dir), ["login"], [["db", "schema_id"], ["object_id"]]).select("event_id", "deny_scope")


@query(f"{PERMS} SELECT event_id FROM p WHERE state = 'GRANT' AND EXISTS (SELECT 1 FROM d WHERE d.login = p.login AND d.db = p.db AND d.object_id = p.object_id)")
def j16_deny_same_scope(spark, sf_dir):
    return diff.deny_conflicts(perms(spark, sf_dir), ["login"], [["db", "object_id"]]).select("event_id")


@query("""WITH n AS (SELECT DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN 'supplierlong' || l_suppkey ELSE 'cust_' || l_suppkey % 10 || '_' || l_suppkey END AS root FROM lineitem),
    p AS (SELECT root, CASE WHEN contains(root, '_') THEN 'cust' ELSE left(root, 10) END AS one, CASE WHEN contains(root, '_') THEN regexp_extract(root, '^([^_]+_[^_]+)', 1) ELSE root END AS two FROM n)
    SELECT one AS parent, two AS child FROM p WHERE one <> two UNION SELECT two, root FROM p WHERE two <> root""")
def g3_group_roots(spark, sf_dir):
    """Suppliers, which are sold by none, under two segments of their names, or under ten letters of names without any."""
    s = F.col("l_suppkey").cast("string")
    parent = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("supplierlong"), s)).otherwise(F.concat(F.lit("cust_"), (F.col("l_suppkey") % 10).cast("string"), F.lit("_"), s))
    return trees.group_roots(t(spark, sf_dir, "lineitem").select(parent.alias("parent"), F.concat(F.lit("part_"), F.col("l_partkey").cast("string")).alias("child")))


@query("""WITH e AS (SELECT DISTINCT s_nationkey::VARCHAR AS parent, s_name AS child, (s_suppkey % 3)::VARCHAR AS p FROM supplier),
    c AS (SELECT parent FROM e GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT p) > 1), m AS (SELECT e.*, c.parent IS NOT NULL AS moved FROM e LEFT JOIN c USING (parent)),
    g AS (SELECT parent, p, p || ' Courses #' || lpad((row_number() OVER (PARTITION BY p ORDER BY parent))::VARCHAR, 4, '0') AS g FROM (SELECT DISTINCT parent, p FROM m WHERE moved))
    SELECT coalesce(g, m.parent) AS parent, child FROM m LEFT JOIN g ON moved AND m.parent = g.parent AND m.p = g.p UNION ALL SELECT parent, g FROM g""")
def g5_insert_groups(spark, sf_dir):
    s = t(spark, sf_dir, "supplier")
    edges = s.select(F.col("s_nationkey").cast("string").alias("parent"), F.col("s_name").alias("child")).distinct()
    return trees.insert_groups(edges, r"\d$", (F.regexp_extract("child", r"(\d+)$", 1).cast("long") % 3).cast("string"))


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN turn = (SELECT min(turn) FROM conversations c WHERE c.conv_id = x.conv_id) THEN 0 ELSE 1 END AS d FROM conversations x)
    SELECT conv_id, turn, d AS depth, CASE WHEN d = 1 THEN (SELECT min(turn) FROM conversations c WHERE c.conv_id = l.conv_id) END AS parent_line FROM l""")
def g6_indent_edges(spark, sf_dir):
    from pyspark.sql import Window

    c = t(spark, sf_dir, "conversations").withColumn("first", F.min("turn").over(Window.partitionBy("conv_id")))
    lines = c.select("conv_id", "turn", F.concat(F.when(F.col("turn") > F.col("first"), "\t").otherwise(""), "role").alias("line"))
    return trees.indent_to_edges(lines, "turn", F.col("line"), ["conv_id"]).select("conv_id", "turn", "depth", "parent_line")


@query("""SELECT event_id AS parent, event_id + 1 AS child, 'success' AS outcome FROM events WHERE event_id % 10 < 9
    UNION ALL SELECT event_id, event_id - event_id % 10, 'failure' FROM events WHERE event_type = 'error'""")
def g7_step_edges(spark, sf_dir):
    i = F.col("event_id")
    return trees.step_edges(t(spark, sf_dir, "events").select(i.alias("step_id"), F.when(i % 10 < 9, i + 1).alias("on_success"), F.when(F.col("event_type") == "error", i - i % 10).alias("on_failure")))


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), one AS (SELECT l_orderkey, count(*) FILTER (l_linenumber = 1) > 0 AS there FROM s GROUP BY 1)
    SELECT l_orderkey * 10 + l_linenumber AS child, l_orderkey * 10 AS parent FROM s JOIN one USING (l_orderkey) WHERE l_linenumber <> 1 AND there""")
def g10_collapse_tree(spark, sf_dir):
    i = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    top = F.col("l_orderkey") * 10
    below = i.select((top + F.col("l_linenumber")).alias("node"), F.when(F.col("l_linenumber") == 1, top).otherwise(top + 1).alias("parent"))
    nodes = below.unionByName(i.select(top.alias("node"), F.lit(None).cast("long").alias("parent")).distinct())
    return trees.collapse_tree(nodes, "node", "parent", F.col("node") % 10 != 1)


# --- personal data ----------------------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 3 < 2 THEN c_name || '@example.org' ELSE 'none' END AS mail, '+1 555 ' || lpad((c_custkey % 10000000)::VARCHAR, 7, '0') AS phone,
    CASE WHEN c_custkey % 3 < 1 THEN '123-45-6789' ELSE '2024-01-02' END AS mixed FROM customer), l AS (UNPIVOT c ON c_name, c_mktsegment, mail, phone, mixed INTO NAME "column" VALUE v),
    f AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY c_custkey) AS n FROM l)
    SELECT "column" FROM f WHERE n <= 20 GROUP BY 1 HAVING avg((regexp_matches(v, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') OR regexp_matches(v, '^\d{3}-\d{2}-\d{4}$')
        OR (regexp_matches(v, '^\+?\d[\d ().-]{6,}\d$') AND NOT regexp_matches(v, '^\d{4}[-/]\d{2}[-/]\d{2}$')))::INT) > 0.5""")
def i1_detect_pii(spark, sf_dir):
    i = F.col("c_custkey")
    mail, phone = F.when(i % 3 < 2, F.concat("c_name", F.lit("@example.org"))).otherwise("none"), F.concat(F.lit("+1 555 "), F.lpad((i % 10_000_000).cast("string"), 7, "0"))
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", mail.alias("mail"), phone.alias("phone"), F.when(i % 3 < 1, "123-45-6789").otherwise("2024-01-02").alias("mixed"))
    return spark.createDataFrame([(x,) for x in pii.detect_pii(c, "c_custkey")], "column string")


@query(f"""WITH d AS (SELECT c_custkey, {hmac_sql('c_name')} AS h, {hmac_sql('c_custkey::VARCHAR')} AS k FROM customer)
    SELECT c_custkey, left(k, 18) AS id_token, (('0x' || left(h, 15))::BIGINT % 97)::BIGINT AS part FROM d""")
def i3_i6_tokens(spark, sf_dir):
    digest = pii.hmac_hex(F.col("c_name"), KEY)
    return t(spark, sf_dir, "customer").select("c_custkey", pii.token(F.col("c_custkey").cast("string"), "customer_id", KEY).alias("id_token"), pii.modulo(F.left(digest, F.lit(15)), 97).alias("part"))


def pool_sql(pool: tuple[str, ...], digest: str) -> str:
    """Pools of 256 or 64 names: the last two hex digits decide."""
    return f"list_extract({list(pool)}, ('0x' || right({digest}, 2))::INT % {len(pool)} + 1)"


@query(f"""WITH c AS (SELECT *, c_mktsegment || '.' || c_nationkey || '@example.com' AS mail FROM customer), f AS (SELECT mail, min(c_custkey) AS c_custkey FROM c GROUP BY 1),
    d AS (SELECT f.mail, {hmac_sql('c_name')} AS dn, {hmac_sql('c_mktsegment')} AS dm, {hmac_sql('f.mail')} AS d FROM f JOIN c USING (c_custkey)), x AS (SELECT mail, d, lower({pool_sql(pii.FIRST, 'dn')} || '.' || {pool_sql(pii.LAST, 'dm')})
    || left(translate(d || sha256(d), 'abcdef', '012345'), 4) AS part FROM d) SELECT mail AS original, part || CASE WHEN count(*) OVER (PARTITION BY part) > 1 THEN '.' || left(d, 24) ELSE '' END || '@example.org' AS token FROM x""")
def i7_row_mail(spark, sf_dir):
    c = t(spark, sf_dir, "customer").withColumn("mail", F.concat(F.col("c_mktsegment"), F.lit("."), F.col("c_nationkey").cast("string"), F.lit("@example.com")))
    return pii.row_mail_mapping(c, "mail", "c_name", "c_mktsegment", "c_custkey", KEY).select("original", "token")


@query("SELECT c_custkey, c_name AS restored, true AS hidden, (SELECT count(DISTINCT c_name) FROM customer) AS tokens FROM customer")
def i8_random_mode(spark, sf_dir):
    """Random tokens put in and taken out again; in between each name is another, and there are as many tokens as names."""
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    mapping = pii.random_mapping(c, ["c_name"])
    hidden = pii.apply_mapping(c, mapping, ["c_name"], "original", "token")
    back = pii.restore(hidden, mapping, ["c_name"]).select("c_custkey", F.col("c_name").alias("restored"))
    both = back.join(hidden.select("c_custkey", F.col("c_name").alias("token")), "c_custkey")
    tokens = hidden.agg(F.count_distinct("c_name").alias("tokens"))
    return both.select("c_custkey", "restored", (F.col("token") != F.col("restored")).alias("hidden")).join(F.broadcast(tokens), F.lit(True))


# --- profiles, loads, files -------------------------------------------------------------------------------------


def int_sql(c: str) -> str:
    return f"CASE WHEN min({c}) >= 0 AND max({c}) <= 255 THEN 'TINYINT' WHEN max({c}) < 32768 THEN 'SMALLINT' WHEN max({c}) < 2147483648 THEN 'INT' ELSE 'BIGINT' END"


def typed_sql(table: str, kinds: dict[str, str]) -> str:
    """column, type, and the score of a key: 20 for whole numbers, 60 for a name that ends in id, 10 for being unique."""
    one = """SELECT '{c}' AS "column", {k} AS type, CASE WHEN count(DISTINCT {c}) = count(*) AND {k} NOT LIKE 'DECIMAL%' THEN 10 + CASE WHEN {k} LIKE '%INT' THEN 20 ELSE 0 END + CASE WHEN '{c}' LIKE '%id' THEN 60 ELSE 0 END END AS score FROM {t}"""
    return " UNION ALL ".join(one.format(c=c, k=k, t=table) for c, k in kinds.items())


TEXT = "'NVARCHAR(' || max(length({0})) || ')'"
MONEY = "'DECIMAL(' || (max(length(ltrim(split_part({0}::DECIMAL(38,4)::VARCHAR, '.', 1), '-0'))) + max(length(rtrim(split_part({0}::DECIMAL(38,4)::VARCHAR, '.', 2), '0')))) || ',' || max(length(rtrim(split_part({0}::DECIMAL(38,4)::VARCHAR, '.', 2), '0'))) || ')'"


@query(typed_sql("orders", {"o_orderkey": int_sql("o_orderkey"), "o_custkey": int_sql("o_custkey"), "o_orderstatus": TEXT.format("o_orderstatus"), "o_totalprice": MONEY.format("o_totalprice"), "o_orderdate": "'DATETIME2(3)'", "o_orderpriority": TEXT.format("o_orderpriority")})
       + " UNION ALL " + typed_sql("events", {"event_id": int_sql("event_id"), "user_id": int_sql("user_id"), "event_type": TEXT.format("event_type")}))
def t1_t3_types_and_keys(spark, sf_dir):
    out = []
    for df in (t(spark, sf_dir, "orders"), t(spark, sf_dir, "events").select("event_id", "user_id", "event_type")):
        types = pf.infer_types(df)
        scores = dict(pf.key_candidates(pf.unique_columns(df), types))
        out += [(c, types[c], scores.get(c)) for c in df.columns]
    return spark.createDataFrame(out, "column string, type string, score int")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 3 = 0")
def l1_l5_load_table(spark, sf_dir):
    """The rows of a condition replaced in a table that the load itself makes first."""
    table = VersionedTable(spark, f"{files.shared_folder(spark)}/load-{uuid.uuid4().hex}")
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    table.load(o)
    changed = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    table.load(changed, "o_orderkey % 3 = 0")
    return table.read()


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def l14_backup(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    path = ing.backup(o, files.shared_folder(spark), f"orders-{uuid.uuid4().hex}", "20240101000000", F.col("o_orderstatus") == "O")
    return spark.read.parquet(path).drop("o_orderstatus")


@query("SELECT doc_id::VARCHAR AS doc_id, text, lang, source FROM documents")
def s1_s6_csv_round_trip(spark, sf_dir):
    """Texts with quotes, separators, line ends, and empty ones."""
    path = f"{files.shared_folder(spark)}/csv-{uuid.uuid4().hex}.csv"
    files.write_any(t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    return files.read_csv(spark, path, encoding="utf-8")


@query("""WITH c AS (SELECT source, string_agg(text, chr(10) || chr(10) ORDER BY doc_id % 4, doc_id) AS corpus FROM documents GROUP BY 1)
    SELECT source, piece, md5(substr(corpus, piece * 20000 + 1, 20000)) AS corpus FROM c, unnest(range((length(corpus) + 19999) // 20000)) u(piece)""")
def s11_corpus(spark, sf_dir):
    """Texts written to four folders a source, read again as one corpus a source, in pieces."""
    path = fresh_path(spark, "texts")
    d = t(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("-", "source", F.col("doc_id") % 4).alias("part"))
    pieces.write_texts(d, "part", "text", ["doc_id"], path, "\x00")
    texts = pieces.read_texts(spark, path, "\x00").withColumn("source", F.regexp_extract("path", "part=(.+)-[0-9]/", 1))
    return pieces.text_pieces(texts, ["source"], F.col("text"), ["path", "start", "number"], "\n\n", most=20_000, name="corpus").select("source", "piece", F.md5("corpus").alias("corpus"))


@query("SELECT o_custkey AS batch, o_orderkey AS record_id, 'record ' || o_orderkey AS name FROM orders")
def s16_synthetic(spark, sf_dir):
    """As many records as there are orders, those with a number of an order."""
    o = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("record_id"))
    made = files.synthetic(spark, 1 + (o.agg(F.max("record_id")).first()[0] or 0))
    return made.join(o, "record_id").select("batch", "record_id", "name")


@query("""WITH n AS (SELECT p_partkey, ['id', p_brand, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'Unnamed: 2' WHEN p_size % 4 = 2 THEN 'ID' ELSE p_type END] AS h FROM part)
    SELECT p_partkey, CASE WHEN h[3] = '' OR starts_with(h[3], 'Unnamed') THEN 'column 3 has no name' WHEN lower(h[3]) = 'id' THEN 'ID is there twice' ELSE '' END AS problems FROM n""")
def q3_header_problems(spark, sf_dir):
    k = F.col("p_size") % 4
    last = F.when(k == 0, "").when(k == 1, "Unnamed: 2").when(k == 2, "ID").otherwise(F.col("p_type"))
    p = t(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("id"), "p_brand", last).alias("names"))
    return p.select("p_partkey", F.array_join(rows.header_problem_list(F.col("names")), "; ").alias("problems"))


@query("SELECT event_id, event_type, user_id AS \"who.user\", value AS \"who.value\" FROM events")
def s4_json_flatten(spark, sf_dir):
    path = f"{files.shared_folder(spark)}/json-{uuid.uuid4().hex}"
    t(spark, sf_dir, "events").select("event_id", "event_type", F.struct(F.col("user_id").alias("user"), "value").alias("who")).write.json(path)
    return files.flatten(spark.read.json(path))


@query("SELECT (row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1)::BIGINT // 1000 AS chunk, o_orderkey FROM orders")
def s14_export_chunks(spark, sf_dir):
    path = f"{files.shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    files.export_chunks(t(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), path, 1000, ["o_orderpriority", "o_orderkey"])
    return spark.read.parquet(path).select(F.col("chunk").cast("long").alias("chunk"), "o_orderkey")


@query("SELECT 'SQL.' || user_id AS source, max(n) AS recorded, count(*) AS actual FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1")
def s18_notebook_grids(spark, sf_dir):
    """A notebook a user, its grid holding the user's events."""
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", "event_type")).alias("data"))
    grid = F.create_map(F.lit("application/vnd.dataresource+json"), F.to_json(F.struct("data")))
    count = F.create_map(F.lit("text/html"), F.concat(F.lit("("), F.size("data").cast("string"), F.lit(" rows affected)")))
    book = F.to_json(F.struct(F.array(F.struct(
        F.lit("code").alias("cell_type"), F.array(F.concat(F.lit("SELECT * FROM SQL."), F.col("user_id").cast("string"))).alias("source"),
        F.array(F.struct(count.alias("data")), F.struct(grid.alias("data"))).alias("outputs"),
    )).alias("cells")))
    rows = files.notebook_grids(e.select(F.col("user_id").cast("string").alias("path"), book.alias("value")))
    return rows.groupBy("source").agg(F.max("recorded").alias("recorded"), F.count("row").alias("actual"))


# --- streams ----------------------------------------------------------------------------------------------------


def event_stream(spark, sf_dir):
    return spark.readStream.schema(t(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/event[s].parquet")


@query("""WITH w AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS s, max(ts) AS l FROM events GROUP BY 1)
    SELECT w.user_id::VARCHAR AS key, s AS last_success, l AS last_event, (SELECT count(*) FROM events e WHERE e.user_id = w.user_id AND e.event_type <> 'purchase' AND (s IS NULL OR e.ts > s)) AS failures FROM w""")
def r1_failure_runs(spark, sf_dir):
    found = status.drained(status.failure_runs(event_stream(spark, sf_dir), "user_id", "ts", F.col("event_type") == "purchase"), "update")
    last = found.groupBy("key").agg(F.max_by(F.struct("last_success", "last_event", "failures"), "batch").alias("x"))
    return last.select("key", "x.*")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, user_id, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1, 2
    HAVING count(*) > 1 AND time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type = 'error')""")
def r1_window_failures(spark, sf_dir):
    return status.drained(status.window_failures(event_stream(spark, sf_dir), "user_id", "ts", F.col("event_type") != "error", "1 day", more_than=1), "append").drop("batch")


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_id, ('0x' || substr(md5('1:' || event_id), 1, 8))::BIGINT AS h FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY h, event_id) AS k FROM e WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)) SELECT window_start, event_id FROM r WHERE k <= 10""")
def r2_window_sample(spark, sf_dir):
    found = status.drained(status.window_sample(event_stream(spark, sf_dir), "ts", "event_id", 10, "1 day"), "append")
    return status.cut_sample(found, "event_id", 10).withColumn("event_id", F.col("event_id").cast("long"))


# --- word vectors -----------------------------------------------------------------------------------------------


@query()
def e8_huffman(spark, sf_dir):
    v = vectors.vocab(vectors.line_words(t(spark, sf_dir, "documents"), "doc_id", "text"), 5)
    return embed.huffman(v).select("word", "cn", "rank", F.array_join("code", "").alias("code"), F.array_join("point", " ").alias("point"))


@query()
def e9_train_vectors(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return embed.train(vectors.words(d, "doc_id", "text"), "doc_id", vectors.vocab(vectors.line_words(d, "doc_id", "text"), 5))


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings WHERE vec_id < 30000),
    q AS (SELECT x.vec_id AS query_id, x.label, a.vec_id AS a, b.vec_id AS b, c.vec_id AS c, d.vec_id AS expected, list_transform(list_zip(a.u, b.u, c.u), lambda x: x[2] - x[1] + x[3]) AS q FROM embeddings x LEFT JOIN u a ON a.vec_id = x.vec_id
        LEFT JOIN u b ON b.vec_id = x.vec_id + 1 LEFT JOIN u c ON c.vec_id = x.vec_id + 2 LEFT JOIN u d ON d.vec_id = x.vec_id + 3 WHERE x.vec_id % 50 = 0),
    k AS (SELECT * FROM q WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND expected IS NOT NULL), s AS (SELECT query_id, u.vec_id AS id, round(list_dot_product(q, u), 12) AS score FROM k JOIN u ON u.vec_id NOT IN (a, b, c)),
    r AS (SELECT query_id, arg_max('V' || id, (score, -id)) AS answer FROM s WHERE score > 0 GROUP BY 1),
    m AS (SELECT CASE WHEN q.label <= 5 THEN 'semantic' ELSE 'syntactic' END AS kind, q.label::VARCHAR AS section, k.query_id IS NOT NULL AS known, coalesce(r.answer = 'V' || q.expected, false) AS correct FROM q LEFT JOIN k USING (query_id) LEFT JOIN r USING (query_id))
    SELECT kind, section, count(*) AS asked, sum(known::INT)::BIGINT AS seen, sum((known AND correct)::INT)::BIGINT AS correct, sum((known AND correct)::INT) / nullif(sum(known::INT), 0) AS accuracy, sum(known::INT) / count(*) AS coverage FROM m GROUP BY ROLLUP (kind, section)""")
def e12_analogy_accuracy(spark, sf_dir):
    v = t(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vector"), "label", "vec_id")
    at = lambda k: F.concat(F.lit("v"), (F.col("vec_id") + k).cast("string"))
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("section"), F.col("label").alias("section_no"), at(0).alias("a"), at(1).alias("b"), at(2).alias("c"), at(3).alias("expected"))
    return ag.accuracy_rollup(embed.analogy_answers(v.select("word", "vector", F.col("vec_id").alias("rank")), q, 30_000))
