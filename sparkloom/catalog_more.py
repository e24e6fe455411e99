"""Queries on profiles, personal data, vectors and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.catalog import query, t
from sparkloom.operators import diff as df_
from sparkloom.operators import pii, trees, vectors
from sparkloom.operators import profile as pf
from sparkloom.operators import sketches as sk
from sparkloom.shared import fresh_path, written


def profile_sql(table: str, cols: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({e}) AS missing, count(DISTINCT {e}) AS distinct_values, max(length({e}))::INT AS max_length,
        min({e}) AS min_value, max({e}) AS max_value, count({e}) = count(*) AND count(DISTINCT {e}) = count(*) AS is_unique FROM {table}""" for c, e in cols.items()
    )


@query(profile_sql("orders", {"o_orderkey": "o_orderkey::VARCHAR", "o_custkey": "o_custkey::VARCHAR", "o_orderstatus": "o_orderstatus", "o_totalprice": "o_totalprice::DECIMAL(38,4)::VARCHAR",
                              "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')", "o_orderpriority": "o_orderpriority"}))
def a5_profile(spark, sf_dir):
    return pf.profile(t(spark, sf_dir, "orders")).drop("top_values")


@query("""WITH u AS (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column")
    SELECT "column", (SELECT count(*) FROM orders) AS rows, CASE WHEN "column" = 'o_orderpriority' THEN (SELECT count(*) FROM orders WHERE o_orderkey % 83 = 0) ELSE 0 END AS missing, true AS distinct_near, true AS median_near, true AS top_near FROM u""")
def a5_kept_sketches(spark, sf_dir):
    """Sketches of three loads of orders, kept as tables and merged, held against the exact profile within their bounds."""
    o = t(spark, sf_dir, "orders").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 83 != 0, F.col("o_orderpriority")))
    folder = fresh_path(spark, "sketches")
    for load in range(3):  # each load adds its rows to the table of sketches
        sk.sketched(o.where(F.col("o_orderkey") % 3 == load)).write.mode("append").parquet(folder)
    kept = sk.estimated(sk.merged(spark.read.parquet(folder)), (0.5,))
    exact = pf.profile(o).select("column", F.col("distinct_values").alias("distinct"), F.get("top_values", F.lit(0)).alias("top"))
    first = F.get("top_values", F.lit(0))  # none where no value is surely frequent
    said = written(kept.join(exact, "column").withColumn("first", first), "sketches-said")  # a row a column
    texts = o.select(*[df_.as_text(o, c).alias(c) for c in o.columns]).unpivot([], o.columns, "column", "value")
    asked = F.broadcast(said.select("column", F.col("quantiles")[0].alias("median"), F.col("first.value").alias("first"), "top"))
    below = F.avg((F.col("value").try_cast("double") <= F.col("median")).cast("int"))
    counts = texts.join(asked, "column").groupBy("column").agg(below.alias("below"), F.count_if(F.col("value") == F.col("first")).alias("n"), F.count_if(F.col("value") == F.col("top")).alias("most"))
    near = F.abs(F.col("distinct_values") - F.col("distinct")) <= 0.06 * F.col("distinct") + 1
    median = F.col("quantiles").isNull() | F.col("below").between(0.48, 0.6)
    top = (F.abs(F.coalesce("first.n", F.lit(0)) - F.col("n")) <= F.col("top_error")) & (F.col("most") - F.col("n") <= 2 * F.col("top_error"))
    return said.join(counts, "column").select("column", "rows", "missing", near.alias("distinct_near"), median.alias("median_near"), top.alias("top_near"))


PART = {"p_partkey": "p_partkey::VARCHAR", "p_name": "p_name", "p_brand": "p_brand", "p_type": "p_type", "p_size": "p_size::VARCHAR", "p_retailprice": "p_retailprice::DECIMAL(38,4)::VARCHAR"}


def top_sql(table: str, cols: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", string_agg(v, '|' ORDER BY n DESC, v) AS top FROM (SELECT {e} AS v, count(*) AS n FROM {table} WHERE {e} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 5)""" for c, e in cols.items()
    )


@query(top_sql("part", PART))
def o4_top_values(spark, sf_dir):
    return pf.profile(t(spark, sf_dir, "part")).select("column", F.array_join("top_values", "|").alias("top"))


@query("SELECT ((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem)))::BIGINT AS duplicates")
def a6_duplicate_rows(spark, sf_dir):
    return pf.duplicate_rows(t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))


@query("""WITH p AS (UNPIVOT (SELECT count(*) - count(CASE WHEN c_acctbal > 9000 THEN c_name END) AS c_name, count(*) - count(c_mktsegment) AS c_mktsegment, count(*) - count(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END) AS c_acctbal,
    count(*) - count(c_custkey) AS c_custkey, 0::BIGINT AS one FROM customer) ON COLUMNS(*) INTO NAME "column" VALUE missing) SELECT "column", 'mostly missing' AS issue FROM p WHERE missing >= 0.5 * (SELECT count(*) FROM customer)
    UNION ALL SELECT 'one', 'constant'""")
def a7_quality_lists(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    some = c.select("c_custkey", F.when(F.col("c_acctbal") > 9000, F.col("c_name")).alias("c_name"), F.lit(1).alias("one"), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("c_acctbal"))
    return pf.quality_lists(pf.profile(some))


@query(" UNION ALL ".join(f"""SELECT * FROM (SELECT '{c}' AS "column", CASE WHEN count(DISTINCT {c}) / count(*) < 0.01 THEN 'partition' WHEN count(DISTINCT {c}) / count(*) < 0.5 THEN 'cluster' ELSE 'bucket' END AS advice
    FROM part HAVING count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) < count(*))""" for c in PART if c != "p_partkey"))
def t4_cluster_advice(spark, sf_dir):
    return pf.cluster_advice(pf.profile(t(spark, sf_dir, "part")), "p_partkey")


@query(r"""WITH s AS (SELECT count(*) AS n, count(DISTINCT c_name) AS dn, count(DISTINCT c_nationkey) AS dk, count(DISTINCT c_acctbal) AS da, count(DISTINCT c_mktsegment) AS dm FROM customer)
    SELECT 'columns' AS section, '| `c_nationkey` |' AS head, format('{:,}', dk) AS distinct_values, 'NO' AS nullable FROM s UNION ALL SELECT 'columns', '| `c_name` |', format('{:,}', dn), 'NO' FROM s
    UNION ALL SELECT 'columns', '| `c_acctbal` |', format('{:,}', da), 'NO' FROM s UNION ALL SELECT 'columns', '| `c_mktsegment` |', format('{:,}', dm), 'NO' FROM s UNION ALL SELECT 'columns', '| `c_custkey` |', format('{:,}', n), 'NO' FROM s
    UNION ALL SELECT 'overview', '- Rows: **' || format('{:,}', n) || '**', NULL, NULL FROM s UNION ALL SELECT 'overview', '- Columns: **5**', NULL, NULL
    UNION ALL SELECT 'quality', '- Duplicate rows (exact): **0**', NULL, NULL""")
def t6_report(spark, sf_dir):
    rows = pf.report_rows(t(spark, sf_dir, "customer"), "customer", "c_custkey")
    cells = F.split("line", r" \| ")
    column = F.col("line").startswith("| `")
    shown = rows.where(column | F.col("line").rlike(r"^- (Rows|Columns|Duplicate)"))
    cell = lambda k: F.when(column, F.element_at(cells, k))
    return shown.select("section", F.when(column, F.concat(F.element_at(cells, 1), F.lit(" |"))).otherwise(F.col("line")).alias("head"), cell(5).alias("distinct_values"), cell(3).alias("nullable"))


KEY = "a secret of tests"


def hmac_sql(value: str) -> str:
    """HMAC by its definition: two hashes over padded keys."""
    raw = KEY.encode().ljust(64, b"\0")
    pad = lambda x: "from_hex('" + bytes(b ^ x for b in raw).hex() + "')"
    return f"sha256({pad(0x5C)} || from_hex(sha256({pad(0x36)} || encode({value}))))"


@query(f"SELECT c_custkey, {hmac_sql('c_name')} AS digest FROM customer")
def i2_hmac(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", pii.hmac_hex(F.col("c_name"), KEY).alias("digest"))


@query(f"SELECT DISTINCT 'c_name' AS \"column\", c_name AS original, substr({hmac_sql('c_name')}, 1, 16) AS token FROM customer WHERE NOT regexp_matches(c_name, '^[A-Z][a-z]+( [A-Z][a-z]+)+$')")
def i9_mapping(spark, sf_dir):
    return pii.build_mapping(t(spark, sf_dir, "customer"), ["c_name"], KEY)


@query(f"SELECT c_custkey, c_name AS restored, substr({hmac_sql('c_name')}, 1, 16) AS hidden FROM customer")
def i10_restore(spark, sf_dir):
    """Besides what comes back, the pseudonym in between, so that doing nothing doesn't pass."""
    c = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    hidden, mapping = pii.pseudonymize(c, ["c_name"], KEY)
    back = pii.restore(hidden, mapping, ["c_name"]).select("c_custkey", F.col("c_name").alias("restored"))
    return back.join(hidden.select("c_custkey", F.col("c_name").alias("hidden")), "c_custkey")


TOKENS = """WITH l AS MATERIALIZED (SELECT doc_id, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS t, generate_subscripts(string_split(replace(text, chr(13), ''), chr(10)), 1) - 1 AS line FROM documents),
w AS MATERIALIZED (SELECT doc_id, line, list_filter(regexp_split_to_array(t, '[ \\t]+'), lambda x: x <> '') AS ws FROM l), tok AS MATERIALIZED (SELECT doc_id, line, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w)"""
VOCAB = f"{TOKENS}, v AS MATERIALIZED (SELECT '</s>' AS word, (SELECT count(*) FROM l) AS cn UNION ALL SELECT word, count(*) FROM tok WHERE word <> '</s>' GROUP BY word HAVING count(*) >= 5)"


def lines(spark, sf_dir):
    return vectors.line_words(t(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"{VOCAB} SELECT word, cn, (row_number() OVER (ORDER BY word <> '</s>', cn DESC, word))::INT AS rank FROM v")
def e1_vocab(spark, sf_dir):
    return vectors.vocab(lines(spark, sf_dir))


@query(f"{TOKENS} SELECT word, next, count(*) AS n FROM (SELECT word, lead(word) OVER (PARTITION BY doc_id ORDER BY line, pos) AS next FROM tok) WHERE next IS NOT NULL GROUP BY 1, 2")
def e2_bigrams(spark, sf_dir):
    return vectors.bigrams(lines(spark, sf_dir))


@query(f"""{TOKENS}, s AS MATERIALIZED (SELECT word, count(*) AS c FROM tok GROUP BY 1 HAVING count(*) >= 5), n AS MATERIALIZED (SELECT count(*) AS n FROM tok),
    p AS MATERIALIZED (SELECT word, next, count(*) AS k FROM (SELECT word, lead(word) OVER (PARTITION BY doc_id ORDER BY line, pos) AS next FROM tok) WHERE next IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 5),
    x AS (SELECT p.word, next, (k - 5) / a.c / b.c * n AS score FROM p JOIN s a ON p.word = a.word JOIN s b ON p.next = b.word, n) SELECT word, next, round(score, 4) AS score FROM x WHERE score > 1""")
def e3_phrase_scores(spark, sf_dir):
    return vectors.phrase_scores(lines(spark, sf_dir), 5, 1.0).select("word", "next", F.round("score", 4).alias("score"))


@query()
def e4_w14_phrases(spark, sf_dir):
    return vectors.phrase_passes(lines(spark, sf_dir), "doc_id", [5.0, 2.0]).select("doc_id", F.array_join(F.transform("lines", lambda x: F.array_join(x, " ")), "\n").alias("text"))


@query(f"{VOCAB}, n AS (SELECT sum(cn) AS n FROM v) SELECT word, round(least(1.0, (sqrt(cn / (0.001 * n)) + 1) * (0.001 * n) / cn), 6) AS p FROM v, n")
def e5_keep_probability(spark, sf_dir):
    v = vectors.vocab(lines(spark, sf_dir))
    total = v.agg(F.sum("cn")).first()[0]
    return v.select("word", F.round(vectors.keep_probability(F.col("cn"), total), 6).alias("p"))


@query(f"{VOCAB}, n AS MATERIALIZED (SELECT sum(cn ** 0.75) AS n FROM v), r AS (SELECT word, cn ** 0.75 / n AS p, row_number() OVER (ORDER BY word <> '</s>', cn DESC, word) AS rank FROM v, n) SELECT word, round(p, 8) AS p, round(sum(p) OVER (ORDER BY rank), 6) AS upper FROM r")
def e6_noise_distribution(spark, sf_dir):
    return vectors.noise_distribution(vectors.vocab(lines(spark, sf_dir))).select("word", F.round("p", 8).alias("p"), F.round("upper", 6).alias("upper"))


@query(f"""{TOKENS}, a AS MATERIALIZED (SELECT *, ('0x' || substr(md5('1:' || doc_id || ':' || line || ':' || pos), 1, 8))::BIGINT % 5 + 1 AS reach FROM tok), o AS (SELECT *, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS d FROM a)
    SELECT o.word AS center, b.word AS context, count(*) AS n FROM o JOIN tok b ON b.doc_id = o.doc_id AND b.line = o.line AND b.pos = o.pos + o.d WHERE abs(d) <= reach GROUP BY 1, 2""")
def e7_context_pairs(spark, sf_dir):
    return vectors.context_pair_counts(lines(spark, sf_dir), "doc_id")


def vecs(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


UNITS = "WITH u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS u FROM embeddings)"


@query(f"""{UNITS}, s AS (SELECT a.id AS query_id, b.id, round(list_dot_product(a.u, b.u), 12) AS score FROM u a JOIN u b ON a.id % 50 = 0 AND b.id <> a.id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score FROM r WHERE rank <= 40""")
def e10_nearest(spark, sf_dir):
    v = vecs(spark, sf_dir)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.array("id").alias("ids"))
    return vectors.nearest(v, q).select("query_id", "id", F.round("score", 6).alias("score"))


@query(f"""{UNITS}, q AS (SELECT a.id AS query_id, a.id AS a, b.id AS b, c.id AS c, list_transform(list_zip(a.u, b.u, c.u), lambda x: x[2] - x[1] + x[3]) AS q FROM u a JOIN u b ON b.id = a.id + 1 JOIN u c ON c.id = a.id + 2 WHERE a.id % 50 = 0),
    s AS (SELECT query_id, u.id, round(list_dot_product(q, u), 12) AS score FROM q JOIN u ON u.id NOT IN (a, b, c)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score > 0)
    SELECT query_id, id, round(score, 6) AS score FROM r WHERE rank <= 40""")
def e11_analogies(spark, sf_dir):
    v = vecs(spark, sf_dir)
    q = v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.col("id") + 2).alias("c"))
    return vectors.analogies(v, q).select("query_id", "id", F.round("score", 6).alias("score"))


def kmeans_sql(k: int, rounds: int) -> str:
    """Each round: sums by cluster and place, their lengths, the largest product."""
    out = f"WITH x AS MATERIALIZED (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), a0 AS MATERIALIZED (SELECT vec_id AS id, (row_number() OVER (ORDER BY vec_id) - 1) % {k} AS c FROM embeddings)"
    for r in range(1, rounds + 1):
        out += f""", s{r} AS MATERIALIZED (SELECT c, p, sum(x) AS s FROM x JOIN a{r - 1} USING (id) GROUP BY 1, 2), n{r} AS MATERIALIZED (SELECT c, p, s / sqrt(sum(s * s) OVER (PARTITION BY c)) AS s FROM s{r}),
        d{r} AS MATERIALIZED (SELECT id, c, sum(x * s) AS d FROM x JOIN n{r} USING (p) GROUP BY 1, 2), a{r} AS MATERIALIZED (SELECT id, arg_max(c, d) AS c FROM d{r} GROUP BY 1)"""
    return out + f" SELECT id, c::INT AS cluster FROM a{rounds}"


@query(kmeans_sql(8, 10))
def e13_spherical_kmeans(spark, sf_dir):
    return vectors.spherical_kmeans(vecs(spark, sf_dir), 8)


#: Regions, nations, customers, orders: a tree that grows with the tables.
PLACES = """WITH e AS MATERIALIZED (SELECT 'world' AS parent, r_name AS child FROM region UNION ALL SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_name, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def places(spark, sf_dir):
    n, r = t(spark, sf_dir, "nation"), t(spark, sf_dir, "region")
    c = t(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    named = lambda x, k: F.concat(F.lit(x), F.col(k).cast("string"))
    below = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    low = c.select(F.col("n_name").alias("parent"), named("c", "c_custkey").alias("child")).unionByName(t(spark, sf_dir, "orders").select(named("c", "o_custkey").alias("parent"), named("o", "o_orderkey").alias("child")))
    return r.select(F.lit("world").alias("parent"), F.col("r_name").alias("child")).unionByName(below).unionByName(low)


@query("SELECT DISTINCT 'c' || o_custkey AS parent FROM orders")
def g2_roots(spark, sf_dir):
    named = lambda x, k: F.concat(F.lit(x), F.col(k).cast("string"))
    o, li = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    edges = o.select(named("c", "o_custkey").alias("parent"), named("o", "o_orderkey").alias("child")).unionByName(li.select(named("o", "l_orderkey").alias("parent"), named("p", "l_partkey").alias("child")))
    return trees.roots(edges)


@query(f"""{PLACES}, r AS (SELECT DISTINCT parent AS node FROM e WHERE parent NOT IN (SELECT child FROM e)), x AS (WITH RECURSIVE d AS (SELECT node, 0 AS depth, node AS path FROM r
    UNION ALL SELECT child, depth + 1, path || '>' || child FROM d JOIN e ON parent = node) SELECT * FROM d) SELECT node, depth, path FROM x""")
def g4_expand(spark, sf_dir):
    e = places(spark, sf_dir)
    return trees.expand(e, trees.roots(e)).select("node", "depth", F.array_join("path", ">").alias("path"))


@query("""SELECT DISTINCT parent, child FROM (SELECT '' AS parent, p_brand AS child FROM part JOIN lineitem ON p_partkey = l_partkey UNION ALL SELECT p_brand, p_type FROM part JOIN lineitem ON p_partkey = l_partkey
    UNION ALL SELECT p_type, l_suppkey::VARCHAR FROM part JOIN lineitem ON p_partkey = l_partkey)""")
def g8_level_rows(spark, sf_dir):
    p, li = t(spark, sf_dir, "part"), t(spark, sf_dir, "lineitem")
    return trees.level_rows(p.join(li, p["p_partkey"] == li["l_partkey"]), ["p_brand", "p_type", "l_suppkey"])


SPANS = """WITH s AS (SELECT l_orderkey * 10 AS node, NULL::BIGINT AS parent, 0.0 AS elapsed FROM (SELECT DISTINCT l_orderkey FROM lineitem)
    UNION ALL SELECT l_orderkey * 10 + l_linenumber, CASE WHEN l_linenumber = 1 THEN l_orderkey * 10 ELSE l_orderkey * 10 + 1 END, max(l_quantity) FROM lineitem GROUP BY 1, l_orderkey, l_linenumber)"""


@query(f"""{SPANS}, p AS (SELECT a.node AS ancestor, b.elapsed AS e FROM s a JOIN s b ON b.parent = a.node UNION ALL SELECT a.node, c.elapsed FROM s a JOIN s b ON b.parent = a.node JOIN s c ON c.parent = b.node),
    m AS (SELECT ancestor, max(e) AS b FROM p GROUP BY 1), x AS (SELECT node, CASE WHEN elapsed = 0 THEN coalesce(b, 0) ELSE elapsed END AS total, coalesce(b, 0) AS b FROM s LEFT JOIN m ON node = ancestor)
    SELECT node, total, greatest(0, total - b) AS self_time, greatest(0, total - b) * 100.0 / (SELECT max(total) FROM x) AS percent FROM x""")
def g9_span_self_time(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    top = F.col("l_orderkey") * 10
    below = li.groupBy((top + F.col("l_linenumber")).alias("node"), F.when(F.col("l_linenumber") == 1, top).otherwise(top + 1).alias("parent")).agg(F.max("l_quantity").alias("elapsed"))
    spans = li.select(top.alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0.0).alias("elapsed")).distinct().unionByName(below)
    return trees.span_self_time(spans, "node", "parent", "elapsed")


@query("""SELECT l_orderkey AS node_id, sum(l_quantity) AS rows, sum(l_quantity * (l_linenumber + 8)) AS rows_read, sum(l_tax) AS cpu_ms, max(l_discount) AS elapsed_ms, sum(l_quantity) / sum(l_quantity * (l_linenumber + 8)) < 0.1 AS selective FROM lineitem GROUP BY 1""")
def g11_a19_node_counters(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem")
    return trees.node_counters(li.select(F.col("l_orderkey").alias("node_id"), F.col("l_quantity").alias("rows"), (F.col("l_quantity") * (F.col("l_linenumber") + 8)).alias("rows_read"), F.col("l_tax").alias("cpu_ms"), F.col("l_discount").alias("elapsed_ms")))


@query(r"""WITH k AS (SELECT n_name AS name FROM nation UNION SELECT lang FROM documents WHERE lang IS NOT NULL UNION SELECT source FROM documents WHERE source IS NOT NULL),
    b AS MATERIALIZED (SELECT doc_id::VARCHAR AS parent, lower(regexp_replace(text, '--[^\n]*(\n|$)|/\*(.|\n)*?\*/', ' ', 'g')) AS body FROM documents)
    SELECT parent, name AS child FROM b JOIN k ON contains(body, lower(name)) AND NOT contains(parent, lower(name))""")
def j12_g1_mentions(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    names = t(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(d.select("lang")).union(d.select("source"))
    return trees.mention_edges(d.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body")), names)


@query("""SELECT p_partkey, coalesce(n_name, 'Strong ' || regexp_extract(p_brand, '(\\d+)', 1)::INT || '; morph ' || p_brand) AS definition FROM part LEFT JOIN nation ON n_nationkey = regexp_extract(p_brand, '(\\d+)', 1)::INT""")
def j13_with_fallback(spark, sf_dir):
    lookup = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("definition"))
    return trees.with_fallback(t(spark, sf_dir, "part"), "p_brand", lookup).select("p_partkey", "definition")
