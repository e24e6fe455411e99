"""Small cases for rules that the queries on the tables don't reach, and files written and read back."""

import base64
import hashlib
import hmac
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import diff, pii, rows, sequence, trees, vectors
from sparkloom.operators import profile as pf
from sparkloom.plans import ingest
from sparkloom.sources import files


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_diff_with_null_keys(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "z")], "k int, v string")
    got = {(r.k, r.change_type, r.v) for r in diff.diff_wide(a, b, ["k"]).collect()}
    assert got == {(1, "Changed", "x <--> z"), (None, "Added", "y <--> NULL")}


def test_deny_conflicts(spark):
    p = spark.createDataFrame([("u", "GRANT", "SELECT", "s", "t"), ("U", "DENY", "select", "s", None), ("w", "GRANT", "SELECT", "s", "t")], "who string, state string, perm string, sch string, obj string")
    got = diff.deny_conflicts(p, ["who", "perm"], [["sch"]]).collect()
    assert [(r.who, r.deny_scope) for r in got] == [("u", 0)]


def test_headers_and_pace(spark):
    assert rows.header_problems(["a", "A", "", "Unnamed: 3"]) == ["A is there twice", "column 3 has no name", "column 4 has no name"]
    rng = random.Random(2)
    due = [rng.randrange(400) for _ in range(60)]
    got = sequence.pace(spark.createDataFrame([(1, i, d) for i, d in enumerate(due)], "g int, i int, due int"), ["g"], "i", "due", 50).orderBy("i").collect()
    tick, want = -1, []
    for d in due:
        tick = max(tick + 1, -(-d // 50))
        want.append(tick * 50)
    assert [r.tick for r in got] == want


def test_pack_rows_equals_the_loop(spark):
    rng = random.Random(4)
    data = [(g, i, rng.randrange(6)) for g in range(20) for i in range(30)]
    got = {(r.g, r.i): r.row_no for r in sequence.pack_rows(spark.createDataFrame(data, "g int, i int, s int"), ["g"], ["i"], "s").collect()}
    for g in range(20):
        row, last = 0, 99
        for _, i, s in [x for x in data if x[0] == g]:
            row += s <= last
            last = s
            assert got[g, i] == row


def test_hmac_and_modulo(spark):
    digest = hmac.new(b"key", "väl".encode(), hashlib.sha256).hexdigest()
    assert one(spark, pii.hmac_hex(F.lit("väl"), "key")) == digest
    assert one(spark, pii.modulo(F.lit(digest), 997)) == int(digest, 16) % 997


def test_pseudonyms(spark):
    df = spark.createDataFrame([(1, "a.b@c.de", "+49 (30) 123-4567", "2020-01-31", "Berlin"), (2, None, "030 555 1234", "1999-12-01", "Rome")], "id long, mail string, phone string, day string, city string")
    assert pii.detect_pii(df, "id") == ["mail", "phone"]
    hidden, mapping = pii.pseudonymize(df, ["mail", "phone", "day", "city"], "k")
    r = hidden.orderBy("id").collect()
    assert r[0].mail.endswith("@example.org") and r[1].mail is None and r[0].city in pii.CITIES
    assert [c if not c.isdigit() else "9" for c in r[0].phone] == [c if not c.isdigit() else "9" for c in "+49 (30) 123-4567"]
    assert r[0].day[4] == "-" and len(r[0].day) == 10
    assert pii.collisions(mapping).count() == 0
    assert [x.phone for x in pii.restore(hidden, mapping, ["phone"]).orderBy("id").collect()] == ["+49 (30) 123-4567", "030 555 1234"]


def test_text_functions(spark):
    assert one(spark, tx.morphemes(F.lit("unhelpfulness"))) == ["un", "help", "fulness"]
    assert one(spark, tx.morphemes(F.lit("rethinkingly's"))) == ["re", "think", "ingly", "'s"]
    assert [one(spark, tx.lemma(F.lit(w))) for w in ("ponies", "boxes", "cats", "tried", "stopped", "running", "went")] == ["pony", "box", "cat", "try", "stopp", "run", "go"]
    sid = bytes([1, 2, 0, 0, 0, 0, 0, 5]) + (32).to_bytes(4, "little") + (544).to_bytes(4, "little")
    assert one(spark, tx.sid_text(F.lit(bytearray(sid)))) == "S-1-5-32-544"
    raw = bytes(range(250))
    assert one(spark, tx.url_base64(F.lit(bytearray(raw)))) == base64.urlsafe_b64encode(raw).decode().rstrip("=")
    assert bytes(one(spark, tx.unurl_base64(tx.url_base64(F.lit(bytearray(raw)))))) == raw
    assert one(spark, tx.looks_like_sql(F.lit("-- x\nselect 1"))) and not one(spark, tx.looks_like_sql(F.lit("print(1)")))
    assert one(spark, tx.html_text(F.lit("<p>a&nbsp;<b>b</b></p><script>x</script>"))) == "a b"


def test_types_and_keys(spark):
    df = spark.createDataFrame([("1", "1.50", "2020-01-01", "yes", "x", "300"), ("2", "22.25", "2020-02-01", "no", "yy", "70000")], "a_id string, d string, t string, b string, s string, i string")
    types = pf.infer_types(df)
    assert types == {"a_id": "TINYINT", "d": "DECIMAL(4,2)", "t": "DATETIME2(3)", "b": "BIT", "s": "NVARCHAR(2)", "i": "INT"}
    assert pf.key_candidates(pf.profile(df), types)[0][0] == "a_id"
    assert pf.spreadsheet_types(df)["d"] == "FLOAT" and pf.spreadsheet_types(df)["s"] == "NVARCHAR(255)"
    assert "`d` DECIMAL(4,2)" in pf.create_table_ddl("x", types)


def test_phrases_equal_the_loop(spark):
    rng = random.Random(7)
    lines = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(40)]
    pairs = {("a", "b"), ("b", "a"), ("a", "a")}
    got = vectors.join_phrases(spark.createDataFrame([(1, lines)], "doc int, lines array<array<string>>"), "doc", spark.createDataFrame(list(pairs), "word string, next string")).first().lines
    for i, ws in enumerate(lines):
        want, k = [], 0
        while k < len(ws):
            joined = k + 1 < len(ws) and (ws[k], ws[k + 1]) in pairs
            want.append(f"{ws[k]}_{ws[k + 1]}" if joined else ws[k])
            k += 1 + joined
        assert got[i] == want


def test_trees(spark):
    lines = spark.createDataFrame([(1, "a"), (2, "\tb"), (3, "\t\tc"), (4, "\td"), (5, "e")], "n int, t string")
    assert [r.parent_line for r in trees.indent_to_edges(lines, "n", F.col("t")).orderBy("n").collect()] == [None, 1, 2, 1, None]
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "node int, parent int")
    assert {(r.parent, r.child) for r in trees.collapse_tree(nodes, "node", "parent", F.col("node").isin(1, 3, 4)).collect()} == {(1, 3), (3, 4)}
    edges = spark.createDataFrame([("P", "MATH 1"), ("P", "MATH 2"), ("P", "ART 1"), ("P", "other")], "parent string, child string")
    got = {(r.parent, r.child) for r in trees.insert_groups(edges, r"\d$", F.regexp_extract("child", r"^(\w+)", 1)).collect()}
    assert got == {("P", "MATH Courses #0001"), ("P", "ART Courses #0001"), ("MATH Courses #0001", "MATH 1"), ("MATH Courses #0001", "MATH 2"), ("ART Courses #0001", "ART 1"), ("P", "other")}


def test_files(spark, tmp_path, sf_dir):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes('k,v\r\n1,"x ""y"" é"\r\n'.encode())
    (tmp_path / "in/b.csv").write_bytes("k,v\n2,caf\xe9\n".encode("cp1252"))
    assert {r.path.rsplit("/", 1)[1]: (r.encoding, r.terminator) for r in files.encodings(spark, str(tmp_path / "in")).collect()} == {"a.csv": ("utf-8", "CRLF"), "b.csv": ("cp1252", "LF")}
    assert {(r.k, r.v) for r in files.read_csv(spark, str(tmp_path / "in")).collect()} == {("1", 'x "y" é'), ("2", "café")}
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    files.export_chunks(o, str(tmp_path / "chunks"), 400, ["o_orderkey"])
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "chunks")).groupBy("chunk").count().orderBy("chunk").collect()]
    assert set(sizes[:-1]) == {400} and sum(sizes) == o.count()
    nested = spark.createDataFrame([((1, ("x",)),)], "a struct<b:int,c:struct<d:string>>")
    assert files.flatten(nested).columns == ["a.b", "a.c.d"]
    v = spark.createDataFrame([("w", [1.0, 2.5])], "word string, vec array<float>")
    files.save_vectors(v, str(tmp_path / "v"), text=True)
    assert files.load_vectors(spark, str(tmp_path / "v"), text=True).collect() == v.collect()


def test_loads(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, g string")
    first, second = str(tmp_path / "t1"), str(tmp_path / "t2")
    a.write.parquet(first)
    b = spark.createDataFrame([(1, "x"), (4, "x"), (3, "y")], "id int, g string")
    assert not ingest.load_table(a, first, second)
    assert ingest.load_table(b, first, second, F.col("g") == "x")
    assert {r.id for r in spark.read.parquet(second).collect()} == {1, 3, 4}
    assert [r.g for r in ingest.changed_groups(b, a, "g").collect()] == ["x"]


def test_huffman_codes_are_prefix_free_and_shortest(spark):
    from sparkloom.operators import embed

    vocabulary = spark.createDataFrame([(w, c, k) for k, (w, c) in enumerate([("a", 50), ("b", 20), ("c", 20), ("d", 9), ("e", 1)], 1)], "word string, cn long, rank int")
    got = {r.word: r for r in embed.huffman(vocabulary).collect()}
    codes = ["".join(map(str, r.code)) for r in got.values()]
    assert not any(x != y and y.startswith(x) for x in codes for y in codes)
    assert sum(r.cn * len(r.code) for r in got.values()) == 50 + 2 * 20 + 3 * 20 + 4 * 9 + 4 * 1
    assert all(r.point[0] == 3 and len(r.point) == len(r.code) for r in got.values())


def as_lines(tokens):
    each = tokens.groupBy("doc", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("ws"))
    return each.groupBy("doc").agg(F.collect_list("ws").alias("lines"))


@pytest.mark.parametrize("cbow,negative,softmax", [(True, 5, False), (False, 5, False), (True, 0, True), (False, 0, True)])
def test_vectors_tell_two_topics_apart(spark, cbow, negative, softmax):
    from sparkloom.operators import embed

    rng = random.Random(3)
    topics = (["ash", "elm", "oak", "fir"], ["cod", "eel", "ray", "carp"])
    rows = [(k, 0, p, w) for k in range(600) for p, w in enumerate(rng.choices(topics[k % 2], k=8))]
    tokens = spark.createDataFrame(rows, "doc int, line int, pos int, word string")
    made = embed.train(tokens, "doc", vectors.vocab(as_lines(tokens), 1), size=16, window=3, cbow=cbow, negative=negative, softmax=softmax, rate=0.1, epochs=8, parts=2)
    v = {r.word: np.array(r.vector) / np.linalg.norm(r.vector) for r in made.collect()}
    inside = min(v["ash"] @ v["elm"], v["oak"] @ v["fir"], v["cod"] @ v["eel"], v["ray"] @ v["carp"])
    across = max(v["ash"] @ v["cod"], v["oak"] @ v["eel"], v["fir"] @ v["ray"])
    assert inside > across + 0.2


def test_analogy_answers(spark):
    from sparkloom.operators import embed

    v = spark.createDataFrame([("man", [1.0, 0.0, 0.1]), ("woman", [1.0, 1.0, 0.1]), ("king", [0.1, 0.0, 1.0]), ("queen", [0.1, 1.0, 1.0])], "word string, vector array<double>").withColumn("rank", F.monotonically_increasing_id())
    q = spark.createDataFrame([(1, "s", 1, "man", "woman", "king", "queen"), (2, "s", 1, "man", "woman", "king", "lost")], "query_id int, section string, section_no int, a string, b string, c string, expected string")
    assert {(r.query_id, r.known, r.correct) for r in embed.analogy_answers(v, q).collect()} == {(1, True, True), (2, False, False)}


def test_row_numbers_with_ties_nulls_and_text(spark):
    from sparkloom.operators.sequence import with_row_number

    rows = [(k % 3 and f"g{k % 7}" or None, k) for k in range(500)]
    got = with_row_number(spark.createDataFrame(rows, "g string, k int"), ["g", "k"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.g, r.k) for r in sorted(got, key=lambda r: r._row)] == want and sorted(r._row for r in got) == list(range(1, 501))
    assert with_row_number(spark.createDataFrame([], "g string"), ["g"]).count() == 0


def test_row_mail(spark):
    df = spark.createDataFrame([(1, "a@x.org", "Ann", "Lee"), (2, "a@x.org", "Bob", "Ray"), (3, None, "C", "D"), (4, "b@x.org", None, None)], "n int, mail string, fn string, ln string")
    got = {r.original: r.token for r in pii.row_mail_mapping(df, "mail", "fn", "ln", "n", "k").collect()}
    first = df.where("n = 1").select(pii.token(F.col("fn"), "first_name", "k"), pii.token(F.col("ln"), "last_name", "k")).first()
    assert got["a@x.org"].startswith(f"{first[0]}.{first[1]}".lower()) and got["b@x.org"].startswith("user") and len(got) == 2


def test_failure_runs_over_two_batches(spark, tmp_path):
    from sparkloom.streaming import status

    src = tmp_path / "src"
    src.mkdir()
    (src / "0.csv").write_text("a,2024-01-01 00:00:00,true\na,2024-01-01 00:01:00,false\nb,2024-01-01 00:01:00,false\n")
    stream = spark.readStream.schema("k string, ts timestamp, ok boolean").option("maxFilesPerTrigger", 1).csv(str(src))
    runs = status.failure_runs(stream, "k", "ts", F.col("ok"))
    (src / "1.csv").write_text("a,2024-01-01 00:02:00,\nb,2024-01-01 00:03:00,true\nb,2024-01-01 00:02:00,false\n")
    last = status.drained(runs, "update").groupBy("key").agg(F.max_by("failures", "batch").alias("f"))
    assert {(r.key, r.f) for r in last.collect()} == {("a", 2), ("b", 0)}


def plain_lemma(w):
    if w in tx.IRREGULAR:
        return tx.IRREGULAR[w]
    ends = w.endswith
    if ends("ies") and not ends("eies") and len(w) > 4:
        return w[:-3] + "y"
    if ends(("ses", "xes", "zes")) and len(w) > 3:
        return w[:-2]
    if ends("s") and not ends("ss") and len(w) > 2:
        return w[:-1]
    if ends("ied") and len(w) > 4:
        return w[:-3] + "y"
    if ends("ed") and len(w) > 3:
        return w[:-2]
    if ends("ing") and len(w) > 4:
        stem = w[:-3]
        return stem[:-1] if len(stem) > 3 and stem[-1] == stem[-2] else stem
    return w


def plain_morphemes(w):
    clitic = next((c for c in tx.CLITICS if w.endswith(c) and len(w) >= len(c) + 2), "")
    root = w[: len(w) - len(clitic)]
    prefix = max((p for p in tx.PREFIXES if root.startswith(p) and len(root) >= len(p) + 3), key=len, default="")
    root, ends = root[len(prefix) :], []
    while suffix := max((s for s in tx.SUFFIXES if root.endswith(s) and len(root) >= len(s) + 3), key=len, default=""):
        root, ends = root[: -len(suffix)], [suffix, *ends]
    kept = [m for m in (prefix, root, *ends, clitic) if len(m) > 1 or m in ("i", "a")]
    return kept or [w]


def test_lemmas_and_morphemes_equal_plain_code(spark, sf_dir):
    rng = random.Random(9)
    parts = [*tx.PREFIXES, *tx.SUFFIXES, *tx.CLITICS, "run", "runn", "class", "box", "fizz", "t", "a", "eies", "x'y", "0"]
    made = {"".join(rng.choices(parts, k=rng.randrange(1, 5))) for _ in range(4000)} | set(tx.IRREGULAR) | {"running", "falling", "sing", "boxes", "i", "b", "qed", "yyyyyyyyyyyyyyyyyyyyy" * 9}
    words = spark.createDataFrame([(w,) for w in made], "w string")
    for r in words.select("w", tx.lemma(F.col("w")).alias("l"), tx.morphemes(F.col("w")).alias("m")).collect():
        assert r.l == plain_lemma(r.w) and r.m == plain_morphemes(r.w), r.w
    counts = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        text = r.text
        for pattern, to in tx.MARKUP:
            text = re.sub(pattern, to.replace("$1", r"\1"), text)
        for w in re.findall(tx.TOKEN, text.lower().replace("-", " ").replace("_", " ")):
            for m in plain_morphemes(w):
                counts[m] = counts.get(m, 0) + 1
    from sparkloom.catalog import QUERIES

    assert {r.term: r["count"] for r in QUERIES["a10_morpheme_counts"](spark, sf_dir).collect()} == counts


def test_cleaning_rules(spark):
    from sparkloom.catalog_text import FILES

    wiki = "<page><text xml>[[Category:Cats|x]] a [[Image:b.jpg|thumb|200px|A ''cat'']] {{icon|x}} [http://x.org/a label] [[de:Katze]] [[Felis|cat]] &amp;nbsp; &lt;ref name=a&gt;no&lt;/ref&gt; {|table}</text>"
    assert one(spark, tx.strip_wiki(F.lit(wiki))).split() == ["Cats", "a", "A", "''cat''", "label", "cat"]
    feed = "<b>Changed Status from Open to Closed.</b>Merged tickets (x): hi\\r\\n  there&#39;s &lt;a&gt; &quot;b&quot; &amp;amp; [Created from mail]"
    assert one(spark, tx.clean_ticket(F.lit(feed))) == " hi there's <a> \"b\" &amp; "
    places = {
        "/a/photo.PNG": "Images", "x.iso": "Software", "y.bak": "Backups", "novel.pdf": "Reading", "tuition.pdf": "Work", "course.md": "Reading", "q.sql": "Work", "oauth.docx": "Work/Identity",
        "neuron.json": None, "neural.json": "Data/Learning", "revenue.json": "Data/Finance", "zzz": None, ".pdf": None,
    }
    for path, place in places.items():
        assert one(spark, tx.file_place(F.lit(path), FILES)) == place, path


def test_calendar_tables(spark):
    lines = ["      Jan 24 13:07 P    Jan  2 22:31      Jan  9 20:24 t    Jan 16 12:35", " 2001 Jan 24 13:07 P    Jan  2 22:31      Jan  9 20:24 t    Jan 16 12:35", "                                     Feb  8 07:12", " 1999 Mar  1 02:03"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "b int, k int, x string")
    got = [tuple(r)[1:] for r in tx.phase_events(df, "x", "k", ["b"]).orderBy("k", "month", "day").collect()]
    assert got == [(1, 2001, "first", 1, 2, "22:31", ""), (1, 2001, "full", 1, 9, "20:24", "t"), (1, 2001, "last", 1, 16, "12:35", ""), (1, 2001, "new", 1, 24, "13:07", "P"), (2, 2001, "full", 2, 8, "07:12", ""), (3, 2001, "new", 3, 1, "02:03", "")]
    rows = ["2001  Jan 10  9:01", "2001  Jan 10 09:01 357132 + ", "  Jan 24 19:05 406565 M 3.5  Feb  7 22:20 356853", "Feb 20 21:45 406336 m", "Mar  8 01:01 350000 Mar 9 02:02 351000"]
    df = spark.createDataFrame([(1, k, x) for k, x in enumerate(rows)], "b int, k int, x string")
    got = {r.k: (r.perigee and (r.perigee.day, r.perigee.distance), r.apogee and (r.apogee.day, r.apogee.distance, r.apogee.flag)) for r in tx.distance_rows(df, "x", "k", ["b"]).collect()}
    assert got == {1: ((10, 357132), None), 2: ((7, 356853), (24, 406565, "M")), 3: (None, (20, 406336, "m")), 4: ((9, 351000), None)}
    text = "x 2001 Jun 21 12:04:46 64 17 127 T -n 2001 Dec 14 20:53:01 64 19 132 A 2003 May 31 04:09:22 64 43 147 Hm 2004 May 04 20:31:17 64 54 121 N"
    df = spark.createDataFrame([(1, text)], "k int, x string")
    assert [tuple(r)[1:] for r in tx.eclipse_days(df, ["k"], "x").collect()] == [(2001, 6, 21, "T"), (2001, 12, 14, "A"), (2003, 5, 31, "A")]


def test_ten_thousand_names_come_back(spark):
    rng = random.Random(1)
    names = {f"{''.join(rng.choices('abcdefgh', k=5)).capitalize()} {''.join(rng.choices('klmnop', k=4)).capitalize()}" for _ in range(10_500)}
    df = spark.createDataFrame(list(enumerate(sorted(names)[:10_000])), "k int, full string").withColumn("first_name", F.col("full"))
    hidden, mapping = pii.pseudonymize(df, ["full", "first_name"], "key")
    assert pii.collisions(mapping).isEmpty() and hidden.select("k", F.col("full").alias("token")).join(df, "k").where("token = full").isEmpty()
    assert sorted(map(tuple, pii.restore(hidden, mapping, ["full", "first_name"]).collect())) == sorted(map(tuple, df.collect()))
    again, newer = pii.pseudonymize(df.where("k < 5000"), ["full"], "other", mapping)
    assert {(r.k, r.full) for r in again.collect()} == {(r.k, r.full) for r in hidden.where("k < 5000").collect()} and pii.collisions(newer).isEmpty()
    with pytest.raises(ValueError):
        pii.restore(hidden, spark.createDataFrame([("full", "a", "t"), ("full", "b", "t")], "column string, original string, token string"), ["full"])


def test_deep_trees(spark):
    """Two thousand levels, a node with many children, a parent that isn't there, and circles."""
    chain = [(k, k - 1 if k else None, float(k % 97) if k % 5 else 0.0) for k in range(700)] + [(10_000 + k, 0, 1.0) for k in range(300)] + [(20_000, 5_555, 3.0)]
    spans = spark.createDataFrame(chain, "node int, parent int, ms double")
    below, kids = {}, {}
    for n, p, ms in chain:
        kids.setdefault(p, []).append(n)
    own = {n: ms for n, _, ms in chain}
    for n in [*range(10_000, 10_300), 20_000, *range(699, -1, -1)]:
        below[n] = max((max(own[c], below[c]) for c in kids.get(n, [])), default=0.0)
    want = {n: (ms or below[n], max(0.0, (ms or below[n]) - below[n])) for n, _, ms in chain}
    assert {r.node: (r.total, r.self_time) for r in trees.span_self_time(spans, "node", "parent", "ms").collect()} == want
    got = {(r.parent, r.child) for r in trees.collapse_tree(spans, "node", "parent", F.col("node") % 100 == 0).collect()}
    assert got == {(k - 100, k) for k in range(100, 700, 100)} | {(0, k) for k in (10_000, 10_100, 10_200)}
    circle = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0)], "node int, parent int, ms double")
    for run in (lambda: trees.span_self_time(circle, "node", "parent", "ms"), lambda: trees.collapse_tree(circle, "node", "parent", F.col("node") == 9)):
        with pytest.raises(ValueError):
            run()
    deep = spark.createDataFrame([(k, "\t" * k + "x") for k in range(40)], "n int, t string")
    assert {r.n: r.parent_line for r in trees.indent_to_edges(deep, "n", F.col("t")).collect()} == {k: k - 1 if k else None for k in range(40)}


def test_phrase_query_equals_the_loop(spark, sf_dir):
    """Two passes over all documents, counted across lines, joined within them."""
    from collections import Counter

    from sparkloom.catalog_more import e4_w14_phrases

    docs = {r.doc_id: [[w for w in re.split("[ \t]+", x) if w] for x in r.text.replace("\r", "").split("\n")] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for threshold in (5.0, 2.0):
        flat = [[w for x in lines for w in x] for lines in docs.values()]
        ones, twos = Counter(w for ws in flat for w in ws), Counter(p for ws in flat for p in zip(ws, ws[1:]))
        total = sum(ones.values())
        good = {p for p, n in twos.items() if min(ones[p[0]], ones[p[1]]) >= 5 and (n - 5) / ones[p[0]] / ones[p[1]] * total > threshold}
        for d, lines in docs.items():
            new = []
            for ws in lines:
                out, k = [], 0
                while k < len(ws):
                    hit = k + 1 < len(ws) and (ws[k], ws[k + 1]) in good
                    out.append("_".join(ws[k : k + 2]) if hit else ws[k])
                    k += 1 + hit
                new.append(out)
            docs[d] = new
    got = {r.doc_id: r.text for r in e4_w14_phrases(spark, sf_dir).collect()}
    assert got == {d: "\n".join(" ".join(x) for x in lines if x) for d, lines in docs.items()}


def test_subsample_keeps_rare_words(spark):
    tokens = spark.createDataFrame([(1, 0, p, w) for p, w in enumerate(["the"] * 5000 + ["rare"] * 5)], "doc int, line int, pos int, word string")
    vocabulary = vectors.vocab(as_lines(tokens), 1)
    kept = {r.word: r.n for r in vectors.subsample(tokens, "doc", vocabulary, 1e-2).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (math.sqrt(5000 / (0.01 * 5006)) + 1) * 0.01 * 5006 / 5000
    assert kept["rare"] == 5 and abs(kept["the"] / 5000 - share) < 0.05
