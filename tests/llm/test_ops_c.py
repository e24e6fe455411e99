"""Prefix trie, packing and divergence audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from oracle import compare, connect
from sparkloom.llm import bpe, divergence, packing, prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_divergence_audit"])
def test_equals_sql(spark, sf_dir, name):
    compare(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name])


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, who in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(who) - 1) * len(WORDS.findall(n[-1][1])) if n else 0
    hashed = lambda n: hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else -1, len(members[n]), children[n], leaves[n], saved[n], hashed(n)) for n in members)


def got_trie(df, band, shard_turns):
    rows = prefix_trie.prefix_trie(*prefix_trie.rebuilt(df), band=band, shard_turns=shard_turns)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows.select(*names).collect())


@pytest.mark.parametrize(("band", "shard_turns"), [(256, 1 << 15), (2, 3), (1, 1), (3, 50)])
def test_trie_equals_brute_force(spark, band, shard_turns, monkeypatch):
    """Many shards and bands: shared first turns, copies, prefixes of others, long chains."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    rng = random.Random(band)
    rows = []
    for c in [*range(0, 90), 100, 101, 121, 5000]:
        kind = rng.randrange(4)
        if kind == 0:  # one very common conversation
            turns = [("system", "be kind"), ("user", "hello there"), ("assistant", "hi")]
        elif kind == 1:
            turns = [("system", "be kind"), *((rng.choice("ua"), rng.choice(["x", "y z", ""])) for _ in range(rng.randrange(6)))]
        elif kind == 2:
            turns = [("user", f"t{k}") for k in range(rng.randrange(12))]
        else:
            turns = [(rng.choice(["user", None]), rng.choice(["a", None, "b c"])) for _ in range(rng.randrange(1, 4))]
        rows += [(c, None if k == 0 and rng.random() < 0.3 else k, role, text) for k, (role, text) in enumerate(turns)]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).withColumns({"node": F.lit("x"), "key": F.lit(1), "part": F.lit(2), "pos": F.lit(3), "words": F.lit("w")})
    assert got_trie(df.repartition(5), band, shard_turns) == brute_trie(rows)


def test_trie_of_odd_tables(spark):
    assert got_trie(spark.createDataFrame([], TURNS), 256, 100) == []
    turnless = [(1, 0, "u", "a")]  # h of 1 is 3, and conversation 0 is absent
    assert got_trie(spark.createDataFrame(turnless, TURNS), 256, 100) == brute_trie(turnless) == [(1, 0, -1, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    long = [(20, k, "u", "w " * 30_000 if k == 0 else str(k % 3)) for k in range(700)] + [(21, k, "u", str(k % 3)) for k in range(700)]
    assert got_trie(spark.createDataFrame(long, TURNS), 256, 1 << 15) == brute_trie(long)
    same = [(20, 1, "u", "a")] * 4 + [(22, None, "u", "a")] * 3  # repeated rows are turns of their own
    assert got_trie(spark.createDataFrame(same, TURNS), 256, 100) == brute_trie(same)


def test_double_array_finds_its_sequences_only():
    rng = random.Random(5)
    sequences = sorted({tuple(rng.choices(range(40), k=rng.randrange(1, 7))) for _ in range(2000)})
    symbols = np.array([x for s in sequences for x in s])
    lengths = np.array([len(s) for s in sequences])
    starts = np.cumsum(lengths) - lengths
    trie = prefix_trie.DoubleArray(symbols, starts, lengths)
    states = trie.walk(symbols, starts, lengths)
    prefixes = {s[: d + 1] for s in sequences for d in range(len(s))}
    assert len(set(states.tolist())) == len(prefixes) == int((trie.check >= 0).sum()) - 1
    absent = np.array([41])
    with pytest.raises((ValueError, IndexError)):
        trie.walk(absent, np.array([0]), np.array([1]))


def library_ids(text):
    return [*Tokenizer.from_file(public_tokenizers.path(bpe.WORD_BPE)).encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(rows, docs, longest=4096):
    """Each id in one piece, binary lengths, one piece a sequence, numbers without gaps, a bucket's numbers together."""
    want = sorted((d if d is not None else -1, library_ids(t)) for d, t in docs)
    pieces = defaultdict(list)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and 0 < r.length <= longest and r.offset == 0
        pieces[-1 if r.doc_id is None else r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for d, ids in want:
        for start, length, crc, n in sorted(pieces[d]):
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) and n == len(ids)
        cuts = sorted((s, s + n) for s, n, *_ in pieces[d])
        assert [a for a, _ in cuts] == [0, *(z for _, z in cuts[:-1])] and cuts[-1][1] == len(ids)
        assert sum(n < longest for _, n, *_ in pieces[d]) == (len(ids) % longest).bit_count()
    assert sorted(pieces) == [d for d, _ in want]
    numbers = sorted((r.sequence_id, r.length) for r in rows)
    assert [k for k, _ in numbers] == list(range(len(rows))) and [n for _, n in numbers] == sorted((r.length for r in rows), reverse=True)


def with_crc(df):
    return df.withColumn("ids_crc32", F.crc32("ids")).collect()


def test_packing(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check_packing(queries.op12_packing(spark, sf_dir).collect(), docs)


def test_packing_of_odd_rows(spark):
    odd = [(1, None), (2, ""), (None, "a b c"), (4, "word " * 30_000), (5, "x" * 5_000), (6, "Ünï \x1c 漢字 🙂 don't"), (7, " \n"), (8, "a b c")]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"part": F.lit("x"), "ids": F.lit(1), "length": F.lit(2), "first": F.lit(0)})
    check_packing(with_crc(packing.pack(df.repartition(3))), odd)
    check_packing(with_crc(packing.pack(df.coalesce(1), longest=64)), odd, 64)
    same = spark.createDataFrame([(3, "same text")] * 5, "doc_id long, text string")
    rows = packing.pack(same).collect()
    assert Counter(r.start for r in rows) == {s: 5 for s in {r.start for r in rows}} and len({r.sequence_id for r in rows}) == len(rows)
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(df, longest=100)


def brute_audit(docs, least=3, most=200):
    terms, has = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        terms[lang or "", source or ""].update(found)
        has[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in terms}:
        kept = sorted(t for t, n in has[lang].items() if n >= least)
        groups = {s: c for (g, s), c in terms.items() if g == lang}
        like = lambda c: (lambda n: {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept})(sum(c[t] for t in kept))
        f = lambda p, q: (p - q) ** 2 // q
        p = {s: like(c) for s, c in groups.items()}
        q = like(sum(groups.values(), Counter()))
        for s in groups:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s), key=lambda x: (x[0], x[1].encode()))
            over = sorted(((-f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            for part, rows in (("pair", pairs), ("term", over[:most])):
                out += [(lang, s, part, item, -v, k) for k, (v, item) in enumerate(rows, 1)]
    return sorted(out)


@pytest.mark.parametrize(("bits", "block", "often"), [(12, 64, 1024), (6, 2, 1024), (12, 3, 20)])
def test_audit_equals_brute_force(spark, bits, block, often, monkeypatch):
    """Many shards, and more groups than a block has; null and empty columns, a language without kept terms, clashing names."""
    monkeypatch.setattr(divergence, "SHARD_BITS", bits)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "OFTEN", often)
    monkeypatch.setattr(divergence, "HELD", 100)
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "abcdeé漢ÀX" for b in "abcdefghijkzß"]
    docs = [(k, " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(60))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S2", "é", None, "z9", "hot", "hot"])) for k in range(120)]
    docs += [(1, None, "en", "empty"), (2, "", None, None), (3, "12 34 _[`{", "xx", "a"), (3, "Once upon", "xx", "b"), (4, "same", "fr", "s1"), (4, "same", "fr", "s1"), (5, "Long" * 20_000 + " " + "aa " * 30_000, "en", "hot")]
    df = spark.createDataFrame(docs, DOCS).withColumns({"term": F.lit("x"), "n": F.lit(1), "p": F.lit(2), "id": F.lit(3), "value": F.lit(4)})
    got = sorted(tuple(r) for r in divergence.divergence_audit(df.repartition(4), most=5).collect())
    assert got == brute_audit(docs, most=5)


def test_audit_of_odd_tables(spark):
    assert divergence.divergence_audit(spark.createDataFrame([], DOCS)).count() == 0
    few = [(1, "a b", "en", "x"), (2, None, "en", "y"), (3, "c", "en", None)]
    got = sorted(tuple(r) for r in divergence.divergence_audit(spark.createDataFrame(few, DOCS)).collect())
    assert got == brute_audit(few) and {r[4] for r in got} == {0} and len(got) == 6


def test_likelihood_is_exact_beyond_a_long(spark):
    n, total, kept = 7_000_000_000_001, 90_000_000_000_007, 12_345
    row = spark.range(1).select(divergence.likelihood(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 1) // (total + kept)


def test_token_files_beside_null_ids(spark):
    """Ids asked for in a file that begins with null ids; rows of one id in one order under any partitions."""
    from sparkloom.llm import token_files
    from sparkloom.llm.common import shared_folder

    df = spark.createDataFrame([(None, "x"), (1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    folder = f"{shared_folder(spark)}/beside-null"
    token_files.write_token_files(df.coalesce(1), folder)
    assert sorted(r.doc_id for r in token_files.read_token_files(spark, folder, [1, 2]).collect()) == [1, 2]
    assert token_files.read_token_files(spark, folder, []).count() == 0 and token_files.read_token_files(spark, folder, [9]).count() == 0
    rng = random.Random(1)
    rows = [(rng.choice([None, 7, 7, 8]), " ".join(rng.choices("abcdef", k=rng.randrange(9)))) for _ in range(60)]
    read = []
    for n in (1, 5):
        rng.shuffle(rows)
        folder = f"{shared_folder(spark)}/one-id-{n}"
        token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), folder)
        read.append(sorted((r.start, r.doc_id or -1, bytes(r.ids)) for r in token_files.read_token_files(spark, folder).collect()))
    assert read[0] == read[1] and [r[1] for r in read[0]] == sorted(r[1] for r in read[0])
    assert [r[0] for r in read[0]] == list(np.cumsum([0, *(len(r[2]) // 4 for r in read[0])]))[:-1]


@pytest.mark.parametrize("alike", [10_000, 5])
def test_mix_without_ids(spark, alike, monkeypatch):
    """Null and repeated ids, and equal rows, come near the targets; reruns agree."""
    from sparkloom.llm import mixing

    monkeypatch.setattr(mixing, "ALIKE", alike)
    rng = random.Random(3)
    rows = [(None, " ".join(["w"] * rng.randrange(1, 9)) + f" {k}", s) for k in range(2500) for s in "abc"]
    rows += [(None, "same text here", "d")] * 4000 + [(5, f"x {k}", "e") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = []
    for n in (3, 3 if alike == 5 else 7):
        plan = mixing.mix_plan(df.repartition(n, "text"))
        got = plan.select("doc.source", "doc.text", "size", "target", "copies").collect()
        runs.append(sorted(map(tuple, got)))
        for s in "abcde":
            target = next(r.target for r in got if r.source == s)
            taken = sum(r["size"] * r.copies for r in got if r.source == s)
            spread = sum(r["size"] ** 2 for r in got if r.source == s) ** 0.5 / 2  # at most, of independent draws
            assert abs(taken - target) <= 3 * spread < 0.2 * target, (s, taken, target)
    assert runs[0] == runs[1]


def test_exact_dedup_of_many_rows_without_id(spark):
    """Of equal rows without an id one stays, and no task gets them all."""
    from sparkloom.llm import exact_dedup

    rows = [(None, "hot  text")] * 3000 + [(None, "b"), (4, "b"), (4, "b"), (9, "hot text"), (1, "c"), (1, "c"), (2, "d"), (None, None), (None, "")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    kept = sorted((r.doc_id or -1, r.group_size) for r in got.where("kept").collect())
    assert kept == [(-1, 2), (1, 2), (2, 1), (4, 3), (9, 3001)] and got.count() == len(rows)
    alone = exact_dedup.exact_dedup(spark.createDataFrame([(None, "x")] * 5000, "doc_id long, text string").repartition(8))
    assert alone.where("kept").count() == 1
    assert alone.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2500


@pytest.mark.parametrize("name", ["letters", "four", "nest", "nests", "hex", "url64", "escapes", "mixed", "words"])
def test_secrets_in_long_runs_end_soon(name):
    """A megabyte of what a pattern could start anew at each place, and deep escapes."""
    import base64
    import time

    from sparkloom.llm import secrets

    raw = random.Random(1).randbytes(700_000)
    text = {
        "letters": "a" * 1_000_000 + "%41", "four": "a" * 1_000_000 + "%41%42%43%44", "nest": "%" + "25" * 50_000 + "41 password=abcdefgh1", "nests": ("%" + "25" * 800 + "41 ") * 60,
        "hex": raw.hex()[:1_000_000] + "%41", "url64": base64.urlsafe_b64encode(raw).decode() + "%41", "escapes": "%41" * 300_000, "mixed": ("a" * 50 + "%41") * 20_000,
        "words": "lorem ipsum/dolor-sit_amet " * 40_000 + "%41",
    }[name]
    began = time.time()
    secrets.find_secrets(text)
    assert time.time() - began < 20
    chain = "x %" + "25" * 30 + "41KIA" + "Z" * 16
    assert ("access", 2, 2 + 1 + 60 + 2 + 19) in secrets.find_secrets(chain)[1]


@pytest.mark.parametrize("far", [1, 30_000])
def test_double_array_stays_dense(far):
    """Families whose children are far apart share the places between them."""
    rng = random.Random(far)
    sequences = sorted({(rng.randrange(2000), rng.choice([0, far, far + 1]), rng.randrange(3)) for _ in range(6000)})
    symbols = np.array([x for s in sequences for x in s])
    starts = np.arange(len(sequences)) * 3
    trie = prefix_trie.DoubleArray(symbols, starts, np.full(len(sequences), 3))
    nodes = len(set(trie.walk(symbols, starts, np.full(len(sequences), 3)).tolist()))
    assert len(trie.base) <= 2 * nodes + 2 * far + 4000
