"""Encoding, token files, near and exact dedup, mixing against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkloom.llm import bpe, components, exact_dedup, mixing, queries, simhash, token_files
from sparkloom.llm.common import shared_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b", "en", "b", 3), (4, "a  b", None, "b", 4),
    (5, "Ünïcode ΣΣ\x1c İ <|endoftext|>x 漢字 🙂 don't", "en", "c", 1), (6, "word " * 30_000, "en", None, 9),
    (7, "a b", "en", "b", 3), (7, "a b", "en", "b", 3), (8, " \t\n", "en", "a", 3), (9, "x" * 50_000, "en", "d", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"h": F.lit(1), "fp": F.lit("x"), "size": F.lit(2), "ids": F.lit(3)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.WORD_BPE))


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_bpe_equals_the_library(spark, sf_dir, odd, empty, library):
    want = {}
    for d, t in documents(spark, sf_dir):
        ids = ids_of(library, t)
        text = library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        want[d] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = queries.op1_bpe_round_trip(spark, sf_dir).collect()
    assert {r[0]: tuple(r[1:4]) for r in got} == want and len(got) == len(want)
    rows = bpe.encode(odd).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in rows) == sorted((d, ids_of(library, t)) for d, t, *_ in ODD)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(odd)).collect()}
    assert back[1] == back[2] == "" and back[3] == "a</w> b</w>"
    assert bpe.round_trip(empty).count() == 0


def test_bpe_random_unicode(library):
    rng = random.Random(1)
    some = "aB'sΣσ \t\x1c\x85 é́İß9٣漢字🙂ǅﬁ-_!?​\n"
    part = lambda: rng.choice([rng.choice(some), chr(rng.randrange(1, 0x250)), "<|endoftext|>", "'ll", chr(rng.randrange(0x250, 0xD7FF))])
    texts = ["".join(part() for _ in range(50)) for _ in range(1500)]
    for encoder in (bpe.WordBpe, bpe.LibraryEncoder):
        assert encoder(public_tokenizers.path(bpe.WORD_BPE)).encode_batch(texts) == [ids_of(library, t) for t in texts]


def test_bpe_letters_before_marks(library):
    """Each Latin letter before each ASCII mark, and words of a few such letters, as Turkish capitals."""
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    rng = random.Random(4)
    texts = [a + m for a in letters for m in marks] + ["ALİ,", "AVNİ.", "İ", "İİ!", "diyarbakİr's", "İ_", "xİ\u0307,", "ſ's", "ª.", "ªİ²,"]
    texts += ["".join(rng.choices(letters + ["\u0130"] * 9, k=rng.randrange(1, 5))) + "".join(rng.choices(marks + ["\u0307"], k=rng.randrange(4))) for _ in range(60_000)]
    rng.shuffle(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    for encoder in (bpe.WordBpe, bpe.LibraryEncoder):
        assert encoder(public_tokenizers.path(bpe.WORD_BPE)).encode_batch(texts) == want


def test_token_files(spark, sf_dir, odd, empty, library):
    want, start = {}, 0
    for d, t in sorted(documents(spark, sf_dir)):
        ids = ids_of(library, t) + b"\1\0\0\0"
        want[d] = (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert {r[0]: tuple(r[1:4]) for r in queries.op2_token_files(spark, sf_dir).collect()} == want
    folder = f"{shared_folder(spark)}/odd-files"
    token_files.write_token_files(odd, folder)
    assert token_files.read_token_files(spark, folder).count() == len(ODD)
    some = token_files.read_token_files(spark, folder, [3, 9, 77]).collect()
    assert {r.doc_id: bytes(r.ids) for r in some} == {3: ids_of(library, "a b") + b"\1\0\0\0", 9: ids_of(library, "x" * 50_000) + b"\1\0\0\0"}
    token_files.write_token_files(empty, folder + "-none")
    assert token_files.read_token_files(spark, folder + "-none").count() == 0


def test_token_file_finds_damage(tmp_path):
    import pyarrow.fs

    fs = pyarrow.fs.LocalFileSystem()
    with fs.open_output_stream(str(tmp_path / "x")) as out:
        writer = token_files.FileWriter(out)
        for k in range(3):
            writer.add(k, bytes([k] * 100))
        writer.finish()
    raw = bytearray((tmp_path / "x").read_bytes())
    with fs.open_input_file(str(tmp_path / "x")) as stream:
        reader = token_files.FileReader(stream)
        assert [reader.document(k) for k in (2, 0)] == [bytes([2] * 100), bytes(100)]
        at = int(reader.starts[1]) + int(reader.sizes[1]) - 2
    raw[at] ^= 1
    (tmp_path / "y").write_bytes(raw)
    with fs.open_input_file(str(tmp_path / "y")) as stream:
        reader = token_files.FileReader(stream)
        assert reader.document(2) == bytes([2] * 100)
        with pytest.raises((ValueError, zstandard.ZstdError)):
            reader.document(1)


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [" ".join(words)] * bool(words)
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(fps, ids, radius=4):
    label = list(range(len(fps)))
    a = np.array(fps, np.uint64)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= radius):
            label[root(i)] = root(int(j))
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, d in enumerate(ids)}


def test_simhash_equals_brute_force(spark, sf_dir, odd, empty):
    docs = documents(spark, sf_dir)
    fps = [brute_simhash(t) for _, t in docs]
    comp = brute_components(fps, [d for d, _ in docs])
    got = queries.op4_simhash_near_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{f:016x}", comp[d]) for (d, _), f in zip(docs, fps)}
    got = simhash.near_components(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 2, 8)} == {1}
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 8)} == {"0" * 16}
    assert simhash.near_components(empty).count() == 0 and simhash.keep_representatives(empty).count() == 0
    assert simhash.keep_representatives(odd).columns == odd.columns


def test_representatives_with_null_and_repeated_ids(spark):
    """Each component keeps the row that comes first by id, null last, and hash of the text."""
    rng = random.Random(11)
    apart = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(12)]
    rows = [(None, apart[0]), (None, apart[1]), (None, apart[1]), (7, apart[2]), (7, apart[3]), (7, apart[3]), (8, apart[4]), (None, apart[4]), (9, apart[5] + " x"), (9, apart[5]), (None, apart[6]), (3, apart[6])]
    rows += [(20 + k % 2, text) for k, text in enumerate(apart[7:])]
    fps = [brute_simhash(text) for _, text in rows]
    comp = brute_components(fps, range(len(rows)))
    best = {}
    for k, (d, text) in enumerate(rows):
        key = (d is None, d or 0, hashlib.sha256(text.encode()).hexdigest())
        best[comp[k]] = min(best.get(comp[k], (key, d, text)), (key, d, text), key=lambda x: x[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in simhash.keep_representatives(docs).collect()]
    assert sorted(got, key=str) == sorted(((d, text) for _, d, text in best.values()), key=str) and len(got) == len(best) == 12


@pytest.mark.parametrize("block", [4, 512])
def test_links_lose_none(spark, block):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for x in list(fps)[:40]:
        for _ in range(8):
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    center = rng.getrandbits(64)
    fps |= {center ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(5))) for _ in range(400)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components.connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block))
    got = {r.node: r.component for r in found.collect()}
    want = brute_components(fps, signed)
    assert {x: got.get(x, x) for x in signed} == want


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 203)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_dedup(spark, odd, empty):
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(odd).select("doc_id", "keep_id", "group_size", "kept").collect())
    alone = [(d, d, 1, True) for d in (5, 6, 8, 9)]
    assert got == sorted([(1, 1, 2, True), (2, 1, 2, False), (3, 3, 4, True), (4, 3, 4, False), (7, 3, 4, False), (7, 3, 4, False), *alone])
    same = spark.createDataFrame([(7, "a"), (7, "a"), (8, "a")], "doc_id long, text string")
    assert sorted(r.kept for r in exact_dedup.exact_dedup(same).collect()) == [False, False, True]
    assert exact_dedup.keep_first(same).count() == 1
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.keep_first(empty).count() == 0
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 8, 9]


def test_exact_dedup_with_colliding_hashes(spark, odd):
    plain = sorted(tuple(r) for r in exact_dedup.exact_dedup(odd).collect())
    weak = exact_dedup.exact_dedup(odd, lambda norm: F.length(norm) % 2)
    assert sorted(tuple(r) for r in weak.collect()) == plain


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        open_ = [k for k in names if k not in capped]
        left = total - sum(3 * sizes[k] for k in capped)
        got = {k: left * w[k] / sum(w[x] for x in open_) for k in open_}
        over = {k for k in open_ if got[k] > 3 * sizes[k] * (1 + 1e-12)}
        if not over:
            return got | {k: 3.0 * sizes[k] for k in capped}
        capped |= over


def test_source_targets(spark):
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 30):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(n)} | ({None: 17} if n % 2 else {"": 3})
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = brute_targets(sizes)
        assert {r.source: pytest.approx(r.target) for r in got} == want
        assert all(r.rate <= 3 for r in got)


def test_mixing(spark, sf_dir, odd, empty):
    rows = queries.op10_source_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op10_source_mixing(spark, sf_dir).collect()))
    assert all(r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(sum(r.size for r in rows), rel=0.2)
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    plan = {r["doc"]["doc_id"]: r for r in mixing.mix_plan(odd).collect()}
    assert plan[1]["size"] == 0 and plan[8]["size"] == 0 and plan[6]["size"] == 30_000
    assert mixed.where("doc_id = 6").count() == plan[6]["copies"]


CLASHING = ["id", "sha", "_sha", "fp", "first", "n", "rows", "t", "key", "component", "least", "stays", "stays_sha", "doc", "size", "copies", "copy", "from_source", "source_size", "target", "rate", "_size",
            "_source", "_copies", "_keep_id", "_stays", "h", "norm", "keep_id", "group_size", "kept", "text_sha256", "u", "v", "m", "node", "last", "ids", "y", "score", "col", "start", "file", "term"]


@pytest.mark.parametrize("keep", [exact_dedup.keep_first, simhash.keep_representatives, mixing.mix])
def test_clashing_names_pass_through(spark, keep):
    """Columns named as those inside the operators come out as they went in, and change nothing."""
    rows = [row for row in ODD if row[0] != 6]
    plain = spark.createDataFrame(rows, SCHEMA)
    clashing = plain.withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in CLASHING})
    out = keep(clashing)
    assert out.columns == clashing.columns
    got = out.collect()
    assert all(r[c] == f"{c}-{r.doc_id}" for r in got for c in CLASHING)
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted((tuple(r) for r in keep(plain).collect()), key=str)


@pytest.mark.parametrize("over", ["exact_dedup", "near_components", "mix_plan", "round_trip", "scan_secrets", "edit_fingerprints"])
def test_clashing_names_change_nothing(spark, over):
    from sparkloom.llm import imatch, secrets

    op = {**vars(exact_dedup), **vars(simhash), **vars(mixing), **vars(bpe), **vars(secrets), **vars(imatch)}[over]
    plain = spark.createDataFrame([row for row in ODD if row[0] != 6], SCHEMA)
    clashing = plain.withColumns({c: F.lit("x") for c in [*CLASHING, "_bucket", "_ghost", "_row", "_next", "_edited", "_term", "_h", "_of"]})
    clean = lambda df: sorted((tuple(r) if over != "mix_plan" else tuple(r)[1:] for r in df.collect()), key=str)
    assert clean(op(clashing)) == clean(op(plain))


def test_heavy_keys(spark, monkeypatch):
    """Keys of more than a share of rows have their values broadcast; rows are the same either way."""
    from sparkloom.llm import common

    rng = random.Random(2)
    texts = ["hot text of many copies"] * 300 + [f"text {rng.randrange(40)}" for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ops = (exact_dedup.exact_dedup, simhash.near_components)
    plain = [sorted(map(tuple, op(docs).collect())) for op in ops]
    monkeypatch.setattr(common, "HEAVY", 4)
    assert [sorted(map(tuple, op(docs).collect())) for op in ops] == plain
    assert all(len(x) == 600 for x in plain)
