"""Quoted text in parallel: many blocks a file against Python's csv module and Spark's own reader."""

import csv
import io
import random

import pytest

from sparkloom.sources import delimited


@pytest.fixture
def small_blocks(spark):
    """Blocks of some bytes, so that records of a few lines lie over several."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def of(n):
        spark.conf.set(names[0], n)
        spark.conf.set(names[1], 0)

    yield of
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def table(rng, rows, end="\n", odd="é"):
    some = ["a", "b c", 'say "x"', "", ",", f"line{end}end", f'{end}{end}",{end}', odd * 3, '"', '""', "x" * 40]
    data = [[str(k), rng.choice(some), rng.choice(some) + rng.choice(some)] for k in range(rows)]
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows([["k", "v", "w"], *data])
    return data, out.getvalue()


def read(spark, path, **options):
    rows = delimited.read_csv(spark, str(path), **options).collect()
    return sorted(tuple(v or "" for v in r) for r in rows)


@pytest.mark.parametrize("size", [30, 37, 64, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blocks_equal_the_csv_module(spark, tmp_path, small_blocks, size, end):
    data, text = table(random.Random(size), 150, end)
    (tmp_path / "x.csv").write_bytes(text.encode())
    small_blocks(size)
    assert delimited.text_lines(spark, str(tmp_path / "x.csv")).rdd.getNumPartitions() >= min(8, len(text) // size)
    assert read(spark, tmp_path / "x.csv") == sorted(map(tuple, data))
    facts = delimited.encodings(spark, str(tmp_path / "x.csv")).first()
    assert (facts.encoding, facts.terminator) == ("utf-8", "CRLF" if end == "\r\n" else "LF")


def test_equals_sparks_reader_and_keeps_its_settings(spark, tmp_path, small_blocks):
    _, text = table(random.Random(9), 400)
    (tmp_path / "x.csv").write_text(text)
    settings = dict(spark.conf.getAll)
    own = spark.read.csv(str(tmp_path / "x.csv"), header=True, escape='"', multiLine=True)
    want = sorted(tuple(v or "" for v in r) for r in own.collect())
    assert delimited.read_csv(spark, str(tmp_path / "x.csv")).columns == own.columns
    assert dict(spark.conf.getAll) == settings
    small_blocks(100)
    assert read(spark, tmp_path / "x.csv") == want


def test_files_of_many_kinds(spark, tmp_path, small_blocks):
    rng = random.Random(3)
    want = []
    for k, (encoding, odd) in enumerate([("utf-8", "é漢"), ("utf-8-sig", "é"), ("cp1252", "€"), ("latin1", "\x81é")]):
        data, text = table(rng, 40, odd=odd)
        want += map(tuple, data)
        (tmp_path / f"{k}.csv").write_bytes(text.encode(encoding))
    small_blocks(50)
    assert read(spark, tmp_path) == sorted(want)
    found = {r.path.rsplit("/", 1)[1]: r.encoding for r in delimited.encodings(spark, str(tmp_path)).collect()}
    assert found == {"0.csv": "utf-8", "1.csv": "utf-8-sig", "2.csv": "cp1252", "3.csv": "latin1"}
    assert read(spark, tmp_path / "2.csv", encoding="cp1252") == read(spark, tmp_path / "2.csv")


def test_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n\n"k\nk",v,v,\n1,2,3,4\n\n5,6\n')
    got = delimited.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["k\nk", "v1", "v2", "_c3"] and [tuple(r) for r in got.collect()] == [("1", "2", "3", "4"), ("5", "6", None, None)]
    (tmp_path / "b.csv").write_text("v1;z\nx;y\n")
    assert delimited.read_csv(spark, str(tmp_path / "b.csv"), sep=";", header=False).columns == ["_c0", "_c1"]
    both = tmp_path / "both"
    both.mkdir()
    (both / "1.csv").write_text("a,b\n1,2\n")
    (both / "2.csv").write_text("b,c\n3,4\n")
    (both / "3.csv").write_text("")
    rows = {(r.a, r.b, r.c) for r in delimited.read_csv(spark, str(both)).collect()}
    assert rows == {("1", "2", None), (None, "3", "4")}


def test_unusual_quotes():
    after = delimited.scanner(b",", b'"')
    cases = {b'a,"b': True, b'a"b,c"': False, b'"a"b,"': True, b'"a""': True, b'"a"""': False, b'"",""': False, b'""",': True, b"": False, b',",",': False}
    for line, want in cases.items():
        assert after(line, False) is want, line
    assert after(b"x", True) and not after(b'x"', True) and after(b'x","', True) and after(b'x""', True)
    assert delimited.scanner(b"\t", b"")(b'"', False) is False


def test_states_of_blocks(spark):
    """Maps of blocks put one after another, against a loop."""
    rng = random.Random(4)
    rows = [(p, k, rng.choice([(False, True), (True, False), (False, False), (True, True)])) for p in "ab" for k in range(60)]
    df = spark.createDataFrame([(p, k, 10, a, b) for p, k, (a, b) in rows], "path string, start long, n_bytes long, plain boolean, quoted boolean")
    got = {(r.path, r.start): (r.open, r.offset) for r in delimited.block_states(df).collect()}
    for p in "ab":
        state = False
        for q, k, (a, b) in rows:
            if q == p:
                assert got[p, k] == (state, 10 * k)
                state = b if state else a
