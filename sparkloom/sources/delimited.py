"""Delimited text with line ends in quotes, read by many tasks a file.

Whether a line end closes a record depends on all text before it, but only through one fact: whether a quoted field is open.
So a first pass reads each block of a file (a split of Spark's text source) once and gives the state at the end of the
block for both states at its beginning. Put one after another these maps say in which state each block begins. A second
pass then cuts the records inside the blocks; the few that lie over a border are put together from their pieces.

The first pass also finds for each file the first encoding that decodes all of it, and its line ends."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.shared import written

#: The encodings that are tried, and how much of a file tells its line ends.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin1")
TERMINATOR_BYTES = 1_000_000
#: Encodings in which a line end is other bytes than in ASCII.
WIDE = re.compile(r"utf[-_]?(16|32)", re.IGNORECASE)
#: Blocks that begin inside quotes, and files with a rarer encoding: rows that are broadcast. At 128 MB a block, as many blocks are 128 TB.
FEW = 1_000_000
#: Different headers among the files of one read.
HEADERS = 64

BLOCKS = "path string, start long, n_bytes long, plain boolean, quoted boolean, decodes array<boolean>, crlf_at long, first binary, first_closed boolean, size long"
RECORDS = "path string, start long, kind string, header boolean, record string"


def scanner(sep: bytes, quote: bytes) -> Callable[[bytes, bool], bool]:
    """Whether a quoted field is open after a line, from whether one was before it. A quote opens a field only at its beginning, doubled ones
    stay in it, and what follows a closing quote belongs to the field."""
    q = re.escape(quote)
    closing = re.compile(b"[^%b]*+(?:%b%b[^%b]*+)*+%b" % (q, q, q, q, q) if quote else b"")
    opening = sep + quote

    def after(line: bytes, open_: bool) -> bool:
        if not quote or quote not in line:
            return open_
        at = 0
        while True:
            if not open_:
                if not line.startswith(quote, at):
                    at = line.find(opening, at)
                    if at < 0:
                        return False
                    at += len(sep)
                at += len(quote)
            found = closing.match(line, at)
            if not found:
                return True
            at, open_ = line.find(sep, found.end()), False
            if at < 0:
                return False
            at += len(sep)

    return after


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, start (of the block), line as bytes, size (of the file). A carriage return stays; Spark drops a byte order mark."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"), F.col("_metadata.file_size").alias("size"))


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes], int]]:
    """Runs of lines of one block, as they come; a block may come in several runs."""
    for b in batches:
        paths, starts, lines, sizes = (b.column(k).to_pylist() for k in range(4))
        begin = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or starts[k] != starts[begin] or paths[k] != paths[begin]:
                yield paths[begin], starts[begin], lines[begin:k], sizes[begin]
                begin = k


def scan_blocks(spark: SparkSession, path: str | list[str], sep: str, quote: str, encodings: list[str]) -> DataFrame:
    """A row a block: its bytes, the state after it if it begins outside (``plain``) and inside quotes (``quoted``), which encodings decode it,
    the place of its first CRLF, and its first record if it begins outside."""
    after = scanner(sep.encode(), quote.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row = None, []

        def batch():
            return pa.RecordBatch.from_pylist([dict(zip([f.split()[0] for f in BLOCKS.split(", ")], [*at, *row], strict=True))], schema=schema)

        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("n_bytes", pa.int64()), ("plain", pa.bool_()), ("quoted", pa.bool_()), ("decodes", pa.list_(pa.bool_())), ("crlf_at", pa.int64()), ("first", pa.binary()), ("first_closed", pa.bool_()), ("size", pa.int64())])
        for path, start, lines, size in in_blocks(batches):
            if at != (path, start):
                if at:
                    yield batch()
                at, row = (path, start), [0, False, True, [True] * len(encodings), None, None, False, size]
            n, plain, quoted, decodes, crlf, first, closed, _ = row
            for line in lines:
                if crlf is None and line.endswith(b"\r"):
                    crlf = n + len(line) - 1
                if not line.isascii():
                    for k, e in enumerate(encodings):
                        if decodes[k]:
                            try:
                                line.decode(e)
                            except (UnicodeDecodeError, LookupError):
                                decodes[k] = False
                plain = after(line, plain)
                quoted = after(line, quoted)
                if not closed and (first is not None or line.strip(b"\r")):
                    first = line if first is None else first + b"\n" + line
                    closed = not plain
                n += len(line) + 1
            row = [n, plain, quoted, decodes, crlf, first, closed, size]
        if at:
            yield batch()

    return text_lines(spark, path).mapInArrow(run, BLOCKS)


def block_states(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``open``, whether a block begins inside quotes, and ``offset``, the bytes before it.

    A block that ends alike from both states sets the state; one that swaps the two turns it over; others leave it."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("path").orderBy("start")
    swaps = F.sum(F.when(F.col("plain") & ~F.col("quoted"), 1).otherwise(0)).over(upto)
    fixed = F.when(F.col("plain") == F.col("quoted"), F.struct(F.col("plain").cast("int").alias("to"), "swaps"))
    out = blocks.withColumn("swaps", swaps)
    out = out.withColumns({"last": F.last(fixed, ignorenulls=True).over(before), "now": F.lag("swaps", 1, 0).over(upto)})
    open_ = (F.coalesce(F.col("last.to"), F.lit(0)) + F.col("now") - F.coalesce(F.col("last.swaps"), F.lit(0))) % 2 == 1
    offset = F.coalesce(F.sum("n_bytes").over(before), F.lit(0))
    return out.withColumns({"open": open_, "offset": offset}).drop("swaps", "last", "now")


def file_facts(states: DataFrame, encodings: list[str]) -> DataFrame:
    """A row a file: path, encoding (the first that decodes all of it), terminator, header (its first record) and header_at (the block with it)."""
    every = [F.min(F.col("decodes")[k]).alias(f"d{k}") for k in range(len(encodings))]
    crlf = F.min(F.col("offset") + F.col("crlf_at"))
    first = F.min(F.when(F.col("first").isNotNull(), F.struct("start", "first", "first_closed")))
    files = states.groupBy("path").agg(*every, F.when(crlf < TERMINATOR_BYTES - 1, "CRLF").otherwise("LF").alias("terminator"), first.alias("first"))
    name = F.lit("latin1")
    for k in reversed(range(len(encodings))):
        name = F.when(F.col(f"d{k}"), encodings[k]).otherwise(name)
    return files.select("path", name.alias("encoding"), "terminator", F.col("first.first").alias("header"), F.col("first.start").alias("header_at"), F.col("first.first_closed").alias("header_closed"))


def encodings(spark: SparkSession, path: str | list[str], first: str | None = None) -> DataFrame:
    """path, encoding (the first that decodes the whole file), terminator (CRLF if one is in its first million bytes, else LF)."""
    names = list(dict.fromkeys(([first] if first else []) + list(ENCODINGS)))
    states = block_states(scan_blocks(spark, path, ",", '"', names))
    # a last line without an end counts one byte more than it has; the mark, which Spark dropped, three less
    marked = states.groupBy("path").agg((F.sum("n_bytes") - F.max("size")).isin(-3, -2).alias("bom"))
    found = file_facts(states, names).join(marked, "path")
    return found.select("path", F.when((F.col("encoding") == "utf-8") & F.col("bom"), "utf-8-sig").otherwise(F.col("encoding")).alias("encoding"), "terminator")


def cut_records(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """Records, and pieces of records over borders, of ``lines(path, start, line, open, encoding, header_at)``."""
    after = scanner(sep.encode(), quote.encode())
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("header", pa.bool_()), ("record", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, open_, kind, header, encoding = None, [], False, "record", False, "utf-8"

        def row(kind: str) -> tuple:
            text = b"\n".join(held).decode(encoding, "replace")
            return *at, kind, header, text[:-1] if kind in ("record", "head") and text.endswith("\r") else text

        for b in batches:
            out = []
            facts = None
            for k, (path, start, line) in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)):
                if at != (path, start):
                    if at and held:
                        out.append(row("tail" if kind == "record" else "middle"))
                    facts = facts or [b.column(c).to_pylist() for c in range(3, 6)]
                    at, held, open_, encoding = (path, start), [], facts[0][k], facts[1][k]
                    kind, header = "head" if open_ else "record", facts[2][k] == start
                held.append(line)
                open_ = after(line, open_)
                if not open_:
                    if kind == "head" or len(held) > 1 or line.strip(b"\r"):
                        out.append(row(kind))
                        header = False
                    held, kind = [], "record"
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 5, schema, strict=True)], schema=schema)
        if at and held:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row("tail" if kind == "record" else "middle"), schema, strict=True)], schema=schema)

    return lines.mapInArrow(run, RECORDS)


def joined_records(cut: DataFrame) -> DataFrame:
    """header, record: whole ones as they are, the others from their pieces in order."""
    pieces = cut.where("kind != 'record'")
    order = Window.partitionBy("path").orderBy("start", F.expr("CASE kind WHEN 'head' THEN 0 ELSE 1 END"))
    numbered = pieces.withColumn("of", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    whole = numbered.groupBy("path", "of").agg(F.max("header").alias("header"), F.array_join(F.sort_array(F.collect_list(F.struct("start", "record")))["record"], "\n").alias("record"))
    return cut.where("kind = 'record'").select("header", "record").unionByName(whole.select("header", "record"))


def column_names(first: str, sep: str, quote: str, header: bool) -> list[str]:
    """Names from the fields of a header: empty and repeated ones get their number."""
    fields, at = [], 0
    field = re.compile(f"{re.escape(quote)}((?:[^{re.escape(quote)}]|{re.escape(quote) * 2})*){re.escape(quote)}(?=$|{re.escape(sep)})|[^{re.escape(sep)}]*" if quote else f"[^{re.escape(sep)}]*", re.DOTALL)
    while True:
        found = field.match(first, at)
        fields.append(found[1].replace(quote * 2, quote) if quote and found[1] is not None else found[0])
        at = found.end() + len(sep)
        if found.end() >= len(first):
            break
    lower = [f.lower() for f in fields]
    return [f"_c{k}" if not header or not f else f"{f}{k}" if lower.count(f.lower()) > 1 else f for k, f in enumerate(fields)]


def read_csv(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"', encoding: str | None = None, header: bool = True) -> DataFrame:
    """All columns as text, in any number of tasks a file. Files may differ in encoding: each is read by the first of the given one and ENCODINGS
    that decodes all of it. Files of different headers are put together by name.

    Line ends inside quotes stay as they are. Blank lines are skipped. A field may follow its closing quote; a quote that never closes makes the
    rest of its file one record. Encodings with other line ends than ASCII's are left to Spark's reader, a task a file."""
    if encoding and WIDE.match(encoding):
        return spark.read.csv(path, sep=sep, quote=quote, escape=quote, encoding=encoding, header=header, multiLine=True)
    names = list(dict.fromkeys(([encoding] if encoding else []) + list(ENCODINGS)))
    states = written(block_states(scan_blocks(spark, path, sep, quote, names)), "csv-blocks")
    facts = written(file_facts(states, names), "csv-files")
    opened = states.where("open").select("path", "start", F.lit(True).alias("open"))
    others = facts.where((F.col("encoding") != "utf-8") | (F.col("header_at") != 0)).select("path", "encoding", "header_at")
    for few in (opened, others):
        if few.count() > FEW:
            raise ValueError(f"over {FEW} blocks inside quotes, or files of other encodings; read fewer files at once, or raise spark.sql.files.maxPartitionBytes")
    if header and facts.where("not header_closed").count():
        raise ValueError("a header is longer than a block; raise spark.sql.files.maxPartitionBytes")
    heads = facts.where("header is not null").groupBy("header", "encoding").agg(F.collect_list("path").alias("paths")).limit(HEADERS + 1).collect()  # a path a file, as Spark itself holds
    by_names: dict[tuple[str, ...], list[str]] = {}
    for r in heads:
        text = bytes(r.header).decode(r.encoding, "replace").removesuffix("\r")
        by_names.setdefault(tuple(column_names(text, sep, quote, header)), []).extend(r.paths)
    if len(by_names) > HEADERS:
        raise ValueError(f"over {HEADERS} different headers")
    if not by_names:
        return spark.createDataFrame([], "_c0 string" if not header else "")
    if not header:  # the widest
        by_names = {max(by_names, key=len): [p for ps in by_names.values() for p in ps]}
    out = None
    for columns, paths in by_names.items():
        lines = text_lines(spark, path if len(by_names) == 1 else paths)
        lines = lines.join(F.broadcast(opened), ["path", "start"], "left").join(F.broadcast(others), ["path"], "left")
        lines = lines.select("path", "start", "line", F.coalesce("open", F.lit(False)).alias("open"), F.coalesce("encoding", F.lit("utf-8")).alias("encoding"), F.coalesce("header_at", F.lit(0)).alias("header_at"))
        records = joined_records(cut_records(lines, sep, quote))
        if header:
            records = records.where("not header")
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
        parsed = records.select(F.from_csv("record", F.lit(schema), {"sep": sep, "quote": quote, "escape": quote}).alias("r")).select("r.*")
        out = parsed if out is None else out.unionByName(parsed, allowMissingColumns=True)
    return out
