"""Conversation prefix trie: double-array tries over shards of sorted turn sequences, merged where shards meet.

A node is a distinct sequence of first turns. Sequences are cut into bands of ``band`` turns, so no row grows with
a conversation; equal pieces are one row with a count. The pieces are sorted and dealt out by ranges, so a first
turn or a prefix of any weight spreads over many tasks. A task takes its pieces in shards of bounded size, numbers
the turns of a shard densely, packs BASE and CHECK over these numbers, and walks each piece through the arrays to
find the nodes and add up their counts. What a node is counts for only once (its words, its place as a child, a leaf) is
claimed by the first piece that reaches it, in order; where two tasks meet, a double claim is taken back. So all
counts of a node are sums, and nodes that several shards share are merged by one aggregation. Sums of a band go up to the
bands above by doubling.

Turns are told apart by 128 bits, nodes by 120 bits, of SHA-256.

Defined results: null role or text counts as empty; a null turn comes first, turns with one number are ordered by
hash, so that reruns agree; rows without a conv_id belong to no conversation and are not looked at; repeated rows are turns
of their own; very long texts are hashed and counted whole; extra columns, of any name, are not looked at; no rows give no
rows, not even a root. For a negative conv_id, ``%`` has the sign of the id."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import join_counted, slices, written
from sparkloom.llm.mixing import word_count

#: Turns of a piece.
BAND = 256
#: Turns of a shard: with its arrays, some ten MB.
SHARD_TURNS = 1 << 15
#: Places that are looked at together, and how often, for the children of a node before they go to the end.
WINDOW, TRIES = 1024, 16
#: Hex digits of a turn, and of a node as two numbers.
TURN, HALF = 32, 15
ROOT = "0" * (2 * HALF)
#: Conversation ids of a block that is hashed.
BLOCK = 1 << 16

NODE = "node string, parent string, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
EDGE = "part long, band long, first_prefix string, first_path string, first_words array<int>, last_prefix string, last_path string"


# -- keys, the same in Python and in Spark ------------------------------------------------------------------------


def next_prefix(prefix: str, band: int, path: str) -> str:
    """The key of the node at the end of a full piece: a sum of hashes, so that Spark can add them up in any order."""
    digest = hashlib.sha256(f"{band}:{path}".encode()).hexdigest()
    return "".join(f"{(int(prefix[k : k + HALF], 16) + int(digest[k : k + HALF], 16)) % (1 << 4 * HALF):0{HALF}x}" for k in (0, HALF))


def path_keys(prefix: str, band: int, path: str, full: int) -> list[str]:
    """The keys of the nodes of a piece, from its prefix to its end."""
    keys, h = [prefix], hashlib.sha256(prefix.encode())
    for at in range(0, len(path), TURN):
        h.update(path[at : at + TURN].encode())
        keys.append(h.copy().hexdigest()[: 2 * HALF])
    if len(keys) > full:
        keys[full] = next_prefix(prefix, band, path)
    return keys


def halves(band: Column, path: Column) -> list[Column]:
    digest = F.sha2(F.concat(band.cast("string"), F.lit(":"), path), 256)
    return [F.conv(F.substring(digest, k, HALF), 16, 10).cast("decimal(20,0)") for k in (1, 1 + HALF)]


def key_of(sums: list[Column]) -> Column:
    whole = F.lit(1 << 4 * HALF).cast("decimal(20,0)")
    return F.concat(*[F.lpad(F.lower(F.hex((s % whole).cast("long"))), HALF, "0") for s in sums])


# -- turns and pieces ---------------------------------------------------------------------------------------------


def keyed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key, words of each turn; texts go no further."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, TURN)
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), key.alias("key"), word_count(F.col("text")).cast("int").alias("words"))


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns with ``pos`` from 0 and ``part``, and spans (conv_id, part, first, n, before): a conversation of any length lies in several
    ranges, and each range knows how many turns come before it."""
    order = ["conv_id", "turn", "key"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("gid", F.monotonically_increasing_id())
    ranged = written(ranged, "trie-turns").withColumn("part", F.shiftright("gid", 33))
    spans = ranged.groupBy("conv_id", "part").agg(F.min("gid").alias("first"), F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("conv_id").orderBy("part")
    return ranged, spans.withColumn("before", F.sum("n").over(upto) - F.col("n"))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, key, words) and lengths (conv_id, length) of the rebuilt conversations: each begins with the first h
    turns of conversation c - c % every, in place of its own; h is the CRC-32 of the decimal id modulo most + 1."""
    ranged, spans = numbered(written(keyed_turns(conversations), "trie-keys"))  # else ranges would hash all texts twice
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    base = F.col("conv_id") - F.col("conv_id") % every
    convs = spans.groupBy("conv_id").agg(F.sum("n").alias("n_own")).select("conv_id", "n_own", h.alias("h"), base.alias("base"))
    placed = ranged.join(spans, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("gid") - F.col("first"))
    heads = placed.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("head"))  # ``most`` at most
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
    convs = convs.select("conv_id", "h", "head", F.size("head").alias("n_head"), (F.size("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("length"))
    convs = written(convs, "trie-conversations")
    shifts = spans.join(convs.select("conv_id", "h", "n_head"), "conv_id")
    own = ranged.join(shifts, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("gid") - F.col("first")).where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "key", "words")
    given = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    return own.unionByName(given), convs.select("conv_id", "length")


def pieces_of(turns: DataFrame, lengths: DataFrame, band: int) -> DataFrame:
    """conv_id, band, prefix, path, words, longer and last (of its conversation) of each piece."""
    cut = turns.withColumn("band", F.floor(F.col("pos") / band))
    cut = cut.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("t"))  # ``band`` at most
    cut = cut.select("conv_id", "band", F.array_join("t.key", "").alias("path"), F.col("t.words").alias("words"))
    cut = lengths.join(cut, "conv_id", "left")  # also those without a turn
    cut = cut.withColumns({"band": F.coalesce("band", F.lit(0)).cast("long"), "path": F.coalesce("path", F.lit("")), "words": F.coalesce("words", F.array().cast("array<int>"))})
    cut = cut.withColumn("longer", F.col("length") > (F.col("band") + 1) * band)
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    a, b = halves(F.col("band"), F.col("path"))
    short = cut.where(F.col("length") <= band).withColumn("prefix", F.lit(ROOT))
    long = cut.where(F.col("length") > band).withColumns({"a": a, "b": b})
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).cast("decimal(38,0)") for c in ("a", "b")]
    return short.unionByName(long.withColumn("prefix", key_of(sums)).drop("a", "b"))


def end_keys(pieces: DataFrame, band: int) -> DataFrame:
    """node, conv_id: where each conversation ends."""
    last = pieces.where("not longer")
    a, b = halves(F.col("band"), F.col("path"))
    own = [F.conv(F.substring("prefix", k, HALF), 16, 10).cast("decimal(38,0)") for k in (1, 1 + HALF)]
    key = F.when(F.col("path") == "", F.col("prefix")).when(F.length("path") == band * TURN, key_of([own[0] + a, own[1] + b]))
    return last.select(key.otherwise(F.substring(F.sha2(F.concat("prefix", "path"), 256), 1, 2 * HALF)).alias("node"), "conv_id")


# -- the double arrays --------------------------------------------------------------------------------------------


class DoubleArray:
    """BASE and CHECK over sequences of dense symbols: from state s, symbol c leads to BASE[s] + c if CHECK there is s.

    Laid out level by level, by first fit: the children of a node go where the first of the free places lets all of them fit, only
    children to what is free after that. Places that large families no longer fit into are passed over by the next ones."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        room = 2 * len(symbols) + (int(symbols.max()) if len(symbols) else 0) + 2
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.check[0] = 0
        self.end = 1  # all places from here on are free
        self.tried = 1  # families are placed from here on
        state = np.zeros(len(lengths), np.int64)
        for level in range(int(lengths.max()) if len(lengths) else 0):
            rows = np.flatnonzero(lengths > level)
            at = state[rows]
            symbol = symbols[starts[rows] + level]
            order = np.lexsort((symbol, at))
            at, symbol = at[order], symbol[order]
            fresh = np.concatenate([[True], (at[1:] != at[:-1]) | (symbol[1:] != symbol[:-1])])
            parents, children = at[fresh], symbol[fresh]
            firsts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
            sizes = np.diff(np.concatenate([firsts, [len(parents)]]))
            for k in np.flatnonzero(sizes > 1).tolist():
                self.place(int(parents[firsts[k]]), children[firsts[k] : firsts[k] + sizes[k]])
            single = firsts[sizes == 1]
            places = np.flatnonzero(self.check[: self.end] < 0)[: len(single)]
            places = np.concatenate([places, np.arange(self.end, self.end + len(single) - len(places))])
            self.end = max(self.end, int(places.max(initial=0)) + 1)
            self.grow(self.end)
            self.base[parents[single]] = places - children[single]
            self.check[places] = parents[single]
            state[rows] = self.step(state[rows], symbols[starts[rows] + level])
        self.base, self.check = self.base[: self.end], self.check[: self.end]

    def place(self, parent: int, children: np.ndarray) -> None:
        offsets = children - children[0]
        span, first = int(offsets[-1]), self.end
        if len(children) <= WINDOW:
            for tries, at in enumerate(range(self.tried, min(self.end, self.tried + TRIES * WINDOW), WINDOW)):
                free = at + np.flatnonzero(self.check[at : min(at + WINDOW, self.end)] < 0)
                if len(free):
                    self.grow(int(free[-1]) + span + 1)
                    fits = np.ones(len(free), bool)
                    for x in offsets[1:]:
                        fits &= self.check[free + x] < 0
                    if fits.any():
                        first = int(free[fits.argmax()])
                        break
                if not tries:
                    self.tried = at + WINDOW
        self.grow(first + span + 1)
        self.base[parent], self.check[first + offsets] = first - int(children[0]), parent
        self.end = max(self.end, first + span + 1)

    def grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size - len(self.base), len(self.base))
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        to = self.base[state] + symbol
        if len(to) and (self.check[to] != state).any():
            raise ValueError("a sequence leaves the trie")
        return to

    def walk(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The state after each symbol of each sequence."""
        states, state = np.zeros(len(symbols), np.int64), np.zeros(len(lengths), np.int64)
        for level in range(int(lengths.max()) if len(lengths) else 0):
            rows = np.flatnonzero(lengths > level)
            state[rows] = states[starts[rows] + level] = self.step(state[rows], symbols[starts[rows] + level])
        return states


def common_turns(a: dict | None, b: dict | None) -> int:
    """Turns that two pieces begin with, -1 if their prefixes differ."""
    if a is None or b is None or a["prefix"] != b["prefix"]:
        return -1
    return len(os.path.commonprefix([a["path"], b["path"]])) // TURN


def suffix_sums(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each value, the sum from it to the end of its sequence."""
    total = np.concatenate([[0], np.cumsum(values)])
    return np.repeat(total[starts + lengths], lengths) - total[:-1]


def shard_nodes(shard: list[dict], before: dict | None, after: dict | None, band: int) -> pa.RecordBatch:
    """The nodes of sorted pieces with what these count for; ``before`` and ``after`` are the pieces beside the shard."""
    turns = [len(p["path"]) // TURN for p in shard]
    shared = [common_turns(a, b) for a, b in zip([before, *shard], [*shard, after], strict=True)]
    sequences = [[p["prefix"], *(p["path"][at : at + TURN] for at in range(0, len(p["path"]), TURN))] for p in shard]
    dense: dict[str, int] = {}
    symbols = np.array([dense.setdefault(x, len(dense)) for s in sequences for x in s], np.int64)
    lengths = np.array(turns, np.int64) + 1
    starts = np.cumsum(lengths) - lengths
    states = DoubleArray(symbols, starts, lengths).walk(symbols, starts, lengths)

    level = np.arange(len(symbols)) - np.repeat(starts, lengths)
    n = np.repeat(np.array([p["n"] for p in shard], np.int64), lengths)
    words = np.array([w for p in shard for w in (0, *p["words"])], np.int64)
    claimed = (level > np.repeat(np.array(shared[:-1]), lengths)) & (level > 0)
    ends = np.array([s < t and not p["longer"] for s, t, p in zip(shared[1:], turns, shard, strict=True)])
    saved = suffix_sums(n * words - claimed * words, starts, lengths)

    found, first, slot = np.unique(states, return_index=True, return_inverse=True)

    def add(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(found), np.int64)
        np.add.at(out, slot, values)
        return out

    below = np.concatenate([claimed[1:], [False]])  # a claimed turn is a child of the node before it
    top = level == 0
    bands = np.repeat(np.array([p["band"] for p in shard], np.int64), lengths)
    counts_here = ~top | (bands == 0)  # the prefix of a lower band is counted above
    conv = np.full(len(found), np.iinfo(np.int64).max)
    np.minimum.at(conv, slot, np.repeat(np.array([p["conv_id"] for p in shard], np.int64), lengths))
    keys = [k for p in shard for k in path_keys(p["prefix"], p["band"], p["path"], band)]
    return pa.RecordBatch.from_pydict({
        "node": [keys[k] for k in first], "parent": pa.array([None if top[k] else keys[k - 1] for k in first.tolist()], pa.string()),
        "depth": (bands * band + level)[first], "conv_id": pa.array(conv, mask=~counts_here[first]), "n_convs": add(n * counts_here),
        "n_children": add(below.astype(np.int64)), "n_leaves": add(np.repeat(ends.astype(np.int64), lengths)), "saved_tokens": add(saved),
    })


def local_nodes(pieces: DataFrame, band: int, shard_turns: int) -> DataFrame:
    """Nodes with the sums of their shards, and a row for each task with its first and last piece."""
    names = ["part", "prefix", "path", "band", "words", "n", "conv_id", "longer"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = before = None
        shard: list[dict] = []
        held = 0

        def nodes(rows: list[dict], after: dict | None) -> pa.RecordBatch:
            out = shard_nodes(rows, before, after, band)
            blank = [pa.nulls(out.num_rows, t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string())]
            return pa.RecordBatch.from_arrays([*out.columns, *blank], [f.split()[0] for f in (NODE + ", " + EDGE).split(", ")])

        for b in slices(batches):
            for piece in b.to_pylist():
                begin = begin or piece
                if held > shard_turns:
                    yield nodes(shard, piece)
                    shard, before, held = [], shard[-1], 0
                shard.append(piece)
                held += 1 + len(piece["words"])
        if shard:
            yield nodes(shard, None)
            end = shard[-1]
            row = [None] * 8 + [begin["part"], begin["band"], begin["prefix"], begin["path"], begin["words"], end["prefix"], end["path"]]
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 8, pa.string(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [f.split()[0] for f in (NODE + ", " + EDGE).split(", ")])

    order = ["prefix", "path"]
    sorted_ = pieces.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    return sorted_.select(*names).mapInArrow(run, f"{NODE}, {EDGE}")


def double_claims(edges: DataFrame, band: int) -> DataFrame:
    """What the first piece of a task claimed although the last piece of the task before has it: the same columns, to be added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out = []
            for e in b.to_pylist():
                first, last = {"prefix": e["first_prefix"], "path": e["first_path"]}, {"prefix": e["prior_prefix"], "path": e["prior_path"]}
                shared = common_turns(first, last) if last["prefix"] is not None else -1
                if shared < 0:
                    continue
                keys = path_keys(first["prefix"], e["band"], first["path"], band)
                words = [0, *e["first_words"][:shared]]
                leaf = -1 if shared * TURN == len(last["path"]) else 0
                out += [(keys[k], keys[k - 1] if k else None, None, None, 0, -1 if k < shared else 0, leaf, sum(words[k:])) for k in range(shared + 1)]
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 6]
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in NODE.split(", ")])

    prior = Window.orderBy("part")  # a row a task
    pairs = edges.withColumns({"prior_prefix": F.lag("last_prefix").over(prior), "prior_path": F.lag("last_path").over(prior)})
    return pairs.mapInArrow(run, NODE)


def from_below(nodes: DataFrame, pieces: DataFrame, band: int, max_band: int) -> DataFrame:
    """What the nodes of a band get from the bands below it: leaves and saved tokens, to be added.

    The beginnings of bands form a tree as deep as there are bands; each adds its sums to its ancestor, which moves up
    twice as far a round."""
    a, b = halves(F.col("band"), F.col("path"))
    own = [F.conv(F.substring("prefix", k, HALF), 16, 10).cast("decimal(38,0)") for k in (1, 1 + HALF)]
    full = pieces.where("longer").withColumn("root", key_of([own[0] + a, own[1] + b]))
    up = full.select(F.col("root").alias("node"), F.when(F.col("band") > 0, F.col("prefix")).alias("up"))
    # of a node that ends one band and begins the next, what it has in the next; its own words are counted in the first
    tops = nodes.where(F.col("parent").isNull() & (F.col("node") != ROOT)).groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    state = written(up.join(tops, "node"), "trie-bands")
    reach = 1
    while reach <= max_band:
        given = state.where("up is not null").groupBy("up").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"), F.count(F.lit(1)).alias("n"))
        given = written(given.withColumnRenamed("up", "node"), "trie-given")
        total = state.count()
        above = given.join(state.select("node", F.col("up").alias("upper")), "node").select(F.col("node").alias("up"), "upper", "n")
        moved = join_counted(state.where("up is not null"), above, ["up"], "n", total).select("node", F.col("upper").alias("up"), "n_leaves", "saved_tokens")
        moved = moved.unionByName(state.where("up is null"))
        moved = moved.join(given, "node", "left")
        state = written(moved.select("node", "up", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", F.lit(0))).alias("saved_tokens")), "trie-bands")
        reach *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in slices(batches, 64):
            out: dict[str, list[int]] = {}
            for p in x.to_pylist():
                for key in path_keys(p["prefix"], p["band"], p["path"], band)[:-1]:
                    sums = out.setdefault(key, [0, 0])
                    sums[0] += p["n_leaves"]
                    sums[1] += p["saved_tokens"]
            yield pa.RecordBatch.from_pydict({"node": pa.array(list(out), pa.string()), "n_leaves": pa.array([v[0] for v in out.values()], pa.int64()), "saved_tokens": pa.array([v[1] for v in out.values()], pa.int64())})

    below = full.join(state.select(F.col("node").alias("root"), "n_leaves", "saved_tokens"), "root")
    below = below.select("prefix", "band", "path", "n_leaves", "saved_tokens").mapInArrow(run, "node string, n_leaves long, saved_tokens long")
    nulls = [F.lit(None).cast(k).alias(c) for c, k in (("parent", "string"), ("depth", "long"), ("conv_id", "long"))]
    zeros = [F.lit(0).cast("long").alias(c) for c in ("n_convs", "n_children")]
    return below.select("node", *nulls, *zeros, "n_leaves", "saved_tokens")


# -- the conversations that end at a node -------------------------------------------------------------------------


def end_hashes(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 of ``ends(node, conv_id)``: ids ascending, joined by commas.

    Ranges of (node, id) are hashed in their tasks. A node over several ranges, however many, comes as compressed
    blocks of ids, which one task reads one after another, as SHA-256 goes in order; it holds one block at a time."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.string()), ("first", pa.int64()), ("whole", pa.string()), ("block", pa.binary())])
        node, ids, alone = None, [], False  # alone: the node lies inside this range

        def block():
            return node, ids[0], None, zlib.compress(",".join(map(str, ids)).encode(), 1)

        for b in batches:
            out = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != node:
                    if node is not None:
                        out.append((node, ids[0], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), None) if alone else block())
                    alone, node, ids = node is not None, k, []
                elif len(ids) == BLOCK:
                    out.append(block())
                    alone, ids = False, []
                ids.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 4, schema, strict=True)], schema=schema)
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(block(), schema, strict=True)], schema=schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for b in slices(batches, 16):
            out = []
            for k, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != node:
                    if node is not None:
                        out.append((node, h.hexdigest()))
                    node, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(zlib.decompress(raw))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(2)], ["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (node, h.hexdigest())], ["node", "ends_sha256"])

    sorted_ = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    made = written(sorted_.mapInArrow(blocks, "node string, first long, whole string, block binary"), "trie-ends")
    split = made.where("block is not null").repartition("node").sortWithinPartitions("node", "first").select("node", "block")
    return made.where("whole is not null").select("node", F.col("whole").alias("ends_sha256")).unionByName(split.mapInArrow(joined, "node string, ends_sha256 string"))


# -- the operator -------------------------------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, lengths: DataFrame, band: int = BAND, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of ``turns(conv_id, pos, key, words)``, where ``pos`` counts from 0 without a gap, of the conversations of ``lengths(conv_id, length)``:
    node, parent, depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    each = written(pieces_of(turns, lengths, band), "trie-pieces")
    distinct = each.groupBy("prefix", "path").agg(F.min("band").alias("band"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.max("longer").alias("longer"))
    distinct = written(distinct, "trie-distinct")
    found = written(local_nodes(distinct, band, shard_turns), "trie-nodes")
    names = [f.split()[0] for f in NODE.split(", ")]
    nodes = found.where("node is not null").select(*names)
    nodes = nodes.unionByName(double_claims(found.where("node is null").select(*[f.split()[0] for f in EDGE.split(", ")]), band))
    max_band = distinct.agg(F.max("band")).first()[0] or 0
    if max_band:
        tops = written(nodes, "trie-nodes")
        nodes = tops.unionByName(from_below(tops, distinct, band, max_band))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.groupBy("node").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums)
    merged = written(merged, "trie-merged")
    parents = merged.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_rows"))
    inner = join_counted(merged.where("parent is not null"), parents, ["parent"], "n_rows", merged.count())
    merged = inner.unionByName(merged.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return merged.join(end_hashes(end_keys(each, band)), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
