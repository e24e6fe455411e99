"""Source divergence audit by count-level bitmaps.

Of each group (a source of a language), and each count that terms have there, the ids of these terms are a bitset. Two
terms of one group with equal counts are equally likely, so what a pair of groups differs by needs only the sizes of the
joint cells: AND of two bitsets, bits counted, times f of the two probabilities. Terms that a group lacks are the
complement of its bitsets.

Bitsets are kept by 64-bit word, and only words with bits. Ids go from frequent to rare terms, so that the many levels of
frequent terms share few words, and the words of rare terms have few levels. A task holds the words of one shard of ids
for one or two blocks of groups, and gives the part of each pair's sum that its shard makes.

Defined results: null text, lang and source count as empty; a group without terms, or without kept ones, has count 0 of each kept
term; a language without kept terms has value 0 for each pair; ties rank by the UTF-8 of the item; repeated rows are documents of
their own; very long texts are counted whole; doc_id and extra columns, of any name, are not looked at; no rows give no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import join_counted, slices, text_bytes, written

SCALE = 1_000_000_000
#: Terms and groups that a task counts before it gives them out.
HELD = 400_000
#: Ids of a shard, by their lowest bits, and groups of a block. Words of terms that a language has so often have many levels and are a shard each.
SHARD_BITS, BLOCK, OFTEN = 12, 64, 1024
#: Terms in a text: bytes of ASCII letters in lower case and of other letters; the rest parts terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (with the term); with a row of the empty term for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        held = 0

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in counts.items():
                n, d = zip(*terms.values(), strict=True)
                rows = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * rows), pa.array([source] * rows), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

        for b in slices(batches):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), text_bytes(b.column(2)), strict=True):
                terms = counts.setdefault((lang, source), {b"": [0, 0]})
                held -= len(terms)
                own: dict[bytes, int] = {}
                for t in text.translate(TERM_BYTES).split():
                    own[t] = own.get(t, 0) + 1
                for t, n in own.items():
                    if (known := terms.get(t)) is None:
                        terms[t] = [n, 1]
                    else:
                        known[0] += n
                        known[1] += 1
                held += len(terms)
            if held > HELD:
                yield from given()
                counts, held = {}, 0
        yield from given()

    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def likelihood(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exactly."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return (F.call_function("div", up, (total + kept).cast("decimal(20,0)")) + 1).cast("long")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """What pairs and terms are made from: ``groups(lang, source, total, kept, zero)``, where zero is the likelihood of a term that
    the group lacks, and ``terms(lang, source, term, id, word, shard, n, p, lang_p)`` of the kept terms that a group has."""

    def __init__(self, docs: DataFrame, least_docs: int = 3):
        counts = written(term_counts(docs), "audit-counts")
        kept = counts.where("term != ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
        kept = kept.where(F.col("docs") >= least_docs).withColumn("rare", -F.col("lang_n"))
        order = ["lang", "rare", "term"]
        kept = kept.repartitionByRange(*order).sortWithinPartitions(*order).select("lang", "term", "lang_n", F.monotonically_increasing_id().alias("id"))
        kept = written(kept, "audit-ids").withColumn("word", F.shiftright("id", 6))
        most = F.max("lang_n").over(Window.partitionBy("lang", "word"))  # 64 rows
        self.kept = written(kept.withColumn("shard", F.when(most >= OFTEN, -1 - F.col("word")).otherwise(F.shiftright("id", SHARD_BITS))), "audit-kept")
        langs = self.kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
        found = written(counts.where("term != ''").join(self.kept, ["lang", "term"]).select("lang", "source", "term", "id", "word", "shard", "n", "lang_n"), "audit-found")
        totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_rows"))
        groups = counts.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        groups = groups.na.fill(0, ["kept", "lang_total", "total", "n_rows"])
        zero = F.when(F.col("kept") > 0, likelihood(F.lit(0), F.col("total"), F.col("kept")))
        self.groups = written(groups.withColumn("zero", zero), "audit-groups")
        joined = join_counted(found, self.groups.where("n_rows > 0").drop("zero"), ["lang", "source"], "n_rows", found.count())
        p, lang_p = likelihood(F.col("n"), F.col("total"), F.col("kept")), likelihood(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        self.terms = joined.select("lang", "source", "term", "id", "word", "shard", "n", p.alias("p"), lang_p.alias("lang_p"))

    def level_words(self) -> DataFrame:
        """lang, shard, source, word, p, bits: the bitset of each count of a group, by words that have bits."""
        bit = F.expr("shiftleft(1L, cast(id & 63 AS int))")
        return self.terms.groupBy("lang", "shard", "source", "word", "n").agg(F.first("p").alias("p"), F.bit_or(bit).alias("bits"))

    def term_gaps(self, most: int = 200) -> DataFrame:
        """lang, source, item, value, rank of the terms that a group has more of than its language."""
        over = self.terms.where("p > lang_p").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("lang_p")).alias("value"), F.pmod(F.xxhash64("term"), F.lit(64)).alias("salt"))
        for by in (["lang", "source", "salt"], ["lang", "source"]):  # each salt's best, then the best of these
            rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item"))
            over = over.withColumn("rank", rank).where(F.col("rank") <= most)
        return over.drop("salt")

    def pair_gaps(self) -> DataFrame:
        """lang, source, item, value, rank of each other source of the language."""
        n_blocks = self.groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n_blocks"))
        block = F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int")
        groups = self.groups.join(n_blocks, "lang").select("lang", "source", "kept", "zero", "n_blocks", block.alias("block"))
        shards = self.kept.groupBy("lang", "shard").agg(F.count(F.lit(1)).alias("size"))
        no_word = [F.lit(None).cast("long").alias(c) for c in ("word", "p", "bits")]
        absent = shards.join(groups, "lang").select("lang", "shard", "source", "block", "n_blocks", "size", "zero", *no_word)
        words = self.level_words().join(n_blocks, "lang")
        nulls = [F.lit(None).cast("long").alias(c) for c in ("size", "zero")]
        words = words.select("lang", "shard", "source", block.alias("block"), "n_blocks", *nulls, "word", "p", "bits")
        # a block meets each other block, in the order of the two
        dealt = absent.unionByName(words).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
        dealt = dealt.select("lang", "shard", "low", "high", "block", "source", "size", "zero", "word", "p", "bits")
        parts = dealt.groupBy("lang", "shard", "low", "high").applyInArrow(shard_gaps, "lang string, source string, item string, value long")
        none = groups.where("kept = 0").select("lang", "source")
        none = none.join(none.select("lang", F.col("source").alias("item")), "lang").where("source != item").withColumn("value", F.lit(0).cast("long"))
        summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(none)
        return summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def shard_gaps(rows: pa.Table) -> pa.Table:
    """lang, source, item, value: the sum of f over the terms of a shard for each pair of its groups, both ways."""
    low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
    known = rows.filter(pc.is_valid(rows["zero"]))
    sources, block, zero = known["source"].to_pylist(), known["block"].to_numpy(), known["zero"].to_numpy()
    size = known["size"][0].as_py()
    place = {s: k for k, s in enumerate(sources)}
    levels = rows.filter(pc.is_valid(rows["bits"])).sort_by("word")
    group = np.array([place[s] for s in levels["source"].to_pylist()], np.int64)
    word, p = levels["word"].to_numpy(), levels["p"].to_numpy()
    bits = levels["bits"].to_numpy().view(np.uint64)
    n = len(sources)
    value, both = np.zeros((n, n), np.int64), np.zeros((n, n), np.int64)
    count = np.bitwise_count(bits).astype(np.int64)
    has = np.zeros(n, np.int64)
    np.add.at(has, group, count)
    bounds = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1, [len(word)]]) if len(word) else [0]
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        g, m, pg, c = group[a:z], bits[a:z], p[a:z], count[a:z]
        joint = np.bitwise_count(m[:, None] & m[None, :])
        x, y = np.nonzero(joint)
        cell = joint[x, y].astype(np.int64)
        np.add.at(value, (g[x], g[y]), gaps(pg[x], pg[y]) * cell)
        np.add.at(both, (g[x], g[y]), cell)
        # terms of a level that the other group lacks
        lacks = np.repeat(c[:, None], n, 1)
        np.subtract.at(lacks, (x, g[y]), cell)
        np.add.at(value, g, gaps(pg[:, None], zero[None, :]) * lacks)
        np.add.at(value.T, g, gaps(zero[None, :], pg[:, None]) * lacks)
    neither = size - has[:, None] - has[None, :] + both
    value += gaps(zero[:, None], zero[None, :]) * neither
    wanted = (block[:, None] == low) & (block[None, :] == high) | (block[:, None] == high) & (block[None, :] == low)
    x, y = np.nonzero(wanted & ~np.eye(n, dtype=bool))
    names = np.array(sources, object)
    return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(x), pa.string()), "source": pa.array(names[x], pa.string()), "item": pa.array(names[y], pa.string()), "value": value[x, y]})


def divergence_audit(docs: DataFrame, least_docs: int = 3, most: int = 200) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    audit = Audit(docs, least_docs)
    pairs, terms = (x.withColumn("part", F.lit(p)) for x, p in ((audit.pair_gaps(), "pair"), (audit.term_gaps(most), "term")))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
