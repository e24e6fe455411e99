"""Edges, trees, mentions of names in texts, and traces."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import name_prefix, strip_sql_comments
from sparkloom.operators.sequence import with_row_number
from sparkloom.operators.spread import join_counted


def mention_edges(texts: DataFrame, names: DataFrame, reverse: bool = False, block: int = 100_000) -> DataFrame:
    """parent, child: which code mentions which name, anywhere in it and in any case. texts: name, body; names: name.

    An automaton of all names reads each text once; it is sent to the tasks, and more than ``block`` names go in
    several passes over the texts. A mention of itself, or of a name that its own contains, is no edge."""
    known = names.select("name", F.lower("name").alias("low")).where("low != ''").distinct()
    n = known.count()
    body = texts.select("name", F.lower(strip_sql_comments(F.col("body"))).alias("body")).where("body is not null")
    out = None
    for part in range(-(-n // block)):
        rows = known.where(F.pmod(F.xxhash64("low"), F.lit(-(-n // block))) == part).collect()
        found = body.mapInArrow(mentions(rows), "parent string, child string")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = body.select(F.col("name").alias("parent"), F.col("body").alias("child")).where("false")
    edges = out.where("not contains(lower(parent), lower(child))").distinct()
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")) if reverse else edges


def mentions(rows: list) -> Callable:
    """A task that finds names, each with its lower case, in texts."""
    spelled: dict[str, list[str]] = {}
    for name, low in rows:
        spelled.setdefault(low, []).append(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for low, as_named in spelled.items():
            automaton.add_word(low, as_named)
        automaton.make_automaton()
        for b in batches:
            edges = [(name, child) for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for child in {c for _, cs in automaton.iter(text) for c in cs}]
            yield pa.RecordBatch.from_pydict({"parent": pa.array([a for a, _ in edges], pa.string()), "child": pa.array([c for _, c in edges], pa.string())})

    return run


def roots(edges: DataFrame) -> DataFrame:
    return edges.select("parent").distinct().join(edges.select(F.col("child").alias("parent")), "parent", "left_anti")


def group_roots(edges: DataFrame, style: str = "_", letters: int = 10) -> DataFrame:
    """Edges from the first segment of each root's name to its first two, and from these to the root. Where both are the same, the first
    ``letters`` of it stand above it."""
    named = roots(edges).select(F.col("parent").alias("root"), name_prefix(F.col("parent"), style).alias("one"), name_prefix(F.col("parent"), style, 2).alias("two"))
    named = named.withColumn("two", F.when(F.col("two") == "", F.col("one")).otherwise(F.col("two")))
    named = named.withColumn("one", F.when(F.col("one") == F.col("two"), F.substring("two", 1, letters)).otherwise(F.col("one")))
    levels = F.array(F.struct(F.col("one").alias("parent"), F.col("two").alias("child")), F.struct(F.col("two").alias("parent"), F.col("root").alias("child")))
    return named.select(F.explode(levels).alias("e")).select("e.*").where("parent != child and parent != ''").distinct()


def expand(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """root, node, depth, path (an array) of every path from the tops; a node on its own path ends it. As many rounds as levels."""
    level = tops.select(F.col("parent").alias("root"), F.col("parent").alias("node"), F.lit(0).alias("depth"), F.array("parent").alias("path"))
    out = level
    while True:
        level = level.join(edges, level["node"] == edges["parent"]).where(~F.array_contains("path", F.col("child"))).select(
            "root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("child")).alias("path")
        ).checkpoint()
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def insert_groups(edges: DataFrame, pattern: str, prefix: Column, label: str = "Courses", min_children: int = 1, min_types: int = 1) -> DataFrame:
    """Between a parent and its children that match a pattern, a node for each prefix, where there are more
    than the given numbers of both. Children that don't match stay where they are."""
    marked = edges.withColumn("_p", F.when(F.col("child").rlike(pattern), prefix))
    counts = marked.where("_p is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("_p").alias("_t"))
    marked = marked.join(counts.where((F.col("_n") > min_children) & (F.col("_t") > min_types)), "parent", "left")
    moved = F.col("_p").isNotNull() & F.col("_n").isNotNull()
    names = marked.where(moved).select("parent", "_p").distinct()
    number = F.row_number().over(Window.partitionBy("_p").orderBy("parent"))
    names = names.withColumn("_g", F.concat_ws(" ", "_p", F.lit(label), F.concat(F.lit("#"), F.lpad(number.cast("string"), 4, "0"))))
    named = marked.join(names, ["parent", "_p"], "left")
    lower = named.select(F.when(F.col("_g").isNotNull(), F.col("_g")).otherwise(F.col("parent")).alias("parent"), "child")
    return lower.unionByName(names.select("parent", F.col("_g").alias("child")))


def indent_to_edges(df: DataFrame, line_no: str, text: str, by: list[str] = ()) -> DataFrame:
    """name, depth, parent_line from leading tabs: the last line before it that is one less deep, whatever the depth.

    Each line is there twice, as a parent at its depth and as a child at the depth above."""
    depth = F.char_length(F.regexp_extract(text, "^(\t*)", 1))
    out = df.withColumns({"depth": depth, "name": F.trim(F.translate(text, "\t", " "))})
    ends = F.array(F.struct(F.col("depth").alias("at"), F.col(line_no).alias("parent")), F.struct((F.col("depth") - 1).alias("at"), F.lit(None).cast(df.schema[line_no].dataType).alias("parent")))
    both = out.withColumn("_end", F.explode(ends))
    w = Window.partitionBy(*by, "_end.at").orderBy(line_no).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("parent_line", F.last("_end.parent", ignorenulls=True).over(w)).where(F.col("_end.at") < F.col("depth")).drop("_end")


def zip_lists(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """Rows of two lists side by side, by their number; lists of unlike length are an error."""
    if a.count() != b.count():
        raise ValueError("lists differ in length")
    num = lambda x: with_row_number(x, [order]).drop(order)
    return num(a).join(num(b), "_row").withColumnRenamed("_row", order)


def step_edges(steps: DataFrame) -> DataFrame:
    """parent, child, outcome from steps: step_id, on_success, on_failure."""
    parts = [steps.select(F.col("step_id").alias("parent"), F.col(c).alias("child"), F.lit(c[3:]).alias("outcome")) for c in ("on_success", "on_failure")]
    return parts[0].unionByName(parts[1]).where("child is not null")


def level_rows(df: DataFrame, levels: list[str]) -> DataFrame:
    """Distinct parent and child of each pair of neighbouring levels, the first below ''."""
    out = df.select(F.lit("").alias("parent"), F.col(levels[0]).cast("string").alias("child"))
    for a, b in zip(levels, levels[1:], strict=False):
        out = out.union(df.select(F.col(a).cast("string"), F.col(b).cast("string")))
    return out.distinct()


def span_self_time(spans: DataFrame, node: str, parent: str, elapsed: str) -> DataFrame:
    """node, total, self_time, percent: a span without time takes the longest below it; its own time is what
    the longest below leaves, 0 at least; percent is of the longest of all. A cycle is an error.

    The longest of a span and all below it climbs by doubling: each round joins a span with what it knows of the one
    twice as far above, so rounds grow with the logarithm of the depth and there is a row a span."""
    state = spans.select(F.col(node).alias("n"), F.col(parent).alias("up"), F.coalesce(F.col(elapsed), F.lit(0)).alias("most")).checkpoint()
    rounds, most = 0, state.count().bit_length() + 1
    while not state.where("up is not null").isEmpty():
        rising = state.where("up is not null").groupBy("up").agg(F.max("most").alias("below"), F.count(F.lit(1)).alias("rows")).checkpoint()
        if (rounds := rounds + 1) > most:
            raise ValueError("the spans go in a circle")
        above = rising.join(state.select("n", F.col("up").alias("next")), F.col("up") == F.col("n"), "left").select("up", "next", "rows")
        known = state.join(rising.select(F.col("up").alias("n"), "below"), "n", "left").select("n", "up", F.greatest("most", F.coalesce("below", "most")).alias("most"))
        climbed = join_counted(known.where("up is not null"), above, ["up"], "rows", 1 << (most - 2)).select("n", F.col("next").alias("up"), "most")
        state = climbed.unionByName(known.where("up is null")).checkpoint()
    below = spans.select(F.col(node).alias("n"), F.col(parent).alias("p")).where("p is not null").join(state.select("n", "most"), "n").groupBy("p").agg(F.max("most").alias("_below"))
    out = spans.join(below, F.col(node) == F.col("p"), "left").withColumn("_b", F.coalesce("_below", F.lit(0)))
    total = F.when(F.coalesce(F.col(elapsed), F.lit(0)) == 0, F.col("_b")).otherwise(F.col(elapsed))
    out = out.select(F.col(node).alias("node"), total.alias("total"), F.greatest(F.lit(0), total - F.col("_b")).alias("self_time"))
    longest = out.agg(F.max("total").alias("_most"))
    return out.join(F.broadcast(longest), F.lit(True)).withColumn("percent", F.try_divide(F.col("self_time") * 100.0, F.col("_most"))).drop("_most")


def collapse_tree(nodes: DataFrame, node: str, parent: str, keep: Column) -> DataFrame:
    """parent, child: kept nodes below their nearest kept ancestor. A cycle is an error.

    Each node points at its parent; as long as that isn't kept, at what that points at, so the way halves each round."""
    state = nodes.select(F.col(node).alias("n"), F.col(parent).alias("up"), F.coalesce(keep, F.lit(False)).alias("kept")).checkpoint()
    rounds, most = 0, state.count().bit_length() + 1
    while True:
        above = state.where("up is not null").groupBy("up").agg(F.count(F.lit(1)).alias("rows"))
        above = above.join(state.select("n", F.col("up").alias("further"), F.col("kept").alias("stop")), F.col("up") == F.col("n"), "left")
        above = above.select("up", "rows", F.when(F.col("stop"), F.col("up")).otherwise(F.col("further")).alias("next")).checkpoint()
        if above.where("not up <=> next").isEmpty():
            return state.where("kept and up is not null").select(F.col("up").alias("parent"), F.col("n").alias("child"))
        if (rounds := rounds + 1) > most:
            raise ValueError("the nodes go in a circle")
        moved = join_counted(state.where("up is not null"), above, ["up"], "rows", 1 << (most - 2)).select("n", F.col("next").alias("up"), "kept")
        state = moved.unionByName(state.where("up is null")).checkpoint()


def node_counters(threads: DataFrame) -> DataFrame:
    """Counters of threads added up by node; elapsed is the longest, a scan that keeps under a tenth is flagged."""
    out = threads.groupBy("node_id").agg(F.sum("rows").alias("rows"), F.sum("rows_read").alias("rows_read"), F.sum("cpu_ms").alias("cpu_ms"), F.max("elapsed_ms").alias("elapsed_ms"))
    return out.withColumn("selective", F.coalesce(F.try_divide(F.col("rows"), F.col("rows_read")) < 0.1, F.lit(False)))


def with_fallback(df: DataFrame, code: str, lookup: DataFrame, name: str = "definition") -> DataFrame:
    """lookup: number, definition. The first digits of the code find it; else a text says what was asked."""
    number = F.regexp_extract(code, r"(\d+)", 1).try_cast("int")
    found = lookup.select(F.col("number").alias("_n"), F.col("definition").alias("_d"))
    other = F.concat(F.lit("Strong "), F.coalesce(number.cast("string"), F.lit("?")), F.lit("; morph "), F.col(code))
    return df.withColumn("_c", number).join(found, F.col("_c") == F.col("_n"), "left").withColumn(name, F.coalesce("_d", other)).drop("_c", "_n", "_d")
