"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are runs of letters in lower case. A vector has all terms of its text that some example has: TF-IDF
times a weight that grows, from EVERY, with the share of the class among the examples with the term, so
that no term is left out however few examples there are. The nearest are exact, by an inverted index with
block maxima (``blockmax``). Votes weigh by closeness, and a rising fit to votes of the examples on each
other (each left out of its own, also in the weights of its terms) makes them probabilities.

Defined results: a text without a term of an example, so also a null or empty one, has no neighbour and
gets the share of the class among the examples, 0 if there are none; equally near examples count by
smaller id; of examples with a plain TF-IDF cosine of COPY and one label only the one with the smallest id
counts; of several texts with one id the least is learned from; very long texts are read whole, a batch
of a few hundred rows at a time; extra columns, of any name, aren't looked at; repeated rows give repeated
rows; no rows give no rows."""

from __future__ import annotations

import functools
import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.blockmax import BlockMax, Query
from sparkloom.llm.common import forget, once_a_worker, shared_folder, slices
from sparkloom.llm.labelled import is_held_out, rising_fit, training_rows

FOLDS, HELD_OUT, CUT = 5, 0, 0.5
#: Bound of what is learned from: labelled rows.
MOST_ROWS = 16_000
#: Examples with a cosine of this are copies.
COPY = 0.8
#: Weight of a term that says nothing about the class, and how many examples at the prior share each term starts with.
EVERY, PRIOR_EXAMPLES = 0.02, 10.0
#: Examples at the prior share that each step of the fit starts with, as a step of few examples says little.
FIT_EXAMPLES = 2
NEIGHBOURS, QUERIES = 25, 128
#: Bytes that are read at once from a finished index.
READ = 8 << 20
TERM = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


def hashes(terms) -> np.ndarray:
    """64 bits for each term; with half a million terms two share one with a chance of under 1 in 10^7."""
    return np.fromiter((xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in terms), np.uint64, len(terms))


def vote(near: tuple[np.ndarray, np.ndarray], labels: np.ndarray, prior: float) -> float:
    """Votes weighted by cosine / distance, so that far examples hardly count; one vote of weight 1 for the prior."""
    cosines, at = near
    weights = cosines / (1.05 - cosines)
    return (prior + float(weights @ labels[at])) / (1 + float(weights.sum()))


@dataclass
class Model:
    """What is learned, ready for use."""

    examples: Examples | None
    index: BlockMax | None
    prior: float
    fit: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def made(self) -> Model:
        return self

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Columns and weights; terms that no example has count in the length only."""
        tf = Counter(terms_of(text))
        counts = 1 + np.log(np.fromiter(tf.values(), float, len(tf)))
        columns = self.examples.columns_of(tf)
        known = columns >= 0
        x = counts[known] * self.weights[columns[known]]
        new = EVERY * self.examples.idf(0) * counts[~known]
        return columns[known], x / (math.sqrt((x * x).sum() + (new * new).sum()) or 1)

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[int]]]:
        """For each text its probability, and the ids of the nearest examples as evidence."""
        if self.index is None:
            yield from ((self.prior, []) for _ in texts)
            return
        ids, labels = self.examples.ids.tolist(), self.examples.labels
        for start in range(0, len(texts), QUERIES):
            some = texts[start : start + QUERIES]
            for near in self.index.search([self.vector(t or "") for t in some], NEIGHBOURS):
                found = len(near[0])
                p = float(np.interp(vote(near, labels, self.prior), *self.fit)) if found else self.prior
                yield p, [ids[k] for k in near[1][:5].tolist()]


def tokenised(rows: DataFrame) -> DataFrame:
    """doc_id, y, and terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # what other operators keep in this worker
        for b in slices(batches):
            tfs = [Counter(terms_of(text)) for text in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(map(list, tfs), pa.list_(pa.string())), pa.array([list(tf.values()) for tf in tfs], pa.list_(pa.int32()))],
                ["doc_id", "y", "terms", "counts"],
            )

    return rows.select("doc_id", "text", "y").mapInArrow(run, "doc_id long, y int, terms array<string>, counts array<int>")


@dataclass
class Examples:
    """Term counts of examples in the order of their ids, with where the entries of each begin."""

    ids: np.ndarray
    labels: np.ndarray
    begins: np.ndarray
    columns: np.ndarray
    counts: np.ndarray
    #: A hash of 64 bits of the term of each column.
    words: np.ndarray
    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.begins))

    def times(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of term frequencies times the weights of the terms, and the lengths before."""
        x = np.log(self.counts, dtype=float)
        x += 1
        x *= weights[self.columns]
        norms = np.sqrt(np.bincount(self.rows, x * x, len(self.ids)))
        norms[norms == 0] = 1
        x /= norms[self.rows]
        return x, norms

    def kept(self, stay: np.ndarray) -> Examples:
        entries = np.repeat(stay, np.diff(self.begins))
        used, columns = np.unique(self.columns[entries], return_inverse=True)
        begins = np.concatenate([[0], np.cumsum(np.diff(self.begins)[stay])])
        return Examples(self.ids[stay], self.labels[stay], begins, columns.astype(np.int32), self.counts[entries], self.words[used])

    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each term: examples, and examples of the class."""
        return np.bincount(self.columns, minlength=len(self.words)), np.bincount(self.columns, self.labels[self.rows], len(self.words))

    def idf(self, df):
        return np.log((1 + len(self.ids)) / (1 + df)) + 1

    def weights(self, df: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """IDF of terms times EVERY and the cube of how far they raise the log odds of the class."""
        prior = self.labels.mean()
        share = (hits + PRIOR_EXAMPLES * prior) / (df + PRIOR_EXAMPLES)
        return self.idf(df) * (EVERY + np.maximum(np.log(share / (1 - share)) - math.log(prior / (1 - prior)), 0) ** 3)

    @functools.cached_property
    def sorted_words(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.words)
        return self.words[order], order

    def columns_of(self, terms) -> np.ndarray:
        """The column of each term, -1 where no example has it."""
        words, order = self.sorted_words
        hashed = hashes(terms)
        if not len(words):
            return np.full(len(hashed), -1)
        at = np.minimum(np.searchsorted(words, hashed), len(words) - 1)
        return np.where(words[at] == hashed, order[at], -1)

    def built(self, weights: np.ndarray) -> Built:
        """The index; exact weights of entries are made again when asked for."""
        x, norms = self.times(weights)
        exact = Exact(self.counts, self.columns, weights, norms)
        block = BlockMax(self.begins, self.columns, x, len(self.words), self.labels, exact)
        self.sorted_words  # noqa: B018  (made here once, not by each worker)
        return Built(self, block, weights, norms, self.seen())

    def entries(self, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        some = slice(self.begins[k], self.begins[k + 1])
        return self.columns[some], values[some]

    def plain(self) -> Built:
        """All examples under plain TF-IDF."""
        return self.built(self.idf(self.seen()[0]))

    def learned(self, stay: np.ndarray) -> Built:
        """Examples without copies, under weights that know the labels."""
        left = self.kept(stay)
        return left.built(left.weights(*left.seen()))


@dataclass
class Exact:
    """Weights of entries in double precision."""

    counts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    norms: np.ndarray

    def __call__(self, entries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return (np.log(self.counts[entries], dtype=float) + 1) * self.weights[self.columns[entries]] / self.norms[vectors]


@dataclass
class Built:
    """Examples with their finished index, as it is sent to all workers, which make nothing of it themselves."""

    examples: Examples
    index: BlockMax
    weights: np.ndarray
    norms: np.ndarray
    seen: tuple[np.ndarray, np.ndarray]

    def query(self, k: int) -> Query:
        """The k-th example."""
        columns, counts = self.examples.entries(self.examples.counts, k)
        return columns, (np.log(counts, dtype=float) + 1) * self.weights[columns] / self.norms[k]

    def left_out(self, k: int) -> Query:
        """The k-th example as a query in which the weights of its terms don't know it."""
        df, hits = self.seen
        columns, counts = self.examples.entries(self.examples.counts, k)
        x = self.examples.weights(df[columns] - 1, hits[columns] - self.examples.labels[k]) * (1 + np.log(counts, dtype=float))
        return columns, x / (math.sqrt((x * x).sum()) or 1)


@dataclass
class Stored:
    """An object in a file of the shared folder, which each worker reads once; large arrays lie behind one another after the rest."""

    folder: str
    name: str

    @staticmethod
    def write(folder: str, name: str, value) -> None:
        buffers: list[pickle.PickleBuffer] = []
        head = pickle.dumps(value, 5, buffer_callback=buffers.append)
        raw = [b.raw() for b in buffers]
        head = pickle.dumps((head, [x.nbytes for x in raw]), 5)
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(len(head).to_bytes(8, "little") + head)
            for x in raw:
                out.write(x)

    def read(self):
        fs, base = pyarrow.fs.FileSystem.from_uri(self.folder)
        with fs.open_input_stream(f"{base}/{self.name}", compression=None, buffer_size=1 << 20) as stream:
            head, sizes = pickle.loads(stream.read(int.from_bytes(stream.read(8), "little")))
            buffers = [bytearray(n) for n in sizes]
            for x in buffers:
                view, at = memoryview(x), 0
                while at < len(x):
                    part = stream.read(min(READ, len(x) - at))
                    view[at : at + len(part)] = part
                    at += len(part)
        return pickle.loads(head, buffers=buffers)

    @property
    def value(self) -> Built:
        """What a worker has read and keeps until another operator needs the memory."""
        return once_a_worker(("stored", self.name), self.read)


def built_once(shared: Stored, how: Callable[[Examples], Built]) -> Stored:
    """What ``how`` makes of the stored examples: made by one task and written for all. Its size is bounded by MOST_ROWS examples."""
    spark = SparkSession.active()
    folder = shared_folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        name = f"toxicity-{uuid.uuid4().hex}.pickle"
        for _ in batches:
            Stored.write(folder, name, how(shared.read()))
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    return Stored(folder, spark.range(0, 1, 1, 1).mapInArrow(run, "name string").first().name)


def against_all(shared: Stored, of: Callable[[Built, list[int]], list[float]], n: int, least: int = 256) -> np.ndarray:
    """``of`` what is shared, for all positions below ``n``; by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, QUERIES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(shared.value, b.column(0).to_pylist()), pa.float64())], ["id", "value"])

    spark = SparkSession.active()
    parts = max(1, min(spark.sparkContext.defaultParallelism, n // least))
    found = spark.range(0, n, 1, parts).mapInArrow(run, "id long, value double").toArrow()
    out = np.zeros(n)
    out[found.column("id").to_numpy()] = found.column("value").to_numpy()
    return out


def are_copies(built: Built, ks: list[int]) -> list[float]:
    labels = built.examples.labels
    near = built.index.search([built.query(k) for k in ks], least=COPY)
    return [float(bool((labels[at[at < k]] == labels[k]).any())) for k, (_, at) in zip(ks, near, strict=True)]


def left_out_votes(built: Built, ks: list[int]) -> list[float]:
    labels = built.examples.labels
    prior = float(labels.mean())
    near = built.index.search([built.left_out(k) for k in ks], NEIGHBOURS + 1)
    return [vote((c[at != k][:NEIGHBOURS], at[at != k][:NEIGHBOURS]), labels, prior) for k, (c, at) in zip(ks, near, strict=True)]


def stored_examples(rows: DataFrame) -> tuple[Stored | None, np.ndarray]:
    """The examples of ``rows(doc_id, y, terms, counts)``, put together and written by one task, and their labels; None without rows."""
    folder = shared_folder(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)  # MOST_ROWS rows at most
        if not sum(b.num_rows for b in parts):
            return
        known = pa.Table.from_batches(parts)
        y = known.column("y").to_numpy().astype(float)
        begins = np.concatenate([[0], np.cumsum(pc.list_value_length(known.column("terms")).to_numpy())]).astype(np.int64)
        coded = pc.list_flatten(known.column("terms")).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        counts = pc.list_flatten(known.column("counts")).to_numpy()
        counts = counts.astype(np.min_scalar_type(int(counts.max(initial=0))))
        every = Examples(known.column("doc_id").to_numpy(), y, begins, coded.indices.to_numpy().astype(np.int32), counts, hashes(coded.dictionary.to_pylist()))
        name = f"toxicity-{uuid.uuid4().hex}.pickle"
        Stored.write(folder, name, every)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([y.tobytes()], pa.binary())], ["name", "y"])

    made = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "name string, y binary").collect()  # a row
    return (Stored(folder, made[0].name), np.frombuffer(made[0].y)) if made else (None, np.zeros(0))


def train(docs: DataFrame, labels: DataFrame) -> Model | Learned:
    """Learns from at most MOST_ROWS rows; the driver sees their labels and votes only."""
    ids = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = training_rows(ids, labels, "toxic", FOLDS, HELD_OUT, MOST_ROWS).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    shared, y = stored_examples(tokenised(rows))
    if not y.any() or y.all():
        share = float(y.mean()) if len(y) else 0.0
        return Model(None, None, share, (np.array([0.0]), np.array([share])))
    plain = built_once(shared, Examples.plain)
    stay = against_all(plain, are_copies, len(y)) == 0
    learned = built_once(shared, lambda e: e.learned(stay))
    votes = against_all(learned, left_out_votes, int(stay.sum()))
    prior = float(y[stay].mean())
    return Learned(learned, prior, careful_fit(votes, y[stay], prior))


@dataclass
class Learned:
    """A model as it is sent: the finished index and the fit."""

    shared: Stored
    prior: float
    fit: tuple[np.ndarray, np.ndarray]

    def made(self) -> Model:
        built = self.shared.value
        return Model(built.examples, built.index, self.prior, self.fit, built.weights)

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[int]]]:
        return self.made().scores(texts)


def careful_fit(votes: np.ndarray, labels: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The rising fit with FIT_EXAMPLES more examples in each step; still non-decreasing."""
    at, value = rising_fit(votes, labels)
    each = np.sort(votes)
    n = np.searchsorted(each, at[1::2], "right") - np.searchsorted(each, at[::2], "left")
    steps = np.maximum.accumulate((value[::2] * n + FIT_EXAMPLES * prior) / (n + FIT_EXAMPLES))
    return at, np.repeat(steps, 2)


def score(docs: DataFrame, model: Model | Learned) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of near examples); the model has a bounded size."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.made()
        for b in slices(batches):
            out = list(m.scores(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([p for p, _ in out], pa.float64()), pa.array([e for _, e in out], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"]
            )

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<long>")
    return scored.select("doc_id", is_held_out(FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "evidence")


def keep_clean(docs: DataFrame, model: Model | Learned) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns, in one pass."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.made()
        for b in slices(batches):
            yield b.filter(pa.array([p < CUT for p, _ in m.scores(b.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
