"""Quality by compression: a text that a dictionary of good text shortens more is likelier good.

Two zstandard dictionaries are trained, on pieces of good and of bad labelled texts. A text's feature
is the difference of its two compressed sizes over its length; a logistic fit on other labelled rows
makes it a probability.

Defined results: a null or empty text has feature 0; a class without labelled rows gives a flat score,
the share of good rows, or 0.5 without any; extra columns aren't looked at; repeated rows give repeated
rows; no rows give no rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import slices, text_bytes
from sparkloom.llm.labelled import is_held_out, logistic, logistic_fit, training_rows

FOLDS, HELD_OUT, CUT = 4, 2, 0.7
#: Bounds of what is learned from: labelled rows, pieces of text for each dictionary, bytes of each.
MOST_ROWS, MOST_PIECES, PIECE, DICTIONARY = 8_000, 6_000, 1_000, 112_640
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    fit: tuple[float, float, float, float]


@functools.lru_cache(4)
def compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    made = []
    for raw in (good, bad):
        trained = zstandard.ZstdCompressionDict(raw)
        trained.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False, write_checksum=False))
    return made[0], made[1]


def features(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    if not good or not bad:
        return np.zeros(len(texts))
    a, b = compressors(good, bad)
    return np.array([(len(b.compress(t)) - len(a.compress(t))) / len(t) if t else 0.0 for t in texts])


def dictionary(pieces: list[bytes]) -> bytes:
    """Of few pieces, which the trainer refuses, the pieces themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(pieces)[-DICTIONARY:]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from at most MOST_ROWS rows: three in four give pieces for the dictionaries, the rest the fit."""
    rows = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, MOST_ROWS).withColumn("to_fit", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0)
    pieces = rows.where("not to_fit").select("doc_id", "y", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("k", "piece"))
    order = [F.xxhash64("doc_id", "k"), F.col("doc_id"), F.col("k")]
    good, bad = (dictionary([r.piece.encode() for r in pieces.where(F.col("y") == y).orderBy(*order).limit(MOST_PIECES).select("piece").collect()]) for y in (1, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(features(text_bytes(b.column(0)), good, bad)), b.column(1)], ["x", "y"])

    seen = rows.where("to_fit").select("text", "y").mapInArrow(run, "x double, y int").toPandas()
    return Model(good, bad, logistic_fit(seen["x"].to_numpy(float), seen["y"].to_numpy(float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; the model is two dictionaries of bounded size."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            p = logistic(features(text_bytes(b.column(1)), m.good, m.bad), m.fit)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", is_held_out(FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
