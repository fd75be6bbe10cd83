"""Logistic regression over hashed features, trained by follow-the-regularised-leader.

Per-coordinate rates and an L1 term (FTRL-proximal) leave few weights; they are broadcast as one array of
2 ** bits floats, whatever the size of the corpus.  Features are binary: a document has one or not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from callwarden.llm.arrays import blocks, text_bytes, tidy
from callwarden.llm.ngrams import features
from callwarden.llm.storage import keyed_texts, scratch, stored


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2)
    skips: tuple[int, ...] = ()
    bits: int = 20
    lower: bool = False
    ditto: bool = False
    alpha: float = 0.1
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 2
    #: Most labelled rows to learn from; beyond it, those with the smallest hash of their key.
    most_rows: int = 12_000


def sampled(labels: DataFrame, key: str, label: str, settings: Settings) -> DataFrame:
    """(key, y) of at most `most_rows` labelled rows; several labels of a key: the largest."""
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("y")).where("key is not null and y is not null")
    return known.groupBy("key").agg(F.max("y").alias("y")).orderBy(F.xxhash64("key"), "key").limit(settings.most_rows)


def train(docs: DataFrame, labels: DataFrame, settings: Settings, key: str = "doc_id", text: str = "text", label: str = "y") -> np.ndarray:
    """Weights, the bias last.  Without labelled rows all are zero.  Runs actions.

    The sample is bounded, so one task goes through it in a fixed order; only non-zero weights
    reach the driver.
    """
    slim = keyed_texts(docs, key, text)
    rows = slim.join(F.broadcast(sampled(labels, key, label, settings)), "key").select("key", "y", "text")

    def extract(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in blocks(offsets):
                doc, found = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], settings.orders, settings.skips, settings.bits, settings.lower, settings.ditto)
                pairs = np.unique(doc << settings.bits | found)
                edge = np.searchsorted(pairs >> settings.bits, np.arange(hi - lo + 1))
                index = (pairs & ((1 << settings.bits) - 1)).astype("<i4")
                cut = [index[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(cut, pa.binary())], ["key", "y", "x"])

    kind = slim.schema["key"].dataType.simpleString()
    def learn(batches):
        held = [(np.frombuffer(x, "<i4"), y) for b in batches for x, y in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True)]
        weights = ftrl(held, settings)
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(weights[at])], ["i", "w"])

    out = np.zeros((1 << settings.bits) + 1)
    with scratch():
        examples = stored(rows.mapInArrow(tidy(extract), f"key {kind}, y int, x binary"))
        sample = examples.repartition(1).sortWithinPartitions(F.xxhash64("key"), "key", F.xxhash64("x"))
        for row in sample.select("y", "x").mapInArrow(tidy(learn), "i int, w double").collect():
            out[row.i] = row.w
    return out


def ftrl(examples: list[tuple[np.ndarray, int]], s: Settings) -> np.ndarray:
    """FTRL-proximal over the examples (feature indices, label), `epochs` times in the given order."""
    bias = 1 << s.bits
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)

    def weights(at):
        zi, root = z[at], np.sqrt(n[at])
        free = at == bias  # the bias is not regularised
        l1 = np.where(free, 0.0, s.l1)
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((s.beta + root) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for index, label in examples:
            at = np.append(index, bias)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - (label > 0)
            grown = np.sqrt(n[at] + g * g)
            z[at] += g - (grown - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    return weights(np.arange(bias + 1))


def with_score(docs: DataFrame, weights: np.ndarray, settings: Settings, text: str = "text", name: str = "score") -> DataFrame:
    """The rows with a column `name`: a sparse dot product of the whole text with the broadcast weights."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    place = docs.columns.index(text)

    def run(batches):
        w = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            values = np.zeros(batch.num_rows)
            for lo, hi in blocks(offsets):
                doc, found = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], settings.orders, settings.skips, settings.bits, settings.lower, settings.ditto)
                hit = w[found] != 0
                pairs = np.unique(doc[hit] << settings.bits | found[hit])
                total = w[-1] + np.bincount(pairs >> settings.bits, w[pairs & ((1 << settings.bits) - 1)], hi - lo)
                values[lo:hi] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score(docs: DataFrame, weights: np.ndarray, settings: Settings, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every whole text."""
    return with_score(keyed_texts(docs, key, text), weights, settings).select("key", "score")
