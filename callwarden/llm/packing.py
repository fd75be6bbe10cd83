"""Packing token streams into sequences of equal length: concatenate and cut.

Pass 1 encodes every document, ends it with the end id and writes it with the number of ids before
it in its partition.  The totals of the partitions, summed up in order, give each partition's place
in the stream.  Pass 2 adds the two and cuts each document at the multiples of the sequence length;
a document across a boundary yields one record on each side.  Only the last sequence is short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callwarden.llm.arrays import kept, tidy
from callwarden.llm.bpe_words import Splitter, WordEncoder, load_tokenizer, parts
from callwarden.llm.storage import keyed_texts, stored

#: Encoded words that a worker keeps until it gets another operator's task; beyond that it starts anew.  Results do not depend on it.
KEPT_WORDS = 800_000


class _Encoder:
    """Little-endian 32-bit ids of texts, with those of recent words kept."""

    def __init__(self, path: str):
        tokenizer = load_tokenizer(path)
        self.split, self.words, self.kept = Splitter(tokenizer), WordEncoder(tokenizer), {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        keys = [self.split(t) for t in texts]
        kept = self.kept
        missing = set().union(*keys).difference(kept)
        if missing:
            if len(kept) + len(missing) > KEPT_WORDS:
                kept.clear()
                missing = set().union(*keys)
            pairs = {k: p for k in missing if (p := parts(k))}
            simple = list({w for p in pairs.values() for w in p if w not in kept} | (missing - pairs.keys()))
            kept.update(zip(simple, self.words.many(simple), strict=True))
            kept.update((k, kept[a] + kept[b]) for k, (a, b) in pairs.items())
        return [b"".join(map(kept.__getitem__, k)) for k in keys]


_encoders: dict[str, _Encoder] = kept.setdefault("packing", {})


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(key, part, before, n, ids): ids as little-endian 32-bit numbers, `before` counted in the partition."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches):
        encoder = _encoder(tokenizer_path)
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 64):
                ids = [i + end for i in encoder([t or "" for t in texts[at : at + 64].to_pylist()])]
                n = np.array([len(i) // 4 for i in ids], np.int64)
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 64), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                    ["key", "part", "before", "n", "ids"],
                )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(tidy(encode, "packing"), f"key {kind}, part int, before bigint, n bigint, ids binary")


def _cut(batches, length: int):
    """(key, start, length, ids, doc_tokens, sequence_id, offset) of each piece of the rows (key, at, n, ids)."""
    for batch in batches:
        keys, at, n = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        first, last = at // length, (at + n - 1) // length
        count = last - first + 1
        row = np.repeat(np.arange(len(n)), count)
        sequence = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        begin = np.maximum(at[row], sequence * length)
        size = np.minimum(at[row] + n[row], (sequence + 1) * length) - begin
        start = begin - at[row]
        for lo in range(0, len(row), 4096):
            s = slice(lo, lo + 4096)
            ids = batch.column(3)
            pieces = [ids[int(r)].as_buffer()[4 * a : 4 * (a + z)].to_pybytes() for r, a, z in zip(row[s], start[s].tolist(), size[s].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(row[s])), pa.array(start[s]), pa.array(size[s]), pa.array(pieces, pa.binary()), pa.array(n[row[s]]), pa.array(sequence[s]), pa.array(begin[s] - sequence[s] * length)],
                ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids, doc_tokens, sequence_id, offset.

    The stream follows the rows of the table.  Null and empty texts are the end id alone; repeated
    rows and repeated or null keys are documents of their own; an empty table gives no rows; other
    columns are ignored.  Texts of any length are cut like others.  Runs an action (the encoded
    table is written once, so both passes see the same stream).
    """
    encoded = stored(encode_documents(keyed_texts(docs, key, text), tokenizer_path, end_id))
    # one row per partition of the input
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("place"))
    placed = encoded.join(F.broadcast(places), "part").select("key", (F.col("place") + F.col("before")).alias("at"), "n", "ids")

    kind = encoded.schema["key"].dataType.simpleString()
    out = placed.mapInArrow(tidy(lambda batches: _cut(batches, length), "packing"), f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key)
