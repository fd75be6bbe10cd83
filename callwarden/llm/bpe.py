"""Byte-pair encoding through a table of distinct words, and decoding through a table of pieces.

Encoding: a task splits a block of texts into words and keeps each text as numbers of the block's own
distinct words.  Those words, dealt out by hash, meet the same words of all other blocks; each
distinct word is encoded once, and its ids go back to the blocks that asked for it, where they are
put in the places of the word.  Per block a word travels once, however often it occurs, so frequent words
are no hot keys; words, numbers and ids travel compressed.  Decoding: ids take their bytes from the id-to-piece
table, whose size is that of the vocabulary.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callwarden.llm.bpe_words import Splitter, WordEncoder, load_tokenizer, parts
from callwarden.llm.storage import keyed_texts

#: A block ends at so many distinct words or bytes of text.
BLOCK_WORDS, BLOCK_TEXT = 400_000, 20 << 20


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, which compress better than the numbers."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unsqueeze(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _squeeze_words(words: list[str]) -> tuple[bytes, bytes]:
    raw = [w.encode() for w in words]
    return _squeeze(np.array([len(r) for r in raw], np.uint32)), zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unsqueeze_words(lens: bytes, packed: bytes) -> list[str]:
    raw, ends = zstandard.ZstdDecompressor().decompress(packed), np.cumsum(_unsqueeze(lens)).tolist()
    return [raw[a:z].decode() for a, z in zip([0, *ends[:-1]], ends, strict=True)]


def _lists(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))


def _blocks(batches, tokenizer_path: str):
    """(block, words in the order of their numbers, keys, words per text, numbers) of each block.

    A block is named by its list of words, so equal names mean equal numbers.
    """
    split = Splitter(load_tokenizer(tokenizer_path))
    numbers, keys, counts, chunks, size = {}, [], [], [], 0

    def closed():
        words = list(numbers)
        name = xxhash.xxh64_intdigest("\x01".join(words)) - (1 << 63)
        return name, words, keys, counts, np.concatenate(chunks)

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            keys += batch.column(0).slice(at, 64).to_pylist()
            for text in batch.column(1).slice(at, 64).to_pylist():
                words = split(text or "")
                chunks.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words)))
                counts.append(len(words))
                size += len(text or "")
            if len(numbers) >= BLOCK_WORDS or size >= BLOCK_TEXT:
                yield closed()
                numbers, keys, counts, chunks, size = {}, [], [], [], 0
    if keys:
        yield closed()


def _words(docs: DataFrame, tokenizer_path: str, buckets: int) -> DataFrame:
    """(bucket, block, numbers, lens, words): a block's words of one bucket; a word and the same with marks share one."""

    def run(batches):
        for block, words, *_ in _blocks(batches, tokenizer_path):
            home = np.array([xxhash.xxh32_intdigest((parts(w) or (w,))[0]) % buckets for w in words], np.int64)
            for at in np.split(np.argsort(home, kind="stable"), np.flatnonzero(np.diff(np.sort(home))) + 1):
                if len(at):
                    at = np.array(sorted(at.tolist(), key=words.__getitem__))
                    lens, packed = _squeeze_words([words[i] for i in at.tolist()])
                    row = [[int(home[at[0]])], [block], [_squeeze(at)], [lens], [packed]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "numbers", "lens", "words"])

    return docs.mapInArrow(run, "bucket int, block bigint, numbers binary, lens binary, words binary")


def _texts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(block, keys, counts, text): the texts of a block as numbers of its words."""
    key_type = docs.schema["key"].dataType.simpleString()

    def run(batches):
        kind = None

        def seen():
            nonlocal kind
            for batch in batches:
                kind = batch.column(0).type
                yield batch

        for block, _, keys, counts, numbers in _blocks(seen(), tokenizer_path):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([keys], pa.list_(kind)), pa.array([counts], pa.list_(pa.int32())), pa.array([_squeeze(numbers)], pa.binary())], ["block", "keys", "counts", "text"])

    return docs.mapInArrow(run, f"block bigint, keys array<{key_type}>, counts array<int>, text binary")


def _encode_words(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """(block, numbers, lens, ids): ids in place of words.  Rows come bucket by bucket."""

    def run(batches):
        encoder, now, known = WordEncoder(load_tokenizer(tokenizer_path)), None, {}
        for batch in batches:
            lens, ids = [], []
            for bucket, sizes, packed in zip(*[batch.column(i).to_pylist() for i in (0, 3, 4)], strict=True):
                if bucket != now:
                    now, known = bucket, {}
                words = _unsqueeze_words(sizes, packed)
                pairs = {w: p for w in words if w not in known and (p := parts(w))}
                simple = [w for w in dict.fromkeys([*words, *(x for p in pairs.values() for x in p)]) if w not in known and w not in pairs]
                known.update(zip(simple, encoder.many(simple), strict=True))
                known.update((w, known[a] + known[b]) for w, (a, b) in pairs.items())
                found = [known[w] for w in words]
                lens.append(_squeeze(np.array([len(f) // 4 for f in found], np.uint32)))
                ids.append(_squeeze(np.frombuffer(b"".join(found), "<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(lens, pa.binary()), pa.array(ids, pa.binary())], ["block", "numbers", "lens", "ids"])

    return rows.mapInArrow(run, "block bigint, numbers binary, lens binary, ids binary")


def gathered(values: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The ranges of `values` given by start and length, one after the other."""
    ends = np.cumsum(lens)
    return values[np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)]


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) per row of `docs`, with the ids of the tokenizer for the whole text.

    Null and empty texts have no ids.  Repeated rows and keys are encoded alike; texts of any length
    are one row; an empty table gives no rows; other columns are ignored.  `docs` is read twice and
    has to give the same rows in the same order; blocks named by their words make sure of that.
    """
    slim = keyed_texts(docs, key, text)
    key_type = slim.schema["key"].dataType.simpleString()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = _words(slim, tokenizer_path, 8 * partitions).repartition("bucket").sortWithinPartitions("bucket")
    rows = _encode_words(words, tokenizer_path).unionByName(_texts(slim, tokenizer_path), allowMissingColumns=True)
    # the texts come after the words of their block
    back = rows.repartition("block").sortWithinPartitions("block", F.col("text").isNotNull()).select("block", "numbers", "lens", "ids", "keys", "counts", "text")

    def join_back(batches):
        now, fresh, where, long, flat = None, [], None, None, None
        for batch in batches:
            for at, block in enumerate(batch.column(0).to_pylist()):
                if block != now:
                    now, fresh, where, long, flat = block, [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
                if not batch.column(6)[at].is_valid:
                    fresh.append([_unsqueeze(batch.column(i)[at].as_py()) for i in (1, 2, 3)])
                    continue
                if fresh:
                    place, lens, flat = (np.concatenate([f[i] for f in fresh]) for i in range(3))
                    lens, fresh = lens.astype(np.int64), []
                    where, long = np.full(int(place.max()) + 1, -1), np.zeros(int(place.max()) + 1, np.int64)
                    where[place], long[place] = np.cumsum(lens) - lens, lens
                keys, counts = batch.column(4)[at].values, batch.column(5)[at].values.to_numpy()
                codes = _unsqueeze(batch.column(6)[at].as_py())
                if len(codes) and (codes.max() >= len(where) or (where < 0).any()):
                    raise RuntimeError("the input gave other rows when it was read again")
                edges = np.concatenate(([0], np.cumsum(counts)))
                for lo in range(0, len(counts), 64):
                    hi = min(lo + 64, len(counts))
                    c = codes[edges[lo] : edges[hi]]
                    each = np.concatenate(([0], np.cumsum(long[c]))).astype(np.int64)
                    out = gathered(flat, where[c], long[c]) if len(c) else flat[:0]
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo), _lists(out.astype(np.int32), each[edges[lo : hi + 1] - edges[lo]])], ["key", "ids"])

    return back.mapInArrow(join_back, f"key {key_type}, ids array<int>").withColumnRenamed("key", key)


def pieces(tokenizer_path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary file."""
    with open(tokenizer_path, encoding="utf-8") as file:
        content = json.load(file)
    # printable bytes stand for themselves; the others, in order, for the characters from 256 on
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shown = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    words = {i: w for w, i in content["model"]["vocab"].items()} | {t["id"]: t["content"] for t in content["added_tokens"]}
    out = [b""] * (max(words) + 1)
    for i, w in words.items():
        out[i] = bytes(shown[c] for c in w) if all(c in shown for c in w) else w.encode()
    return out


def decode(encoded: DataFrame, tokenizer_path: str, ids: str = "ids") -> DataFrame:
    """The rows with a column `decoded`: the text of the ids, null where they are null.

    Bytes that are no UTF-8 become replacement characters.
    """
    kept = [c for c in encoded.columns if c != "decoded"]

    def run(batches):
        table = pieces(tokenizer_path)
        lens = np.array([len(p) for p in table], np.int64)
        flat, starts = np.frombuffer(b"".join(table), np.uint8), np.cumsum(lens) - lens
        for batch in batches:
            column = batch.column(kept.index(ids))
            texts = []
            for item in column:
                if item.is_valid:
                    i = item.values.to_numpy()
                    texts.append(gathered(flat, starts[i], lens[i]).tobytes().decode("utf-8", "replace"))
                else:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, "decoded"])

    schema = encoded.select(*kept).schema.add("decoded", "string")
    return encoded.select(*kept).mapInArrow(run, schema)
