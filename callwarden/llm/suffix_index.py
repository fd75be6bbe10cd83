"""Removing long repeats with a logarithmic family of suffix arrays.

A byte string of `length` bytes repeats if it starts at two places.  Of each window of that length the
gram with the least hash is its anchor; equal windows have equal anchors at equal distances, so only
places under an anchor seen elsewhere can repeat.  Neighbouring windows with one anchor form a run.

1. Anchors and runs are counted as hashes.  Runs whose anchor is unique hold no repeat; runs equal to
   all others of their anchor repeat as a whole.
2. Of what is left, one copy of each different run goes to the index.  Tasks, by anchor, take the runs in
   batches: a batch gets a suffix array of its window starts and joins the existing levels; levels of equal
   size are merged, so that there are only logarithmically many, and scanned for matches of the full length as
   they are.  At the end the levels left are merge-scanned against each other.
3. Anchors with very many different runs (the edge of a passage that very many documents share) would
   fill one task; their windows are counted by hash instead.

Work and shuffles follow the bytes that repeat, not the pairs that do.

Passages of a number of words are found the same way in texts whose words are replaced by codes of equal
width.
"""

from __future__ import annotations

from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from callwarden.llm.arrays import Hasher, blocks, text_bytes, tidy, words
from callwarden.llm.storage import scratch, stored

#: Bytes taken at once, window starts per batch of the index and per task, and different runs of an
#: anchor beyond which its windows are counted.  None of them changes the result.
CHUNK, BATCH, TASK, CROWD = 1 << 19, 1 << 15, 150_000, 1024

#: Characters that stand for a word, of 64 different ones: 30 bits of its hash.
CODE = 5
_DIGITS = np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+-", np.uint8)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` neighbours, from running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    square = padded.reshape(-1, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(document, start in the block, windows, place of the anchor, anchor hash, run hash)."""
    width = length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return none
    hasher = Hasher(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    bits = np.uint64(max(20, int(n).bit_length()))
    ranked = (hasher.ranges(at, at + gram) >> bits << bits) | at.astype(np.uint64)
    place = (_sliding_min(ranked, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    windows = len(data) - length + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:windows]
    valid = np.arange(windows) + length <= offsets[1:][doc]
    edge = np.ones(windows, bool)
    edge[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, windows))
    start, size = start[valid[start]], size[valid[start]]
    place = place[start]
    return doc[start], start, size, place, hasher.ranges(place, place + gram), hasher.ranges(start, start + size + length - 1)


def find_runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, h, start, n, anchor, run) of every text of `docs` (key, h, text)."""

    def rows(keys, hashes, found, doc, shift):
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(doc)), hashes.take(pa.array(doc)), pa.array((found[1] + shift).astype(np.int32)), pa.array(found[2].astype(np.int32)), pa.array(found[4].view(np.int64)), pa.array(found[5].view(np.int64))],
            ["key", "h", "start", "n", "anchor", "run"],
        )

    def run(batches):
        for batch in batches:
            keys, hashes = batch.column(0), batch.column(1)
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in blocks(offsets, CHUNK):
                a, z = offsets[lo], offsets[hi]
                if hi == lo + 1 and z - a > 2 * CHUNK:  # a very long text, in overlapping parts
                    for c in range(a, z - length + 1, CHUNK):
                        part = data[c : min(c + CHUNK + length - 1, z)]
                        found = anchor_runs(part, np.array([0, len(part)]), length, gram)
                        yield rows(keys, hashes, found, found[0] + lo, c - a)
                    continue
                found = anchor_runs(data[a:z], offsets[lo : hi + 1] - a, length, gram)
                if len(found[0]):
                    yield rows(keys, hashes, found, found[0] + lo, a - offsets[lo:hi][found[0]])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(tidy(run), f"key {kind}, h bigint, start int, n int, anchor bigint, run bigint")


class Family:
    """Suffix arrays by level; an array is a list of suffix numbers in the order of the suffixes.

    Suffixes are cut at the length of a match, which is all that a scan compares.  An array is scanned as it is made,
    by itself or of two levels, so each suffix is read once a level and not once for each batch after it.
    """

    def __init__(self):
        self.levels: list[list[int]] = []
        self.suffixes: dict[int, bytes] = {}
        self._matched: set[int] = set()

    def _array(self, numbers: list[int]) -> list[int]:
        """The numbers in the order of their suffixes; neighbours with a common prefix of the full length match.

        Of arrays one after the other the sort finds the runs and merges them.
        """
        order = sorted(numbers, key=self.suffixes.__getitem__)
        cut = [self.suffixes[i] for i in order]
        again = np.fromiter(map(eq, cut, islice(cut, 1, None)), bool, max(0, len(cut) - 1))
        for at in np.flatnonzero(again).tolist():
            self._matched.add(order[at])
            self._matched.add(order[at + 1])
        return order

    def add(self, suffixes: list[tuple[bytes, int]]) -> None:
        """A new batch: it gets a suffix array, which is merged with the levels that are no larger."""
        self.suffixes.update((number, suffix) for suffix, number in suffixes)
        new = self._array([number for _, number in suffixes])
        while self.levels and len(self.levels[-1]) <= len(new):
            new = self._array(self.levels.pop() + new)
        self.levels.append(new)

    @property
    def matched(self) -> set[int]:
        """The numbers of suffixes that are equal to another; the levels are scanned against each other, smallest first."""
        if len(self.levels) > 1:
            last: list[int] = []
            for level in reversed(self.levels):
                last = self._array(level + last)
        return self._matched


def _intervals(numbers: np.ndarray) -> list[dict]:
    """Sorted window numbers as half-open ranges."""
    if not len(numbers):
        return []
    cut = np.flatnonzero(np.diff(numbers) > 1)
    starts, ends = numbers[np.append(0, cut + 1)], numbers[np.append(cut, len(numbers) - 1)] + 1
    return [{"a": int(a), "z": int(z)} for a, z in zip(starts, ends, strict=True)]


_HITS = "anchor bigint, run bigint, hits array<struct<a:int,z:int>>"


def index_runs(runs: DataFrame, length: int, tasks: int) -> DataFrame:
    """(anchor, run, hits) for runs (anchor, run, body): the windows that start elsewhere as well."""

    def run(batches):
        family, owners, begins, waiting, count = Family(), [], [], [], 0
        for batch in batches:
            for anchor, name, body in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                owners.append((anchor, name))
                begins.append(count)
                windows = len(body) - length + 1
                waiting += [(body[i : i + length], count + i) for i in range(windows)]
                count += windows
                if len(waiting) >= BATCH:
                    family.add(waiting)
                    waiting = []
        if waiting:
            family.add(waiting)
        if not owners:
            return
        hits = np.array(sorted(family.matched), np.int64)
        edges = np.searchsorted(hits, np.array([*begins, count]))
        for lo in range(0, len(owners), 4096):
            part = range(lo, min(lo + 4096, len(owners)))
            found = [_intervals(hits[edges[i] : edges[i + 1]] - begins[i]) for i in part]
            yield pa.RecordBatch.from_arrays(
                [pa.array([owners[i][0] for i in part]), pa.array([owners[i][1] for i in part]), pa.array(found, pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))],
                ["anchor", "run", "hits"],
            )

    return runs.repartition(tasks, "anchor").mapInArrow(tidy(run), _HITS)


def count_windows(runs: DataFrame, length: int) -> DataFrame:
    """As `index_runs`, by counting the hash of every window under its anchor."""

    def run(batches):
        for batch in batches:
            for anchor, name, body in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                at = np.arange(len(body) - length + 1)
                h = Hasher(np.frombuffer(body, np.uint8)).ranges(at, at + length).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * len(at), pa.int64()), pa.array([name] * len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(h)], ["anchor", "run", "at", "window"])

    windows = runs.mapInArrow(tidy(run), "anchor bigint, run bigint, at int, window bigint")
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "window")
    hit = windows.join(twice, ["anchor", "window"])
    each = F.transform(F.array_sort(F.collect_list("at")), lambda a: F.struct(a.alias("a"), (a + 1).alias("z")))
    return hit.groupBy("anchor", "run").agg(each.alias("hits"))  # one entry per window of a run at most


def repeated_spans(slim: DataFrame, length: int, gram: int) -> DataFrame:
    """(key, h, spans) of the texts (key, h, text) that hold repeats; spans may overlap."""
    runs = stored(find_runs(slim, length, gram))
    # written, so that the join below deals out both sides anew and can split a very common anchor
    anchors = stored(runs.groupBy("anchor").agg(F.count("*").alias("c"), F.min("run").alias("least"), F.max("run").alias("most")).where("c > 1"))
    shared = runs.join(anchors, "anchor").withColumn("same", F.col("least") == F.col("most")).drop("c", "least", "most")
    shared = stored(shared)
    differing = shared.where(~F.col("same"))
    one = F.min(F.struct("h", "key", "start", "n"))
    kinds = stored(differing.groupBy("anchor", "run").agg(F.count("*").alias("c"), one.alias("one")).select("anchor", "run", "c", "one.*"))
    crowd = kinds.groupBy("anchor").agg(F.count("*").alias("different")).where(F.col("different") > CROWD)
    starts = kinds.agg(F.sum("n")).first()[0] or 0

    def cut(wanted: DataFrame) -> DataFrame:
        joined = slim.join(wanted.withColumnsRenamed({"h": "h2", "key": "key2"}), F.col("h").eqNullSafe(F.col("h2")) & F.col("key").eqNullSafe(F.col("key2")))
        # equal rows hold the same text
        body = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("n") + length - 1)
        return joined.select("anchor", "run", body.alias("body")).dropDuplicates(["anchor", "run"])

    indexed = index_runs(cut(kinds.join(crowd, "anchor", "left_anti")), length, max(1, -(-starts // TASK)))
    counted = count_windows(cut(kinds.join(crowd, "anchor", "left_semi")), length)
    found = indexed.unionByName(counted)
    # a run that occurs twice repeats as a whole, whatever else is like it
    known = kinds.join(found, ["anchor", "run"], "left").select("anchor", "run", F.when(F.col("c") > 1, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("z")))).otherwise(F.col("hits")).alias("hits"))
    hit = differing.join(known, ["anchor", "run"]).select("key", "h", "start", F.explode("hits").alias("hit"))
    spans = hit.select("key", "h", (F.col("start") + F.col("hit.a")).alias("a"), (F.col("start") + F.col("hit.z") + (length - 1)).alias("z"))
    whole = shared.where("same").select("key", "h", F.col("start").alias("a"), (F.col("start") + F.col("n") + (length - 1)).alias("z"))
    # per document at most one span per byte
    return spans.unionByName(whole).distinct().groupBy("key", "h").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def _coded(slim: DataFrame) -> DataFrame:
    """`slim` (key, h, text) with CODE characters for each word of the text."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in blocks(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                part = data[offsets[lo] : offsets[hi]]
                starts, ends, doc = words(part, at)
                h = Hasher(part).ranges(starts, ends)
                codes = _DIGITS[np.stack([h >> np.uint64(6 * i) & np.uint64(63) for i in range(CODE)], axis=1)].tobytes()
                edges = np.append(0, np.cumsum(np.bincount(doc, minlength=hi - lo))) * CODE
                texts = pa.array([codes[a:z].decode() for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), texts], ["key", "h", "text"])

    return slim.mapInArrow(tidy(run), slim.schema)


def _byte_spans(raw: bytes, spans) -> list[dict]:
    """Spans of coded words as spans of bytes, from a first word to the end of a last one."""
    starts, ends, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    a, z = (spans.values.field(f).to_numpy() for f in ("a", "z"))
    a, z = np.unique(np.stack([-(-a // CODE), z // CODE]), axis=1)
    begin = np.where(a == 0, 0, starts[a])  # white space at the text's ends goes with its words
    end = np.where(z == len(ends), len(raw), ends[z - 1])
    return [{"a": x, "z": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)]


def repeated_word_spans(slim: DataFrame, most: int) -> DataFrame:
    """(key, h, spans) of the texts (key, h, text) with passages of over `most` words that start elsewhere as well.

    Passages are alike word by word, whatever white space is between; spans are in bytes.
    """
    length = (most + 1) * CODE
    found = repeated_spans(_coded(slim), length, length // 2).withColumnsRenamed({"key": "key2", "h": "h2"})

    def run(batches):
        for batch in batches:
            out = [_byte_spans(t.as_buffer().to_pybytes(), s) for t, s in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())])))], ["key", "h", "spans"])

    joined = slim.join(found, F.col("h").eqNullSafe(F.col("h2")) & F.col("key").eqNullSafe(F.col("key2"))).select("key", "h", "text", "spans").dropDuplicates(["key", "h"])
    return joined.mapInArrow(tidy(run), f"key {slim.schema['key'].dataType.simpleString()}, h bigint, spans array<struct<a:int,z:int>>")


def _marked(docs: DataFrame, length: int, gram: int | None, key: str, text: str, most_words: int | None = None) -> DataFrame:
    """(row, text, spans): `row` is the whole row, `spans` its repeats or null."""
    named = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("h"), F.coalesce(docs[text], F.lit("")).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    slim = named.select("key", "h", "text")
    with scratch() as own:
        spans = own.keep(repeated_spans(slim, length, gram or max(1, length // 2)))
    if most_words is not None:
        with scratch() as own:
            both = spans.unionByName(own.keep(repeated_word_spans(slim, most_words)))
        spans = both.groupBy("key", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    spans = spans.withColumnsRenamed({"key": "key2", "h": "h2"})
    return named.join(spans, F.col("h").eqNullSafe(F.col("h2")) & F.col("key").eqNullSafe(F.col("key2")), "left").select("row", "text", "spans")


def _cut_out(raw: bytes, spans) -> tuple[list[dict], bytes]:
    """(maximal removed ranges, bytes left)."""
    if not spans.is_valid:
        return [], raw
    a, z = (spans.values.field(f).to_numpy() for f in ("a", "z"))
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    first = np.append(0, np.flatnonzero(a[1:] > z[:-1]) + 1)
    removed = list(zip(a[first].tolist(), z[np.append(first[1:] - 1, len(z) - 1)].tolist(), strict=True))
    edges = [0, *[e for r in removed for e in r], len(raw)]
    return [{"a": a, "z": z} for a, z in removed], b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, length: int = 400, gram: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, removed, kept) per row of `docs`: the maximal removed byte ranges, the bytes left.

    Every byte of a `length`-byte string that also starts elsewhere goes, in all places, judged on the
    texts as given.  Null and empty texts have no bytes; shorter texts stay whole; rows repeated with
    key and text count as several places and are treated alike; null keys are keys; an empty table
    gives no rows; other columns are ignored.  Runs actions.
    """

    def run(batches):
        for batch in batches:
            raws = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            out = [_cut_out(r, s) for r, s in zip(raws, batch.column(2), strict=True)]
            ranges = pa.array([o[0] for o in out], pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raws], pa.int64()), ranges, pa.array([o[1] for o in out], pa.binary())], ["key", "n_bytes", "removed", "kept"])

    slim = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    marked = _marked(slim, length, gram, "key", "text").select(F.col("row.key").alias("key"), "text", "spans")
    out = marked.mapInArrow(tidy(run), f"key {slim.schema['key'].dataType.simpleString()}, n_bytes bigint, removed array<struct<a:bigint,z:bigint>>, kept binary")
    return out.withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, length: int = 400, gram: int | None = None, key: str = "doc_id", text: str = "text", most_words: int | None = None) -> DataFrame:
    """The rows of `docs` with the repeats cut out of the text; rows with nothing left are left out.

    With `most_words`, repeated passages of more words go too, however few bytes they have.  A character that is cut through goes as a whole.  Runs actions.
    """

    def run(batches):
        for batch in batches:
            out = [None if not s.is_valid else _cut_out(t.as_buffer().to_pybytes(), s)[1].decode("utf-8", "ignore") for t, s in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["row", "left"])

    marked = _marked(docs, length, gram, key, text, most_words)
    schema = StructType([marked.schema["row"], StructField("left", StringType())])
    done = marked.mapInArrow(tidy(run), schema).where("left is null or left <> ''")
    return done.select(*[F.coalesce("left", F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
