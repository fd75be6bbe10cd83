"""Near-duplicate documents by SimHash with multi-index hashing.

Fingerprints differ in at most d bits only if some one of their m segments differs in at most
floor(d / m) bits.  Each distinct fingerprint therefore enters a table under each of its segments,
and probes it with the small Hamming ball around each segment; matches are verified on all bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.llm.arrays import LOWER, SPACE, blocks, text_bytes, tidy, words
from callwarden.llm.components import components
from callwarden.llm.storage import keyed_texts, stored

BITS, SEGMENTS = 64, 4


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the lower-cased word shingles, their number by document) of a block."""
    docs = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    count = np.bincount(doc, minlength=docs)
    first = np.cumsum(count) - count
    plain, keep = LOWER[data], ~SPACE[data]
    follows = np.ones(len(starts), bool)
    follows[first[count > 0]] = False
    gap = starts[follows] - 1
    keep[gap], plain[gap] = True, 0x20
    place = np.concatenate(([0], np.cumsum(keep)))
    joined = plain[keep].tobytes()
    begin, end = place[starts], place[ends]
    # one shingle per word that has enough words from it on, or one for a short document
    per_doc = np.where(count == 0, 0, np.maximum(count - shingle + 1, 1))
    at = np.repeat(first, per_doc) + np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    last = np.minimum(at + shingle, np.repeat(first + count, per_doc)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(begin[at].tolist(), end[last].tolist(), strict=True)], np.uint64), per_doc


def _fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    """Fingerprints, as big-endian bytes by row, of the documents of a block."""
    out = np.zeros((len(offsets) - 1, 8), np.uint8)
    hashes, per_doc = shingle_hashes(data, offsets, shingle)
    if not len(hashes):
        return out
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    some = per_doc > 0
    edge = (np.cumsum(per_doc) - per_doc)[some]
    sums = np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * sums > per_doc[some][:, None], axis=1)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): 64-bit fingerprints over word shingles of the lower-cased text; no words: zero."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in blocks(offsets):
                fp = _fingerprints(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(">i8").ravel().astype(np.int64))], ["key", "fp"])

    slim = keyed_texts(docs, key, text)
    return slim.mapInArrow(tidy(run), f"key {slim.schema['key'].dataType.simpleString()}, fp bigint")


def _segment(fp: Column, j: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, j * width).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, distance: int, roots: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp) at most `distance` bits apart.

    With `roots` (fp, root), links inside one component are left out.
    """
    width = BITS // SEGMENTS
    flips = [sum(1 << b for b in c) for r in range(distance // SEGMENTS + 1) for c in combinations(range(width), r)]
    known = distinct.withColumn("root", F.col("fp")) if roots is None else distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    entries = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _segment(F.col("fp"), j, width).alias("v")) for j in range(SEGMENTS)])).alias("e")
    table = known.select(F.col("fp").alias("b"), F.col("root").alias("root_b"), entries).select("b", "root_b", "e.j", "e.v")
    ball = F.explode(F.array(*[F.lit(f).cast("bigint") for f in flips])).alias("flip")
    probes = known.select(F.col("fp").alias("a"), F.col("root").alias("root_a"), entries).select("a", "root_a", "e.j", "e.v", ball)
    probes = probes.select("a", "root_a", "j", F.col("v").bitwiseXOR(F.col("flip")).alias("v"))
    found = probes.join(table, ["j", "v"]).where("a < b and root_a <> root_b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return found.select("a", "b")


def star_links(distinct: DataFrame, distance: int) -> DataFrame:
    """Of each table entry, the links to its smallest fingerprint: at most one per row.

    They join nearly all of a large group of near copies before pairs are looked for.
    """
    width = BITS // SEGMENTS
    entries = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _segment(F.col("fp"), j, width).alias("v")) for j in range(SEGMENTS)])).alias("e")
    table = distinct.select("fp", entries).select("fp", "e.j", "e.v")
    least = table.groupBy("j", "v").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= distance
    return table.join(least, ["j", "v"]).where((F.col("fp") != F.col("b")) & near).select(F.col("fp").alias("a"), "b")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component) per row: component is the smallest key that links lead to.

    Documents with equal fingerprints are one node, so groups of copies cost one row each.  Null
    and empty texts have fingerprint zero and are linked like any other; repeated rows link; null
    keys take part but are never a component's name unless all its keys are null; an empty table
    gives no rows; other columns are ignored.  Runs actions.
    """
    marked = stored(fingerprints(docs, shingle, key, text))
    nodes = stored(marked.groupBy("fp").agg(F.min("key").alias("least")))
    distinct = nodes.select("fp")
    stars = components(star_links(distinct, distance)).withColumnRenamed("node", "fp")
    # what is left links whole stars; their roots are the nodes of the second round
    rest = links(distinct, distance, stars)
    rooted = rest.join(stars.select(F.col("fp").alias("a"), F.col("root").alias("ra")), "a", "left").join(stars.select(F.col("fp").alias("b"), F.col("root").alias("rb")), "b", "left")
    joined = components(rooted.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct())
    top = nodes.join(stars, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("star"))
    top = top.join(joined.withColumnRenamed("node", "star"), "star", "left").select("fp", "least", F.coalesce("root", "star").alias("root"))
    names = top.groupBy("root").agg(F.min("least").alias("component"))
    classes = top.join(names, "root").select("fp", "component")
    return marked.join(classes, "fp").select(F.col("key").alias(key), "fp", "component")


def one_of_each(docs: DataFrame, shingle: int = 5, distance: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` without near duplicates: of each component the row with the smallest key stays,
    and of several such rows the one whose text has the smallest hash.  Runs actions."""
    hashed = docs.select(docs[key].alias("key"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("h"))
    name = F.struct("key", "h")
    marked = near_duplicates(hashed.select(name.alias("key"), "text"), shingle, distance, "key", "text")
    # a component is named by its smallest (key, hash)
    stay = marked.select(F.col("component.key").alias("key2"), F.col("component.h").alias("h2")).distinct()
    whole = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("h"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = whole.join(stay, F.col("h").eqNullSafe(F.col("h2")) & F.col("key").eqNullSafe(F.col("key2")), "left_semi").dropDuplicates(["key", "h"])
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
