"""Approximate nearest neighbours by largest inner product with vantage-point trees.

Vectors are dealt to shards by hash of their id.  A vector x of length |x| is placed at
(x, sqrt(M^2 - |x|^2)), M being the largest length, where a larger inner product with a query means a smaller
distance.  Each shard has a tree: a node parts its vectors at the median distance from a vantage
point and keeps the range of distances on either side.  By the triangle inequality no vector of a leaf
is nearer than its ranges allow; leaves are visited in that order until the bound, times `factor`, passes
the k-th distance found.  Factor 1 is exact; a larger one stops earlier.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callwarden.llm.storage import stored

#: Vectors per shard, per leaf and queries per block.
SHARD, LEAF, BLOCK = 4096, 128, 512


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with vectors as doubles; null, zero and non-finite ones are left out."""
    slim = vectors.select(vectors[key].cast("bigint").alias("id"), vectors[vector].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return slim.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[list[np.ndarray], list[tuple]]:
    """(rows of each leaf, nodes as (vantage row, leaf range and distances of either side))."""
    leaves, nodes = [], []

    def part(rows):
        if len(rows) <= leaf:
            leaves.append(rows)
            return
        centre = points[rows].mean(0)
        vantage = rows[int(np.argmax(((points[rows] - centre) ** 2).sum(1)))]
        far = np.sqrt(((points[rows] - points[vantage]) ** 2).sum(1))
        order = np.argsort(far, kind="stable")
        half = len(rows) // 2
        at = len(leaves)
        part(rows[order[:half]])
        middle = len(leaves)
        part(rows[order[half:]])
        nodes.append((vantage, at, middle, len(leaves), far[order[0]], far[order[half - 1]], far[order[half]], far[order[-1]]))

    part(np.arange(len(points)))
    return leaves, nodes


def search(points: np.ndarray, ids: np.ndarray, originals: np.ndarray, tree, queries: np.ndarray, query_ids: np.ndarray, spots: np.ndarray, k: int, factor: float):
    """(ids, scores) of the k best per query, best first, ties to smaller ids; -1 where there are fewer."""
    leaves, nodes = tree
    n = len(queries)
    bound = np.zeros((n, len(leaves)))
    for vantage, at, middle, end, a, b, c, d in nodes:
        far = np.sqrt(((spots - points[vantage]) ** 2).sum(1))[:, None]
        bound[:, at:middle] = np.maximum(bound[:, at:middle], np.maximum(a - far, far - b))
        bound[:, middle:end] = np.maximum(bound[:, middle:end], np.maximum(c - far, far - d))
    order = np.argsort(bound, axis=1, kind="stable")
    best_id, best_score = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
    worst = np.full(n, np.inf)  # distance to the k-th so far
    lengths = (spots**2).sum(1)
    squares = (points**2).sum(1)
    active = np.arange(n)
    for step in range(len(leaves)):
        target = order[active, step]
        # a hair of tolerance, so that rounding never prunes a tie
        open_ = bound[active, target] * factor <= worst[active] * (1 + 1e-9) + 1e-9
        active = active[open_]
        target = target[open_]
        if not len(active):
            break
        for leaf in np.unique(target):
            q, rows = active[target == leaf], leaves[leaf]
            score = queries[q] @ originals[rows].T
            score[query_ids[q][:, None] == ids[rows][None, :]] = -np.inf
            merged = np.concatenate((best_score[q], score), axis=1)
            names = np.concatenate((best_id[q], np.broadcast_to(ids[rows], score.shape)), axis=1)
            names = np.where(np.isneginf(merged), np.iinfo(np.int64).max, names)
            top = np.lexsort((names, -merged), axis=1)[:, :k]
            best_score[q], best_id[q] = np.take_along_axis(merged, top, 1), np.take_along_axis(names, top, 1)
            full = best_score[q][:, -1]
            reach = np.sqrt(np.maximum(lengths[q] + squares.max() - 2 * full, 0))
            worst[q] = np.where(np.isneginf(full), np.inf, reach)
    return np.where(np.isneginf(best_score), -1, best_id), best_score


def _pack(*arrays: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.savez(file, *arrays)
    return file.getvalue()


def _unpack(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as file:
        return [file[f"arr_{i}"] for i in range(len(file.files))]


def _gather(rows: DataFrame, group: str) -> DataFrame:
    """(group, ids and vectors packed) from rows sorted by the group; groups are bounded by their hash."""

    def run(batches):
        now, ids, vectors = None, [], []
        for batch in batches:
            groups, keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            edges = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True]))) if len(groups) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if now is not None and groups[a] != now:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_pack(np.concatenate(ids), np.concatenate(vectors))])], [group, "data"])
                    ids, vectors = [], []
                now = groups[a]
                ids.append(keys[a:b])
                vectors.append(np.stack([v.values.to_numpy() for v in values.slice(a, b - a)]))
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([_pack(np.concatenate(ids), np.concatenate(vectors))])], [group, "data"])

    return rows.select(group, "id", "v").repartition(group).sortWithinPartitions(group, "id").mapInArrow(run, f"{group} bigint, data binary")


def meetings(trees: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """(shard, kind, data), a shard's rows together: its vectors (kind 0), once, then each block of queries (kind 1)."""
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard")
    blocks = asked.select(every, F.lit(1).alias("kind"), "data")
    return trees.select("shard", F.lit(0).alias("kind"), "data").unionByName(blocks).repartition("shard").sortWithinPartitions("shard", "kind")


def nearest_of_every(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 1.1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose key `every` divides.

    Nearness is the inner product of the vectors as given, in double precision; ties go to the
    smaller key.  Null keys, and vectors that are null, zero or hold null or non-finite components,
    take no part; vectors of another length than the most common one neither.  Keys are unique; of
    a repeated key each row is a candidate, except for queries of that key.  An empty table gives no
    rows; other columns are ignored.  Queries, in blocks, meet every shard; runs actions.
    """
    good = usable(vectors, key, vector)
    sizes = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension, rows = (sizes[0]["d"], sizes[0]["count"]) if sizes else (0, 0)
    good = good.where(F.size("v") == dimension)
    top = good.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0
    shards, blocks = max(1, -(-rows // SHARD)), max(1, -(-rows // (every * BLOCK)))
    shard = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).alias("shard")
    trees = stored(_gather(good.select(shard, "id", "v"), "shard"))
    asked = good.where(F.col("id") % every == 0).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "v")
    asked = stored(_gather(asked, "block"))

    def run(batches):
        now, shard_data, tree = None, None, None
        for batch in batches:
            for name, kind, d in zip(*[batch.column(i) for i in range(3)], strict=True):
                if name.as_py() != now:
                    now, tree = name.as_py(), None
                if kind.as_py() == 0:
                    ids, originals = _unpack(d.as_py())
                    points = np.concatenate((originals, np.sqrt(np.maximum(top - (originals**2).sum(1), 0))[:, None]), axis=1)
                    shard_data, tree = (ids, originals, points), build(points)
                    continue
                if tree is None:  # a shard without vectors
                    continue
                ids, originals, points = shard_data
                query_ids, queries = _unpack(d.as_py())
                spots = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1)
                found, score = search(points, ids, originals, tree, queries, query_ids, spots, k, factor)
                row, column = np.nonzero(found >= 0) if ids.min() >= 0 else np.nonzero(~np.isneginf(score))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(found[row, column]), pa.array(score[row, column])], ["query_id", "vec_id", "score"])

    found = meetings(trees, asked, shards).mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
