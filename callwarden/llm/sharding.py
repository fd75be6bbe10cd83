"""Reproducible shuffle into shards by a keyed permutation of row numbers.

Rows are numbered by key over the whole table: a range-partitioned sort records each row's place in
its partition, and the sums of the earlier partitions' counts are added.  A Feistel network on pairs
(x, y) below (a, b), with a * b just above the row count, permutes the numbers; results beyond
the count walk on along their cycle.  Shard and slot are remainder and quotient of the permuted
number, so both can be computed for any row number without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwarden.llm.storage import stored

ROUNDS = 4
_P = 2147483647


def domain(rows: int) -> tuple[int, int, int]:
    """(a, b, most steps of a walk): a * b >= rows.

    A walk leaves the numbers beyond `rows` after at most a * b - rows + 1 steps.  Of large tables
    at most one number in about sqrt(rows) lies beyond, so that 64 steps leave a chance below
    rows ** -30; the last step fails loudly instead of giving a wrong place.
    """
    a = max(1, math.isqrt(max(rows - 1, 0)) + 1)
    b = max(1, -(-rows // a))
    return a, b, min(a * b - rows + 1, 64)


def round_keys(seed: int) -> list[int]:
    return [(seed * 7919 + 104729 * i * i + 15485863 * i) % _P for i in range(1, 2 * ROUNDS + 1)]


def whole(value: Column, by: int) -> Column:
    """Integer quotient, without a detour over doubles."""
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The place of a row number below `rows`, below `rows` again."""
    a, b, steps = domain(rows)

    def mixed(value: Column, key: Column) -> Column:
        g = (value * 48271 + key) % _P
        return (g * g % _P + g) % _P

    def once(value: Column) -> Column:
        start = F.struct((value % a).alias("x"), whole(value, a).alias("y"))
        keys = round_keys(seed)
        pairs = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(l).cast("bigint").alias("l")) for k, l in zip(keys[::2], keys[1::2], strict=True)])

        def step(s: Column, k: Column) -> Column:
            x = (s["x"] + mixed(s["y"], k["k"])) % a
            return F.struct(x.alias("x"), ((s["y"] + mixed(x, k["l"])) % b).alias("y"))

        return F.aggregate(pairs, start, step, lambda s: s["y"] * a + s["x"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once(number), lambda at, _: F.when(at < rows, at).otherwise(once(at)))
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("a walk is too long")).cast("bigint"))


def shard(docs: DataFrame, shards: int = 24, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Counts of shards are at most one apart and slots run from 0 without gaps.  Rows are ordered by
    key (nulls first), then size and checksum; rows equal in all three are interchangeable.  Null
    texts have size 8 and checksum 0.  An empty table gives no rows; other columns are ignored.
    Runs actions (the numbered rows, without texts, are written once).
    """
    slim = docs.select(
        docs[key].alias("key"),
        (F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(F.coalesce(docs[text], F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # the last column only spreads equal rows over partitions
    order = ["key", "size", "text_crc32", "apart"]
    ranged = slim.withColumn("apart", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stored(ranged.select("key", "size", "text_crc32", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort
    places = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("place"))
    rows = numbered.count()
    placed = numbered.withColumn("part", part).join(F.broadcast(places), "part")
    number = F.col("place") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.select("key", "size", "text_crc32", permuted(number, rows, seed).alias("to"))
    return out.select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("to") % shards).cast("int").alias("shard"),
        whole(F.col("to"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
