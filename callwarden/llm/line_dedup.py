"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

A line is the set of its words.  Sets x and y with Jaccard similarity t or more share a token among the
first |x| - ceil(t |x|) + 1 of either, in any common order of tokens; ordered by rarity, few
others do.  These prefixes are joined on the token, under the length filter, the positional filter and
a 64-bit parity sketch that bounds the symmetric difference; survivors are verified on their whole
sets.  All filters are lossless.

Texts are read once: each block of them is written as its distinct sets, words standing as numbers in the
block's own list of distinct words.  Prefixes and the sets to verify are cut from that table.

Similar sets that must share two tokens share two among prefixes longer by one.  A frequent first token
therefore stands only together with each later one of the longer prefix, which keeps groups small.

Rarity comes from counts in a fixed number of hash buckets, so the broadcast table has one size.
A task reads its groups in order and tries each line with the group's first line and the `REACH` lines before it, which
are all earlier ones in most groups.  Of those that pass the filters the one met most often is verified; the others, and
the lines further up in long groups, are met only by lines which that leaves unsettled.  So a family of copies costs about its size
and not its square, memory does not grow with a group, and no earlier line is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callwarden.llm.arrays import Hasher, blocks, mix, text_bytes, tidy, words
from callwarden.llm.storage import LARGE_VALUES, scratch, stored

#: Buckets of token counts, bits that name a token, bits of the filter of wanted sets.
BUCKETS, NAME, WANTED = 22, 42, 24
_CHUNK = 16
#: Class of rarity (1 + 2 log2 of the count) from which a token needs a second one beside it.
FREQUENT = 21
#: Lines of a group that each line is tried with at once.
REACH = 128
#: Bytes of text taken at once.
BLOCK = 1 << 19


def _tokens(data: np.ndarray, offsets: np.ndarray):
    """Words as (document, line of the document, line of the block, 64-bit hash)."""
    starts, ends, doc = words(data, offsets)
    feeds = np.flatnonzero(data == 10)
    before = np.searchsorted(feeds, starts)
    return doc, before - np.searchsorted(feeds, offsets[:-1])[doc], before + doc, Hasher(data).ranges(starts, ends)


class _Lines:
    """Sets of the lines of a block with at least `least` different words."""

    def __init__(self, data, offsets, least):
        doc, line, number, h = _tokens(data, offsets)
        edge = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else np.zeros(0, np.int64)
        doc, line = doc[edge], line[edge]
        index = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(number))))
        self.names, word = np.unique(h >> np.uint64(64 - NAME), return_inverse=True)
        code = np.unique(index.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64))
        of, word = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
        size = np.bincount(of, minlength=len(edge))
        good = size >= least
        kept = good[of]
        self.word = word[kept]
        self.doc, self.line, self.size = doc[good], line[good], size[good]
        self.set, self.bits = _digests(self.names, self.word, self.size)


def _digests(names, word, size) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each set, and the parity of its words in 64 classes."""
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    value = mix(names + np.uint64(1))[word]
    sign = (np.uint64(1) << (names & np.uint64(63)))[word]
    return np.add.reduceat(value, first).view(np.int64), np.bitwise_xor.reduceat(sign, first).view(np.int64)


class _Block:
    """The distinct sets of a block as they were written, words in order of rarity if classes are given."""

    def __init__(self, names: bytes, words: bytes, sizes: bytes, lines: bytes, classes=None):
        self.names, self.size, self.line = np.frombuffer(names, "<u8"), np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(lines, "<i4")
        self.word = np.frombuffer(words, "<u2" if len(self.names) <= 1 << 16 else "<u4").astype(np.int64)
        self.set, self.bits = _digests(self.names, self.word, self.size)
        self.first = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(self.size)), self.size)
        if classes is not None:
            self.rarity = classes[self.names >> np.uint64(NAME - BUCKETS)]
            order = np.lexsort((self.names, self.rarity))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            self.word = order[np.sort(self.of << 32 | rank[self.word]) & 0xFFFFFFFF]

    def keys(self, num: int, den: int):
        """(set, place of the token, key) under which each set meets others; tokens counted once are in no other."""
        need = -(-num * self.size // den)
        pos = np.arange(len(self.of)) - self.first[self.of]
        prefix = (self.size - need + 1)[self.of]
        rarity, value = self.rarity[self.word], mix(self.names + np.uint64(1))[self.word]
        lone = (pos < prefix) & (rarity > 0) & ((rarity < FREQUENT) | (need[self.of] < 2))
        at, keys = [np.flatnonzero(lone)], [value[lone]]
        paired = np.flatnonzero((pos < prefix) & (rarity >= FREQUENT))
        last = (self.first + np.minimum(self.size, self.size - need + 2))[self.of[paired]]
        step = 1
        while len(paired):
            good = paired + step < last
            paired, last = paired[good], last[good]
            at.append(paired)
            keys.append(mix(value[paired] * np.uint64(3) + value[paired + step]))
            step += 1
        at = np.concatenate(at)
        return self.of[at], pos[at], np.concatenate(keys).view(np.int64)


def _each(batch, column):
    """(first document, number of its first line here, bytes, offsets) of each block; a long document is cut after line feeds."""
    data, offsets = text_bytes(batch.column(column))
    for lo, hi in blocks(offsets, BLOCK):
        start, end = offsets[lo], offsets[hi]
        if hi - lo > 1 or end - start <= BLOCK:
            yield lo, 0, data[start:end], offsets[lo : hi + 1] - start
            continue
        line = 0
        while start < end:
            feeds = np.flatnonzero(data[start : start + BLOCK] == 10)
            if start + BLOCK >= end:
                cut = end
            elif len(feeds):
                cut = start + feeds[-1] + 1
            else:  # one long line
                cut = start + BLOCK
                while cut < end and data[cut - 1] != 10:
                    more = np.flatnonzero(data[cut : cut + BLOCK] == 10)
                    cut = cut + more[0] + 1 if len(more) else min(cut + BLOCK, end)
            yield lo, line, data[start:cut], np.array([0, cut - start])
            line += int(np.count_nonzero(data[start:cut] == 10))
            start = cut


_BLOCK = ["names", "words", "sizes", "lines"]


def _occurrences(slim: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """Rows of three kinds: (key, h, line, set) of every line; (chunk, at, n) of token counts by bucket; and of each
    block (keys, names, words, sizes, lines), its distinct sets that may be similar to another."""
    columns = ["key", "h", "line", "set", "chunk", "at", "n", "keys", *_BLOCK]

    def run(batches):
        counts, key_type = np.zeros(1 << BUCKETS, np.uint32), None

        def out(length, **given):
            kinds = {"key": key_type, "h": pa.int64(), "line": pa.int32(), "set": pa.int64(), "chunk": pa.int32(), "keys": pa.list_(key_type)}
            return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(length, kinds.get(c, pa.binary()))) for c in columns], columns)

        for batch in batches:
            key_type = batch.column(0).type
            for lo, line, data, offsets in _each(batch, 2):
                found = _Lines(data, offsets, least)
                found.line += line
                at, n = pa.array(found.doc + lo), len(found.doc)
                yield out(n, key=batch.column(0).take(at), h=batch.column(1).take(at), line=pa.array(found.line.astype(np.int32)), set=pa.array(found.set))
                # a set with one word more is the most similar other one
                use = _earliest(batch.column(0), found, lo) & (found.size * den >= num * (found.size + 1))
                if not use.any():
                    continue
                word = found.word[np.repeat(use, found.size)]
                some, word, times = np.unique(word, return_inverse=True, return_counts=True)
                names = found.names[some]
                np.add.at(counts, names >> np.uint64(NAME - BUCKETS), times.astype(np.uint32))
                keys = batch.column(0).take(at.filter(pa.array(use)))
                body = [names.astype("<u8"), word.astype("<u2" if len(names) <= 1 << 16 else "<u4"), found.size[use].astype("<i4"), found.line[use].astype("<i4")]
                yield out(1, keys=pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), **{c: pa.array([b.tobytes()], pa.binary()) for c, b in zip(_BLOCK, body, strict=True)})
        if key_type is None:
            return
        rows = []
        for c in range(1 << BUCKETS - _CHUNK):
            part = counts[c << _CHUNK : c + 1 << _CHUNK]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((c, at.astype("<u2").tobytes(), part[at].astype("<u4").tobytes()))
        yield out(len(rows), **{c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("chunk", pa.int32()), ("at", pa.binary()), ("n", pa.binary())))})

    kind = slim.schema["key"].dataType.simpleString()
    blocks_of = ", ".join(f"{c} binary" for c in _BLOCK)
    return slim.mapInArrow(tidy(run), f"key {kind}, h bigint, line int, set bigint, chunk int, at binary, n binary, keys array<{kind}>, {blocks_of}")


def _rarity(rows: DataFrame) -> np.ndarray:
    """Class of each bucket: 0 for a single occurrence, else growing with the logarithm of the count."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at, n in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                total = sums.setdefault(c, np.zeros(1 << _CHUNK, np.uint64))
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        kept = sorted(sums)
        classes = [np.where(s <= 1, 0, np.minimum(63, 1 + 2 * np.log2(np.maximum(s, 1)))).astype(np.uint8).tobytes() for s in (sums[c] for c in kept)]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(classes, pa.binary())], ["chunk", "classes"])

    out = np.zeros(1 << BUCKETS, np.uint8)
    # 2 ** BUCKETS bytes in all
    for row in rows.where("chunk is not null").select("chunk", "at", "n").repartition("chunk").mapInArrow(tidy(run), "chunk int, classes binary").collect():
        out[row.chunk << _CHUNK : row.chunk + 1 << _CHUNK] = np.frombuffer(row.classes, np.uint8)
    return out


def _earliest(keys: pa.Array, found: _Lines, lo: int) -> np.ndarray:
    """Which lines of a block are the first of their set there; all, if the keys are no integers.

    A very common line leaves a block once, and its later places never count.
    """
    if not pa.types.is_integer(keys.type) or not len(found.set):
        return np.ones(len(found.set), bool)
    place = keys.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()[found.doc + lo]
    order = np.lexsort((found.line, place))
    once = np.zeros(len(found.set), bool)
    once[order[np.unique(found.set[order], return_index=True)[1]]] = True
    return once


def _maybe(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the filter may hold the values."""
    at = values >> np.uint64(64 - WANTED)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Join:
    """The similarity join over the blocks (keys, names, words, sizes, lines) at similarity num / den."""

    def __init__(self, rows: DataFrame, classes: np.ndarray, num: int, den: int):
        self.blocks = rows.where("names is not null").select("keys", *_BLOCK)
        self.num, self.den = num, den
        self.context = rows.sparkSession.sparkContext
        self.classes = self.context.broadcast(classes)

    def postings(self) -> DataFrame:
        """(token, set, key, line, size, pos, bits): the prefix of every set under its tokens or pairs of tokens."""
        num, den, shared = self.num, self.den, self.classes

        def run(batches):
            for batch in batches:
                for i in range(len(batch)):
                    block = _Block(*[batch.column(1 + c)[i].as_py() for c in range(4)], shared.value)
                    keys = batch.column(0)[i].values
                    of, pos, token = block.keys(num, den)
                    for a in range(0, len(of), 1 << 16):
                        o, z = of[a : a + (1 << 16)], a + (1 << 16)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(token[a:z]), pa.array(block.set[o]), keys.take(pa.array(o)), pa.array(block.line[o]),
                                pa.array(block.size[o].astype(np.int32)), pa.array(pos[a:z].astype(np.int32)), pa.array(block.bits[o]),
                            ],
                            ["token", "set", "key", "line", "size", "pos", "bits"],
                        )

        kind = self.blocks.schema["keys"].dataType.elementType.simpleString()
        return self.blocks.mapInArrow(tidy(run), f"token bigint, set bigint, key {kind}, line int, size int, pos int, bits bigint")

    def _filter(self, values: DataFrame):
        """A broadcast filter of 2 ** WANTED bits for the column v, whatever the number of rows."""
        at = F.shiftrightunsigned("v", 64 - WANTED)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), at.bitwiseAND(F.lit(63)).cast("int"))
        table = np.zeros(1 << WANTED - 6, np.int64)
        for cell in values.groupBy(F.shiftright(at, 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).collect():
            table[cell.cell] = cell.bits
        return self.context.broadcast(table.view(np.uint64))

    def passes(self, a: str, b: str) -> Column:
        """Whether the length, positional and sketch filters let a pair through."""
        x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
        need = F.ceil((x + y) * self.num / (self.num + self.den) - 1e-9)
        most = F.least(x - F.col(f"{a}.pos"), y - F.col(f"{b}.pos"))
        apart = F.bit_count(F.col(f"{a}.bits").bitwiseXOR(F.col(f"{b}.bits")))
        return (F.least(x, y) * self.den >= F.greatest(x, y) * self.num) & (most >= need) & (apart <= x + y - 2 * need)

    def later(self, a: str, b: str) -> Column:
        return F.struct(f"{a}.place", f"{a}.set") > F.struct(f"{b}.place", f"{b}.set")

    def meetings(self) -> DataFrame:
        """Pairs (x, y) of sets that pass, seldom more than once a group; and of groups longer
        than `REACH` lines their rows (token, key, line, set, size, pos, bits), `far` where not all earlier ones were tried."""
        num, den, reach = self.num, self.den, REACH
        dealt = self.postings().repartition("token").sortWithinPartitions("token", "key", "line", "set")
        kind = dealt.schema["key"].dataType.simpleString()

        def run(batches):
            group = _Group(num, den, reach)
            for batch in batches:
                yield from group.feed(batch)

        return dealt.mapInArrow(tidy(run), f"x bigint, y bigint, token bigint, set bigint, key {kind}, line int, size int, pos int, bits bigint, far boolean")

    def _pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """(token, x, y) for each set x of `left` and each earlier set y of `right` that passes with it.

        Where a set occurs several times its first place counts.
        """
        once = lambda df: df.groupBy("token", F.col("x.set").alias("set")).agg(F.min("x").alias("x"))
        x, y = once(left), once(right).select("token", F.col("x").alias("y"))
        return (
            x.join(y, "token").where((F.col("x.set") != F.col("y.set")) & self.later("x", "y") & self.passes("x", "y"))
            .select("token", F.col("x.set").alias("x"), F.col("y.set").alias("y"))
        )

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The similar ones of the pairs (x, y), by their whole token sets, as (x, y) with x the later set."""
        wanted = pairs.select(F.col("x").alias("set")).union(pairs.select("y")).distinct()
        shared = self._filter(wanted.select(F.col("set").alias("v")))
        kind = self.blocks.schema["keys"].dataType.elementType.simpleString()

        def run(batches):
            bits = shared.value
            for batch in batches:
                for i in range(len(batch)):
                    block = _Block(*[batch.column(1 + c)[i].as_py() for c in range(4)])
                    hit = np.flatnonzero(_maybe(bits, block.set.view(np.uint64)))
                    if len(hit):
                        lens = block.size[hit]
                        ends = np.cumsum(lens)
                        at = np.repeat(block.first[hit] - ends + lens, lens) + np.arange(ends[-1])
                        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(block.names[block.word[at]].view(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array(block.set[hit]), batch.column(0)[i].values.take(pa.array(hit)), pa.array(block.line[hit]), lists], ["set", "key", "line", "tokens"])

        found = self.blocks.mapInArrow(tidy(run), f"set bigint, key {kind}, line int, tokens array<bigint>").join(wanted, "set", "left_semi")
        # a set of several blocks counts at its first place
        sets = found.groupBy("set").agg(F.min(F.struct("key", "line")).alias("place"), F.any_value("tokens").alias("tokens"))
        x, y = (sets.select(F.col("set").alias(c), F.col("tokens").alias(f"t{c}"), F.struct("place", "set").alias(f"p{c}")) for c in "xy")
        common = F.size(F.array_intersect("tx", "ty"))
        similar = common * self.den >= (F.size("tx") + F.size("ty") - common) * self.num
        later = F.greatest("px", "py")["set"]
        return pairs.join(x, "x").join(y, "y").where(similar).select(later.alias("x"), F.least("px", "py")["set"].alias("y"))

    def matched(self) -> DataFrame:
        """(set): the sets with an earlier similar one.  Runs actions."""
        met = stored(self.meetings())
        pairs = stored(met.where("x is not null").groupBy("x", "y").agg(F.count("*").alias("n")))
        # sets that meet most often are the most similar ones
        best = stored(pairs.groupBy("x").agg(F.max_by("y", F.struct("n", "y")).alias("y")))
        done = stored(self.verified(best).select("x").distinct())
        settled = done.withColumnRenamed("x", "set")
        spare = pairs.join(done, "x", "left_anti").select("x", "y")
        row = F.struct(F.struct("key", "line").alias("place"), "set", "size", "pos", "bits").alias("x")
        long = met.where("token is not null")
        far = long.where("far").join(settled, "set", "left_anti")
        more = self._pairs(far.select("token", row), long.select("token", row)).select("x", "y")
        more = stored(spare.union(more).distinct().join(best, ["x", "y"], "left_anti"))
        return stored(done.union(self.verified(more).select("x")).distinct()).select(F.col("x").alias("set"))


class _Group:
    """Rows sorted by token and place, taken batch by batch; of the last group only a bounded part is kept."""

    FIELDS = ("token", "set", "key", "line", "size", "pos", "bits")

    def __init__(self, num: int, den: int, reach: int = REACH):
        self.num, self.den, self.reach = num, den, reach
        #: rows kept, how many of their group are left out after the first, whether they were given out as a long group's
        self.kept, self.skipped, self.given = None, 0, False

    def feed(self, batch):
        rows, old = batch, 0
        if self.kept is not None:
            old = len(self.kept)
            rows = pa.Table.from_batches([self.kept, batch]).combine_chunks().to_batches()[0] if len(batch) else self.kept
        if len(rows) == old:
            return
        token, sets, size, pos, bits = (rows.column(i).to_numpy() for i in (0, 1, 4, 5, 6))
        n = len(token)
        index = np.arange(n)
        starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        start = np.repeat(starts, np.diff(np.append(starts, n)))
        at = index - start
        if old and self.skipped:
            at[(start == 0) & (index > 0)] += self.skipped

        def passing(x, y):
            a, b = size[x].astype(np.int64), size[y].astype(np.int64)
            need = -(-(a + b) * self.num // (self.num + self.den))
            good = (np.minimum(a, b) * self.den >= np.maximum(a, b) * self.num) & (np.minimum(a - pos[x], b - pos[y]) >= need) & (sets[x] != sets[y])
            x, y, room = x[good], y[good], (a + b - 2 * need)[good]
            near = np.bitwise_count((bits[x] ^ bits[y]).view(np.uint64)) <= room
            return x[near], y[near]

        active = index[(index >= old) & (index > start)]
        found = [passing(active, start[active])]
        for d in range(1, self.reach + 1):
            active = active[active - d > start[active]]
            if not len(active):
                break
            found.append(passing(active, active - d))
        x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        # sets that stand several times in a group give the same pairs
        once = np.unique(mix(sets[x].view(np.uint64)) + sets[y].view(np.uint64), return_index=True)[1]
        x, y = x[once], y[once]

        most = np.repeat(np.maximum.reduceat(at, starts), np.diff(np.append(starts, n)))
        long = most > self.reach + 1
        out = np.flatnonzero(long & (at > 0) & ((index >= old) | ~np.bool_(self.given)))
        columns = dict(zip(self.FIELDS, rows.columns, strict=True))
        for a in range(0, len(x), 1 << 15):
            near, other = x[a : a + (1 << 15)], y[a : a + (1 << 15)]
            yield self._out(columns, len(near), x=pa.array(sets[near]), y=pa.array(sets[other]))
        take = pa.array(out)
        yield self._out(columns, len(out), far=pa.array(at[out] > self.reach + 1), **{c: v.take(take) for c, v in columns.items()})

        first = int(starts[-1])
        whole = n - first <= self.reach + 2 and not (first == 0 and self.skipped)
        keep = index[first:] if whole else np.append(first, index[n - self.reach :])
        self.skipped = 0 if whole else int(at[n - 1]) - self.reach
        self.given = bool(long[n - 1])
        self.kept = rows.take(pa.array(keep))

    def _out(self, columns, length, **given):
        kinds = {"x": pa.int64(), "y": pa.int64(), **{c: columns[c].type for c in self.FIELDS}, "far": pa.bool_()}
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(length, t)) for c, t in kinds.items()], list(kinds))


def _marked(docs: DataFrame, similarity: tuple[int, int], least: int, key: str, text: str) -> DataFrame:
    """(key, text, row, removed): `row` holds the other columns, `removed` the lines that go or null."""
    named = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("text"), F.struct(F.lit(0).alias("_"), *[docs[c] for c in docs.columns if c != text]).alias("row"))
    slim = named.select("key", "h", "text")
    num, den = similarity
    with scratch() as own:
        rows = stored(_occurrences(slim, least, num, den), LARGE_VALUES)
        with scratch() as inner:
            matched = inner.keep(Join(rows, _rarity(rows), num, den).matched())
        lines = rows.where("set is not null").select("key", "h", "line", "set")
        earliest = lines.groupBy("set").agg(F.min(F.struct("key", "line", "h")).alias("first")).join(matched.withColumn("near", F.lit(True)), "set", "left")
        place = F.struct("key", "line", "h")
        gone = lines.join(earliest, "set").where(F.col("near") | ~place.eqNullSafe(F.col("first")))
        # per document at most one entry per line
        gone = own.keep(gone.select("key", "h", "line").distinct().groupBy("key", "h").agg(F.collect_list("line").alias("removed")).withColumnsRenamed({"key": "key2", "h": "h2"}))
    both = named.join(gone, F.col("h").eqNullSafe(F.col("h2")) & F.col("key").eqNullSafe(F.col("key2")), "left")
    return both.select("key", "text", "row", "removed")


def _left() -> Column:
    """The text without the removed lines."""
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("removed", i))
    return F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, similarity: tuple[int, int] = (4, 5), least: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_lines, removed, kept) per row: the numbers of the removed lines, the text left.

    Lines end at line feeds; words are runs of other than ASCII white space.  A line of at least `least`
    different words (one: any line with a word) goes if an earlier line, removed or not, has the same words or a Jaccard
    similarity of at least num / den; earlier means a smaller key (null first), then a smaller line
    number.  Shorter lines and lines without words stay.  Rows repeated with key and text are one
    document and lose the same lines; null texts have no lines and stay null; an empty table gives
    no rows; other columns are ignored.  Runs actions.
    """
    return _marked(docs.select(docs[key].alias("key"), docs[text].alias("text")), similarity, least, "key", "text").select(
        F.col("key").alias(key),
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint").alias("n_lines"),
        F.array_sort(F.coalesce("removed", F.array().cast("array<int>"))).alias("removed"),
        _left().alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, similarity: tuple[int, int] = (4, 5), least: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with such lines cut out of the text; rows that lose all their words are left out.

    Repeated rows stay as they are left.  Runs actions.
    """
    marked = _marked(docs, similarity, least, key, text)
    worded = F.col("removed").isNull() | F.col("left").rlike("[^\\x20\\x09-\\x0D]")
    kept = marked.withColumn("left", _left()).where(worded)
    return kept.select(*[F.col("left").alias(text) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
