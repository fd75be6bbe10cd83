"""Hard negatives by a multiway hyperplane tree over the angles between vectors.

A node has several split points; a vector belongs to the nearest of them.  For every pair of split points (i, j)
the node keeps the least and the greatest angle between i and the vectors that belong to j, and for each j the range
of lengths.  For a query with angle a to i, the triangle inequality gives an annulus of angles that j's vectors lie
in; the annuli of all i intersect, and with the lengths give the scores that j's vectors can have.  A window of scores
that does not meet them leaves out all of j.  Windows shrink as results come in.  Leaves are compared exactly.

The upper levels (split points from a bounded sample, ranges over all vectors) deal vectors to cells; the
cells' vectors meet their queries in one task, which builds the lower levels.  Every query first visits
its most promising cells, and then each other cell that can still change its result.  Results are exact.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callwarden.llm.storage import stored

#: Split points per node; vectors per cell and per leaf; bytes and number of vectors in the sample that upper split
#: points come from; cells that a query visits first; queries of one task, and at once.
SPLIT, CELL, LEAF, SAMPLE_BYTES, SAMPLED, FIRST, QUERIES, BLOCK = 16, 4096, 512, 64 << 20, 20_000, 2, 65_536, 1024
#: Scores are held within this limit, so that a hundredfold of one fits a long.
MOST = 9 * 10**16
_PAD = 1e-7  # radians; more than what rounding does to an angle


@dataclass
class Node:
    points: np.ndarray  # (m, d), of length one
    low: np.ndarray  # (m, m): least angle between point i and what belongs to j
    high: np.ndarray
    shortest: np.ndarray  # (m,)
    longest: np.ndarray
    children: list = field(default_factory=list)  # nodes, or numbers of leaves or cells


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length one, lengths); a zero vector gets the first axis and length zero."""
    lengths = np.sqrt((vectors**2).sum(1))
    out = vectors / np.where(lengths > 0, lengths, 1)[:, None]
    out[lengths == 0, 0] = 1
    return out, lengths


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def split_points(units: np.ndarray, rnd: np.random.Generator, many: int = SPLIT) -> np.ndarray:
    """Some of the vectors, far from each other: of three times as many, the farthest from those taken, in turn."""
    some = units[rnd.choice(len(units), min(len(units), 3 * many), replace=False)]
    near, taken = angles(some, some[:1])[:, 0], [0]
    while len(taken) < many:
        at = int(near.argmax())
        if near[at] <= 1e-6:
            break
        taken.append(at)
        near = np.minimum(near, angles(some, some[at : at + 1])[:, 0])
    return some[taken]


def ranges(theta: np.ndarray, lengths: np.ndarray, owner: np.ndarray):
    """(low, high, shortest, longest) of vectors with angles `theta` to the points that own them."""
    m = theta.shape[1]
    low, high, shortest, longest = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, np.inf), np.full(m, -np.inf)
    for j in np.unique(owner):
        mine = owner == j
        low[:, j], high[:, j] = theta[mine].min(0), theta[mine].max(0)
        shortest[j], longest[j] = lengths[mine].min(), lengths[mine].max()
    return low, high, shortest, longest


def reach(node: Node, theta: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) score that queries can have with what belongs to each split point; an empty one has none."""
    near = np.maximum(node.low[None] - theta[:, :, None], theta[:, :, None] - node.high[None]).max(1) - _PAD
    far = np.minimum(theta[:, :, None] + node.high[None], 2 * np.pi - theta[:, :, None] - node.low[None]).min(1) + _PAD
    best, worst = np.cos(np.clip(near, 0, np.pi)), np.cos(np.clip(far, 0, np.pi))
    full = np.isfinite(node.shortest)
    short, long = np.where(full, node.shortest, 0), np.where(full, node.longest, 0)
    slack = 1e-9 * lengths[:, None] * long + 1e-9
    greatest = lengths[:, None] * np.where(best >= 0, long * best, short * best) + slack
    least = lengths[:, None] * np.where(worst >= 0, short * worst, long * worst) - slack
    least, greatest = np.clip(least, -MOST, MOST), np.clip(greatest, -MOST, MOST)  # as scores are
    return np.where(full, least, np.inf), np.where(full, greatest, -np.inf)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact, within MOST."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] >= 2**53:
        whole = np.array([[int(x) for x in row] for row in a], object) @ np.array([[int(x) for x in row] for row in b], object).T
        return np.clip(whole, -MOST, MOST).astype(np.int64)
    return np.clip((a @ b.T), -MOST, MOST).astype(np.int64)


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[Node | int, list[np.ndarray]]:
    """(root, rows of each leaf) of a tree over all the vectors."""
    units, lengths = directions(vectors)
    rnd, leaves = np.random.default_rng(len(vectors)), []

    def part(rows: np.ndarray):
        points = split_points(units[rows], rnd) if len(rows) > leaf else units[:0]
        if len(points) < 2:
            leaves.append(rows)
            return len(leaves) - 1
        theta = angles(units[rows], points)
        owner = theta.argmin(1)
        node = Node(points, *ranges(theta, lengths[rows], owner))
        node.children = [part(rows[owner == j]) if (owner == j).any() else None for j in range(len(points))]
        return node

    return part(np.arange(len(vectors))), leaves


class Search:
    """The k best (score, id) per window, largest score first, smaller id of equal ones."""

    def __init__(self, vectors, labels, ids, id_ends, same: bool, k: int):
        self.vectors, self.labels, self.ids, self.ends = vectors, labels, ids, id_ends
        self.same, self.k, self.read = same, k, 0
        self.root, self.leaves = build(vectors)

    def run(self, queries, labels, of, low, high):
        """`of`: the query of each window; (window, score, id, own) of what is found."""
        self.queries, self.query_labels, self.of, self.high = queries, labels, of, high
        self.units, self.lengths = directions(queries)
        self.score = np.full((len(of), self.k), -MOST - 1, np.int64)
        self.id = np.full((len(of), self.k), np.iinfo(np.int64).max, np.int64)
        self.own = np.zeros((len(of), self.k), bool)
        self.low = low.copy()
        self._visit(self.root, np.arange(len(of)))
        w, at = np.nonzero(self.score >= -MOST)
        return w, self.score[w, at], self.id[w, at], self.own[w, at]

    def _visit(self, node, windows) -> None:
        if not isinstance(node, Node):
            self._read(self.leaves[node], windows)
            return
        asked, back = np.unique(self.of[windows], return_inverse=True)
        least, greatest = reach(node, angles(self.units[asked], node.points), self.lengths[asked])
        for j in np.argsort(-greatest.mean(0), kind="stable"):
            open_ = (greatest[back, j] >= self.low[windows]) & (least[back, j] <= self.high[windows])
            if node.children[j] is not None and open_.any():
                self._visit(node.children[j], windows[open_])

    def _read(self, rows, windows) -> None:
        self.read += 1
        asked, back = np.unique(self.of[windows], return_inverse=True)
        score = products(self.queries[asked], self.vectors[rows])
        fits = (self.query_labels[asked][:, None] == self.labels[rows][None]) == self.same
        score = np.where(fits, score, -MOST - 1)[back]
        w, r = np.nonzero((score >= self.low[windows][:, None]) & (score <= self.high[windows][:, None]))
        if not len(w):
            return
        many = self.ends[rows[r] + 1] - self.ends[rows[r]]
        w, r, nth = np.repeat(w, many), np.repeat(r, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        ids, found = self.ids[self.ends[rows[r]] + nth], score[w, r]
        own = (self.vectors[rows[r]] == self.queries[self.of[windows[w]]]).all(1) if self.same else np.zeros(len(w), bool)
        w = windows[w]
        hit, k = np.unique(w), self.k
        w = np.concatenate((np.repeat(hit, k), w))
        found, ids = np.concatenate((self.score[hit].ravel(), found)), np.concatenate((self.id[hit].ravel(), ids))
        own = np.concatenate((self.own[hit].ravel(), own))
        order = np.lexsort((ids, -found, w))
        w, found, ids, own = w[order], found[order], ids[order], own[order]
        nth = np.arange(len(w)) - np.searchsorted(w, w)
        w, found, ids, own, nth = (x[nth < k] for x in (w, found, ids, own, nth))
        self.score[w, nth], self.id[w, nth], self.own[w, nth] = found, ids, own
        self.low[hit] = np.maximum(self.low[hit], self.score[hit, -1])


def _flat(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows of doubles, shorter ones padded with zeros."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(ends)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(ends[:-1] - ends[0], size)] = values[ends[0] : ends[-1]]
    return out


class Upper:
    """The upper levels: nodes whose children are nodes or cells.  Split points come from a sample."""

    def __init__(self, sample: np.ndarray, share: float):
        """share: vectors for each one of the sample."""
        units, rnd = directions(sample)[0], np.random.default_rng(7)
        self.nodes: list[Node] = []
        self.cells = 0

        def part(rows):
            points = split_points(units[rows], rnd) if len(rows) * share > CELL and len(rows) >= 2 * SPLIT else units[:0]
            if len(points) < 2:
                self.cells += 1
                return self.cells - 1
            m = len(points)
            node = Node(points, np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, np.inf), np.full(m, -np.inf))
            self.nodes.append(node)
            owner = angles(units[rows], points).argmin(1)
            node.children = [part(rows[owner == j]) for j in range(m)]
            return node

        self.root = part(np.arange(len(sample)))

    def descend(self, vectors: np.ndarray):
        """(cell of each vector, what to add to each node's ranges)."""
        units, lengths = directions(vectors)
        cell, seen = np.zeros(len(vectors), np.int64), []

        def part(node, rows):
            if not isinstance(node, Node):
                cell[rows] = node
            elif len(rows):
                theta = angles(units[rows], node.points)
                owner = theta.argmin(1)
                seen.append((next(n for n, x in enumerate(self.nodes) if x is node), ranges(theta, lengths[rows], owner)))
                for j, child in enumerate(node.children):
                    part(child, rows[owner == j])

        part(self.root, np.arange(len(vectors)))
        return cell, seen

    def scores(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score of each query with each cell's vectors."""
        units, lengths = directions(queries)
        least, greatest = np.full((len(queries), self.cells), -np.inf), np.full((len(queries), self.cells), np.inf)

        def part(node, low, high):
            if not isinstance(node, Node):
                least[:, node], greatest[:, node] = low, high
                return
            lower, upper = reach(node, angles(units, node.points), lengths)
            for j, child in enumerate(node.children):
                part(child, np.maximum(low, lower[:, j]), np.minimum(high, upper[:, j]))

        part(self.root, np.full(len(queries), -np.inf), np.full(len(queries), np.inf))
        return least, greatest


class Index:
    """All vectors of `rows` (id, label, v: whole numbers), dealt to cells.

    Rows of equal vector and label are one entry with its `kept` smallest ids, since none of the others
    can be among so many best.
    """

    def __init__(self, rows: DataFrame, kept: int):
        spark = rows.sparkSession
        nth = F.row_number().over(Window.partitionBy("v", "label").orderBy("id"))
        entries = rows.distinct().withColumn("nth", nth).where(F.col("nth") <= kept).groupBy("v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        entries = stored(entries)
        many, width = entries.agg(F.count("*"), F.max(F.size("v"))).first()
        self.width, self.context = max(width or 0, 1), spark.sparkContext
        wanted = min(SAMPLED, SAMPLE_BYTES // (8 * self.width) + 1)
        some = entries.where(F.pmod(F.xxhash64("v", "label"), F.lit(max(1, many // wanted))) == 0).select("v").collect() if many > CELL else []
        sample = np.zeros((len(some), self.width))
        for i, r in enumerate(some):
            sample[i, : len(r.v)] = r.v
        self.upper = Upper(sample, many / max(1, len(some)))
        self.shared = self.context.broadcast((self.upper, np.ones(self.upper.cells, np.int64)))
        dealt = stored(self._dealt(entries))
        self._measure(dealt)
        slices = np.ones(self.upper.cells, np.int64)
        for r in dealt.groupBy("cell").count().collect():
            slices[r.cell] = -(-r["count"] // CELL)
        self.shared = self.context.broadcast((self.upper, slices))
        of = F.element_at(F.array(*[F.lit(int(n)) for n in slices]), F.col("cell") + 1)
        self.dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("v", "label", F.lit(1)), of).cast("int"))
        self.shards = int(slices.sum())

    def _dealt(self, entries: DataFrame) -> DataFrame:
        shared, width = self.shared, self.width

        def run(batches):
            for batch in batches:
                cell, _ = shared.value[0].descend(_flat(batch.column(0), width))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["v", "label", "ids", "cell"])

        return entries.select("v", "label", "ids").mapInArrow(run, f"v array<bigint>, label {entries.schema['label'].dataType.simpleString()}, ids array<bigint>, cell int")

    def _measure(self, dealt: DataFrame) -> None:
        """The ranges of the upper nodes over all vectors; tasks give a row per node and pair of split points."""
        if not self.upper.nodes:
            return
        shared, width = self.shared, self.width

        def run(batches):
            total = {}
            for batch in batches:
                for n, (low, high, short, long) in shared.value[0].descend(_flat(batch.column(0), width))[1]:
                    if n in total:
                        a, b, c, d = total[n]
                        low, high, short, long = np.minimum(a, low), np.maximum(b, high), np.minimum(c, short), np.maximum(d, long)
                    total[n] = low, high, short, long
            for n, (low, high, short, long) in total.items():
                i, j = np.nonzero(np.isfinite(low))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(i), n), i, j, low[i, j], high[i, j], short[j], long[j])], ["n", "i", "j", "low", "high", "short", "long"])

        seen = dealt.select("v").mapInArrow(run, "n bigint, i bigint, j bigint, low double, high double, short double, long double")
        for r in seen.groupBy("n", "i", "j").agg(F.min("low"), F.max("high"), F.min("short"), F.max("long")).collect():
            node = self.upper.nodes[r.n]
            node.low[r.i, r.j], node.high[r.i, r.j], node.shortest[r.j], node.longest[r.j] = r[3], r[4], r[5], r[6]

    def _routed(self, asked: DataFrame, rest: bool) -> DataFrame:
        """Queries with the (cell, slice) that they visit: the most promising cells, or the rest of those open to them."""
        shared, width = self.shared, self.width

        def run(batches):
            upper, slices = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(start, BLOCK)
                    least, greatest = upper.scores(_flat(batch.column(1), width))
                    windows = batch.column(3)
                    ends = windows.offsets.to_numpy()
                    of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
                    low, high, floor = (pa.array(windows.values.field(n)).to_numpy()[ends[0] : ends[-1]] for n in range(3))
                    first = np.argsort(-greatest, axis=1, kind="stable")[:, :FIRST]
                    is_first = np.zeros(greatest.shape, bool)
                    np.put_along_axis(is_first, first, True, 1)
                    open_ = np.zeros(greatest.shape, bool)
                    np.logical_or.at(open_, of, (greatest[of] >= np.maximum(low, floor)[:, None]) & (least[of] <= high[:, None]))
                    row, cell = np.nonzero(open_ & (is_first != rest))
                    many = slices[cell]
                    row, cell, nth = np.repeat(row, many), np.repeat(cell, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    for at in range(0, len(row), BLOCK):
                        part = slice(at, at + BLOCK)
                        taken = batch.take(pa.array(row[part]))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell[part], pa.int32()), pa.array(nth[part], pa.int32())], ["q", "v", "label", "windows", "cell", "slice"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
        return asked.mapInArrow(run, f"{kinds}, cell int, slice int")

    def _searched(self, asked: DataFrame, same: bool, k: int, rest: bool) -> DataFrame:
        """(q, window, score, id, own): up to k of each cell and slice that a query visits."""
        copies = -(-asked.count() // QUERIES) or 1
        windows = asked.schema["windows"].dataType.simpleString()
        data = self.dealt.select("cell", "slice", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("q"), "v", "label", "ids", F.lit(None).cast(windows).alias("windows"))
        copy = F.pmod(F.xxhash64("q"), F.lit(copies)).cast("int")
        routed = self._routed(asked, rest).select("cell", "slice", copy.alias("copy"), F.lit(1).alias("kind"), "q", "v", "label", F.array().cast("array<bigint>").alias("ids"), "windows")
        both = data.unionByName(routed).repartition(min(20_000, self.shards * copies), "cell", "slice", "copy").sortWithinPartitions("cell", "slice", "copy", "kind")
        width = self.width

        def labels_of(column: pa.Array) -> np.ndarray:
            return column.to_numpy(zero_copy_only=False)

        def run(batches):
            now, held, search = None, [], None
            for batch in batches:
                place = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
                edges = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(1), [True])))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    key, kind, part = tuple(place[a, :3]), place[a, 3], batch.slice(a, b - a)
                    if key != now:
                        now, held, search = key, [], None
                    if kind == 0:
                        held.append(part)
                        continue
                    if not held:
                        continue
                    if search is None:
                        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        ids = rows.column(7)
                        search = Search(_flat(rows.column(5), width), labels_of(rows.column(6)), ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py(), same, k)
                    for start in range(0, part.num_rows, BLOCK):
                        block = part.slice(start, BLOCK)
                        w = block.column(8)
                        ends = w.offsets.to_numpy()
                        of = np.repeat(np.arange(block.num_rows), np.diff(ends))
                        low, high, floor = (w.values.field(n).to_numpy()[ends[0] : ends[-1]] for n in range(3))
                        found = search.run(_flat(block.column(5), width), labels_of(block.column(6)), of, np.maximum(low, floor), high)
                        at = of[found[0]]
                        yield pa.RecordBatch.from_arrays(
                            [block.column(4).take(pa.array(at)), pa.array((found[0] - (ends[:-1] - ends[0])[at]).astype(np.int32)), *map(pa.array, found[1:])], ["q", "window", "score", "id", "own"]
                        )

        return both.mapInArrow(run, "q string, window int, score bigint, id bigint, own boolean")

    def best(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(q, window, nth, score, id, own): the k best of each window of `asked` (q, v, label, windows), all cells considered."""
        order = Window.partitionBy("q", "window").orderBy(F.desc("score"), "id", F.desc("own"))
        top = lambda df: df.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
        first = stored(top(self._searched(asked, same, k, False)))
        floors = first.where(F.col("nth") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floors"))
        higher = F.transform("windows", lambda w, i: F.struct(w["low"].alias("low"), w["high"].alias("high"), F.coalesce(F.try_element_at("floors", i), w["floor"]).alias("floor")))
        again = stored(asked.join(floors, "q", "left").select("q", "v", "label", higher.alias("windows")))
        return top(first.drop("nth").unionByName(self._searched(again, same, k, True)))


def whole_vectors(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(id, label, v): components as floor(scale * x); without rows that hold a null or a non-finite component anywhere."""
    v = vectors[vector].cast("array<double>")
    slim = vectors.select(vectors[key].cast("bigint").alias("id"), (vectors[label] if isinstance(label, str) else label).cast("bigint").alias("label"), v.alias("v"))
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    slim = slim.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite)
    return slim.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))))


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, the rows whose id `every` divides.

    `rows` has (id, label, v), without nulls, as `whole_vectors` gives them.  A score is the inner product with the anchor.  An
    anchor's positives are the best other rows of its label; for each, the best rows of other labels are returned whose score is
    between `low` and `high` percent of the positive's.  Higher scores come first, then smaller ids; where there are fewer, all
    are returned.  A positive of negative score has no such rows.

    A shorter vector counts as if zeros followed; a zero vector scores zero.  Repeated rows (id, label and vector) count once;
    rows of one id with different vectors or labels are rows of their own, each an anchor.  Scores are held within 9 * 10^16.
    No rows, or no anchors, give none.  Runs actions.
    """
    if not 0 <= low <= high <= 10_000:
        raise ValueError("the window has to be between two shares of the positive's score, of 10,000 percent at most, the lower one first")
    index = Index(rows, max(positives + 1, negatives))
    name = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")))
    anchors = stored(rows.where(F.col("id") % every == 0).distinct().select(name.alias("q"), "id", "label", "v"))
    window = "array<struct<low:bigint,high:bigint,floor:bigint>>"
    everything = F.array(F.struct(F.lit(-MOST).alias("low"), F.lit(MOST).alias("high"), F.lit(-MOST).alias("floor"))).cast(window)
    asked = stored(anchors.groupBy("q").agg(F.first("v").alias("v"), F.first("label").alias("label")).select("q", "v", "label", everything.alias("windows")))
    near = stored(index.best(asked, True, positives + 1).select("q", "score", F.col("id").alias("positive_id"), "own"))
    shares = near.where("score >= 0").groupBy("q").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    share = lambda percent, more: f"(CAST(s AS DECIMAL(20)) * {percent} + {more}) div 100"
    windows = F.expr(f"transform(scores, s -> struct({share(low, 99)} AS low, {share(high, 0)} AS high, {share(low, 99)} AS floor))").cast(window)
    asked = stored(asked.drop("windows").join(shares, "q").select("q", "v", "label", windows.alias("windows"), "scores"))
    found = index.best(asked.drop("scores"), False, negatives)
    lists = found.groupBy("q", "window").agg(F.sort_array(F.collect_list(F.struct("nth", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("found"))
    lists = lists.join(asked.select("q", "scores"), "q").select("q", F.expr("scores[window]").alias("score"), "found")
    others = anchors.select("q", F.col("id").alias("anchor_id"), "label", "v").join(near, "q").where(~(F.col("own") & (F.col("positive_id") == F.col("anchor_id"))))
    nth = F.row_number().over(Window.partitionBy("q", "anchor_id").orderBy(F.desc("score"), "positive_id"))
    chosen = others.withColumn("nth", nth).where(F.col("nth") <= positives)
    out = chosen.join(lists, ["q", "score"]).select("anchor_id", "positive_id", F.col("score").alias("positive_score"), F.explode("found").alias("f"))
    return out.select("anchor_id", "positive_id", F.col("f.nth").cast("int").alias("rank"), "f.negative_id", "positive_score", "f.negative_score")


def negatives_sql() -> str:
    """The same over `embeddings` by comparing every anchor with every row, for the check."""
    return """
WITH whole AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole a JOIN whole r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10"""
