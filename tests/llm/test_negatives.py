"""Hard negatives against brute force, and the bounds of the tree."""

import math

import numpy as np
import pytest

from callwarden.llm import hyperplane_tree as ht

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v int, cell int, q string, score int, windows string"


def vectors():
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(8, 12))
    rows = [(i, [float(x) for x in centres[i % 8] + rnd.normal(size=12) * 0.2], int(rnd.integers(0, 4))) for i in range(700)]
    rows += [(1000 + i, rows[3][1], 1 + i % 2) for i in range(300)]  # a vector that a third of all rows hold
    rows += [(2000, None, 1), (2010, [1.0, None, *[0.0] * 10], 1), (2020, [math.nan] * 12, 1), (2030, [math.inf] * 12, 1), (2040, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    rows += [(2100, [0.0] * 12, 1), (2110, [], 2), (2120, [2.0, -1.5, 0.3], 1), (2101, [0.0] * 12, 1), (2130, [0.001] * 12, 0), (2140, [3e38] * 12, 3), (2141, [2e38] * 12, 2)]
    rows += [rows[20], rows[20], (rows[40][0], rows[41][1], rows[40][2]), (-30, rows[50][1], 0), (-10, rows[50][1], 0)]
    return rows


def brute(rows, every, positives, negatives, low, high):
    whole = set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        whole.add((i, label, tuple(max(-(2**63), min(2**63 - 1, math.floor(256 * x))) for x in v)))
    out = []
    for a in whole:
        if a[0] % every:
            continue
        score = lambda r: max(-ht.MOST, min(ht.MOST, sum(x * y for x, y in zip(a[2], r[2], strict=False))))
        same = sorted((-score(r), r[0]) for r in whole if r != a and r[1] == a[1])[:positives]
        others = sorted((-score(r), r[0]) for r in whole if r[1] != a[1])
        for s, p in same:
            fits = [(o, n) for o, n in others if low * -s <= 100 * -o <= high * -s][:negatives]
            out += [(a[0], p, k + 1, n, -s, -o) for k, (o, n) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("low", "high", "k"), [(30, 90, 10), (0, 100, 3), (95, 400, 400)])
def test_against_brute_force(spark, monkeypatch, low, high, k):
    monkeypatch.setattr(ht, "CELL", 64)
    rows = vectors()
    frame = spark.createDataFrame([(*r, "x", 1, 2, "q", 3, "w") for r in rows], SCHEMA).repartition(5)
    got = ht.hard_negatives(ht.whole_vectors(frame), 10, 5, k, low, high)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 10, 5, k, low, high)


def test_search_prunes_and_is_exact():
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(20, 16))
    points = np.floor(256 * (centres[rnd.integers(0, 20, 6000)] + rnd.normal(size=(6000, 16)) * 0.05))
    points[5] = 0
    labels, ids = rnd.integers(0, 3, 6000), np.arange(6000)
    search = ht.Search(points, labels, ids, np.arange(6001), False, 10)
    queries = points[:40]
    score = ht.products(queries, points)
    low, high = np.full(40, 1000), np.sort(score, 1)[:, -300]
    w, s, i, _ = search.run(queries, labels[:40], np.arange(40), low, high)
    want = []
    for q in range(40):
        fits = [(-score[q, r], r) for r in range(6000) if labels[r] != labels[q] and low[q] <= score[q, r] <= high[q]]
        want += [(q, -a, r) for a, r in sorted(fits)[:10]]
    assert list(zip(w.tolist(), s.tolist(), i.tolist(), strict=True)) == want
    one = ht.Search(points, labels, ids, np.arange(6001), False, 10)
    one.run(queries[:1], labels[:1], np.arange(1), low[:1], high[:1])
    assert len(one.leaves) > 20 and one.read < len(one.leaves) / 3


def test_bounds_hold_every_score():
    rnd = np.random.default_rng(2)
    points = rnd.normal(size=(3000, 4)) * rnd.uniform(0, 3, size=(3000, 1))
    root, leaves = ht.build(points, 50)
    queries = rnd.normal(size=(50, 4))
    queries[0] = 0
    units, lengths = ht.directions(queries)

    def members(node):
        return leaves[node] if not isinstance(node, ht.Node) else np.concatenate([members(c) for c in node.children if c is not None])

    def check(node):
        if isinstance(node, ht.Node):
            least, greatest = ht.reach(node, ht.angles(units, node.points), lengths)
            for j, child in enumerate(node.children):
                if child is not None:
                    score = queries @ points[members(child)].T
                    assert (score.max(1) <= greatest[:, j]).all() and (score.min(1) >= least[:, j]).all()
                    check(child)

    check(root)


def test_nothing_to_do(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ht.hard_negatives(ht.whole_vectors(empty)).count() == 0
    no_anchor = spark.createDataFrame([(1, [1.0], 1), (2, [2.0], 2)], "vec_id bigint, embedding array<float>, label int")
    assert ht.hard_negatives(ht.whole_vectors(no_anchor)).count() == 0
    with pytest.raises(ValueError):
        ht.hard_negatives(ht.whole_vectors(empty), low=50, high=40)
