"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from callwarden.llm import spelling_variants as sv

SCHEMA = "doc_id bigint, text string, word string, n int, run string, key string, root string, place int"


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio):
    out = {}
    for w, n in counts.items():
        others = sorted((-m, o) for o, m in counts.items() if o != w and near(w, o))
        form = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[w] = (form, n, len(others), counts[form] if form else None)
    roots = {}
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        roots[w] = root
    return {(w, f, roots[w], n, k, m) for w, (f, n, k, m) in out.items()}


def texts():
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(6, 10))) for _ in range(60)]
    words = []
    for b in base:
        words += [b] * rnd.choice([5, 30, 200])
        for _ in range(4):
            i, kind = rnd.randrange(len(b) + 1), rnd.randrange(3)
            v = b[:i] + rnd.choice("abcÉ×") * (kind != 0) + b[i + (kind != 1) :]
            words += [v] * rnd.choice([1, 5, 6, 26])
    words += ["aaaaaaa"] * 9 + ["aaaaaaaa"] * 50 + ["aaaaaaaaa"] * 260 + ["ABCABC"] * 5 + ["a" * 3000] * 5
    rnd.shuffle(words)
    cut = [words[i : i + 40] for i in range(0, len(words), 40)]
    return [(i, " ,\n-1"[i % 5].join(w) if i % 5 != 4 else "1".join(w)) for i, w in enumerate(cut)] + [(None, "abcabc"), (None, None), (1, ""), (2, "abcabc éé")]


@pytest.mark.parametrize("every", [0, 7])
def test_variants_against_brute_force(spark, every):
    rows = texts()
    rows += rows[:2]
    docs = spark.createDataFrame([(i, t, "w", 1, "r", "k", "x", 3) for i, t in rows], SCHEMA).repartition(4)
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = sv.spelling_variants(docs, every=every).collect()
    assert len(got) == len(counts) > 100
    assert {tuple(r) for r in got} == brute(counts, 5)
    assert any(r.root not in (r.word, r.form) for r in got)


def test_pairs_of_ties_and_short_words(spark):
    words = ["abcd", "abce", "abc" + "d" * 3, "abcdd", "aaaa", "aaaaa", "aaaaaa", "dcba", "abab", "baba", "ababa", "xbcd", "acd" + "x", "éé" * 2, "éé" * 2 + "é"]
    got = {tuple(r) for r in sv.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and near(a, b)}
    with pytest.raises(Exception, match="four code points"):
        sv.near_words(spark.createDataFrame([("abc",)], "word string")).collect()


def test_no_texts(spark):
    assert sv.spelling_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sv.spelling_variants(spark.createDataFrame([(1, None)], "doc_id bigint, text string")).count() == 0
