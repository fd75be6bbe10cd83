"""Each operator against brute force on a small table with nulls, ties, copies and a long text."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from callwarden.llm import (
    arrays,
    bpe,
    ftrl,
    line_dedup,
    packing,
    quality_classifier,
    sharding,
    shingles,
    simhash,
    suffix_index,
    toxicity,
    vantage_trees,
    weak_supervision,
)
from callwarden.llm.components import components
from callwarden.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators use inside, to see that others of that name do no harm.
SCHEMA = "doc_id bigint, text string, key string, h int, row int, score double, removed int, root string"


def texts():
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8))) for _ in range(400)]

    def prose(words):
        out = [rnd.choice(vocabulary) + rnd.choice(["", "", "", ",", ".\n"]) for _ in range(words)]
        return " ".join(out)

    passage = prose(120)
    base = [prose(rnd.randrange(5, 150)) for _ in range(20)]
    near = []
    for b in base[:6]:
        w = b.split(" ")
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    shared = [prose(20) + " " + passage + " " + prose(20) for _ in range(4)]
    odd = [None, "", " ", "\n\n", "a", "one two", "<|endoftext|> x  y\t\nz　日本 's it's 12ab", "aaaa" * 300, "ab " * 400, "x\x00y", prose(20000)]
    rows = [(i, t) for i, t in enumerate([*base, *near, *shared, *odd, base[0], base[0], near[1]])]
    return [*rows, (0, base[0]), (3, base[3]), (None, "no key"), (None, None), (None, base[2])]


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 1, 2, 3.0, 4, "r") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def order(values):
    return sorted(values, key=repr)


def test_packing(docs, empty, rows, tokenizer):
    pieces = packing.pack(docs, tokenizer_path(), length=64, end_id=1).collect()
    stream = {}
    for p in pieces:
        assert p.length * 4 == len(p.ids)
        stream.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s, parts in stream.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or s == max(stream)
    assert sorted(stream) == list(range(max(stream) + 1))
    want = [(i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows]
    got, open_ = [], {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        ids = open_.pop("ids", ()) + tuple(np.frombuffer(p.ids, "<u4").tolist())
        assert p.start == len(ids) - p.length
        if len(ids) == p.doc_tokens:
            got.append((p.doc_id, ids))
        else:
            open_["ids"] = ids
    assert not open_ and order(got) == order(want)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def lines_brute(rows, least=1):
    """{(doc_id, text): removed line numbers}."""
    seen, out = [], {}
    unique = sorted({(i, t) for i, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    entries = [((i is not None, i or 0, n), (i, t), frozenset(WORD.findall(line))) for i, t in unique for n, line in enumerate(t.split("\n"))]
    for place, doc, words in sorted(entries, key=lambda e: e[0]):
        out.setdefault(doc, [])
        if len(words) < least:
            continue
        if any(5 * len(words & other) >= 4 * len(words | other) for other in seen):
            out[doc].append(place[2])
        seen.append(words)
    return out


def test_line_dedup(docs, empty, rows):
    # keys with several texts tie between documents; those are looked at in the next test
    single = [r for r in rows if r[0] is not None]
    want = lines_brute(single)
    got = line_dedup.dedup_lines(docs.where("doc_id is not null")).collect()
    assert len(got) == len(single)
    assert any(r.removed for r in got)
    numbers = {}
    for (i, t), removed in want.items():
        numbers.setdefault(i, []).append((len(t.split("\n")), removed, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in removed)))
    for r in got:
        if r.kept is None:
            assert r.n_lines == 0 and r.removed == []
        else:
            assert (r.n_lines, r.removed, r.kept) in numbers[r.doc_id]
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_null_keys_and_whole_rows(docs, rows):
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(rows)
    left = line_dedup.without_repeated_lines(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        assert r.text is None or WORD.search(r.text) or not WORD.search(dict(rows).get(r.doc_id) or "")


def test_line_dedup_large_family(spark):
    """One line in many variants, most like the first, some only like a later one."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        w = list(words)
        for _ in range(rnd.choice([0, 1, 2, 3, 5])):
            w[rnd.randrange(30)] = f"v{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: removed for (i, _), removed in lines_brute(rows).items()}


def test_line_dedup_family_with_copies_over_partitions(spark):
    """Variants and exact copies in places of any order, far more in a group than are tried at once."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(24)]
    lines = []
    for _ in range(160):
        w = list(words)
        for _ in range(rnd.choice([1, 2, 3, 4, 5])):
            w[rnd.randrange(24)] = f"v{rnd.randrange(60)}"
        lines.append(" ".join(w))
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(4)))) for i in range(300)]
    rnd.shuffle(rows)
    want = {i: removed for (i, _), removed in lines_brute(rows).items()}
    for parts in (1, 9):
        frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
        assert {r.doc_id: r.removed for r in line_dedup.dedup_lines(frame).collect()} == want


def test_long_documents_are_cut_at_lines(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    texts = ["a b", "", None, "one two three\n\nfour\n" + "x" * 50 + "\nfive\nsix seven eight\n", "z" * 40, "\n" * 40 + "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = {}
    for lo, line, data, offsets in line_dedup._each(batch, 0):
        found = line_dedup._Lines(data, offsets, 1)
        for doc, n in zip(found.doc + lo, found.line + line, strict=True):
            got.setdefault(int(doc), []).append(int(n))
    assert got == {i: lines for i, t in enumerate(texts) if (lines := [n for n, x in enumerate((t or "").split("\n")) if x.split()])}


@pytest.mark.parametrize("frequent", [1, 4, 99])
def test_similar_sets_share_a_key(monkeypatch, frequent):
    """Whether tokens stand alone or in pairs."""
    import numpy as np

    monkeypatch.setattr(line_dedup, "FREQUENT", frequent)
    rnd = random.Random(frequent)
    base = [rnd.sample(range(40), rnd.randrange(1, 25)) for _ in range(12)]
    sets = [sorted({w if rnd.random() < 0.95 else rnd.randrange(40) for w in rnd.choice(base)}) for _ in range(120)]
    names = np.sort(np.random.default_rng(1).integers(0, 1 << line_dedup.NAME, 40)).astype("<u8")
    classes = np.ones(1 << line_dedup.BUCKETS, np.uint8)
    classes[names >> np.uint64(line_dedup.NAME - line_dedup.BUCKETS)] = np.arange(40) % 7 + 1
    sizes, lines = np.array([len(s) for s in sets], "<i4"), np.zeros(len(sets), "<i4")
    block = line_dedup._Block(names.tobytes(), np.concatenate(sets).astype("<u2").tobytes(), sizes.tobytes(), lines.tobytes(), classes)
    for num, den in ((4, 5), (1, 2)):
        of, _, token = block.keys(num, den)
        keys = [set(token[of == i].tolist()) for i in range(len(sets))]
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                common = len(set(a) & set(b))
                if a != b and common * den >= (len(a) + len(b) - common) * num:
                    assert keys[i] & keys[j]


def test_groups_by_batches():
    """Any cut into batches gives every earlier line: as a pair, or as rows of a long group."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    names = list(line_dedup._Group.FIELDS)
    token = np.sort(np.concatenate([np.repeat(np.arange(6), [1, 2, 17, 18, 19, 90]), 100 + np.arange(5)]))
    n = len(token)
    ones = pa.array(np.full(n, 10, np.int32))
    whole = pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.arange(n)), pa.array(np.arange(n)), ones, ones, pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int64))], names)
    want = {(x, y) for x in range(n) for y in range(x) if token[x] == token[y]}
    for _ in range(30):
        group, got, long = line_dedup._Group(4, 5, 16), set(), []
        cuts = [0, *np.sort(rnd.integers(0, n + 1, rnd.integers(0, 40))).tolist(), n]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            for out in group.feed(whole.slice(lo, hi - lo)):
                for r in out.to_pylist():
                    if r["x"] is None:
                        long.append((r["token"], r["set"], r["far"]))
                    else:
                        got.add((r["x"], r["y"]))
        assert len(long) == len(set(long))
        got |= {(x, y) for t, x, far in long for u, y, _ in long if far and t == u and y < x}
        assert got == want


def test_bpe(docs, empty, rows, tokenizer):
    got = [(r.doc_id, tuple(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs, tokenizer_path()), tokenizer_path()).collect()]
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, tuple(ids), tokenizer.decode(ids, skip_special_tokens=False)))
    assert order(got) == order(want)
    assert bpe.decode(bpe.encode(empty, tokenizer_path()), tokenizer_path()).count() == 0


def test_vantage_trees(spark):
    rnd = np.random.default_rng(5)
    points = rnd.normal(size=(600, 8))
    points[50:90] = points[40]
    vectors = [(i, p.tolist()) for i, p in enumerate(points)]
    vectors += [(600, None), (620, [0.0] * 8), (640, [1.0] * 7 + [float("nan")]), (660, [1.0] * 7 + [None]), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id bigint, embedding array<double>, id int, rank int")
    for factor, least in ((1.0, 1.0), (1.2, 0.9)):
        got = {}
        for r in vantage_trees.nearest_of_every(frame, every=20, k=10, factor=factor).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert sorted(got) == list(range(0, 600, 20))
        hits = 0
        for q, found in got.items():
            scores = points @ points[q]
            scores[q] = -np.inf
            best = np.lexsort((np.arange(600), -scores.round(9)))[:10].tolist()
            hits += len(set(best) & {v for _, v, _ in found})
            assert [rank for rank, _, _ in sorted(found)] == list(range(1, 11))
            assert all(abs(s - scores[v]) < 1e-9 for _, v, s in found)
        assert hits >= least * 10 * len(got)
    assert vantage_trees.nearest_of_every(frame.where("false")).count() == 0


def test_vantage_trees_of_many_shards(spark, monkeypatch):
    """A shard's vectors travel once, however many blocks of queries it meets; all shards are searched."""
    monkeypatch.setattr(vantage_trees, "SHARD", 100)
    monkeypatch.setattr(vantage_trees, "BLOCK", 10)
    rnd = np.random.default_rng(6)
    points = rnd.normal(size=(900, 6))
    frame = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    kinds, meetings = {}, vantage_trees.meetings

    def counted(trees, asked, shards):
        met = meetings(trees, asked, shards)
        kinds.update({r.kind: r["count"] for r in met.groupBy("kind").count().collect()}, shards=shards, blocks=asked.count())
        return met

    monkeypatch.setattr(vantage_trees, "meetings", counted)
    got = {(r.query_id, r["rank"]): r.vec_id for r in vantage_trees.nearest_of_every(frame, every=5, k=7, factor=1.0).collect()}
    assert kinds["shards"] == 9 and kinds[0] == 9 and kinds["blocks"] > 10 and kinds[1] == 9 * kinds["blocks"]
    for q in range(0, 900, 5):
        scores = points @ points[q]
        scores[q] = -np.inf
        assert [got[q, rank] for rank in range(1, 8)] == np.argsort(-scores)[:7].tolist()


def test_sharding(docs, empty, rows):
    got = sharding.shard(docs, 7).collect()
    want = order((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert order((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert order(map(tuple, sharding.shard(docs.repartition(5), 7).collect())) == order(map(tuple, got))
    assert sharding.shard(empty).count() == 0


def test_permutation_is_one(spark):
    for rows in (1, 2, 3, 5, 10, 97, 1000):
        frame = spark.range(rows)
        assert sorted(r[0] for r in frame.select(sharding.permuted(frame["id"], rows, 42)).collect()) == list(range(rows))


def test_classifiers(spark, docs, empty):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(30)) + (" awful thing" if i % 3 == 0 else "")) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 != 0)) for i, _ in rows], "doc_id bigint, toxic int, quality int")
    for scored, wanted, modulus, rest in (
        (toxicity.score_toxicity(frame, labels), lambda i: int(i % 3 == 0), 5, 0),
        (quality_classifier.score_quality(frame, labels), lambda i: int(i % 3 != 0), 3, 1),
    ):
        got = scored.collect()
        assert len(got) == 900
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in got)
        held = [r for r in got if r.held_out]
        assert sum(r.predicted == wanted(r.doc_id) for r in held) >= 0.95 * len(held)
        assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    nothing = toxicity.score_toxicity(docs, labels.where("false")).collect()
    assert {r.score for r in nothing} == {0.5} and len(nothing) == docs.count()
    assert quality_classifier.score_quality(empty, labels).count() == 0
    assert quality_classifier.good_documents(docs, labels.where("false")).count() == docs.count()


def test_ftrl_gives_sparse_weights():
    s = ftrl.Settings(bits=8, l1=10.0, epochs=3)
    rnd = np.random.default_rng(0)
    examples = [(np.unique(np.append(rnd.integers(1, 256, 5), [0] if y else [])).astype(int), y) for y in rnd.integers(0, 2, 2000)]
    weights = ftrl.ftrl(examples, s)
    assert weights[0] == max(weights[:256]) and (weights[:256] == 0).sum() > 100


def measured(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_weak_supervision(spark, docs, empty, rows):
    got = weak_supervision.judge_quality(docs).collect()
    want = order((i, *measured(t or "")) for i, t in rows)
    assert order((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    assert not any(r.kept and r.base_failed for r in got)
    assert weak_supervision.judge_quality(empty).count() == 0
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(500)]
    clean = [(i, " ".join(rnd.choice(words) for _ in range(80))) for i in range(180)]
    junk = [(i, " ".join(rnd.choice(words) + "&&&" for _ in range(80))) for i in range(180, 200)]
    kept = {r.doc_id for r in weak_supervision.judge_quality(spark.createDataFrame(clean + junk, "doc_id bigint, text string")).where("kept").collect()}
    assert kept == {i for i, _ in clean}


@pytest.mark.parametrize("crowd", [1, 1024])
def test_suffix_arrays(docs, empty, rows, monkeypatch, crowd):
    monkeypatch.setattr(suffix_index, "CROWD", crowd)
    monkeypatch.setattr(suffix_index, "BATCH", 64)
    monkeypatch.setattr(suffix_index, "CHUNK", 4096)
    length = 100
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = {}
    for n, (_, b) in enumerate(raws):
        for at in range(len(b) - length + 1):
            seen.setdefault(b[at : at + length], []).append((n, at))
    marks = [np.zeros(len(b), bool) for _, b in raws]
    for places in seen.values():
        if len(places) > 1:
            for n, at in places:
                marks[n][at : at + length] = True
    want = []
    for (i, b), m in zip(raws, marks, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], m.astype(int), [0]))))
        want.append((i, len(b), [(int(a), int(z)) for a, z in zip(edges[::2], edges[1::2], strict=True)], bytes(np.frombuffer(b, np.uint8)[~m])))
    got = suffix_index.remove_repeats(docs, length).collect()
    assert order((r.doc_id, r.n_bytes, [(s.a, s.z) for s in r.removed], bytes(r.kept)) for r in got) == order(want)
    left = suffix_index.without_repeats(docs, length)
    assert left.columns == docs.columns
    assert order(r.text for r in left.collect() if r.text) == order(t for t in (w[3].decode("utf-8", "ignore") for w in want) if t)
    assert suffix_index.remove_repeats(empty, length).count() == 0


def test_levels_merge_geometrically():
    family = suffix_index.Family()
    for batch in range(13):
        family.add([(b"%03d" % (i * 13 + batch), i * 13 + batch) for i in range(8)])
    sizes = [len(level) for level in family.levels]
    assert sizes == [64, 32, 8] and not family.matched
    family.add([(b"007", 1000)])
    assert family.matched == {7, 1000}


def test_levels_are_read_once_a_merge():
    """a batch is not compared with all that came before it."""
    reads = 0

    class Suffix(bytes):
        __hash__ = bytes.__hash__

        def __eq__(self, other):
            nonlocal reads
            reads += 1
            return bytes(self) == bytes(other)

    family = suffix_index.Family()
    for batch in range(64):
        family.add([(Suffix(b"%04d" % (i * 64 + batch)), i * 64 + batch) for i in range(16)])
    assert not family.matched and reads <= 64 * 16 * 7
    family.add([(Suffix(b"0007"), 2000), (Suffix(b"0007"), 2001)])
    assert family.matched == {7, 2000, 2001}


def test_a_worker_keeps_no_memory_of_a_stage(monkeypatch):
    """encoded words go when another operator begins, and free memory is given back at the end of a task, failed or not."""
    assert packing._encoder(tokenizer_path())(["a word"]) and packing._encoders
    assert list(arrays.tidy(iter, "packing")([])) == [] and packing._encoders
    assert list(arrays.tidy(iter)([])) == [] and not packing._encoders
    calls = []
    monkeypatch.setattr(arrays, "release", lambda: calls.append(1))
    assert list(arrays.tidy(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3] and calls == [1]
    with pytest.raises(ZeroDivisionError):
        list(arrays.tidy(lambda batches: (1 / b for b in batches))([0]))
    assert calls == [1, 1]


def fingerprint(text, shingle):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    parts = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("distance", [3, 4])
def test_simhash(docs, empty, rows, distance):
    got = simhash.near_duplicates(docs, 4, distance).collect()
    prints = [fingerprint(t, 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    want = order((i, prints[n], least.get(find(n))) for n, (i, _) in enumerate(rows))
    assert order((r.doc_id, r.fp % (1 << 64), r.component) for r in got) == want
    assert simhash.near_duplicates(empty).count() == 0
    one = simhash.one_of_each(docs, 4, distance)
    assert one.columns == docs.columns and one.count() == len({find(n) for n in range(len(rows))})


def shingle_set(text, shingle=5):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited_copies():
    """Originals with copies at similarities from 0.7 to 1, some on the edge of 0.8, and a family with a shared head."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randrange(10**6)}"
    out = []
    for n in (20, 104, 304):
        for edits in range(0, max(2, n // 30)):
            for _ in range(6):
                w = [word() for _ in range(n)]
                out.append(" ".join(w))
                for at in rnd.sample(range(n), edits):
                    w[at] = word()
                out.append(" ".join(w))
    w = [word() for _ in range(94)]
    # 90 shingles and ten more on either side: 90 of 112 (0.804), then 90 of 114 (0.789)
    for more in (11, 12):
        out += [" ".join([*w, *[word() for _ in range(more)]]) for _ in range(2)]
    base = [word() for _ in range(200)]
    for _ in range(60):
        v = list(base)
        for at in rnd.sample(range(200), rnd.randrange(0, 6)):
            v[at] = word()
        out.append(" ".join(v))
    return list(enumerate(out))


def test_near_copies_against_brute_force(spark, docs, empty, rows):
    both = [*rows, *((1000 + i, t) for i, t in edited_copies())]
    sets = [shingle_set(t) for _, t in both]
    root = list(range(len(both)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(both)):
        for b in range(a):
            if alike(sets[a], sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for n, (i, t) in enumerate(both):
        groups.setdefault(find(n), set()).add((-1 if i is None else i, t))
    frame = spark.createDataFrame(both, "doc_id bigint, text string").repartition(5)
    got = {}
    marked = shingles.similar_texts(frame.selectExpr("struct(doc_id, text) as doc_id", "text")).collect()
    for r in marked:
        got.setdefault(tuple(r.component), set()).add((-1 if r.doc_id[0] is None else r.doc_id[0], r.doc_id[1]))
    assert len(marked) == len(both)
    assert sorted(map(sorted, ([(i, t or "") for i, t in g] for g in got.values()))) == sorted(map(sorted, ([(i, t or "") for i, t in g] for g in groups.values())))
    assert shingles.one_of_each(frame).count() == len(groups)
    assert shingles.one_of_each(docs).columns == docs.columns and shingles.one_of_each(empty).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hashes_of_the_queries(spark):
    """Digest columns are those of their contracts."""
    from callwarden.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in QUERIES["op8_suffix_arrays"](spark, folder).where("n_removed = 0").collect():
        assert r.kept_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    for r in QUERIES["op3_bpe"](spark, folder).collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    for r in QUERIES["op9_simhash"](spark, folder).collect():
        assert int(r.fingerprint, 16) == fingerprint(text[r.doc_id], 4) and len(r.fingerprint) == 16
