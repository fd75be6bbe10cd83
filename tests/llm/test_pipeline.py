"""The pipeline, stage by stage, against brute force on the smallest table."""

import re
import zlib

import numpy as np
import pytest
from test_operators import alike, lines_brute, shingle_set

import corpus_pipeline
from callwarden.llm import quality_classifier
from callwarden.llm.queries import table, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def without_lines(docs):
    """{id: text} without removed lines; documents without any words left go."""
    out = {}
    removed = lines_brute(list(docs.items()))
    for i, text in docs.items():
        gone = removed[i, text]
        left = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
        if not gone or WORD.search(left):
            out[i] = left
    return out


def one_of_each(docs):
    """Brute-force Jaccard of five-word shingles."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in docs:
        for b in docs:
            if a < b and alike(sets[a], sets[b]) and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: docs[i] for i in docs if find(i) == i}


def repeated_bytes(docs, length=400):
    """{id: marks of the bytes} of strings of this length that start at two places."""
    raws = {i: t.encode() for i, t in docs.items()}
    places = {}
    for i, b in raws.items():
        for at in range(len(b) - length + 1):
            places.setdefault(b[at : at + length], []).append((i, at))
    marks = {i: np.zeros(len(b), bool) for i, b in raws.items()}
    for found in places.values():
        if len(found) > 1:
            for i, at in found:
                marks[i][at : at + length] = True
    return marks


def repeated_words(docs, most=50):
    """{id: marks of the bytes} of passages of more words that start at two places."""
    spans = {i: [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for i, t in docs.items()}
    places = {}
    for i, t in docs.items():
        raw = t.encode()
        words = [raw[a:z] for a, z in spans[i]]
        for at in range(len(words) - most):
            places.setdefault(tuple(words[at : at + most + 1]), []).append((i, at))
    marks = {i: np.zeros(len(t.encode()), bool) for i, t in docs.items()}
    for found in places.values():
        for i, at in found if len(found) > 1 else []:
            last = at + most
            marks[i][0 if at == 0 else spans[i][at][0] : len(marks[i]) if last == len(spans[i]) - 1 else spans[i][last][1]] = True
    return marks


def without(docs, *marks):
    out = {}
    for i, t in docs.items():
        gone = np.logical_or.reduce([m[i] for m in marks])
        left = bytes(np.frombuffer(t.encode(), np.uint8)[~gone]).decode("utf-8", "ignore")
        if left or not gone.any():
            out[i] = left
    return out


def without_repeats(docs):
    """Without passages of 400 bytes, or of over 50 words, that start elsewhere as well."""
    return without(docs, repeated_bytes(docs), repeated_words(docs))


@pytest.fixture(scope="module")
def documents(spark):
    """The table, and long documents again with other line ends: copies that no line gives away."""
    docs, rows = table(spark, FOLDER), []
    for r in docs.orderBy("doc_id").collect():
        words = (r.text or "").split()
        if len(words) >= 60 and len(rows) < 8:
            text = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
            rows.append({**r.asDict(), "doc_id": r.doc_id + 10_000_000, "text": text, "n_chars": len(text)})
    assert len(rows) == 8
    return docs.union(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema))


def through(spark, docs):
    """The result of each stage, as it is written and read again."""
    from callwarden.llm.storage import stored

    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER))
        out.append(docs)
    return out


@pytest.fixture(scope="module")
def stages(spark, documents):
    return through(spark, documents)


def texts(frame):
    rows = frame.select("doc_id", "text", "n_chars").collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return {r.doc_id: r.text for r in rows}


def test_stages_against_brute_force(spark, documents, stages):
    from tokenizers import Tokenizer

    assert all(s.columns == documents.columns for s in stages[:-1])
    scores = quality_classifier.score_quality(documents, table(spark, FOLDER, "labels")).collect()
    text = {r.doc_id: r.text for r in documents.collect()}
    want = {r.doc_id: text[r.doc_id] for r in scores if r.predicted}
    assert {r.doc_id: r.text for r in stages[0].collect()} == want
    for stage, brute in zip(stages[1:4], (without_lines, one_of_each, without_repeats), strict=True):
        smaller = brute(want)
        assert texts(stage) == smaller
        assert smaller != want
        want = smaller
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in want.items()}
    length, ends = {}, {}
    for p in stages[4].collect():
        piece = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(piece) and p.doc_tokens == len(ids[p.doc_id])
        length[p.doc_id] = length.get(p.doc_id, 0) + p.length
        ends[p.sequence_id] = ends.get(p.sequence_id, 0) + p.length
    assert length == {i: len(x) for i, x in ids.items()}
    assert all(n == 2048 for s, n in ends.items() if s < max(ends)) and max(ends) == (sum(length.values()) - 1) // 2048


def test_run_gives_the_pieces_of_the_stages(spark):
    count = lambda frame: sorted((r.doc_id, r.doc_tokens) for r in frame.where("start = 0").collect())
    assert count(corpus_pipeline.run(spark, FOLDER)) == count(through(spark, table(spark, FOLDER))[-1])


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, FOLDER, name).where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_passages_of_over_fifty_words(spark):
    """In the middle of different lines, and in fewer than 400 bytes; fifty words are not enough."""
    own = lambda i, n: [f"own{i}x{j}" for j in range(n)]
    passage = [f"w{j}" for j in range(51)]
    docs = {i: " ".join([*own(i, 20), *passage, *own(i + 100, 20)]) for i in range(3)}
    docs[3] = " ".join([*own(3, 20), *passage[:50], *own(103, 20)])
    docs[4] = "\n".join([*own(4, 20), *passage, *own(104, 20)])  # the same words, other white space
    docs[5] = docs[6] = " ".join(own(5, 60)) + "\n"
    assert len(" ".join(passage)) < 323
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in docs.items()], "doc_id bigint, text string, n_chars bigint")
    left = {i: t.split() for i, t in texts(corpus_pipeline.repeats(spark, frame, FOLDER)).items()}
    assert left == {**{i: own(i, 20) + own(i + 100, 20) for i in (0, 1, 2, 4)}, 3: docs[3].split()}


def test_repeats_by_words_and_bytes_against_brute_force(spark):
    frame = table(spark, FOLDER).where("text is not null and text <> ''").dropDuplicates(["doc_id"])
    docs = {r.doc_id: r.text for r in frame.collect()}
    want = without_repeats(docs)
    assert texts(corpus_pipeline.repeats(spark, frame, FOLDER)) == want
    by_bytes = without(docs, repeated_bytes(docs))
    print("documents that a window of 400 bytes alone leaves otherwise:", sum(by_bytes.get(i, "") != want.get(i, "") for i in docs))
    assert any(by_bytes.get(i, "") != want.get(i, "") for i in docs)


def test_near_copies_begin_with_fingerprints(spark, monkeypatch):
    """Near duplicates by SimHash are verified and handed to the join, which finds what they miss."""
    from callwarden.llm import shingles

    base = [f"w{i}" for i in range(300)]
    edited = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    docs = {1: edited(), 2: edited(0), 3: edited(0, 299), 4: " ".join(f"v{i}" for i in range(300)), 5: None, 6: edited()}
    frame = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs.items()], "doc_id bigint, text string, n_chars bigint")
    given, links = [], shingles.Join.links
    monkeypatch.setattr(shingles.Join, "links", lambda self, nodes, known=None: given.append(known.count()) or links(self, nodes, known))
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, frame, FOLDER).collect()} == {1, 4, 5}
    assert given[0] > 0


def test_classes_of_fingerprints_are_checked_in_whole(spark, monkeypatch):
    """Texts of one class that are unlike its head, but like each other, are linked before the join of all texts."""
    from callwarden.llm import shingles

    same = ["p", "q", "r", "s", "t"] * 200  # decides the fingerprint
    docs = {}
    for family in range(5):
        tail = [f"f{family}x{i}" for i in range(60)]
        docs[2 * family] = " ".join([*same, *tail])
        docs[2 * family + 1] = " ".join([*same, *tail[:30], "other", *tail[31:]])
    frame = spark.createDataFrame([(i, t, len(t)) for i, t in docs.items()], "doc_id bigint, text string, n_chars bigint")
    given, links = [], shingles.Join.links
    monkeypatch.setattr(shingles.Join, "links", lambda self, nodes, known=None: given.append(known.count()) or links(self, nodes, known))
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, frame, FOLDER).collect()} == {0, 2, 4, 6, 8}
    assert given == [1, 5]


def test_sketches_lose_no_similar_pair():
    """Sketches differ in no more classes than sets do in shingles, also sketches of two sizes."""
    import pyarrow as pa

    from callwarden.llm.shingles import _apart, _lists, _sketch

    rnd = np.random.default_rng(3)
    pairs = []
    for n in (0, 1, 5, 63, 64, 65, 120, 130, 1000, 1030, 1300):
        for changed in (0, 1, n // 20, n // 9, n // 2, n):
            a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
            pairs.append((a, np.unique(np.append(a[changed:], rnd.integers(0, 1 << 63, changed + n // 9).astype(np.uint64)))))
    assert any(len(_sketch(a)) != len(_sketch(b)) for a, b in pairs)
    a, b = (_lists([_sketch(p[i]) for p in pairs]) for i in (0, 1))
    apart, differ = _apart(a, b), np.array([len(np.setxor1d(x, y)) for x, y in pairs])
    assert (apart <= differ).all() and (apart[differ < 3] == differ[differ < 3]).mean() > 0.8
    assert (_apart(a.slice(3), b.slice(3)) == apart[3:]).all() and len(_apart(a.slice(0, 0), b.slice(0, 0))) == 0
    assert isinstance(a, pa.ListArray)


def test_stages_leave_no_tables_and_no_shuffles(spark, tmp_path):
    """What a stage writes on its way is gone when its result is there, but for one narrow table that the result reads."""
    from pathlib import Path

    from callwarden.sources.checkpoints import ensure_checkpoint_dir

    docs = table(spark, FOLDER)
    here = lambda: {p for p in Path(ensure_checkpoint_dir(spark).removeprefix("file:")).glob("llm-*")}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = here()
        out = stage(spark, docs, FOLDER)
        left = here() - before
        assert len(left) <= 2 and (not left or max(sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in left) < 60_000), name
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
