"""WARC archives: round trip, revisits, equal bytes in every run, damage."""

import base64
import gzip
import hashlib
import random

import pytest

from callwarden.llm import warc

SCHEMA = "page_id bigint, url string, html string, key bigint, digest string, shard int, size int, best string, payload string"


def pages():
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abc <>é\r\n\n") for _ in range(n))
    rows = [(i, f"http://x/{i}", text(rnd.randrange(0, 400))) for i in range(300)]
    rows += [(1000 + i, f"http://copy/{i}", "<p>copy</p>") for i in range(120)]
    rows += [(2000, "u", None), (2001, None, ""), (2002, "line\nbreak: x", text(300_000)), (None, "n", "<p>copy</p>"), (None, None, None), (-5, "m", "WARC/1.1\r\n\r\n")]
    rows += [(2003, "b", "twice"), (2003, "a", "twice"), (2003, "a", "twice"), (2004, "z", "<p>other</p>"), (2004, "z", "<p>copy</p>")]
    return rows


def frame(spark, rows, parts):
    return spark.createDataFrame([(*r, 1, "d", 2, 3, "b", "p") for r in rows], SCHEMA).repartition(parts)


def want(rows, least):
    best = {}
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= least:
            best[h or ""] = max(k, best.get(h or "", k))
    out, seen = [], set()
    for k, _, h in rows:
        data = (h or "").encode()
        target = best.get(h or "") if k is not None else None
        first = target == k and (k, data) not in seen
        seen.add((k, data))
        refers = None if target is None or first else target
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip(spark, tmp_path, least):
    rows = pages()
    manifest = warc.write_archives(frame(spark, rows, 5), f"{tmp_path}/a", revisit_from=least, file_bytes=4000, shard_bytes=40_000)
    files = manifest.collect()
    assert len({f.shard for f in files}) > 3 and max(f.name.rsplit("-", 1)[1] for f in files) > "00000.warc.gz"
    records = warc.with_targets(warc.read_archives(spark, f"{tmp_path}/a", payloads=True))
    got = records.collect()
    assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == want(rows, least)
    assert len({r.record_id for r in got if r.key is not None}) == len([r for r in got if r.key is not None])
    held = {(r.key, bytes(r.payload)) for r in got if r.record_type == "response"}
    assert held == {(k, (h or "").encode()) for k, _, h in rows if (k, (h or "").encode()) in held} and len(held) > 250
    # any gzip reader takes the files, records are sorted by key, and nothing else is left
    keys = []
    for f in sorted(files, key=lambda f: f.name):
        assert gzip.decompress((tmp_path / "a" / f.name).read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        keys += [r.key for r in sorted(got, key=lambda r: r.offset) if r.file == f.name and r.key is not None]
    assert keys == sorted(keys)
    assert {p.name for p in (tmp_path / "a").iterdir()} == {"_manifest", *(f.name for f in files)}


def test_same_bytes_in_every_run(spark, tmp_path):
    rows = pages()
    made = []
    for name, parts in (("a", 1), ("b", 7)):
        random.Random(name).shuffle(rows)
        manifest = warc.write_archives(frame(spark, rows, parts), f"file://{tmp_path}/{name}", file_bytes=4000, shard_bytes=40_000)
        made.append({(f.name, f.records, f.bytes, f.sha1) for f in manifest.collect()})
    assert made[0] == made[1]
    assert {(n, hashlib.sha1((tmp_path / "b" / n).read_bytes()).hexdigest()) for n, *_ in made[0]} == {(n, s) for n, _, _, s in made[0]}


def test_damage_and_second_writing(spark, tmp_path):
    pages = frame(spark, [(1, "u", "x" * 500), (2, "v", "y" * 500)], 1)
    [file] = warc.write_archives(pages, f"{tmp_path}/a").collect()
    with pytest.raises(FileExistsError):
        warc.write_archives(pages, f"{tmp_path}/a")
    path = tmp_path / "a" / file.name
    whole = path.read_bytes()
    path.write_bytes(whole[:-20])
    with pytest.raises(Exception, match="breaks off"):
        warc.read_archives(spark, f"{tmp_path}/a").collect()
    path.write_bytes(gzip.compress(gzip.decompress(whole).replace(b"xxx", b"xzx", 1)))
    with pytest.raises(Exception, match="is damaged|not a WARC record"):
        warc.read_archives(spark, f"{tmp_path}/a").collect()


def test_a_repeated_commit_and_attempts_that_failed(spark, tmp_path):
    """A task that runs again finds its file renamed; files of lost attempts are in no manifest."""
    folder = f"{tmp_path}/a"
    (tmp_path / "a" / "_temporary").mkdir(parents=True)
    (tmp_path / "a" / "_temporary" / "pages-00000-00000.warc.gz.lost").write_bytes(b"half")
    [file] = warc.write_archives(frame(spark, [(1, "u", "x")], 1), folder).collect()
    assert not (tmp_path / "a" / "_temporary").exists()
    again = spark.createDataFrame([tuple(file)], warc.MANIFEST)
    (tmp_path / "a" / "_manifest").rename(tmp_path / "a" / "_before")
    warc._commit(again, folder)
    assert warc.read_archives(spark, folder).count() == 1
    (tmp_path / "a" / "_manifest").rename(tmp_path / "a" / "_twice")
    (tmp_path / "a" / file.name).unlink()
    with pytest.raises(Exception, match="neither there nor renamed"):
        warc._commit(again, folder)


def test_no_pages(spark, tmp_path):
    assert warc.write_archives(frame(spark, [(1, "u", "x")], 1).where("false"), f"{tmp_path}/a").count() == 0
    assert warc.with_targets(warc.read_archives(spark, f"{tmp_path}/a")).count() == 0
