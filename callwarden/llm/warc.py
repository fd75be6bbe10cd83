"""WARC archives of a table of pages: a deterministic sharded writer, and a reader.

* Rows are sorted by key within shards of key ranges.  The bounds of the ranges follow from the keys alone: from
  the bytes under a share of the keys, chosen by hash.  The same rows give the same files, byte for byte,
  however they were dealt out before.
* Of records with equal payloads (SHA-1) the one of the largest key holds the payload, the others are
  `revisit` records that refer to it.  That is decided on a narrow table; a decision travels to its record as
  a row in front of it, so that payloads are shuffled once.
* Each record is a gzip member of its own.  A file is rolled when its compressed size passes `file_bytes`.
* Tasks write under temporary names, one per attempt, and return what they wrote; only rows of successful
  attempts reach the manifest.  Its files are renamed, which can be repeated, and the manifest is
  written last.  Readers take the files of the manifest only: without one, nothing counts as written.

Tasks reach the folder through `pyarrow.fs` (local or mounted paths, hdfs, s3, gs); pages may come from any source.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callwarden.llm.storage import stored

#: Keys that the bounds of shards are chosen from, at most about so many; shards at most.
SAMPLED, MOST_SHARDS = 20_000, 20_000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, names that are URLs
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, temporary string, shard int, records bigint, bytes bigint, sha1 string"
RECORD = "file string, offset bigint, record_type string, record_id string, key bigint, url string, payload_digest string, payload_bytes bigint, refers_to_id string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(key: int | None, digest: bytes, nth: int) -> str:
    """The name of the nth record of a key and payload, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}:{digest.hex()}:{nth}')}>"


def _head(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def _line(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def _member(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(block).digest())}"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _record(key, url: str, payload: bytes, digest: bytes, nth: int, refers, date: str, level: int) -> bytes:
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(key, digest, nth)), ("WARC-Date", date),
        ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if key is not None:
        fields.append(("X-Source-Key", str(key)))
    if refers is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers[0], digest, 0)), ("WARC-Refers-To-Target-URI", _line(refers[1])), ("WARC-Refers-To-Date", date)]
        return _member(fields, _head(len(payload)), level)
    return _member(fields, _head(len(payload)) + payload, level)


class _Roller:
    """Files of one task: opened under temporary names, rolled by compressed size."""

    def __init__(self, folder: str, prefix: str, date: str, most: int, level: int):
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.prefix, self.date, self.most, self.level = prefix, date, most, level
        self.attempt, self.shard, self.number, self.file, self.done = uuid.uuid4().hex, None, 0, None, []

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.name, self.temporary, self.shard, self.records, self.bytes, self.sha1.hexdigest()))
            self.file = None

    def put(self, data: bytes) -> None:
        self.file.write(data)
        self.sha1.update(data)
        self.bytes += len(data)

    def write(self, shard: int, data: bytes) -> None:
        if shard != self.shard or self.file is None or self.bytes >= self.most:
            self.close()
            self.number = 0 if shard != self.shard else self.number + 1
            self.shard = shard
            self.name = f"{self.prefix}-{shard:05d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.file, self.sha1, self.bytes, self.records = self.fs.open_output_stream(f"{self.root}/{self.temporary}"), hashlib.sha1(), 0, 0
            info = f"format: WARC File Format 1.1\r\nfilename: {self.name}\r\n".encode()
            name = f"<urn:uuid:{uuid.uuid5(_NAMESPACE, self.name)}>"
            self.put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info, self.level))
        self.put(data)
        self.records += 1

    def report(self) -> pa.RecordBatch | None:
        rows, self.done = self.done, []
        names = ["name", "temporary", "shard", "records", "bytes", "sha1"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names) if rows else None


def _bounds(narrow: DataFrame, shard_bytes: int) -> list[int]:
    """Keys that part the rows into shards of about equal bytes; the same for the same rows."""
    rows, total = narrow.agg(F.count("*"), F.sum(F.col("size") + 512)).first()
    shards = min(MOST_SHARDS, -(-(total or 0) // shard_bytes))
    if shards < 2:
        return []
    some = narrow.where(F.col("key").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(max(1, rows // SAMPLED))) == 0))
    seen = sorted((r.key, r.w) for r in some.groupBy("key").agg(F.sum(F.col("size") + 512).alias("w")).collect())
    whole, bounds, so_far = sum(w for _, w in seen), [], 0
    for key, w in seen:
        so_far += w
        if so_far * shards >= whole * (len(bounds) + 1) and len(bounds) < shards - 1:
            bounds.append(key)
    return bounds


def _shard(key: Column, bounds: list[int]) -> Column:
    """The number of bounds below the key, by halving; null keys come first."""
    if not bounds:
        return F.lit(0)
    table, steps = F.array(*[F.lit(b) for b in bounds]), [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    at = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when(F.try_element_at(table, at + s) < key, at + s).otherwise(at),
    )
    return F.coalesce(at, F.lit(0))


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", revisit_from: int = 0, prefix: str = "pages",
    date: str = "1970-01-01T00:00:00Z", file_bytes: int = 256 << 20, shard_bytes: int = 32 << 20, level: int = 6,
) -> DataFrame:
    """Write one record per row below `folder`; returns the manifest, one row per file.

    Payloads are the UTF-8 bytes of the column; null payloads and URLs are empty.  Records of equal payloads of at least
    `revisit_from` bytes refer to the one of the largest key.  Of rows with the same key and payload the first (by URL, descending)
    is the one referred to, the others revisit it.  Rows without a key come first, are always responses and never
    referred to.  Other columns are ignored.  An empty table gives a manifest without files; a folder that has a manifest
    is an error.  All rows of one key lie in one shard.  Runs actions.
    """
    files, root = pafs.FileSystem.from_uri(folder)
    if files.get_file_info(f"{root}/_manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} has archives already")
    data = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    rows = pages.select(pages[key].cast("bigint").alias("key"), F.coalesce(pages[url].cast("string"), F.lit("")).alias("url"), data.alias("payload"))
    digest = F.unhex(F.sha1("payload")).alias("digest")
    narrow = stored(rows.select("key", "url", F.length("payload").cast("bigint").alias("size"), digest))
    bounds = _bounds(narrow, shard_bytes)
    shard = _shard(F.col("key"), bounds)
    same = narrow.where(F.col("key").isNotNull() & (F.col("size") >= revisit_from))
    best = same.groupBy("digest").agg(F.max(F.struct("key", "url")).alias("best"), F.count("*").alias("c")).where("c > 1").select("digest", "best")
    decided = same.select("key", "digest").distinct().join(best, "digest").where(F.col("key") < F.col("best.key"))
    decided = decided.select("key", F.lit(None).cast("string").alias("url"), F.lit(b"").alias("payload"), "digest", F.lit(0).alias("kind"), "best")
    records = rows.select("key", "url", "payload", digest, F.lit(1).alias("kind"), F.lit(None).cast("struct<key:bigint,url:string>").alias("best"))
    sorted_ = decided.union(records).withColumn("shard", shard).repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "key", "digest", "kind", F.desc("url"))
    slim = sorted_.select("shard", "key", "url", "payload", "digest", "kind", F.col("best.key").alias("best_key"), F.col("best.url").alias("best_url"))

    def run(batches):
        out, now, nth, refers = _Roller(folder, prefix, date, file_bytes, level), None, 0, None
        for batch in batches:
            columns = [batch.column(i) for i in range(8)]
            for place, k, u, p, d, kind, best_key, best_url in zip(*columns, strict=True):
                k, d = k.as_py(), d.as_py()
                if (k, d) != now:
                    now, nth, refers = (k, d), 0, None
                if kind.as_py() == 0:
                    refers = best_key.as_py(), best_url.as_py()
                    continue
                u, p = u.as_py(), p.as_py()
                if nth == 0:
                    first_url = u
                target = refers
                if target is None and nth and k is not None and len(p) >= revisit_from:
                    target = k, first_url
                out.write(place.as_py(), _record(k, u, p, d, nth, target, date, level))
                nth += 1
            if (report := out.report()) is not None:
                yield report
        out.close()
        if (report := out.report()) is not None:
            yield report

    written = stored(slim.mapInArrow(run, MANIFEST))
    _commit(written, folder)
    return written.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _commit(written: DataFrame, folder: str) -> None:
    """Give the files of the table their names, then write it as the manifest, then drop what attempts left."""

    def rename(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary, size in zip(*[batch.column(i).to_pylist() for i in (0, 1, 4)], strict=True):
                old, new = f"{root}/{temporary}", f"{root}/{name}"
                if files.get_file_info(old).type != pafs.FileType.NotFound:
                    files.move(old, new)
                elif files.get_file_info(new).size != size:  # a repeated task finds it renamed
                    raise FileNotFoundError(f"{temporary} is neither there nor renamed")
            yield batch

    written.mapInArrow(rename, MANIFEST).write.parquet(f"{folder}/_manifest")
    files, root = pafs.FileSystem.from_uri(folder)
    if files.get_file_info(f"{root}/_temporary").type != pafs.FileType.NotFound:
        files.delete_dir(f"{root}/_temporary")


def _members(file, step: int = 1 << 20):
    """(offset, content) of the gzip members of a stream, one at a time."""
    offset, rest, unpacker, parts = 0, b"", zlib.decompressobj(31), []
    used = 0
    while data := rest or file.read(step):
        parts.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        used += len(data) - len(rest)
        if unpacker.eof:
            yield offset, b"".join(parts)
            offset, unpacker, parts = used, zlib.decompressobj(31), []
    if used != offset:
        raise ValueError("a record breaks off")


def _parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of a record, its length and block digest checked."""
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not found or lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(block).digest())}":
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    return fields, block


def read_archives(spark: SparkSession, folder: str, payloads: bool = False, batch_bytes: int = 8 << 20) -> DataFrame:
    """One row per record of the manifest's files, as RECORD says; with `payloads` also the payload of responses.

    Lengths, block digests, the payload digests of responses and the number of records are checked; what does not agree is an
    error.  `payload_bytes` is the length of the full payload, of revisits as their HTTP header states it.  `refers_to_id` is
    the record that a revisit refers to.  Digests are without their `sha1:`.  Files are read as streams, a record at a time.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("name", "records")
    tasks = min(MOST_SHARDS, manifest.count()) or 1
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [part.split(" ")[0] for part in RECORD.split(", ")]
    if payloads:
        kinds, names = [*kinds, pa.binary()], [*names, "payload"]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with files.open_input_stream(f"{root}/{name}", compression=None) as file:
                    rows, held, count = [], 0, 0
                    for offset, content in _members(file):
                        fields, block = _parsed(content)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        count += 1
                        head, _, body = block.partition(b"\r\n\r\n")
                        size = int(head.rsplit(b"Content-Length: ", 1)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (size != len(body) or digest != base32(hashlib.sha1(body).digest())):
                            raise ValueError(f"{fields['WARC-Record-ID']} has another payload than it states")
                        key = fields.get("X-Source-Key")
                        row = (name, offset, fields["WARC-Type"], fields["WARC-Record-ID"], None if key is None else int(key), fields["WARC-Target-URI"], digest, size, fields.get("WARC-Refers-To"))
                        rows.append((*row, body if fields["WARC-Type"] == "response" else None) if payloads else row)
                        held += 256 + len(body) * payloads
                        if held > batch_bytes:
                            yield table(rows)
                            rows, held = [], 0
                    if rows:
                        yield table(rows)
                    if count != records:
                        raise ValueError(f"{name} has {count} records instead of {records}")

    return manifest.repartition(tasks, "name").mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def with_targets(records: DataFrame) -> DataFrame:
    """The records with `refers_to`, the key of the record that a revisit refers to; a missing one is an error."""
    records = stored(records)
    targets = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    known = F.coalesce("refers_to", F.raise_error(F.lit("a revisit refers to no record")).cast("bigint"))
    revisits = revisits.withColumn("refers_to", known).select(*records.columns, "refers_to")
    return records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(revisits)


def warc_sql() -> str:
    """What the archives of `pages` have to say, with revisits of any length."""
    five = ", ".join(f"CAST(concat('0x', substr(d, {i * 5 + 1}, 5)) AS BIGINT)" for i in range(8))
    sign = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x // {1 << shift}) % 32 + 1 AS BIGINT), 1)"
    return f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
last AS (SELECT html, max(page_id) AS target FROM hashed GROUP BY html)
SELECT page_id, CAST(octet_length(encode(h.html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform([{five}], lambda x: concat({", ".join(map(sign, (15, 10, 5, 0)))})), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> target THEN target END AS refers_to
FROM hashed h JOIN last ON last.html = h.html"""
