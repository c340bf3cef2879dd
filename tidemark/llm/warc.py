"""WARC archives compressed record by record with a Zstandard dictionary.

``write`` makes ``*.warc.zst`` files: a leading skippable frame (magic 0x184D2A5D) holds the dictionary, then every
record is a frame of its own, so a reader can start at any record's offset.  The dictionary is built from a bounded
sample of the records (``sample_rows`` pages by hash, ``sample_bytes`` of each); it only changes the size of the files.

Of pages with equal payloads of ``least`` bytes or more the one with the smallest id is written as a response, all others
as revisits that name it and carry the digest but no payload.  Payloads are shuffled once, with equal payloads
dealt over salts, so a payload that a third of all pages share meets in no single task.

A task rolls its files at ``roll_bytes`` and writes under a temporary name first; file contents depend on the rows alone,
so a task that runs again after a lost executor replaces its files by equal ones.  The folder may be of any file system that
pyarrow opens by URI (file, hdfs, s3, ...); ``read`` streams one frame at a time.

Defined cases: null html is an empty payload; a null url leaves the target out; a null id is never a response that others refer
to and never a revisit; rows that repeat the smallest id are responses too; line ends in urls are percent-encoded;
an empty table writes no file and reads as no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SALTS, attach, scratch, stored

SKIPPABLE = 0x184D2A5D
LEAST = 100
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122
RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target_uri string, payload binary"


def _fs(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}" if not folder.startswith("file:") else "file://" + folder[5:])


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{digest}')}>"


def _safe(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_bytes(page_id, url, digest: str, size: int, refers_to, payload: bytes | None) -> bytes:
    """One WARC/1.1 record; ``payload`` None makes a revisit."""
    body = HTTP + (payload if payload is not None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of RECORD, from the record alone; the digest of a response is computed from its payload."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    f = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(f["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    stated = f["WARC-Payload-Digest"].removeprefix("sha256:")
    out = {"page_id": int(f["X-Page-ID"]) if "X-Page-ID" in f else None, "record_type": f["WARC-Type"], "refers_to": None, "target_uri": f.get("WARC-Target-URI")}
    if f["WARC-Type"] == "revisit":
        return out | {"payload_bytes": int(f["X-Payload-Length"]), "payload_digest": stated, "refers_to": int(f["X-Refers-To-Page-ID"]), "payload": None}
    digest = hashlib.sha256(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"payload of {f['WARC-Record-ID']} does not have its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload}


def train_dictionary(pages: DataFrame, html: str = "html", key: str = "page_id", sample_rows: int = 400, sample_bytes: int = 16_384, size: int = 112_640) -> bytes:
    """A dictionary from the records of at most ``sample_rows`` pages (by hash); empty when there is too little to learn from."""
    import zstandard

    # the ids are chosen first, so that no task sends more than ids; then their pages come, sample_rows * sample_bytes at most
    ids = stored(pages.where(F.col(key).isNotNull()).select(F.col(key).alias("__k")).distinct().orderBy(F.xxhash64("__k"), "__k").limit(sample_rows))
    rows = (
        pages.join(F.broadcast(ids), F.col(key) == F.col("__k")).groupBy("__k").agg(F.min(F.substring(F.coalesce(html, F.lit("")), 1, sample_bytes)).alias("t")).orderBy("__k").collect()
    )
    samples = [record_bytes(r["__k"], "http://example.org/", "0" * 64, len(r["t"]), None, r["t"].encode()) for r in rows]
    size = min(size, sum(map(len, samples)) // 10)
    if len(samples) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b""


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, size, first): what is written; ``first`` is null for responses."""
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    firsts = base.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = attach(base, stored(firsts), ["digest"], "left", F.xxhash64("page_id", "url"))
    return out.withColumn("first", F.when((F.col("size") >= least) & (F.col("first") != F.col("page_id")), F.col("first")))


def write(pages: DataFrame, folder: str, dictionary: bytes | None = None, roll_bytes: int = 64_000_000, level: int = 6, **columns) -> DataFrame:
    """Write the archives below ``folder``; returns the stored list of records (file, offset, length, page_id)."""
    dictionary = train_dictionary(pages, **{k: v for k, v in columns.items() if k in ("html", "key")}) if dictionary is None else dictionary
    rows = plan(pages, **columns).sortWithinPartitions("page_id", "url", "digest")

    def run(batches):
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        with Archive(folder, part, attempt, dictionary, level, roll_bytes) as archive:
            for batch in batches:
                ids, urls, payloads, sizes, digests, firsts = (batch.column(batch.schema.get_field_index(n)) for n in ("page_id", "url", "payload", "size", "digest", "first"))
                at = []
                for i in range(batch.num_rows):
                    first = firsts[i].as_py()
                    at.append(archive.add(record_bytes(ids[i].as_py(), urls[i].as_py(), digests[i].as_py(), sizes[i].as_py(), first, payloads[i].as_py() if first is None else None)))
                yield pa.RecordBatch.from_arrays([pa.array([a[j] for a in at], t) for j, t in enumerate((pa.string(), pa.int64(), pa.int64()))] + [ids], ["file", "offset", "length", "page_id"])

    return stored(rows.mapInArrow(run, "file string, offset long, length long, page_id long"))


class Archive:
    """Files of one task: written under a temporary name, moved when full or done."""

    def __init__(self, folder: str, part: int, attempt: int, dictionary: bytes, level: int, roll_bytes: int) -> None:
        import zstandard

        self.fs, self.root = _fs(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.part, self.attempt, self.dictionary, self.roll = part, attempt, dictionary, roll_bytes
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zstd = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        self.n, self.out = 0, None

    def __enter__(self) -> Archive:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()

    def add(self, record: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name = f"part-{self.part:05d}-{self.n:05d}.warc.zst"
            self.out = self.fs.open_output_stream(f"{self.root}/.{self.name}.{self.attempt}", compression=None)
            head = struct.pack("<II", SKIPPABLE, len(self.dictionary)) + self.dictionary
            self.out.write(head)
            self.at = len(head)
        frame = self.zstd.compress(record)
        self.out.write(frame)
        start, name = self.at, self.name
        self.at += len(frame)
        if self.at >= self.roll:
            self.close()
        return name, start, len(frame)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.root}/.{self.name}.{self.attempt}", f"{self.root}/{self.name}")
            self.out, self.n = None, self.n + 1


def records(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of one archive, frame by frame; holds one record and one chunk."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame at the start")
    dictionary = stream.read(size)
    known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    zstd = zstandard.ZstdDecompressor(dict_data=known)
    rest = b""
    while rest or (rest := stream.read(chunk)):
        one, out = zstd.decompressobj(), io.BytesIO()
        while not one.eof:
            out.write(one.decompress(rest))
            rest = one.unused_data if one.eof else stream.read(chunk)
            if not one.eof and not rest:
                raise ValueError("the archive ends inside a record")
        yield out.getvalue()


def read(spark: SparkSession, folder: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the named archives (column ``file``) as RECORD; one row per file is dealt out, the records stream."""
    names = files.select("file").distinct()
    names = names.repartition(max(1, names.count()), "file")  # a task per file or so; adaptive execution would merge them

    def run(batches):
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        fields = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "target_uri", "payload"]
        fs, root = _fs(folder)

        def batch_of(got):
            return pa.RecordBatch.from_arrays([pa.array([g[f] for g in got], t) for f, t in zip(fields, types)], fields)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                got, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in records(stream):
                        r = parse_record(data)
                        got.append(r if payloads else r | {"payload": None})
                        held += len(data) if payloads else 100
                        if held > 8_000_000 or len(got) >= 10_000:
                            yield batch_of(got)
                            got, held = [], 0
                if got:
                    yield batch_of(got)

    return names.mapInArrow(run, RECORD)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every page as it is read back from the archives."""
    folder = f"{scratch(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read(spark, folder, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle() -> str:
    return """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest"""
