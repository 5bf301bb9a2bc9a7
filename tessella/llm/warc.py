"""Deterministic sharded WARC writing, and reading back.

Records are sorted by range of (key, digest), so shards follow each other. The
bounds of the shards are exact: running sums of payload bytes over the sorted
(key, digest), cut at fixed totals. They depend on the rows alone, not on how
these are dealt out, on samples or on earlier jobs, and so do names and bytes
of all files. A shard is one or more files, a new one being started when the
compressed size passes ``roll_bytes``; every record is a gzip member of its own, with
headers and digests made afresh from the payload, and nothing in a file
depends on clock, host or attempt. A file is written under a temporary name
and moved to its final name when it is whole; a repeated attempt writes the
same bytes over it. The manifest (file, place, records, bytes, SHA-256, first
and last key) is a table committed after all files are: readers go by it, and
files that it does not name do not count. Any file system that pyarrow opens by
its URI will do; where a move is a copy (object stores), a file is written twice.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one
with the largest key is the response and the others are revisits of it, which
hold no payload but its digest and length.

Defined cases: a null payload is empty; a null URL is written as
``urn:page:<key>``, blanks, ``%`` and what is not printable ASCII are percent-encoded;
rows that repeat key and payload are one response (the first) and revisits of
that same key; a null key is the least key and is written as empty; an empty
table makes an empty manifest; extra columns are left out. Rows of one key and
one payload are the least that one shard holds.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import materialize

REVISIT_BYTES = 1000
ROLL_BYTES = 1 << 30
#: A shard has 1 / 256 of all bytes, but at least and at most so many (uncompressed).
LEAST_SHARD, MOST_SHARD = 4 << 20, 1 << 30
#: Bytes that headers add to a record, for the running sums.
HEADERS = 600
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, part int, records long, bytes long, sha256 string, first_key string, last_key string"
READ = "file string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def record_id(key: str, digest: str) -> str:
    """The same for the same page and payload, wherever it is written."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{digest}')}>"


def _uri(url: str | None, key: str) -> str:
    return f"urn:page:{key}" if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~|^`{}<>\\\"")


def _record(key: str, url: str | None, payload: bytes | None, digest: str, length: int, refers: str | None) -> bytes:
    """One record: a response with its payload, or (payload None) a revisit."""
    sha1 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload or b"")
    kind = "response" if refers is None else "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest)}", f"WARC-Target-URI: {_uri(url, key)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: {sha1}",
        "WARC-Block-Digest: sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode(), f"WARC-Page-Key: {key}", f"WARC-Payload-Length: {length}", f"WARC-Has-URI: {int(url is not None)}",
    ]
    if refers is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, digest)}", f"WARC-Refers-To-Key: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Shard:
    """The file being written."""

    def __init__(self, files: fs.FileSystem, folder: str, name: str, part: int):
        self.files, self.name, self.part = files, name, part
        self.final, self.temp = f"{folder}/{name}", f"{folder}/_temporary/{uuid.uuid4().hex}-{name}"
        self.out, self.sha = files.open_output_stream(self.temp), hashlib.sha256()
        self.records = self.bytes = 0
        self.first = self.last = ""

    def add(self, key: str, record: bytes) -> None:
        data = _member(record)
        self.out.write(data)
        self.sha.update(data)
        self.first = key if not self.records else self.first
        self.last = key
        self.records += 1
        self.bytes += len(data)

    def commit(self) -> tuple:
        self.out.close()
        self.files.move(self.temp, self.final)
        return self.name, self.part, self.records, self.bytes, self.sha.hexdigest(), self.first, self.last

    def abort(self) -> None:
        self.out.close()
        self.files.delete_file(self.temp)


def _writer(folder_uri: str, prefix: str, roll_bytes: int):
    """Reads rows sorted by (part, key, digest, is page): decisions come before the pages they hold for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(folder_uri)
        shard, made, part, rolled = None, [], None, 0
        decided = responded = None  # ((key, digest), the key to refer to), and the last (key, digest) written as a shared response
        try:
            for batch in batches:
                keys, digests, pages, parts, refers, urls = (batch.column(i).to_pylist() for i in range(6))
                for i, (key, digest) in enumerate(zip(keys, digests)):
                    if not pages[i]:
                        decided = ((key, digest), refers[i])
                        continue
                    payload = batch.column(6)[i].as_buffer() if batch.column(6)[i].is_valid else b""
                    name = "" if key is None else str(key)
                    to = decided[1] if decided is not None and decided[0] == (key, digest) else None
                    if to is not None and to == key and responded != (key, digest):
                        to, responded = None, (key, digest)  # the response itself; rows that repeat it revisit it
                    if shard is None or shard.bytes >= roll_bytes or part != parts[i]:
                        if shard is not None:
                            made.append(shard.commit())
                        rolled = rolled + 1 if part == parts[i] else 0
                        part = parts[i]
                        shard = _Shard(files, folder, f"{prefix}-{part:06d}-{rolled:04d}.warc.gz", part)
                    data = bytes(payload)
                    shard.add(name, _record(name, urls[i], None if to is not None else data, digest, len(data), None if to is None else str(to)))
            if shard is not None:
                made.append(shard.commit())
                shard = None
        finally:
            if shard is not None:
                shard.abort()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "part", "records", "bytes", "sha256", "first_key", "last_key"), m)) for m in made], schema=_arrow(MANIFEST))

    return run


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def shard_bounds(thin: DataFrame, shards: int | None = None) -> list[tuple[int | None, str]]:
    """The first (key, digest) of every shard, in order, from (key, digest, length).

    The driver gets one row a shard, 100,000 for 100 TB.
    """
    groups = thin.groupBy("key", "digest").agg(F.sum(F.col("length") + HEADERS).alias("bytes"))
    # Where these ranges end does not matter: the sums over them are exact.
    ranges = materialize(groups.repartitionByRange("key", "digest").withColumn("range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("range").agg(F.sum("bytes").alias("bytes"))
    # One row a range.
    starts = sums.select("range", F.expr("coalesce(sum(bytes) over (order by range rows between unbounded preceding and 1 preceding), 0) as start"), F.expr("sum(bytes) over () as total"))
    cut = F.ceil(F.col("total") / shards) if shards else F.least(F.greatest(F.ceil(F.col("total") / 256), F.lit(LEAST_SHARD)), F.lit(MOST_SHARD))
    inside = "coalesce(sum(bytes) over (partition by range order by key, digest rows between unbounded preceding and 1 preceding), 0)"
    placed = ranges.withColumn("inside", F.expr(inside)).join(F.broadcast(starts), "range").select("key", "digest", F.floor((F.col("start") + F.col("inside")) / cut).alias("shard"))
    found = placed.groupBy("shard").agg(F.min(F.struct("key", "digest")).alias("first")).select("shard", "first.*").collect()
    return [(r.key, r.digest) for r in sorted(found, key=lambda r: r.shard)]


def _shard_of(bounds: list[tuple[int | None, str]]) -> Column:
    """The shard of each (key, digest); a null key comes before all others."""
    low = -(2**63)
    order = [(low if key is None else key, key is not None, digest) for key, digest in bounds]
    keys = np.array([b[0] for b in order], dtype=np.int64)

    def place(key: pd.Series, absent: pd.Series, digest: pd.Series) -> pd.Series:
        at = np.searchsorted(keys, key, side="right") - 1
        # Where bounds share the key, the digest decides.
        for i in np.flatnonzero(np.searchsorted(keys, key, side="left") <= at):
            at[i] = bisect.bisect_right(order, (int(key[i]), not absent[i], digest[i])) - 1
        return pd.Series(np.maximum(at, 0).astype(np.int32))

    return F.pandas_udf(place, "int")(F.coalesce("key", F.lit(low)), F.col("key").isNull(), F.col("digest"))


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", revisit_bytes: int = REVISIT_BYTES, roll_bytes: int = ROLL_BYTES, shards: int | None = None, prefix: str = "part") -> DataFrame:
    """Write every row of ``pages`` below ``folder`` and return the committed manifest.

    Payloads are shuffled once. Shards, and what revisits what, are found on a
    thin table of digests, and the decisions (one row a revisit) are sorted in
    among the pages. ``shards``: about so many, of equal bytes.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    thin = materialize(rows.select("key", "digest", F.octet_length("payload").cast("long").alias("length")), "digests")
    bounds = shard_bounds(thin, shards)
    long = thin.where(F.col("length") >= revisit_bytes)
    shared = long.groupBy("digest").agg(F.count("*").alias("n"), F.max("key").alias("refers")).where("n > 1").select("digest", "refers")
    decisions = long.select("key", "digest").distinct().join(shared, "digest").where("refers is not null")
    both = rows.select("key", "digest", F.lit(True).alias("page"), F.lit(None).cast("long").alias("refers"), "url", "payload").unionByName(
        decisions.select("key", "digest", F.lit(False).alias("page"), "refers", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    )
    dealt = both.withColumn("part", _shard_of(bounds)).repartitionById(max(1, len(bounds)), "part")
    ordered = dealt.sortWithinPartitions("part", "key", "digest", "page", "url")
    files, place = fs.FileSystem.from_uri(folder)
    files.create_dir(f"{place}/_temporary")
    made = ordered.select("key", "digest", "page", "part", "refers", "url", "payload").mapInArrow(_writer(folder, prefix, roll_bytes), MANIFEST)
    made.write.parquet(f"{folder}/manifest")
    files.delete_dir(f"{place}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzipped WARC stream; a broken record raises ValueError."""
    data = gzip.GzipFile(fileobj=stream)
    while True:
        version = data.readline()
        if not version:
            return
        if version.rstrip() != b"WARC/1.1":
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        head = {}
        while (line := data.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = data.read(size)
        if len(block) != size or data.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record is cut short")
        yield head, block


def _reader(folder_uri: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(folder_uri)
        schema = _arrow(READ)
        for batch in batches:
            for name, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                with files.open_input_stream(f"{folder}/{name}") as raw:
                    for head, block in records(io.BufferedReader(raw, 1 << 20) if not isinstance(raw, io.IOBase) else raw):
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        revisit = head["warc-type"] == "revisit"
                        if not revisit and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{name}: the payload of {head['warc-record-id']} does not match its digest")
                        key, to = head["warc-page-key"], head.get("warc-refers-to-key")
                        rows.append({
                            "file": name, "page_id": int(key) if key else None, "url": unquote(head["warc-target-uri"]) if head["warc-has-uri"] == "1" else None, "record_type": head["warc-type"], "refers_to": int(to) if to else None,
                            "payload_digest": digest, "payload_bytes": int(head["warc-payload-length"]) if revisit else len(body), "payload": None if revisit or not with_payload else body,
                        })
                        whole -= 1
                        held += len(body)
                        if held > 8_000_000 or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if whole:
                    raise ValueError(f"{name}: the manifest has {whole} records more")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest names; digests and counts are verified."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "records")
    n = max(1, manifest.count())
    return manifest.repartition(n).mapInArrow(_reader(folder, with_payload), READ)
