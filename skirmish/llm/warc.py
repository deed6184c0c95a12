"""A deterministic, sharded WARC writer and its reader."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.llm.common import Scratch, staged

#: Compressed size at which a file is closed, payload bytes of a shard, and the least payload that is stored once.
ROLL_BYTES, SHARD_BYTES, LEAST_DUPLICATE = 32 << 20, 64 << 20, 100
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
MANIFEST = "file string, records long, bytes long, sha256 string, first_page long, last_page long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def order_key(page_id: Column, digest: Column) -> Column:
    """A string that sorts as page_id (null first), then digest."""
    number = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(page_id.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), number)), digest)


def classify(pages: DataFrame, least: int = LEAST_DUPLICATE) -> DataFrame:
    """page_id, digest, refers_to of the pages whose payload of at least `least` bytes another page with a smaller page_id has."""
    pages = pages.filter(F.col("bytes") >= least).select("page_id", "digest")
    firsts = pages.groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return pages.join(firsts, F.col("digest") == F.col("d")).filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def splitters(pages: DataFrame, shard_bytes: int) -> list[str]:
    """The first key of each shard but the first: pages in order are cut wherever their summed bytes pass a multiple of shard_bytes.

    The sums are exact, so the cuts depend on the rows alone, not on partitions. One key a shard comes to the driver.
    """
    scratch = Scratch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, pid = 0, TaskContext.get().partitionId()
        for batch in batches:
            size = batch.column(1).to_numpy()
            upto = total + np.cumsum(size)
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(upto - size, pa.int64()), pa.array(size, pa.int64()), pa.array(np.full(len(size), pid), pa.int32())], ["key", "before", "bytes", "pid"])

    keys = pages.select(order_key(F.col("page_id"), F.col("digest")).alias("key"), "bytes")
    keys = scratch.staged(keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "key string, before long, bytes long, pid int"), "warc-keys")
    ranges = sorted(keys.groupBy("pid").agg(F.sum("bytes").alias("bytes"), F.min("key").alias("key")).collect(), key=lambda r: r.key)
    offsets, total = [], 0
    for r in ranges:
        offsets.append((r.pid, total))
        total += r.bytes
    if total <= shard_bytes:
        scratch.clear()
        return []
    moved = keys.join(F.broadcast(keys.sparkSession.createDataFrame(offsets, "pid int, offset long")), "pid")
    shard = F.floor((F.col("offset") + F.col("before")) / shard_bytes).alias("shard")
    cuts = moved.groupBy(shard).agg(F.min("key").alias("key")).orderBy("shard").collect()
    scratch.clear()
    return [r.key for r in cuts[1:]]


def _uuid(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response or revisit record; equal arguments give equal bytes."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", _uuid(page_id, digest)), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is None:
        return _record("response", fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _uuid(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    return _record("revisit", fields, http)


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a record per page to folder (a URI that executors share) and return the manifest, one row a file.

    Records are range-sorted by page_id (null first), then digest and url, and cut into shards of about shard_bytes of payload
    by `splitters`; payloads are shuffled once, with the revisits' references beside them. A task writes one shard, and closes
    a file when its compressed size reaches roll_bytes. A file is written under a temporary name of the attempt and renamed
    when it is whole; names, headers, ids and digests depend on the rows alone, however they are partitioned, so an attempt
    that runs again renames equal bytes. Only files that the manifest lists, which is written last, count.

    Null html: an empty payload. Null url: a URN of the page_id. Null page_id: no page header; it never is referred to.
    Repeated rows with the smallest page_id of a payload are all responses. Empty table: no files. Other columns are ignored.
    """
    scratch = Scratch()
    payload = F.encode(F.coalesce(pages["html"].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    light = scratch.staged(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "warc-digests")
    cuts = splitters(light, shard_bytes)

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, "S81"), keys.to_numpy().astype("S81"), "right").astype(np.int32))

    key = order_key(F.col("page_id"), F.col("digest")).alias("key")
    marks = classify(light).select(key, F.lit(0).alias("kind"), "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to")
    records = rows.select(key, F.lit(1).alias("kind"), "page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"))
    placed = records.union(marks).withColumn("shard", shard("key") if cuts else F.lit(0))
    ordered = placed.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("key", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, seq, shard_no, mark = TaskContext.get(), 0, 0, (None, None)
        out: dict = {}

        def begin() -> None:
            name = f"part-{shard_no:06d}-{seq:05d}.warc.gz"
            temporary = f"{root}/.{name}.{task.taskAttemptId()}.tmp"
            out.update(name=name, temporary=temporary, stream=fs.open_output_stream(temporary, compression=None), sha=hashlib.sha256(), bytes=0, records=0, first=None, last=None)
            put(_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

        def put(data: bytes) -> None:
            out["stream"].write(data)
            out["sha"].update(data)
            out["bytes"] += len(data)

        def end() -> pa.RecordBatch:
            nonlocal seq
            out["stream"].close()
            fs.move(out["temporary"], f"{root}/{out['name']}")
            seq += 1
            row = {"file": [out["name"]], "records": [out["records"]], "bytes": [out["bytes"]], "sha256": [out["sha"].hexdigest()], "first_page": [out["first"]], "last_page": [out["last"]]}
            out.clear()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for i in range(batch.num_rows):
                shard_no, key, kind, page_id, url, payload, digest, refers_to = (batch.column(k)[i].as_py() for k in range(8))
                if kind == 0:  # the reference of the records with this key, which follow
                    mark = (key, refers_to)
                    continue
                if not out:
                    begin()
                put(page_record(page_id, url, payload, digest, mark[1] if mark[0] == key else None))
                out["records"] += 1
                out["first"] = page_id if out["records"] == 1 else out["first"]
                out["last"] = page_id
                if out["bytes"] >= roll_bytes:
                    yield end()
        if out:
            yield end()

    columns = ["shard", "key", "kind", "page_id", "url", "payload", "digest", "refers_to"]
    manifest = staged(ordered.select(*columns).mapInArrow(run, MANIFEST), "warc-manifest")
    scratch.clear()
    return manifest


def members(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("the last gzip member is cut off")
            piece = view[at : at + step]
            parts.append(z.decompress(piece))
            at += len(piece)
        at -= len(z.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> dict | None:
    """The row of a page's record (None for other records). A response's length and digest come from its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest differs in {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    row = {"page_id": number("X-Page-Id"), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number("X-Refers-To-Page")}
    if kind == "revisit":
        return row | {"payload": None, "payload_bytes": number("X-Payload-Length"), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")}
    payload = block.partition(b"\r\n\r\n")[2]
    digest = hashlib.sha256(payload).hexdigest()
    if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest}


def read(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The page records of the files in the manifest; block and payload digests are checked. A file is a row while it is read.

    Columns: RECORDS (no payload if payloads is False; a revisit's payload is null). A record whose digest differs or that is cut
    off raises ValueError. Files that the manifest doesn't list are left out. Empty manifest: no rows.
    """
    names = RECORDS.split(", ")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    wanted = [n.split() for n in names if payloads or not n.startswith("payload ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[dict] = []
                for member in members(data.as_py()):
                    if row := parse(member):
                        rows.append(row)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in wanted], [n for n, _ in wanted])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in wanted], [n for n, _ in wanted])

    schema = ", ".join(" ".join(x) for x in wanted)
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    committed = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(manifest.select("file"), "file", "left_semi")
    return committed.select("content").mapInArrow(run, schema)
