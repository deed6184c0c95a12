"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII blanks; bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a fresh folder in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skirmish-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """The staged tables of one job, so that those that nothing reads any more can go."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def add(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        return self.add(staged(df, name))

    def clear(self, *still_read: DataFrame) -> None:
        for table in self.tables:
            if not any(table is x for x in still_read):
                drop_staged(table)
        self.tables = [x for x in self.tables if any(x is y for y in still_read)]


def give_back() -> None:
    """Return memory that is free in this Python worker to the system: Spark reuses workers, and what an idle one holds counts against its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other allocators return memory by themselves
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow or mapInPandas that gives its memory back when its task ends."""

    def held(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return held


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first().n or 0


def in_blocks(docs: DataFrame, key: str, target_bytes: int, least: int = 1) -> tuple[DataFrame, int]:
    """docs with a column `block`: rows hashed (by key and text, so null keys spread) into blocks of about target_bytes of text, and the number of blocks."""
    n = max(least, -(-text_bytes(docs) // target_bytes))
    return docs.withColumn("block", F.pmod(F.xxhash64(key, "text"), F.lit(n)).cast("int")), n


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over a uint64 array."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


_SPREAD = mix64(np.arange(1, 257, dtype=np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]] (uint8 data), from one prefix sum modulo 2**64.

    Equal spans have equal hashes wherever they stand; the length is mixed in.
    """
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SPREAD[data] * up[: len(data)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX2)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of a batch of texts as arrays: data (one uint8 array), starts, ends, doc (index of each word's text)."""

    def __init__(self, texts: list[str | None], lower: bool):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        joined = b" ".join(raw)
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes + 1)])[: len(raw)].astype(np.int64)
        word = np.concatenate([[False], ~_BLANK[self.data], [False]])
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.doc = np.searchsorted(self.begin, self.starts, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(raw)).astype(np.int64) if len(raw) else np.zeros(0, np.int64)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each window of n words within one text."""
        h = self.hashes()
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[: len(h) - n + 1] == self.doc[n - 1 :])
        total = np.zeros(len(at), np.uint64)
        for k in range(n):
            total = (total + h[at + k]) * _BASE
        return mix64(total), at


def slices(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Cut a batch into runs of rows with about `most` bytes of text each; a longer single row is a run of its own."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        out.append((begin, len(sizes)))
    return out


def text_slices(texts: list[str | None], most: int = 2 << 20) -> list[tuple[int, int]]:
    return slices(np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts)), most)
