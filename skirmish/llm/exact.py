"""Exact deduplication by two passes of a Bloom filter: only rows whose hash may repeat are shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import Scratch, lower_ascii

#: Bits of one segment of the filter, cells that a hash sets in its segment, and cells for each row.
SEGMENT_BITS, PROBES, BITS_PER_ROW = 1 << 15, 3, 16
#: The filter's size is bounded, since it is broadcast. With more rows than it suits, more unique rows are shuffled; results stay exact.
MOST_SEGMENTS = 1 << 16
#: Hashes that a task gathers before it emits their cells.
FLUSH = 1 << 20
#: A group with over this many rows, and over this share of all rows (so there are 2,048 at most), is sent to its rows instead of meeting them in a shuffle.
HOT_ROWS, HOT_SHARE = 10_000, 2048


def text_key(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))).cast("binary"), 256))


def segments_for(n_rows: int) -> int:
    return max(1, min(MOST_SEGMENTS, -(-n_rows * BITS_PER_ROW // SEGMENT_BITS)))


def cells_of(hashes: np.ndarray, segments: int) -> np.ndarray:
    """Cell numbers (segment * SEGMENT_BITS + bit) of 64-bit hashes, PROBES for each; equals the expressions in may_repeat."""
    h = hashes.view(np.uint64)
    base = ((h >> np.uint64(45)) % np.uint64(segments)).astype(np.int64) * SEGMENT_BITS
    return np.concatenate([base + ((h >> np.uint64(15 * k)) & np.uint64(SEGMENT_BITS - 1)).astype(np.int64) for k in range(PROBES)])


def repeated_cells(hashes: DataFrame, segments: int) -> DataFrame:
    """First pass: segment and its bits (array of 64-bit words) that two rows or more set; segments without any have no row.

    hashes: one column of longs. A task emits, for each segment, the cells that its rows set, each with a mark if it
    was set twice; a cell is repeated if any task marked it or two tasks set it. Tasks send two bytes a cell, no rows.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunk(held: list[np.ndarray]) -> pa.RecordBatch:
            cells, times = np.unique(cells_of(np.concatenate(held), segments), return_counts=True)
            segment, first = np.unique(cells // SEGMENT_BITS, return_index=True)
            marked = ((cells % SEGMENT_BITS) | ((times > 1) << 15)).astype("<u2")
            parts = [x.tobytes() for x in np.split(marked, first[1:])]
            return pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array(parts, pa.binary())], ["segment", "cells"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            n += len(held[-1])
            if n >= FLUSH:
                yield chunk(held)
                held, n = [], 0
        if n:
            yield chunk(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One byte a cell: bit 0 set once, bit 1 set again. A task has its share of at most MOST_SEGMENTS segments.
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cells = np.frombuffer(part.as_buffer(), "<u2")
                held = seen.setdefault(segment, np.zeros(SEGMENT_BITS, np.uint8))
                at = cells & (SEGMENT_BITS - 1)
                held[at] |= (((held[at] & 1) | (cells >> 15)) << 1).astype(np.uint8) | np.uint8(1)
        for segment, held in seen.items():
            words = np.packbits(held >> 1, bitorder="little").view("<i8")
            if words.any():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([words.tolist()], pa.list_(pa.int64()))], ["segment", "bits"])

    return hashes.mapInArrow(emit, "segment int, cells binary").repartition("segment").mapInArrow(merge, "segment int, bits array<bigint>")


def may_repeat(rows: DataFrame, key: str, cells: DataFrame, segments: int, name: str) -> DataFrame:
    """Second pass: rows with a boolean column, false only where no other row has the key. cells is broadcast: at most MOST_SEGMENTS * SEGMENT_BITS / 8 bytes."""
    h = F.xxhash64(key)
    bits = cells.select(F.col("segment").alias("_segment"), F.col("bits").alias("_bits"))
    found = rows.join(F.broadcast(bits), (F.shiftrightunsigned(h, 45) % F.lit(segments)).cast("int") == F.col("_segment"), "left")
    maybe = F.col("_bits").isNotNull()
    for k in range(PROBES):
        bit = F.shiftrightunsigned(h, 15 * k).bitwiseAND(F.lit(SEGMENT_BITS - 1)).cast("int")
        word = F.get("_bits", F.shiftright(bit, 6))
        maybe = maybe & (F.getbit(word, bit.bitwiseAND(F.lit(63))) == 1)
    return found.withColumn(name, F.coalesce(maybe, F.lit(False))).drop("_segment", "_bits")


def classes(docs: DataFrame) -> DataFrame:
    """Each row of docs with its class of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    docs: doc_id, text; other columns are ignored, whatever their names. Texts are equal when identical after
    lower-casing A-Z (by SHA-256 of their UTF-8); null counts as empty. Of a class the row with the largest doc_id stays:
    keep_id. Null doc_ids are smaller than all others; keep_id is null where a class has no other. Of repeated rows (equal
    doc_id and text) exactly one is kept. Whole texts of any length are hashed where they are read; only their keys are
    staged. Empty table: no rows.

    Rows whose key cannot repeat, by the filter, go straight to the result. Of the others, classes are counted with
    partial sums; each large class is sent to its rows, whose number a shuffle would bring to one task; the rest are joined.
    """
    scratch = Scratch()
    keys = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_key(docs["text"]).alias("sha"), F.monotonically_increasing_id().alias("row"))
    keys = scratch.staged(keys, "exact-keys")
    n = keys.count()
    segments = segments_for(n)
    cells = scratch.staged(repeated_cells(keys.select(F.xxhash64("sha").alias("h")), segments), "exact-cells")
    marked = may_repeat(keys, "sha", cells, segments, "maybe")
    groups = marked.filter("maybe").groupBy("sha").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("stays"))
    groups = scratch.staged(groups.filter("group_size > 1"), "exact-groups")

    hot = groups.filter(F.col("group_size") > max(HOT_ROWS, n // HOT_SHARE))
    seen = marked.join(F.broadcast(hot), "sha", "left")
    alone = seen.filter(~F.col("maybe") | F.col("group_size").isNotNull())
    rest = seen.filter(F.col("maybe") & F.col("group_size").isNull()).drop("group_size", "stays").join(groups.filter(F.col("group_size") <= max(HOT_ROWS, n // HOT_SHARE)), "sha", "left")
    one = F.col("group_size").isNull()
    return alone.unionByName(rest).select(
        "doc_id",
        F.when(one, F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (one | (F.col("row") == F.col("stays.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns: one of each class of equal texts, that with the largest doc_id.

    Rows that cannot repeat are passed on as they are read. The others meet by key in a maximum, with partial results, so
    a class of any size is no burden to one task. Among rows equal in doc_id and text, that whose columns hash highest
    stays. Null doc_ids are smallest. Columns of any name are carried. Empty table: no rows.
    """
    scratch = Scratch()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), docs["doc_id"].cast("long").alias("id"), text_key(docs["text"]).alias("sha"))
    hashes = scratch.staged(rows.select(F.xxhash64("sha").alias("h")), "exact-hashes")
    segments = segments_for(hashes.count())
    cells = scratch.staged(repeated_cells(hashes, segments), "exact-cells")
    scratch.clear(cells)
    marked = may_repeat(rows, "sha", cells, segments, "maybe")
    best = marked.filter("maybe").groupBy("sha").agg(F.max_by("doc", F.struct("id", F.xxhash64("doc"))).alias("doc"))
    return marked.filter(~F.col("maybe")).select("doc.*").union(best.select("doc.*"))
