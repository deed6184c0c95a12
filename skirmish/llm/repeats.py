"""Exact repeats of byte strings by a sparse suffix array.

Of every window of LENGTH bytes one position, chosen by the window's content alone, is its anchor: the start of the
smallest hashed gram of GRAM bytes in it. Equal windows have equal grams at equal places, so only suffixes that start at anchors have to be
compared, and only those whose gram occurs again. They are range-partitioned by their leading bytes, sorted in their bucket by
multikey quicksort, and equal windows are read off the sorted order of the suffixes and of the text before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import _SPREAD, MIX1, MIX2, _powers, in_blocks, mix64, staged, text_slices
from skirmish.llm.similarity import _grouped, _parts

LENGTH, GRAM = 200, 100
#: Places of an anchor in a window.
PLACES = LENGTH - GRAM + 1
#: Text of a block, window positions worked on at once, and contexts of a bucket.
BLOCK_BYTES, CHUNK, BUCKET = 8 << 20, 1 << 20, 1 << 15
#: Parts of the contexts of a common window.
SALTS = 64
_POSITION = np.uint64((1 << 24) - 1)


class Anchors:
    """The anchors of a batch of texts: for each run of windows with one anchor, the anchor's position `at`, the first and last
    window's start, the gram's hash h and the hash g of all bytes that the windows cover. A text has the same runs in any batch."""

    def __init__(self, texts: list[str | None]):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        n = len(self.data)
        change = np.zeros(n + 1, np.int8)  # +1 where a text's windows begin, -1 after its last
        long = self.sizes >= LENGTH
        change[self.begin[long]] += 1
        change[(self.begin + self.sizes - LENGTH + 1)[long]] -= 1
        valid = np.cumsum(change[:n], dtype=np.int8) > 0
        parts = [self._chunk(valid, a, min(a + CHUNK, n)) for a in range(0, n, CHUNK)]
        self.at, self.first, self.last, self.h, self.g = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(5))

    def _chunk(self, valid: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...]:
        """Runs of windows that begin in a..b, whole: a run has PLACES windows at most, and one that began before a is not taken."""
        begin, end = a, b
        a, b = max(a - 1, 0), min(b + PLACES, len(self.data))
        data = self.data[a : b + LENGTH]
        up, down = _powers(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_SPREAD[data] * up[: len(data)], out=prefix[1:])
        grams = len(data) - GRAM + 1
        if grams < PLACES:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        h = mix64((prefix[GRAM:] - prefix[:-GRAM]) * down[:grams])
        low = (h & ~_POSITION) | np.arange(grams, dtype=np.uint64)
        width = 1
        while 2 * width <= PLACES:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        rest = PLACES - width
        low = np.minimum(low[:-rest], low[rest:]) if rest else low
        n = min(b - a, len(low))
        anchor, on = (low[:n] & _POSITION).astype(np.int64), valid[a : a + n]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (on[1:] != on[:-1]))
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        keep = on[first] & (first >= begin - a) & (first < end - a)
        first, last = first[keep], last[keep]
        at = anchor[first]
        size = (last + LENGTH - first).astype(np.uint64)
        g = mix64((prefix[last + LENGTH] - prefix[first]) * down[first] + size * MIX2 + (at - first).astype(np.uint64) * MIX1)
        return at + a, first + a, last + a, h[at], g


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a uint8 matrix, and how many leading bytes each has in common with the one before.

    Multikey quicksort with words of eight bytes as keys: rows are sorted by a word, and runs of equal ones by the next.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order, run = np.arange(n), np.zeros(n, np.int64)
    for w in range(words.shape[1]):
        size = np.bincount(run, minlength=n)
        active = np.flatnonzero(size[run] > 1)
        if not len(active):
            break
        key = words[order[active], w]
        by = np.lexsort((key, run[active]))
        order[active] = order[active][by]
        key = key[by]
        split = np.zeros(n, bool)
        split[active[1:]] = (key[1:] != key[:-1]) & (run[active][1:] == run[active][:-1])
        run = np.cumsum(split | np.append(False, run[1:] != run[:-1]))
    common = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 14):
        b = min(a + (1 << 14), n)
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        common[a:b] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def repeated_windows(contexts: list[bytes], offset: np.ndarray) -> np.ndarray:
    """For each context (the bytes that the windows of an anchor cover; offset: the anchor in it) and each number d of bytes before
    the anchor: whether another context has the window that begins there. Boolean, contexts x PLACES."""
    n = len(contexts)
    size = np.fromiter(map(len, contexts), np.int64, n)
    after, before = np.zeros((n, LENGTH), np.uint8), np.zeros((n, PLACES - 1), np.uint8)
    for i, (c, o) in enumerate(zip(contexts, offset.tolist(), strict=True)):
        after[i, : size[i] - o] = np.frombuffer(c, np.uint8, offset=o)
        before[i, :o] = np.frombuffer(c, np.uint8, count=o)[::-1]
    ranks = [(order, common) for order, common in map(multikey_sort, (after, before))]
    least = np.maximum(LENGTH - (size - offset), 0)  # fewest bytes before the anchor that a window of this context has
    out = np.zeros((n, PLACES), bool)
    classes = np.zeros((2, n), np.int64)
    for d in range(PLACES):
        rows = np.flatnonzero((offset >= d) & (least <= d))
        if len(rows) < 2:
            continue
        for k, need in enumerate((LENGTH - d, d)):
            order, common = ranks[k]
            classes[k, order] = np.cumsum(common < need)
        _, which, times = np.unique(classes[0, rows] * (n + 1) + classes[1, rows], return_inverse=True, return_counts=True)
        out[rows, d] = times[which] > 1
    return out


def _live(t: pa.Table) -> pa.Table:
    """Rows whose gram occurs again; full: the whole context does; several: the gram has other contexts."""
    h, g, times = (t[c].to_numpy() for c in ("h", "g", "times"))
    order = np.lexsort((g, h))
    new_h = np.append(True, h[order][1:] != h[order][:-1])
    new_g = new_h | np.append(True, g[order][1:] != g[order][:-1])
    of_h, of_g = np.cumsum(new_h) - 1, np.cumsum(new_g) - 1
    total_h, total_g = np.bincount(of_h, weights=times[order]), np.bincount(of_g, weights=times[order])
    kinds = np.bincount(of_h, weights=new_g)
    live = total_h[of_h] > 1
    t = t.take(order[live]).select(["block", "h", "g"])
    return t.append_column("full", pa.array((total_g[of_g] > 1)[live])).append_column("several", pa.array((kinds[of_h] > 1)[live]))


def crowded_bits(contexts: DataFrame) -> DataFrame:
    """h, g, bits of repeated_windows for contexts h, g, offset, context of common grams: windows are compared by MD5.

    Windows are counted with partial sums, and their counts are dealt back by SALTS, so no task holds a gram or a window's contexts.
    """
    salt = F.pmod(F.xxhash64("g"), F.lit(SALTS)).cast("int")
    least = F.greatest(F.lit(0), F.lit(LENGTH) - (F.octet_length("context") - F.col("offset")))
    windows = contexts.select("h", "g", "offset", "context", F.explode(F.sequence(least, F.col("offset"))).alias("d"))
    windows = windows.select("h", "g", "d", salt.alias("salt"), F.unhex(F.md5(F.expr(f"substring(context, offset - d + 1, {LENGTH})"))).alias("window"))
    twice = windows.groupBy("h", "d", "window").count().filter("count > 1").select("h", "d", "window", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of = windows.join(twice, ["h", "d", "window", "salt"]).groupBy("h", "g").agg(F.collect_set("d").alias("ds"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.zeros((b.num_rows, PLACES), bool)
            for i, d in enumerate(b.column(2).to_pylist()):
                bits[i, d] = True
            packed = pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), packed], ["h", "g", "bits"])

    return of.mapInArrow(pack, "h long, g long, bits binary")


def find(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: the bytes that repeated strings cover, in order), kept (the other bytes).

    docs: doc_id, text; other columns are ignored. A byte goes if a string of LENGTH bytes of UTF-8 that covers it starts
    anywhere else too, in any text or the same one, overlapping or not. Strings don't cross texts.

    Null or empty text, or one under LENGTH bytes: no spans. Null doc_id stays null; repeated rows are each other's copies.
    Empty table: no rows. Texts of any length are cut into chunks of windows. Grams and whole contexts are compared by two
    64-bit hashes; contexts that differ somewhere are compared byte by byte, or by MD5 where a gram has over BUCKET of them.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    blocked, _ = in_blocks(plain, "doc_id", block_bytes)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, block = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a, b in text_slices(col):
                x = Anchors(col[a:b])
                home = block[a:b][np.searchsorted(x.begin + x.sizes, x.at, "right")] if len(x.at) else np.zeros(0, np.int32)
                order = np.lexsort((home, x.g, x.h))
                h, g, home = x.h[order], x.g[order], home[order]
                new = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (home[1:] != home[:-1])) if len(h) else np.zeros(0, bool)
                times = np.diff(np.append(np.flatnonzero(new), len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(g[new].view(np.int64)), pa.array(home[new], pa.int32()), pa.array(times.astype(np.int32))], ["h", "g", "block", "times"])

    found = blocked.select("text", "block").mapInArrow(grams, "h long, g long, block int, times int")
    n_bytes = blocked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    live = staged(_grouped(found, _parts(found, 2 * n_bytes // PLACES), "h", "block int, h long, g long, full boolean, several boolean", _live), "repeats-live")

    def contexts(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        x = {"h": [], "g": [], "offset": [], "context": []}
        todo = set(wanted["g"].to_numpy().view(np.uint64).tolist())
        col = texts["text"].to_pylist()
        for a, b in text_slices(col) if todo else []:
            s = Anchors(col[a:b])
            for i in np.flatnonzero(np.isin(s.g, np.fromiter(todo, np.uint64, len(todo)))).tolist():
                if (g := int(s.g[i])) in todo:
                    todo.remove(g)
                    x["h"].append(s.h[i])
                    x["g"].append(s.g[i])
                    x["offset"].append(s.at[i] - s.first[i])
                    x["context"].append(s.data[s.first[i] : s.last[i] + LENGTH].tobytes())
        if todo:
            raise RuntimeError(f"{len(todo)} contexts of a block are not in its texts")
        as_long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        return pa.table({"h": as_long(x["h"]), "g": as_long(x["g"]), "offset": pa.array(np.array(x["offset"], np.int32)), "context": pa.array(x["context"], pa.binary())})

    several = live.filter("several")
    mixed = blocked.groupBy("block").cogroup(several.select("block", "g").groupBy("block")).applyInArrow(contexts, "h long, g long, offset int, context binary")
    mixed = staged(mixed, "repeats-contexts")

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            # One block in which a context occurs is enough.
            _, one = np.unique(np.stack([t["h"].to_numpy(), t["g"].to_numpy()], 1), axis=0, return_index=True)
            t = t.take(one)
            bits = np.packbits(repeated_windows(t["context"].to_pylist(), t["offset"].to_numpy().astype(np.int64)), axis=1)
            yield from pa.table({"h": t["h"], "g": t["g"], "bits": pa.array([x.tobytes() for x in bits], pa.binary())}).to_batches()

    # Contexts of a gram that has more than a bucket of them have equal leading bytes: they are judged window by window instead.
    mixed = staged(mixed.dropDuplicates(["h", "g"]), "repeats-distinct")
    hot = staged(mixed.groupBy("h").count().filter(F.col("count") > BUCKET).select("h"), "repeats-hot")
    crowded = mixed.join(hot, "h", "left_semi")
    mixed = mixed.join(hot, "h", "left_anti")
    n = mixed.count()
    ranged = mixed.withColumn("leading", F.expr(f"substring(context, offset + 1, {GRAM})")).repartitionByRange(max(1, -(-n // BUCKET)), "leading")
    judged = staged(ranged.select("h", "g", "offset", "context").mapInArrow(buckets, "h long, g long, bits binary").unionByName(crowded_bits(crowded)), "repeats-judged")

    # A context that occurs twice is repeated as a whole; of the others, what its bucket says.
    partly = several.filter("not full").join(judged, ["h", "g"]).select("block", "h", "g", "bits")
    marks = live.filter("full").select("block", "h", "g", F.lit(None).cast("binary").alias("bits")).union(partly)

    def cut(texts: pa.Table, known: pa.Table) -> pa.Table:
        key = lambda h, g: mix64(h ^ mix64(g))
        keys = key(known["h"].to_numpy().view(np.uint64), known["g"].to_numpy().view(np.uint64))
        order = np.argsort(keys, kind="stable")
        keys, bits = keys[order], known["bits"].take(pa.array(order)).to_pylist()
        sizes, spans, kept = [], [], []
        col = texts["text"].to_pylist()
        for a, b in text_slices(col):
            x = Anchors(col[a:b])
            n = len(x.data)
            starts = np.zeros(n + 1, np.int64)
            if len(keys):
                mine = key(x.h, x.g)
                at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                for i in np.flatnonzero(keys[at] == mine).tolist():
                    mask = bits[at[i]]
                    if mask is None:
                        starts[x.first[i] : x.last[i] + 1] = 1
                    else:
                        d = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), count=PLACES))
                        starts[x.at[i] - d] = 1
            upto = np.cumsum(starts)
            covered = (upto - np.concatenate([np.zeros(min(LENGTH, n + 1), np.int64), upto[: max(n + 1 - LENGTH, 0)]]))[:n] > 0
            for begin, size in zip(x.begin.tolist(), x.sizes.tolist(), strict=True):
                c = covered[begin : begin + size]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], c.view(np.int8), [0]])))
                sizes.append(size)
                spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                kept.append(x.data[begin : begin + size][~c].tobytes())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": texts["doc_id"], "n_bytes": pa.array(sizes, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    schema = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return blocked.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(cut, schema)
