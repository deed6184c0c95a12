"""Harmonic packing of tokenised documents into sequences of fixed capacity.

A piece of s tokens is of class j = capacity // s, and a bin of class j takes exactly j pieces, so a
bin is filled by counting alone. Workers fill the bins of their own partition: no shuffle, no shared state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skirmish.llm.common import lean, text_slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Bytes of chunks whose ids a worker remembers (each counts ENTRY bytes more). Beyond, it keeps those of up to SHORT characters, which are the frequent ones.
CACHE_BYTES, SHORT, ENTRY = 320 << 20, 7, 150
#: Sequence ids: the partition's number above these bits, the worker's own count below.
LOCAL_BITS = 40

#: A blank that no non-blank follows, and the blanks at which a text is cut. What either takes for a blank may be more than
#: what the tokenizer does: then a text is cut at fewer places.
_OPEN_BLANK, _CUT = re.compile(r" (?=\s|$)"), re.compile(r" (?=\S)")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    A byte-level BPE starts a new pre-token at every blank that a non-blank follows, whatever stands
    before it. Texts are cut there, and the ids of a chunk are looked up once.
    """

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(names.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        self.widths[list(names.values())] = list(map(len, names))
        self.known: dict[str, bytes] = {}
        self.held, self.cache_bytes = 0, cache_bytes

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Parts of a text that are encoded apart: the first, and then each one's rest behind the blank that begins it."""
        if not _OPEN_BLANK.search(text):
            return text.split(" ")
        return _CUT.split(text)

    def learn(self, rests: list[str]) -> None:
        """Encode what follows a blank, joined to one text: a pre-token ends before each such blank."""
        for i in range(0, len(rests), 5000):
            some = rests[i : i + 5000]
            joined = " " + " ".join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            sizes = [len(c) + 1 for c in some] if joined.isascii() else [len(c.encode()) + 1 for c in some]
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(sizes)) + 1
            data, begin = ids.tobytes(), 0
            for c, end in zip(some, (4 * cuts).tolist(), strict=True):
                self.known[c] = data[begin:end]
                self.held += ENTRY + len(c) + end - begin
                begin = end

    def ids(self, texts: list[str]) -> list[bytes]:
        cut = [self.chunks(t) for t in texts]
        heads = [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([c[0] for c in cut], add_special_tokens=False)]
        wanted: set[str] = set()
        for chunks in cut:
            wanted.update(chunks[1:])
        new = wanted.difference(self.known)
        if self.held > self.cache_bytes:
            self.known = {c: x for c, x in self.known.items() if len(c) <= SHORT}
            self.held = sum(ENTRY + len(c) + len(x) for c, x in self.known.items())
            if 2 * self.held > self.cache_bytes:
                self.known, self.held = {}, 0
            new = wanted.difference(self.known)
        self.learn(list(new))
        get = self.known.__getitem__
        return [head + b"".join(map(get, chunks[1:])) for head, chunks in zip(heads, cut, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker; it keeps what it knows from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def dyadic(length: int, capacity: int) -> list[int]:
    """Cut a length into whole capacities and then falling powers of two."""
    whole, rest = divmod(length, capacity)
    out = [capacity] * whole
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def whole_pieces(length: int, capacity: int) -> list[int]:
    """Cut only what is longer than a sequence."""
    whole, rest = divmod(length, capacity)
    return [capacity] * whole + [rest] * (rest > 0)


class Bins:
    """The open bins of one worker: at most one of each class, each with fewer pieces than its class."""

    def __init__(self, capacity: int, first_id: int, cut: bool):
        self.capacity, self.next_id, self.cut = capacity, first_id, cut
        self.open: dict[int, list] = {}

    def close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for piece in pieces:
            yield (*piece, self.next_id, offset)
            offset += piece[2]
        self.next_id += 1

    def add(self, piece: tuple) -> Iterator[tuple]:
        j = self.capacity // piece[2]
        held = self.open.setdefault(j, [])
        held.append(piece)
        if len(held) == j:
            del self.open[j]
            yield from self.close(held)

    def rest(self) -> Iterator[tuple]:
        """What is left at the end. Powers of two fall into full sequences, then into sequences of a power of two."""
        if not self.cut:
            for j in sorted(self.open):
                yield from self.close(self.open[j])
            return
        left = [p for j in sorted(self.open) for p in self.open[j]]
        size = sum(p[2] for p in left)
        at = 0
        for room in dyadic(size, self.capacity):
            begin = at
            while room:
                room -= left[at][2]
                at += 1
            yield from self.close(left[begin:at])


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, cut: bool = True, cache_bytes: int = CACHE_BYTES, keep_cache: bool = True) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most `capacity` tokens.

    docs: doc_id, text; other columns are ignored, whatever their names. A document's tokens are its
    ids and then end_id. cut (capacity must be a power of two): the rest of a document beyond whole
    sequences is cut into powers of two, whose classes fill bins without padding; what a worker has
    left at its end fills whole sequences and then sequences of a power of two. cut=False: a rest is
    one piece, and a bin of class j may have up to capacity / (j + 1) tokens of padding.

    A worker remembers the ids of up to about cache_bytes of text chunks, from task to task if keep_cache, else it lets go of them
    and of the tokenizer at the end of each task: Python workers are reused by whatever runs next on the executor.

    Null or empty text: one piece with end_id alone. Null doc_id: packed, and stays null. Repeated
    rows are packed as often as they occur. Empty table: no rows. Long texts are encoded whole.
    Recomputed partitions give equal rows, as long as their input has the same order.
    """
    if cut and capacity & (capacity - 1):
        raise ValueError("cut needs a capacity that is a power of two")
    pieces_of = dyadic if cut else whole_pieces
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path) if keep_cache else Encoder(tokenizer_path, cache_bytes)
        bins = Bins(capacity, TaskContext.get().partitionId() << LOCAL_BITS, cut)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, length, ids, total, seq, offset = zip(*rows, strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((doc, start, length, ids, total, seq, offset), kinds, strict=True)], names)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in text_slices(texts.to_pylist(), 1 << 20):
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[a:b], encoder.ids([t or "" for t in texts[a:b].to_pylist()]), strict=True):
                    ids += tail
                    total, start = len(ids) // 4, 0
                    for n in pieces_of(total, capacity):
                        rows += bins.add((doc_id, start, n, ids[4 * start : 4 * (start + n)], total))
                        start += n
                if rows:
                    yield table(rows)
        if rows := list(bins.rest()):
            yield table(rows)

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInArrow(run if keep_cache else lean(run), SCHEMA)
