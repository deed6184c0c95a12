"""Periodic runs of words: branching tandem repeats from each text's suffix tree, merged into maximal runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import Words, mix64, text_slices

#: A run has at least LEAST words and COPIES periods. Every window of GRAM words in such a run occurs in it again.
LEAST, COPIES, GRAM = 24, 3, 8
#: Leaves of small children that are tested at a time.
CHUNK = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"


class SuffixTree:
    """The suffix tree of a sequence whose parts end in symbols that occur once: suffix array, and its internal nodes as intervals of equal prefixes.

    ranks[l] orders suffixes by their first 2**l symbols, equal ranks for equal ones; so the longest common
    prefix of any two suffixes is read off from the highest level down, without comparing symbols.
    """

    def __init__(self, t: np.ndarray):
        self.t, n = t, len(t)
        ordered = np.argsort(t, kind="stable")
        first = np.concatenate([[True], t[ordered][1:] != t[ordered][:-1]])
        rank = np.empty(n, np.int64)
        rank[ordered] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        self.ranks = [rank.astype(np.int32)]
        # Only suffixes that are still equal to another are sorted again: each has a symbol at the next place, since parts end in symbols of their own.
        size = np.bincount(rank, minlength=n)
        left, k = np.flatnonzero(size[rank] > 1), 1
        while len(left):
            mine, then = rank[left], rank[left + k]
            order = np.lexsort((then, mine))
            left, mine, then = left[order], mine[order], then[order]
            at = np.arange(len(left))
            group = np.concatenate([[True], mine[1:] != mine[:-1]])
            cell = group | np.concatenate([[True], then[1:] != then[:-1]])
            begin, own = np.maximum.accumulate(np.where(group, at, 0)), np.maximum.accumulate(np.where(cell, at, 0))
            rank[left] = mine + own - begin
            self.ranks.append(rank.astype(np.int32))
            alone = cell & np.concatenate([cell[1:], [True]])
            left, k = left[~alone], 2 * k
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of suffixes i and j (different ones)."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.ranks) - 1, -1, -1):
            same = self.ranks[level][i + out] == self.ranks[level][j + out]
            out += same.astype(np.int64) << level
        return out

    def nodes(self) -> tuple[np.ndarray, ...]:
        """(depth, first, last, children's first ranks, their ends, whose) of the internal nodes below the root, with children in order; whose: each child's node."""
        depth = np.concatenate([[0], self.common(self.order[:-1], self.order[1:])])
        n = len(depth)
        first, last = np.zeros(n, np.int64), np.full(n, n - 1, np.int64)
        stack = [0]
        values = depth.tolist()
        lows, highs = first.tolist(), last.tolist()
        for x in range(1, n):
            d = values[x]
            while values[stack[-1]] > d:
                highs[stack.pop()] = x - 1
            below = stack[-1]
            lows[x] = lows[below] if values[below] == d else below
            stack.append(x)
        # Borders of one node stand on the stack together and are closed by the same x.
        first, last = np.array(lows, np.int64), np.array(highs, np.int64)
        border = np.flatnonzero(depth > 0)
        border = border[np.lexsort((border, depth[border], first[border]))]
        begins = np.flatnonzero(np.concatenate([[True], (first[border][1:] != first[border][:-1]) | (depth[border][1:] != depth[border][:-1])])) if len(border) else np.zeros(0, np.int64)
        head = border[begins]
        starts = np.insert(border, begins, first[head])
        whose = np.repeat(np.arange(len(head)), np.diff(np.append(begins, len(border))) + 1)
        ends = np.append(starts[1:], 0)
        lasts = np.append(np.flatnonzero(whose[1:] != whose[:-1]), len(whose) - 1) if len(whose) else np.zeros(0, np.int64)
        ends[lasts] = last[head] + 1
        return depth[head], first[head], last[head], starts, ends, whose

    def branching(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, period) of tandem repeats whose next symbol differs from the one a period before, by testing the leaves of all children of a node but its largest.

        A leaf i of a node of depth d begins such a repeat if i + d is a leaf of another child, and ends its first
        half if i - d is. Each leaf is in a small child at most log2(n) times.
        """
        depth, first, last, starts, ends, whose = self.nodes()
        if not len(depth):
            return
        sizes = ends - starts
        heads = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        largest = np.flatnonzero(sizes == np.maximum.reduceat(sizes, heads)[whose])
        largest = largest[np.unique(whose[largest], return_index=True)[1]]
        small = np.ones(len(sizes), bool)
        small[largest] = False
        small = np.flatnonzero(small)
        upto = np.concatenate([[0], np.cumsum(sizes[small])])
        n, t, rank = len(self.t), self.t, self.rank
        for low in range(0, int(upto[-1]), CHUNK):
            at = np.arange(low, min(low + CHUNK, int(upto[-1])))
            child = np.searchsorted(upto, at, "right") - 1
            leaf = self.order[starts[small[child]] + at - upto[child]]
            node = whose[small[child]]
            d, a, b = depth[node], first[node], last[node]
            for start in (leaf, leaf - d):
                other = leaf + d if start is leaf else start
                ok = np.flatnonzero((other >= 0) & (other < n))
                where = rank[other[ok]]
                ok = ok[(where >= a[ok]) & (where <= b[ok])]
                s, q = start[ok], d[ok]
                apart = t[s + q] != t[s + 2 * q]
                yield s[apart], q[apart]


def maximal_runs(t: np.ndarray, least: int = LEAST, copies: int = COPIES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of a sequence whose parts end in symbols that occur once, by start, then period.

    A maximal run of period q ends where a branching repeat of period q does. The other repeats of the run are its left
    rotations, and how far these go is found by bisection over common prefixes. Runs equal in extent are merged to the least period.
    """
    tree = SuffixTree(t)
    found = [x for x in tree.branching() if len(x[0])]
    if not found:
        return []
    start, period = (np.concatenate(x) for x in zip(*found, strict=True))
    end = start + 2 * period
    begin = end - np.maximum(least, copies * period)
    fits = begin >= 0
    begin, end, period = begin[fits], end[fits], period[fits]
    end, period = np.unique(np.stack([end, period]), axis=1) if len(end) else (end, period)
    begin = end - np.maximum(least, copies * period)
    long = tree.common(begin, begin + period) >= end - period - begin
    begin, end, period = begin[long], end[long], period[long]
    # The lowest start from which the period holds up to the end.
    low, high = np.full(len(begin), -1, np.int64), begin.copy()
    while (high - low > 1).any():
        middle = np.where(high - low > 1, (low + high) // 2, high)
        holds = tree.common(middle, middle + period) >= end - period - middle
        high, low = np.where(holds, middle, high), np.where(holds, low, middle)
    order = np.lexsort((period, end, high))
    high, end, period = high[order], end[order], period[order]
    new = np.concatenate([[True], (high[1:] != high[:-1]) | (end[1:] != end[:-1])]) if len(high) else np.zeros(0, bool)
    runs = sorted(zip(high[new].tolist(), (end - high)[new].tolist(), period[new].tolist(), strict=True), key=lambda r: (r[0], r[2]))
    return runs


def stretches(words: Words, gram: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of the stretches of at least `least` words that windows of `gram` words cover which occur twice in their text."""
    n = len(words.starts)
    h, at = words.grams(gram)
    if not len(h):
        return at, at
    key = mix64(h ^ mix64(words.doc[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + gram, -1)
    inside = np.cumsum(change)[:n] > 0
    cuts = np.flatnonzero(np.concatenate([[True], (inside[1:] != inside[:-1]) | (words.doc[1:] != words.doc[:-1]), [True]]))
    first, end = cuts[:-1], cuts[1:]
    good = inside[first] & (end - first >= least)
    return first[good], end[good]


def runs_of(texts: list[str | None], least: int = LEAST, copies: int = COPIES) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(number of words, runs, text without what runs repeat) of each text.

    Only stretches of windows that recur in their text can hold a run; they become the parts of one sequence of whole
    numbers (equal words, equal numbers) for one tree, each ending in a number of its own.
    """
    words = Words(texts, lower=False)
    base = np.concatenate([[0], np.cumsum(words.counts)])
    # A window recurs in its run if the run has two periods and a window's length.
    gram = min(GRAM, max(1, least // copies))
    first, end = stretches(words, gram, least)
    all_words = words.data.tobytes().split() if len(first) else []
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(first):
        ids: dict[bytes, int] = {}
        sizes = end - first + 1
        t = np.empty(int(sizes.sum()), np.int64)
        begin = np.cumsum(sizes) - sizes
        for k, (a, b, at) in enumerate(zip(first.tolist(), end.tolist(), begin.tolist(), strict=True)):
            t[at : at + b - a] = [ids.setdefault(w, len(ids)) for w in all_words[a:b]]
            t[at + b - a] = -1 - k
        for start, length, period in maximal_runs(t, least, copies):
            k = int(np.searchsorted(begin, start, "right")) - 1
            word = int(first[k]) + start - int(begin[k])
            doc = int(words.doc[word])
            found[doc].append((word - int(base[doc]), length, period))
    out = []
    for doc, runs in enumerate(found):
        a, b = int(words.begin[doc]), int(words.begin[doc] + words.sizes[doc])
        mine = words.data[a:b].tobytes().split()
        if runs:
            drop = np.zeros(len(mine) + 1, np.int64)
            for start, length, period in runs:
                drop[start + period] += 1
                drop[start + length] -= 1
            mine = [w for w, d in zip(mine, np.cumsum(drop).tolist(), strict=False) if not d]
        out.append((int(words.counts[doc]), runs, b" ".join(mine)))
    return out


def find(docs: DataFrame, least: int = LEAST, copies: int = COPIES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start, then period), collapsed (UTF-8: words that are in no run beyond its first period, joined by blanks).

    docs: doc_id, text; other columns are ignored, whatever their names. A run is a stretch of words with smallest period q (words
    q apart are equal), at least max(least, copies * q) words long, that no neighbouring word extends. Words are runs of
    anything but ASCII blanks, compared as they are. Null, blank and short texts: no runs; null doc_ids stay null. Each row is
    judged by itself, repeated rows as often as they occur; a text of any length is judged whole, in memory proportional
    to it. No shuffle. Empty table: no rows.
    """
    if least < 2 * copies or copies < 3:
        raise ValueError("runs need at least three copies and twice as many words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.binary()]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_slices(texts, 1 << 20):
                n, runs, kept = zip(*runs_of(texts[a:b], least, copies), strict=True)
                named = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in runs]
                columns = [ids.slice(a, b - a), *(pa.array(x, kind) for x, kind in zip((n, named, kept), kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)
