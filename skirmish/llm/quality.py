"""Quality rules: counts over whole texts, and a linear-chain CRF that marks lines as content or boilerplate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import Words, lean, mix64, span_hashes, text_slices

#: Most labelled documents that a model is fitted to, lines in one training sequence (longer documents give several), and most sequences.
SAMPLE_DOCS, SAMPLE_LINES, SAMPLE_SEQUENCES = 2000, 32, 800
#: A document is kept if content lines hold at least this share of its words.
CONTENT_SHARE = 0.5
WINDOW = 8
SYMBOLS = b"#*$%&|<>"

_SYMBOL, _UPPER, _LOWER, _DIGIT, _CONT = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58], _CONT[128:192] = True, True, True, True

FEATURES = ("bias", "words<3", "words<6", "words>=12", "symbols>0.1", "symbols>0.5", "upper>0.6", "repeats>0.3", "repeats>0.6", "repeated line", "digits>0.3", "shouts", "first", "last")
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_words long"


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[ends] - upto[starts]


class Lines:
    """The \\n-split lines of a batch of texts: arrays over lines, with features of each."""

    def __init__(self, texts: list[str | None]):
        w = self.words = Words(texts, lower=False)
        n = len(texts)
        breaks = np.flatnonzero(w.data == 10)
        ends = w.begin + w.sizes
        own = np.searchsorted(w.begin, breaks, "right") - 1
        inside = breaks < ends[own] if n else np.zeros(0, bool)
        breaks, own = breaks[inside], own[inside]
        self.doc = np.concatenate([np.arange(n), own])
        starts = np.concatenate([w.begin, breaks + 1])
        order = np.argsort(starts, kind="stable")
        self.doc, self.starts = self.doc[order], starts[order]
        last = np.append(self.doc[1:] != self.doc[:-1], True) if n else np.zeros(0, bool)
        self.ends = np.where(last, ends[self.doc], np.append(self.starts[1:] - 1, 0)) if n else np.zeros(0, np.int64)
        self.of_word = np.searchsorted(self.starts, w.starts, "right") - 1
        self.n_words = np.bincount(self.of_word, minlength=len(self.starts))
        h = span_hashes(w.data, self.starts, self.ends) ^ mix64(self.doc.astype(np.uint64))
        real = np.flatnonzero(self.n_words > 0)
        by = real[np.argsort(h[real], kind="stable")]  # equal lines of a text stand together, the first one first
        same = np.zeros(len(h), bool)
        later = h[by][1:] == h[by][:-1]
        same[by[1:][later]] = True
        self.later = same  # equal to an earlier line
        self.repeated = same.copy()
        self.repeated[by[:-1][later]] = True

    def features(self) -> np.ndarray:
        w, n = self.words, np.maximum(self.n_words, 1)
        d, a, b = w.data, self.starts, self.ends
        upper, lower = _sums(_UPPER[d], a, b), _sums(_LOWER[d], a, b)
        symbols, digits, size = _sums(_SYMBOL[d], a, b), _sums(_DIGIT[d], a, b), np.maximum(b - a, 1)
        shouts = _sums(d == 33, a, b)
        key = mix64(self.of_word.astype(np.uint64)) ^ w.hashes()
        distinct = np.bincount(self.of_word[np.unique(key, return_index=True)[1]], minlength=len(a))
        repeats = 1 - distinct / n
        first = np.append(True, self.doc[1:] != self.doc[:-1]) if len(a) else np.zeros(0, bool)
        last = np.append(self.doc[1:] != self.doc[:-1], True) if len(a) else np.zeros(0, bool)
        columns = (np.ones(len(a), bool), n < 3, n < 6, n >= 12, symbols / n > 0.1, symbols / n > 0.5, upper > 0.6 * np.maximum(upper + lower, 1), (repeats > 0.3) & (n > 3), (repeats > 0.6) & (n > 3), self.repeated, digits / size > 0.3, shouts / n > 0.5, first, last)
        return np.stack(columns, 1).astype(np.float64)


@dataclass
class Chain:
    """A linear-chain CRF with two labels, 0 boilerplate and 1 content."""

    emit: np.ndarray  # features x 2
    step: np.ndarray  # 2 x 2

    @staticmethod
    def fit(x: list[np.ndarray], y: list[np.ndarray], rounds: int = 120, rate: float = 0.1, l2: float = 1e-3) -> Chain:
        """Adam on the conditional log-likelihood, with gradients from log-space forward and backward sums."""
        k, f = len(x), x[0].shape[1]
        longest = max(map(len, x))
        xs, ys, on = np.zeros((k, longest, f)), np.zeros((k, longest), int), np.zeros((k, longest), bool)
        for i, (a, b) in enumerate(zip(x, y, strict=True)):
            xs[i, : len(a)], ys[i, : len(b)], on[i, : len(a)] = a, b, True
        theta = np.zeros(2 * f + 4)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        total = on.sum()
        gold = np.stack([(ys == c) & on for c in (0, 1)], 2).astype(float)
        pairs = on[:, 1:] & on[:, :-1]
        gold_step = np.array([[(gold[:, :-1, a] * gold[:, 1:, b]).sum() for b in (0, 1)] for a in (0, 1)])
        for i in range(1, rounds + 1):
            emit, step = theta[: 2 * f].reshape(f, 2), theta[2 * f :].reshape(2, 2)
            score = xs @ emit
            fwd, bwd = np.zeros((k, longest, 2)), np.zeros((k, longest, 2))
            fwd[:, 0] = score[:, 0]
            for t in range(1, longest):
                nxt = np.logaddexp.reduce(fwd[:, t - 1, :, None] + step, axis=1) + score[:, t]
                fwd[:, t] = np.where(on[:, t, None], nxt, fwd[:, t - 1])
            for t in range(longest - 2, -1, -1):
                nxt = np.logaddexp.reduce(step + (score[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
                bwd[:, t] = np.where(on[:, t + 1, None], nxt, 0)
            z = np.logaddexp.reduce(fwd[:, -1], axis=1)
            node = np.exp(fwd + bwd - z[:, None, None]) * on[:, :, None]
            edge = np.exp(fwd[:, :-1, :, None] + step + (score[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
            grad = np.concatenate([np.einsum("ktf,ktc->fc", xs, gold - node).ravel(), (gold_step - edge.sum((0, 1))).ravel()]) / total - l2 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        return Chain(theta[: 2 * f].reshape(f, 2), theta[2 * f :].reshape(2, 2))

    def viterbi(self, features: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The best label of each line; doc (sorted) tells sequences apart. All sequences step together."""
        score = features @ self.emit
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, int)
        length = np.diff(np.append(begin, len(doc)))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        best, back = score.copy(), np.zeros((len(doc), 2), np.int8)
        for t in range(1, int(length[0]) if len(length) else 0):
            at = begin[: np.searchsorted(-length, -t, "left")] + t
            reach = best[at - 1][:, :, None] + self.step
            back[at] = reach.argmax(1)
            best[at] += reach.max(1)
        label = np.zeros(len(doc), np.int8)
        end = begin + length - 1
        if len(end):
            label[end] = best[end].argmax(1)
        for t in range(1, int(length[0]) if len(length) else 0):
            n = np.searchsorted(-length, -t, "left")
            at = end[:n] - t
            label[at] = back[at + 1, label[at + 1]]
        return label


def spliced(x: list[np.ndarray], good: list[int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sequences of about SAMPLE_LINES lines and their labels, from runs of lines of good documents and of others.

    Runs are cut into stretches of 1 to SAMPLE_LINES / 2 lines (lengths from a generator with a fixed seed). While both kinds last, a
    sequence takes stretches of the two in turn, the next sequence begins with the other kind; what is left of one kind follows
    in sequences of its own. Each line stands in one sequence. The features of first and last lines are those of the sequence.
    """
    rng = np.random.default_rng(0)
    parts: list[list[np.ndarray]] = [[], []]
    for a, g in zip(x, good, strict=True):
        cuts = np.cumsum(rng.integers(1, SAMPLE_LINES // 2 + 1, len(a)))
        parts[int(g)] += [p for p in np.split(a, cuts[cuts < len(a)]) if len(p)]
    for p in parts:
        p.reverse()
    made, labels, turn = [], [], 0
    while parts[0] or parts[1]:
        held, marks, kind, n = [], [], turn, 0
        while n < SAMPLE_LINES and (parts[0] or parts[1]):
            kind = kind if parts[kind] else 1 - kind
            held.append(parts[kind].pop())
            marks.append(np.full(len(held[-1]), kind))
            n, kind = n + len(held[-1]), 1 - kind
        lines = np.concatenate(held)
        lines[:, -2:] = 0
        lines[0, -2] = lines[-1, -1] = 1
        made.append(lines)
        labels.append(np.concatenate(marks))
        turn = 1 - turn
    return made, labels


def fit_lines(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sequences: int = SAMPLE_SEQUENCES) -> Chain:
    """A chain fitted to at most sample_docs labelled documents and `sequences` runs of SAMPLE_LINES of their lines, the first in
    the order of a hash.

    Training sequences alternate: stretches of lines of good documents and of others stand in turn in one sequence (see spliced), so
    that labels change within it and the step weights learn how long content and boilerplate last. A line's label is the quality,
    as judged by people, of the document it comes from (1 content, others boilerplate); it is no function of the line's features,
    and good lines of poor documents are noise that the good documents outweigh. Several labels of one
    document: the least counts. Repeated rows with one doc_id: their sequences each count. Labels or rows with null doc_id, null
    labels and null texts take no part; blank lines neither; long texts give several sequences. Without a labelled line (empty
    tables among them) the chain calls every line content. Sequences are fitted in one task, whose size the two bounds fix; only
    the chain's weights come to the driver.
    """
    judged = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = Lines(batch["text"].tolist())
            on = got.n_words > 0
            x, doc = got.features()[on].astype(np.float32), got.doc[on]
            within = np.arange(len(doc)) - np.searchsorted(doc, doc)
            begin = np.append(np.flatnonzero(within % SAMPLE_LINES == 0), len(doc))
            good = batch["quality"].to_numpy() == 1
            rows = [(int(batch["doc_id"].iloc[doc[a]]), int(within[a]), x[a:b].ravel(), int(good[doc[a]])) for a, b in zip(begin, begin[1:])]
            yield pd.DataFrame(rows, columns=["doc_id", "line", "x", "good"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pd.concat(held).sort_values(["doc_id", "line", "good"], kind="stable")
            x = [np.asarray(v, float).reshape(-1, len(FEATURES)) for v in rows["x"]]
            chain = Chain.fit(*spliced(x, rows["good"].tolist()))
            yield pd.DataFrame({"theta": [np.concatenate([chain.emit.ravel(), chain.step.ravel()])]})

    runs = texts.dropna().join(F.broadcast(some), "doc_id").mapInPandas(lean(lines), "doc_id long, line long, x array<float>, good int")
    runs = runs.orderBy(F.xxhash64("doc_id", "line"), "doc_id", "line", "x").limit(sequences)
    found = runs.repartition(1).mapInPandas(lean(fit), "theta array<double>").collect()
    if not found:
        emit = np.zeros((len(FEATURES), 2))
        emit[0, 1] = 1
        return Chain(emit, np.zeros((2, 2)))
    theta = np.array(found[0].theta)
    return Chain(theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2))


def measure(texts: list[str | None], chain: Chain) -> dict[str, np.ndarray]:
    """The counts of each text of a batch, in one pass of array operations."""
    lines = Lines(texts)
    w, n = lines.words, len(texts)
    ends = w.begin + w.sizes
    points = ~_CONT[w.data]
    h, at = w.grams(WINDOW)
    key = h ^ mix64(w.doc[at].astype(np.uint64) + np.uint64(1))
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(len(w.starts) + 1, np.int64)
    twice = at[times[which] > 1]
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + WINDOW, -1)
    repeat = np.cumsum(covered)[:-1] > 0
    count = lambda index, flags: np.bincount(index, weights=flags, minlength=n).astype(np.int64)
    label = chain.viterbi(lines.features(), lines.doc)
    n_repeat = count(w.doc, repeat)
    return {
        "n_words": w.counts,
        "word_chars": count(w.doc, _sums(points, w.starts, w.ends)),
        "n_symbols": _sums(_SYMBOL[w.data], w.begin, ends),
        "n_dup_lines": count(lines.doc, lines.later),
        "n_repeat_words": n_repeat,
        "base_failed": (w.counts < 20) | (100 * n_repeat > 30 * w.counts),
        "content_words": count(lines.doc, lines.n_words * (label == 1)),
    }


def judge(docs: DataFrame, chain: Chain, content_share: float = CONTENT_SHARE) -> DataFrame:
    """Counts, content_words and kept for each document.

    A document is kept unless it fails the base rules (under 20 words, or over 30 % of its words in
    repeated 8-word windows) or its content lines hold less than content_share of its words. Null or
    empty text: all counts 0, not kept. Null doc_id stays null; repeated rows are judged alike; other
    columns are ignored; empty table: no rows. Lines are compared by 64-bit hashes within one text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in text_slices(texts):
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].to_numpy()} | measure(texts[a:b], chain))

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    counted = plain.mapInPandas(lean(run), COUNTS)
    share = F.col("content_words") >= F.lit(content_share) * F.col("n_words")
    return counted.withColumn("kept", ~F.col("base_failed") & share)


def keep(docs: DataFrame, chain: Chain, content_share: float = CONTENT_SHARE) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, in one pass without a shuffle.

    docs has a column text; null, blank and short texts go, repeated rows are judged alike, long texts are read whole; other
    columns, of whatever name, are carried. Empty table: no rows.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in text_slices(texts):
                got = measure(texts[a:b], chain)
                good = ~got["base_failed"] & (got["content_words"] >= content_share * got["n_words"])
                yield batch.slice(a, b - a).filter(pa.array(good))

    return docs.mapInArrow(lean(run), docs.schema)
