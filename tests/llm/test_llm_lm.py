"""Lattice sums against all segmentations spelled out; the base score against counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import EDGES, WORD, frame, lower
from pyspark.sql import functions as F

from skirmish.llm import lm, queries

PIECES = sorted(["▁".encode(), b"a", b"b", b"ab", b"ba", b"aba", "▁a".encode(), "▁ab".encode()])
LOGP = np.log(np.arange(1, len(PIECES) + 1) / 36)


def paths(word):
    if not word:
        yield ()
    for p in PIECES:
        if word.startswith(p):
            for rest in paths(word[len(p) :]):
                yield (p, *rest)


def test_lattice_equals_all_segmentations():
    lattice = lm.Lattice(PIECES, LOGP)
    words, counts = [b"a", b"ab", b"abab", b"bbaba", b"ab", b""], np.array([1.0, 2, 3, 1, 1, 4])
    got, expected = lattice.words(words, counts)
    want = np.zeros(len(PIECES))
    for w, c, x in zip(words, counts, got, strict=True):
        weight = {p: math.exp(sum(LOGP[PIECES.index(q)] for q in p)) for p in paths("▁".encode() + w)}
        assert x == pytest.approx(math.log(sum(weight.values())))
        for p, v in weight.items():
            for q in p:
                want[PIECES.index(q)] += c * v / sum(weight.values())
    assert expected == pytest.approx(want)


def test_no_path_is_minus_infinity():
    assert lm.Lattice(PIECES, LOGP).words([b"xyz"])[0][0] == -math.inf


def brute(rows):
    """The base score of each (doc_id, text, train)."""
    tokens = [[*WORD.findall(lower(t or "")), None] for _, t, _ in rows]
    count = Counter(w for ts, (_, _, mine) in zip(tokens, rows, strict=True) if mine for w in ts)
    n, v = sum(count.values()), len(count)
    return [(len(ts), sum(count[w] > 0 for w in ts), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ts)) for ts in tokens]


def test_base_score(spark):
    rows = [(r[0], r[1], (r[0] or 0) % 3 != 0) for r in EDGES]
    docs = frame(spark, EDGES).withColumn("train", F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0)
    got = lm.score(docs, queries.tokenizer_path("piece_bpe_32k.model"), rounds=1, block_bytes=1000).collect()
    key = lambda x: repr((x[0], *x[1:4], round(x[4], 6)))
    want = [(r[0], *b) for r, b in zip(rows, brute(rows), strict=True)]
    assert sorted(key((g.doc_id, g.n_tokens, g.n_known, g.train_tokens, g.base_score)) for g in got) == sorted(map(key, want))
    assert all(math.isfinite(g.score) and g.score < 0 for g in got)


def test_held_out_texts_gain_from_training(spark, sf):
    got = queries.op2_lattice_lm(spark, sf).collect()
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 1) for g in got)
    held = {g.doc_id: g for g in got if g.held_out}
    # The base gives each unknown word the same share and spells none, so only texts without one compare with it.
    known = [g for g in held.values() if g.n_known == g.n_tokens]
    assert known and sum(g.score for g in known) > 1.05 * sum(g.base_score for g in known)
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(F.col("doc_id").isin(list(held))).withColumn("train", F.lit(False))
    plain = {g.doc_id: g.score for g in lm.score(docs, queries.tokenizer_path("piece_bpe_32k.model")).collect()}
    assert sum(g.score for g in held.values()) > 0.9 * sum(plain.values())


def test_nothing_to_learn_from(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    assert lm.score(frame(spark, []), path).count() == 0
    (got,) = lm.score(frame(spark, [(1, "some words")]).withColumn("train", F.lit(False)), path).collect()
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and math.isfinite(got.score)


def test_scores_equal_all_segmentations_spelled_out(spark):
    """EM over the training words and both scores, by adding up every segmentation of every word."""
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = [(1, "the cat sat on the mat", True), (2, "The dog sat", True), (3, "cats on mats", False), (4, "a", True), (5, None, True), (6, "the zq", False), (6, "the zq", False)]
    docs = frame(spark, [r[:2] for r in rows]).withColumn("train", ~F.coalesce(F.col("doc_id").isin(3, 6), F.lit(False)))
    pieces, logp = lm.vocabulary(path)
    weight = dict(zip(pieces, np.exp(logp), strict=True))

    def ways(word):
        """Every segmentation of a word with its mark, as lists of pieces."""
        if not word:
            return [[]]
        return [[word[:k], *rest] for k in range(1, len(word) + 1) if word[:k] in weight for rest in ways(word[k:])]

    tokens = [[*WORD.findall(lower(t or "")), None] for _, t, _ in rows]
    count = Counter(w for ts, (*_, mine) in zip(tokens, rows, strict=True) if mine for w in ts)
    n, texts = sum(count.values()), count.pop(None)
    spelled = {w: ways("▁".encode() + w.encode()) for ts in tokens for w in ts if w}
    mass = lambda w: sum(math.prod(weight[p] for p in way) for way in spelled[w])
    end = 0.5
    for _ in range(lm.ROUNDS):
        expected = dict.fromkeys(weight, lm.SMOOTHING)
        for w in count:
            for way in spelled[w]:
                for p in way:
                    expected[p] += math.prod(weight[q] for q in way) / mass(w)
        whole = sum(expected.values()) + len(count) + 1
        weight, end = {p: x / whole for p, x in expected.items()}, (len(count) + 1) / whole
    n1, n2 = (sum(c == k for c in count.values()) for k in (1, 2))
    d = min(max(n1 / (n1 + 2 * n2), 0.1), 0.9)
    want = []
    for (i, *_), ts in zip(rows, tokens, strict=True):
        of = [(max(count[w] - d, 0) / n + d * len(count) / n * mass(w) * end, (1 - texts / n) * mass(w) * end) for w in ts if w]
        want.append((i, *(math.log10(texts / n) + sum(math.log10(x[k]) for x in of) for k in (0, 1))))
    got = sorted((g.doc_id, g.score, g.piece_score) for g in lm.score(docs, path, block_bytes=20).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a == pytest.approx(b, rel=1e-9)
