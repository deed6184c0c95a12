"""Repeated byte strings against a table of all of them."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_cases import EDGES, frame, prose

from skirmish.llm import queries, repeats

LENGTH = repeats.LENGTH


def brute(rows):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + LENGTH] for b in raw for i in range(len(b) - LENGTH + 1))
    out = []
    for r, b in zip(rows, raw, strict=True):
        covered = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - LENGTH + 1):
            if seen[b[i : i + LENGTH]] > 1:
                covered[i + 1 : i + LENGTH + 1] = True
        edge = np.flatnonzero(covered[1:] != covered[:-1])
        spans = [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2], strict=True)]
        out.append(repr((r[0], len(b), spans, bytes(np.frombuffer(b, np.uint8)[~covered[1:-1]]))))
    return sorted(out)


def found(df):
    return sorted(repr((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept))) for r in df.collect())


def planted():
    r = random.Random(3)
    passage = prose(1, 60)
    rows = [(i, prose(100 + i, r.randrange(1, 300), 5000)) for i in range(40)]
    rows += [(50 + i, prose(200 + i, 20) + " " + passage[r.randrange(30) :] + " " + prose(300 + i, 30)) for i in range(8)]
    rows += [(70, "ab" * 400), (71, "x" * 199), (72, "x" * 200), (73, "y" * 200), (74, "y" * 201), (75, "日本" * 50), (76, "z" + "日本" * 50)]
    rows += [(80 + i, passage + passage) for i in range(3)] + [(90, passage[:200]), (91, passage[1:201] + "!")]
    return rows


@pytest.mark.parametrize("block", [2000, 8 << 20])
def test_planted_repeats(spark, block):
    assert found(repeats.find(frame(spark, planted()), block)) == brute(planted())


def test_edges(spark):
    rows = [r for r in EDGES if r[0] != 8] + [(6, EDGES[5][1])]
    assert found(repeats.find(frame(spark, rows))) == brute(rows)
    assert repeats.find(frame(spark, [])).count() == 0


def test_chunks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 500)
    got = repeats.Anchors([t for _, t in planted()])
    monkeypatch.setattr(repeats, "CHUNK", 1 << 20)
    want = repeats.Anchors([t for _, t in planted()])
    starts = lambda x: sorted((int(a), int(s)) for a, f, e in zip(x.at, x.first, x.last, strict=True) for s in range(f, e + 1))
    assert starts(got) == starts(want)


def test_cuts_leave_no_trace(monkeypatch):
    """A text has the same contexts wherever chunks and slices are cut."""
    texts = [t for _, t in planted()] + [prose(1000 + i, 90, 10**6) for i in range(60)]
    runs = lambda x: sorted(zip(x.h.tolist(), x.g.tolist(), (x.last - x.first).tolist(), strict=True))
    want = runs(repeats.Anchors(texts))
    for chunk in (7, 101, 333):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        assert runs(repeats.Anchors(texts)) == want
        assert sorted(r for a in range(0, len(texts), 3) for r in runs(repeats.Anchors(texts[a : a + 3]))) == want


def test_common_passage_is_not_held_at_once(spark, monkeypatch):
    """Grams with more contexts than a bucket has: the same spans, and no bucket gets them."""
    judge = repeats.repeated_windows

    def small(contexts, offset):
        leading = Counter(c[o : o + repeats.GRAM] for c, o in zip(contexts, offset.tolist(), strict=True))
        assert not leading or max(leading.values()) <= 3
        return judge(contexts, offset)

    monkeypatch.setattr(repeats, "BUCKET", 3)
    monkeypatch.setattr(repeats, "repeated_windows", small)
    assert found(repeats.find(frame(spark, planted()), 2000)) == brute(planted())


def test_query_equals_counting_windows(spark, sf):
    """Every window of every whole document counted, and the query's digests from it."""
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = repeats.LENGTH
    times = Counter(hash(b[i : i + n]) for b in texts.values() for i in range(len(b) - n + 1))
    want = []
    for i, b in texts.items():
        gone = np.zeros(len(b), bool)
        for at in range(len(b) - n + 1):
            if times[hash(b[at : at + n])] > 1:
                gone[at : at + n] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in queries.op5_repeats(spark, sf).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got) > 0


def test_multikey_sort():
    r = np.random.default_rng(1)
    rows = r.integers(97, 100, (300, 21)).astype(np.uint8)
    rows[100:200] = rows[:100]
    order, common = repeats.multikey_sort(rows)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(map(bytes, rows))
    for a, b, n in zip(got[:-1], got[1:], common[1:], strict=True):
        assert a[:n] == b[:n] and (n == 21 or a[n] != b[n])
