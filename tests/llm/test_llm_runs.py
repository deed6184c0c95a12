"""Runs of words against scanning every period, and the suffix tree against its definition."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from llm_cases import EDGES, WORD, frame, prose

from skirmish.llm import queries, runs


def brute(words, least=24, copies=3):
    """Maximal runs with their least period, found by scanning for each period the stretches that repeat by it."""
    found = {}
    for q in range(1, len(words) // copies + 1):
        i = 0
        while i + q < len(words):
            begin = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - begin + q >= max(least, copies * q):
                found.setdefault((begin, i - begin + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(seed):
    r, words = random.Random(seed), []
    letters = r.choice([1, 2, 2, 3, 5, 50])
    for _ in range(r.randrange(6)):
        unit = [str(r.randrange(letters)) for _ in range(r.randrange(1, 12))]
        words += (unit * r.randrange(2, 9))[: r.randrange(1, 90)] if r.random() < 0.6 else [str(r.randrange(letters)) for _ in range(r.randrange(40))]
    return " ".join(words)


@pytest.mark.parametrize(("least", "copies"), [(24, 3), (6, 3), (9, 4)])
def test_runs_of(monkeypatch, least, copies):
    monkeypatch.setattr(runs, "CHUNK", 97)
    texts = [made(i) for i in range(300)]
    for a in range(0, 300, 7):
        for text, (n, found, kept) in zip(texts[a : a + 7], runs.runs_of(texts[a : a + 7], least, copies), strict=True):
            words = text.split()
            assert n == len(words) and found == brute(words, least, copies) and kept.decode() == collapsed(words, found)


def test_suffix_tree():
    r = random.Random(5)
    t = np.array([r.randrange(3) for _ in range(200)] + [-1] + [r.randrange(2) for _ in range(50)] + [-2], np.int64)
    tree, s = runs.SuffixTree(t), t.tolist()
    at = {x: i for i, x in enumerate(sorted(set(s)))}
    assert tree.order.tolist() == sorted(range(len(s)), key=lambda i: [at[x] for x in s[i:]])
    lcp = lambda i, j: next(k for k in range(len(s)) if s[i + k] != s[j + k])
    pairs = [(r.randrange(200), 201 + r.randrange(50)) for _ in range(100)]
    assert tree.common(*np.array(pairs).T).tolist() == [lcp(i, j) for i, j in pairs]
    want = {(i, q) for q in range(1, 130) for i in range(len(s) - 2 * q) if s[i : i + q] == s[i + q : i + 2 * q] and s[i + q] != s[i + 2 * q]}
    got = {(int(a), int(b)) for x, y in tree.branching() for a, b in zip(x, y, strict=True)}
    assert got == want
    depth, first, last, starts, ends, whose = tree.nodes()
    for k in range(len(depth)):
        mine = whose == k
        assert starts[mine][0] == first[k] and ends[mine][-1] == last[k] + 1 and (starts[mine][1:] == ends[mine][:-1]).all()


def test_find_takes_edges_and_long_runs(spark):
    unit = prose(3, 700, 5000)
    rows = [*EDGES, (20, " ".join([unit] * 12)), (21, "ha " * 5000), (22, "A a " * 30), (23, "x " * 23), (24, "x " * 24)]
    got = sorted(runs.find(frame(spark, rows)).collect(), key=str)
    want = []
    for r in rows:
        words = WORD.findall(r[1] or "")
        found = brute(words) if len(words) < 20_000 else []
        want.append((r[0], len(words), found, collapsed(words, found).encode()))
    assert sorted([(r.doc_id, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in got], key=str) == sorted(want, key=str)
    assert runs.find(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="three copies"):
        runs.find(frame(spark, []), 24, 2)


def test_query_over_the_whole_table(spark, sf):
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words) if n < 4000 else [x for d in runs.runs_of([" ".join(words)]) for x in d[1]]
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2])) if found else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in found)
        want.append((r.doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha256(lines.encode()).hexdigest(), sha256(collapsed(words, found).encode()).hexdigest()))
    assert sorted(map(tuple, queries.op13_periodic_runs(spark, sf).collect())) == sorted(want)
    assert sum(x[1] > 0 for x in want) >= len(want) // 20
