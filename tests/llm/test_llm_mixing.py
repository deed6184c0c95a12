"""Targets against resharing round by round, samples against sorting whole sources."""

import hashlib
import math
from collections import defaultdict

import pytest
from llm_cases import EDGES, WORD, frame, prose

from skirmish.llm import mixing, queries


def targets(sizes):
    """sizes: source -> words. Excess over twice a source goes to the others by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    goal, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in full]
        level = (goal - sum(full.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return full | {s: level * weight[s] for s in free}
        full |= {s: 2.0 * sizes[s] for s in over}


def copies(rows, hashes):
    """doc_id -> copies, of rows with distinct ids; hashes: doc_id -> row_hash."""
    by = defaultdict(list)
    for r in rows:
        by[r[3] if len(r) > 3 else None].append((r[0], len(WORD.findall(r[1] or ""))))
    sizes = {s: sum(n for _, n in docs) for s, docs in by.items()}
    goal, out = targets(sizes), {}
    for s, docs in by.items():
        whole, part = divmod(goal[s] / sizes[s], 1) if sizes[s] else (0, 0)
        part = 0 if part < 1e-9 else part
        key = {}
        for i, n in docs:
            out[i] = int(whole)
            if n and part:
                u = (int(hashlib.sha256(f"mix:{i}:{hashes[i]}:1".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
                miss = (1 - part) ** math.sqrt(n * len(docs) / sizes[s])
                key[i] = u / (1 - u) / ((1 - miss) / miss)
        upto = 0
        for i, n in sorted(((i, n) for i, n in docs if i in key), key=lambda d: (key[d[0]], d[0])):
            upto += n
            if upto - n / 2 <= part * sizes[s]:
                out[i] += 1
            else:
                break
    return goal, out


def hashes_of(docs):
    return {r.doc_id: r.h for r in docs.select("doc_id", mixing.row_hash(docs).alias("h")).collect()}


def corpus():
    return [(i, prose(i, 1 + i * 7 % 90), "en", [None, "a", "b", "c", "", "é"][i % 7 % 6]) for i in range(300)] + [(1000 + i, prose(i, 20), "en", "a") for i in range(200)]


def test_equals_sorting(spark):
    got = {r.doc_id: r for r in mixing.mix(frame(spark, corpus())).collect()}
    goal, want = copies(corpus(), hashes_of(frame(spark, corpus())))
    assert {i: g.copies for i, g in got.items()} == want
    for g in got.values():
        assert g.target == pytest.approx(goal[g.source]) and g.taken == g.copies * g.size <= 2 * g.size


def test_taken_words_come_near_the_target(spark, sf):
    by, source = defaultdict(int), {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_mixing(spark, sf).collect()
    for g in got:
        by[source[g.doc_id]] += g.taken
    largest = max(g.size for g in got)
    assert all(abs(by[source[g.doc_id]] - g.target) <= largest / 2 for g in got)
    assert sorted(got) == sorted(queries.op9_mixing(spark, sf).collect())


def test_copies_are_taken(spark):
    docs = frame(spark, corpus())
    mixed = mixing.mix(docs)
    rows = mixing.take(docs, mixed)
    assert rows.columns == docs.columns
    assert {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()} == {r.doc_id: r.copies for r in mixed.collect() if r.copies}


def test_edges(spark):
    got = mixing.mix(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES) and all(g.size == g.taken == 0 for g in got if g.doc_id in (1, 2, 3))
    assert all(0 <= g.taken <= 2 * g.size for g in got)
    assert mixing.mix(frame(spark, [])).count() == 0
    (one,) = mixing.mix(frame(spark, [(1, "a b c", None, None)])).collect()
    assert one.target == 4.5 and one.taken in (3, 6)
    assert all(g.target == 0 for g in mixing.mix(frame(spark, [(1, "", None, "x"), (2, None, None, "y")])).collect())


def test_take_tells_texts_of_one_id_apart(spark):
    rows = [(1, prose(1, 30), "en", "a"), (1, prose(2, 50), "en", "a"), (1, prose(3, 30), "en", "b"), (1, prose(9, 30), "en", "b"), (None, prose(4, 9), "en", None), (None, None, "en", None), *[(2, prose(5, 20), "de", "b")] * 3]
    docs = frame(spark, rows)
    mixed, planned, got = mixing.mix(docs), defaultdict(int), defaultdict(int)
    taken = mixing.take(docs, mixed)
    for r in mixed.collect():
        planned[r.doc_id, r.source, r.size] += r.copies
    for r in taken.collect():
        got[r.doc_id, r.source, len(WORD.findall(r.text or ""))] += 1
    assert taken.columns == docs.columns and dict(got) == {k: n for k, n in planned.items() if n}


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: i % 3])
def test_a_source_with_shared_ids_comes_near_its_target(spark, ids):
    """Different texts, and equal rows, under one id or none."""
    for seed in (lambda i: i, lambda i: 0):
        rows = [(ids(i), prose(seed(i), 10), "en", "a") for i in range(300)] + [(1000 + i, prose(i, 10), "en", "b") for i in range(200)]
        docs = frame(spark, rows)
        got = mixing.mix(docs).filter("source = 'a'").collect()
        assert len(got) == 300 and abs(sum(g.taken for g in got) - got[0].target) <= 5
        assert mixing.take(docs, mixing.mix(docs)).filter("source = 'a'").count() == sum(g.copies for g in got)


def test_take_carries_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([(i, prose(i, 10), "a", 10 * i, "x", i) for i in range(30)], "doc_id long, text string, source string, _mix_copies_0 int, _mix_copy string, _MIX_nth_0 int")
    taken = mixing.take(docs, mixing.mix(docs))
    assert taken.columns == docs.columns and taken.count() > 0 and all(r._mix_copies_0 == 10 * r.doc_id for r in taken.collect())
