"""Exact deduplication against counting by text, and the filter's bounds."""

from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from llm_cases import EDGES, frame, lower, prose
from pyspark.sql import functions as F

from skirmish.llm import exact, queries


def brute(rows):
    """doc_id, keep_id, group_size, kept, text_sha256; of repeated rows one is kept."""
    same = defaultdict(list)
    for r in rows:
        same[lower(r[1] or "")].append(r[0])
    out = []
    for text, ids in same.items():
        keep = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            out.append((i, keep, len(ids), k == 0, sha256(text.encode()).hexdigest()))
    return Counter(out)


CASES = [*EDGES, *[(100 + i, prose(i % 40, 30)) for i in range(120)], *[(300 + i, "The licence line") for i in range(200)], (600, "THE LICENCE line"), (601, "ÄB"), (602, "äb"), (603, "Äb"), (None, "The licence line")]


@pytest.mark.parametrize("hot_rows", [exact.HOT_ROWS, 20])
def test_classes(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(exact, "HOT_ROWS", hot_rows)
    got = exact.classes(frame(spark, CASES).repartition(7))
    assert Counter(map(tuple, got.collect())) == brute(CASES)
    assert exact.classes(frame(spark, [])).count() == 0


def test_results_stay_exact_when_the_filter_is_full(spark, monkeypatch):
    monkeypatch.setattr(exact, "MOST_SEGMENTS", 1)
    rows = [(i, f"text {i % 20_000}") for i in range(30_000)]
    assert Counter(map(tuple, exact.classes(frame(spark, rows)).collect())) == brute(rows)


def test_keep_one_carries_all_columns(spark):
    got = exact.keep_one(frame(spark, CASES))
    assert got.columns == frame(spark, []).columns
    want = [(i, text) for i, _, _, kept, text in brute(CASES).elements() if kept]
    assert Counter((r.doc_id, sha256(lower(r.text or "").encode()).hexdigest()) for r in got.collect()) == Counter(want)
    assert exact.keep_one(frame(spark, [])).count() == 0


def test_only_rows_that_may_repeat_are_shuffled(spark):
    n = 20_000
    rows = spark.range(n).select(F.xxhash64(F.when(F.col("id") % 100 == 0, F.col("id") % 1000).otherwise(F.col("id"))).alias("h"), F.when(F.col("id") % 100 == 0, F.col("id") % 1000).otherwise(F.col("id")).alias("k"))
    segments = exact.segments_for(n)
    cells = exact.repeated_cells(rows.select("h"), segments).cache()
    marked = exact.may_repeat(rows, "k", cells, segments, "maybe")
    repeated = marked.filter("k % 100 = 0")
    assert repeated.filter("not maybe").count() == 0
    assert marked.filter("maybe").count() < repeated.count() + 0.02 * n
    cells.unpersist()


def test_cells_are_those_of_the_expression():
    h = np.array([-1, 0, 1 << 62, 12345678901234567], np.int64)
    got = exact.cells_of(h, 5).reshape(exact.PROBES, -1)
    for j, x in enumerate(h.tolist()):
        u = x % 2**64
        assert [int(got[k][j]) for k in range(3)] == [(u >> 45) % 5 * exact.SEGMENT_BITS + (u >> 15 * k) % exact.SEGMENT_BITS for k in range(3)]


def test_query_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, queries.op12_exact_dedup(spark, sf).collect())) == brute(docs)


def test_distinct_rows_pass_without_a_shuffle_of_texts(spark, sf):
    plan = exact.keep_one(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "Window" not in plan
