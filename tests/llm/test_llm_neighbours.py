"""Neighbours against all cosines."""

import numpy as np
from pyspark.sql import functions as F

from skirmish.llm import neighbours, queries

ROWS = "vec_id long, embedding array<float>, label int, dim int, b int, q int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 5) for r in rows], ROWS)


def exact(rows, query, k=5):
    q = np.array(rows[query], float)
    score = {i: float(np.dot(np.array(v, float), q) / np.sqrt(np.dot(v, v) * np.dot(q, q))) for i, v in rows.items() if i != query}
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_recall_and_scores(spark, sf, monkeypatch):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    for block in (neighbours.BLOCK, 100):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "LEAST_BLOCK", 10**9 if block > 100 else 50)
        hit = total = 0
        got = queries.op7_neighbours(spark, sf).collect()
        assert {g.query_id for g in got} == {i for i in rows if i % 50 == 0}
        for query in {g.query_id for g in got}:
            mine = sorted((g for g in got if g.query_id == query), key=lambda g: g["rank"])
            want = exact(rows, query)
            assert [g["rank"] for g in mine] == [1, 2, 3, 4, 5]
            for g in mine:
                a, b = rows[g.vec_id], rows[query]
                assert abs(g.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
            hit += len({g.vec_id for g in mine} & {i for i, _ in want})
            total += len(want)
        assert hit >= 0.9 * total


def test_edges(spark):
    bad = [(50, None), (100, []), (150, [0.0, 0.0]), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    good = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [4.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    got = neighbours.search(frame(spark, bad + good), F.col("vec_id") % 50 == 0, k=5).collect()
    assert [(g.query_id, g["rank"], g.vec_id, round(g.score, 9)) for g in sorted(got, key=lambda g: g["rank"])] == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 7, 0.0), (0, 4, 7, 0.0)]
    assert neighbours.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert neighbours.search(frame(spark, [(0, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0


def test_vectors_under_one_id_are_queries_of_their_own(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), *[(i, [1.0, i / 100]) for i in range(1, 7)], *[(100 + i, [i / 100, 1.0]) for i in range(1, 7)]]
    for block in (neighbours.BLOCK, 3):
        neighbours.BLOCK, kept = block, neighbours.BLOCK
        got = neighbours.search(frame(spark, rows), F.col("vec_id") == 50, k=3).collect()
        neighbours.BLOCK = kept
        assert sorted((g["rank"], g.vec_id) for g in got) == [(r, v) for r in (1, 2, 3) for v in (r, 100 + r)] and {g.query_id for g in got} == {50}


def test_windows_grow_until_the_kth_best_would_be_seen():
    r = np.random.default_rng(2)
    vectors = r.standard_normal((3000, 32))
    near = vectors[:8] + 0.01 * r.standard_normal((8, 32))
    index = neighbours.Index(np.concatenate([vectors, near]), np.arange(3008))
    for i, (best, verified) in enumerate(index.search(vectors[:8], np.arange(8), 1)):
        assert best[0][1] == 3000 + i and verified < 30  # near neighbours end the search at the first windows
    few = neighbours.Index(vectors[:4], np.arange(4))
    assert [sorted(i for _, i in best) for best, _ in few.search(vectors[:2], np.arange(2), 5)] == [[1, 2, 3], [0, 2, 3]]
    same = neighbours.Index(np.ones((50, 3)), np.arange(50))
    assert [i for _, i in next(same.search(np.ones((1, 3)), np.array([0]), 5))[0]] == [1, 2, 3, 4, 5]
    assert neighbours.reached(0.0, 0.1) and not neighbours.reached(1.4, 0.5) and neighbours.reached(1.0, 1.1)


def test_recall_on_many_vectors_without_structure(spark):
    """Far from every query, as in 64 dimensions at random: the hardest case."""
    r = np.random.default_rng(3)
    rows = r.standard_normal((30_000, 64))
    ids = np.arange(len(rows))
    index = [neighbours.Index(rows[b::2], ids[b::2]) for b in range(2)]
    asked = ids[::500]
    found = [list(x.search(rows[asked], asked, 5)) for x in index]
    hit = verified = 0
    unit = rows / np.sqrt((rows * rows).sum(1))[:, None]
    for j, i in enumerate(asked):
        score = unit @ unit[i]
        score[i] = -2
        got = sorted(found[0][j][0] + found[1][j][0])[:5]
        hit += len({i for _, i in got} & set(np.argsort(-score)[:5].tolist()))
        verified += found[0][j][1] + found[1][j][1]
    assert hit >= 0.9 * 5 * len(asked) and verified < 0.2 * len(asked) * len(rows)
