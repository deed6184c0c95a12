"""The join against all pairs."""

import random

import pytest
from llm_cases import EDGES, WORD, frame, lower, prose

from skirmish.llm import queries, similarity
from skirmish.llm.graph import components


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) of rows; ids may repeat but aren't null."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            k = len(a & sets[j])
            if k and 100 * k >= 80 * (len(a) + len(sets[j]) - k):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted((r[0], len(s), least[top(i)]) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def edited(words, n, seed):
    r = random.Random(seed)
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    r = random.Random(11)
    rows = [(i, prose(i, r.randrange(1, 120), 3000)) for i in range(60)]
    for g in range(6):  # near-copies about the threshold, and exact ones
        base = prose(500 + g, 60 + 25 * g, 3000).split()
        rows += [(100 + 20 * g + k, edited(base, k % 5, 100 * g + k)) for k in range(14)]
    # A chain: each text is its neighbour moved by a few words. Its ends are far apart.
    line = prose(77, 200, 3000).split()
    rows += [(400 + k, " ".join(line[4 * k : 4 * k + 60])) for k in range(20)]
    # Common passages in otherwise different texts.
    rows += [(500 + k, prose(900 + k, 25) + " " + " ".join(line[:20])) for k in range(10)]
    # Sets right at the threshold: 8 of 10 shingles in common.
    rows += [(600, "a b c d e f g h i j k l m"), (601, "a b c d e f g h i j k l m x"), (602, "a b c d e f g h i j k l y"), (603, "A B"), (604, "a  b"), (605, "a b c")]
    return rows


def test_equals_all_pairs(spark):
    rows = corpus()
    assert found(similarity.join(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("percent,words", [(60, 3), (95, 5)])
def test_other_thresholds(spark, percent, words):
    rows = corpus()[60:110]
    sets = {i: (lambda w: {tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 0))} or {tuple(w)})(t.split()) for i, t in rows}
    part = {r.doc_id: r.component_id for r in similarity.join(frame(spark, rows), percent, words).collect()}
    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                assert part[a] == part[b]


def test_query_on_the_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(queries.op10_jaccard_join(spark, sf)) == brute(rows)


def test_edges(spark):
    got = similarity.join(frame(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    assert {(g.doc_id, g.n_shingles, g.component_id) for g in got if g.doc_id in (1, 2, 3, 4)} == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4)}
    assert [(g.n_shingles, g.component_id) for g in got if g.doc_id == 6] == [(36, 6), (36, 6)]
    assert sorted((g.n_shingles, g.component_id is None) for g in got if g.doc_id is None) == [(0, True), (26, True)]
    assert similarity.join(frame(spark, [])).count() == 0
    with_null = similarity.join(frame(spark, [(None, prose(1, 30)), (4, prose(1, 30))])).collect()
    assert {g.component_id for g in with_null} == {4}


def test_an_id_on_two_texts(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(6, a), (10, a), (6, b), (9, b + " two more"), (None, b), (None, prose(3, 30)), (None, prose(3, 30))]
    got = sorted(((g.doc_id, g.n_shingles, g.component_id) for g in similarity.join(frame(spark, rows)).collect()), key=repr)
    assert got == sorted([(6, 56, 6), (10, 56, 6), (6, 56, 6), (9, 58, 6), (None, 56, 6), (None, 26, None), (None, 26, None)], key=repr)
    kept = [(r.doc_id, r.text) for r in similarity.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(6, a), (6, b), (None, prose(3, 30))], key=repr)
    both = [(6, a), (6, a + " more words"), (5, prose(4, 40)), (5, prose(4, 40)), (7, None), (7, None), (7, " ")]
    assert sorted((r.doc_id for r in similarity.keep_one(frame(spark, both)).collect())) == [5, 6, 7, 7, 7]


def test_a_hot_shingle(spark, monkeypatch):
    """A passage in all texts, counted apart from the other shingles."""
    passage = prose(5, 12, 3000)
    rows = [(i, passage + " " + prose(100 + i // 2, 25, 3000)) for i in range(60)] + corpus()[60:90]
    monkeypatch.setattr(similarity, "TASK_ROWS", 100)
    sets = spark.createDataFrame([(i, 8, list(range(8))) for i in range(40)], "c long, n long, shingles array<long>")
    assert similarity.hot_shingles(sets, 320, 20) == dict.fromkeys(range(8), 40)
    assert found(similarity.join(frame(spark, rows))) == brute(rows)


def test_fragments_are_cut_by_frequency(spark):
    sets = {c: [h for h in range(1, 7) if c < 2**h] for c in range(40)}
    rows = similarity.in_order(spark.createDataFrame([(c, len(h), h) for c, h in sets.items()], "c long, n long, shingles array<long>"), 200).collect()
    for c, h in sets.items():
        mine = sorted((r for r in rows if r.c == c), key=lambda r: r.f)
        assert [x for r in mine for x in r.part] == h and all(r.n == r["size"] == len(h) for r in mine)
        assert [r.before for r in mine] == [sum(len(q.part) for q in mine[:k]) for k in range(len(mine))]
        assert all(r.f == min(40, 2**x).bit_length() - 2 for r in mine for x in r.part)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 130), 100) | {200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
