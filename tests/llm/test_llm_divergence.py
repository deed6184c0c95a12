"""The audit of sources against plain loops over all groups and terms."""

import re
from collections import Counter, defaultdict

import pytest
from llm_cases import EDGES, frame, lower, prose

from skirmish.llm import divergence, queries
from skirmish.llm.common import Scratch

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, k=200):
    counts, having, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lower(text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        having.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in having.items() if x == lang and n >= 3]
        sources = sorted(s for x, s in groups if x == lang)
        v = len(kept)
        every = sum((counts[lang, s] for s in sources), Counter())

        def shares(c, kept=kept, v=v):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + v) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(every)
        for s in sources:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            term = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, r) for r, (value, item) in enumerate(ranked, 1) if part == "pair" or r <= k]
    return Counter(out)


CASES = [*EDGES, *[(i, prose(i % 90, 60 + i % 50, 300).replace("w", "w" + "abcdefg"[i % 7]).translate(str.maketrans("0123456789", "qrstuvxyzä")), ("en", "de", None)[i % 3], f"s{i % 5}") for i in range(150)], (900, "", "xx", "a"), (901, None, "xx", "b"), (902, "Only once", "yy", "a")]


@pytest.mark.parametrize(("k", "finish", "bits"), [(200, 256, 12), (5, 0, 3), (20, 4, 12)])
def test_audit(spark, monkeypatch, k, finish, bits):
    monkeypatch.setattr(divergence, "DIGIT_BITS", bits)
    plain = divergence.radix_top
    monkeypatch.setattr(divergence, "radix_top", lambda rows, k, scratch: plain(rows, k, scratch, finish))
    got = divergence.audit(frame(spark, CASES).repartition(5), k)
    assert Counter(map(tuple, got.collect())) == brute([(r[1], *(list(r[2:4]) + [None, None])[:2]) for r in CASES], k)


def test_empty_and_no_terms(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    got = divergence.audit(frame(spark, [(1, None, "en", "a"), (2, " 12 ", "en", None)]))
    assert sorted(map(tuple, got.collect())) == [("en", "", "pair", "a", 0, 1), ("en", "a", "pair", "", 0, 1)]


def test_ties_are_cut_by_bytes(spark):
    items = [f"ab{x}{y}" for x in "aäzZ\U0001f600" for y in ("", "q", "rr", "日本")] + ["a", "ab", "abc"]
    rows = [("en", "s", i, 7) for i in items] + [("en", "s", "top", 9), ("en", "s", "low", 1), ("de", "s", "x", 0)]
    df = spark.createDataFrame(rows, "lang string, source string, item string, value long")
    for k in (1, 4, 12, 25, 99):
        got = divergence.radix_top(df, k, Scratch(), finish=0).collect()
        want = sorted((r for r in rows if r[0] == "en"), key=lambda r: (-r[3], r[2].encode()))[:k]
        assert sorted((r.rank, r.item, r.value) for r in got if r.lang == "en") == [(n, r[2], r[3]) for n, r in enumerate(want, 1)]
        assert [(r.rank, r.item) for r in got if r.lang == "de"] == [(1, "x")]


def test_shares_are_exact_beyond_64_bits(spark):
    row = spark.range(1).select(divergence.share(divergence.F.lit(3 * 10**15), divergence.F.lit(9 * 10**15 + 1), divergence.F.lit(10**6)).alias("p")).first()
    assert row.p == 1 + 10**9 * (3 * 10**15 + 1) // (9 * 10**15 + 1 + 10**6)


def test_query_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()
    assert Counter(map(tuple, queries.op11_source_divergence(spark, sf).collect())) == brute(docs)
