"""Counts against plain loops, Viterbi against all labellings."""

import itertools
from collections import Counter

import numpy as np
from llm_cases import EDGES, WORD, frame, prose

from skirmish.llm import quality, queries

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    repeat = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), len(words) < 20 or 100 * len(repeat) > 30 * len(words)


def test_counts(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs + [(1000 + i, t) for i, t in enumerate(["a\na\n\n\na", "a b c d e f g h " * 4, " # $\n# $", "x", prose(1, 30) + "\n" + prose(1, 30), "ä|ö"])]
    chain = quality.Chain(np.zeros((len(quality.FEATURES), 2)), np.zeros((2, 2)))
    got = sorted((r.doc_id, *(r[n] for n in NAMES)) for r in quality.judge(frame(spark, rows), chain).collect())
    assert got == sorted((i, *brute(t)) for i, t in rows)


def test_viterbi_equals_all_labellings():
    r = np.random.default_rng(5)
    chain = quality.Chain(r.standard_normal((3, 2)), r.standard_normal((2, 2)))
    sizes = [1, 6, 3, 7]
    x, doc = r.standard_normal((sum(sizes), 3)), np.repeat(np.arange(4), sizes)
    got, at = chain.viterbi(x, doc), 0
    for n in sizes:
        score = x[at : at + n] @ chain.emit
        total = lambda y, s=score: sum(s[i, c] for i, c in enumerate(y)) + sum(chain.step[a, b] for a, b in zip(y, y[1:], strict=False))
        assert tuple(got[at : at + n]) == max(itertools.product((0, 1), repeat=n), key=total)
        at += n


def test_fit_comes_near_the_true_chain():
    """Labels in runs of four, seen through noise: the true chain is known, and no line for itself shows its label as well."""
    r = np.random.default_rng(6)
    y = [np.repeat(r.integers(0, 2, 5), 4) for _ in range(400)]
    x = [np.stack([np.ones(20), v + r.normal(0, 0.8, 20)], 1) for v in y]
    true = quality.Chain(np.array([[0, -0.5], [0, 1]]) / 0.64, np.log([[17, 2], [2, 17]]))
    lines, doc, want = np.concatenate(x[200:]), np.repeat(np.arange(200), 20), np.concatenate(y[200:])
    got, best = ((c.viterbi(lines, doc) == want).mean() for c in (quality.Chain.fit(x[:200], y[:200]), true))
    assert got > best - 0.02 and got > ((lines[:, 1] > 0.5) == want).mean() + 0.03


def test_query_keeps_clean_documents_and_drops_boilerplate(spark, sf):
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    assert all(not g.kept for g in got.values() if g.base_failed)
    fine = [i for i, q in labels.items() if q == 1 and i in got and not got[i].base_failed]
    assert sum(got[i].kept for i in fine) >= 0.98 * len(fine) > 0


def test_planted_boilerplate_is_told_from_the_prose_around_it(spark, sf):
    """Lines of poor documents within, before and behind good ones: the content share lies between 0 and 1, near that of the good lines."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = quality.fit_lines(docs, labels)
    texts = {q: [r.text for r in docs.join(labels, "doc_id").filter(f"quality = {q}").orderBy("doc_id").collect() if len(WORD.findall(r.text)) > 60] for q in (0, 1)}
    assert chain.step[0, 0] + chain.step[1, 1] > chain.step[0, 1] + chain.step[1, 0]
    between, near, made = 0, 0, []
    for i, good in enumerate(texts[1][:120]):
        poor = [x for x in texts[0][i % len(texts[0])].split("\n")[1:] if len(WORD.findall(x)) > 3][:6]
        lines = [x for x in good.split("\n") if len(WORD.findall(x)) > 3][:12]
        if len(poor) > 1 and len(lines) > 3:
            at = (0, len(lines) // 2, len(lines))[i % 3]
            made.append((lines[:at] + poor + lines[at:], len(WORD.findall("\n".join(lines)))))
    assert len(made) > 30
    got = quality.measure(["\n".join(x) for x, _ in made], chain)
    for (_, prose_words), n, content in zip(made, got["n_words"], got["content_words"], strict=True):
        between += 0 < content < n
        near += abs(content - prose_words) <= 0.15 * n
    assert between >= 0.8 * len(made) and near >= 0.75 * len(made)


def test_spliced_sequences_alternate_and_hold_each_line_once():
    width = len(quality.FEATURES)
    x = [np.full((n, width), 10.0 * i) for i, n in enumerate([32, 5, 20, 1, 32, 32, 7])]
    good = [1, 0, 1, 0, 1, 1, 0]
    seqs, labels = quality.spliced(x, good)
    assert sum(map(len, seqs)) == sum(map(len, x)) and all(len(a) == len(b) for a, b in zip(seqs, labels, strict=True))
    assert len(set(labels[0])) == 2
    seen = Counter((v, y) for a, b in zip(seqs, labels, strict=True) for v, y in zip(a[:, 0], b, strict=True))
    assert seen == Counter({(10.0 * i, g): len(a) for i, (a, g) in enumerate(zip(x, good, strict=True))})
    assert all(a[0, -2] == a[-1, -1] == 1 and a[:, -2:].sum() == 2 for a in seqs)


def marked(text, chain):
    """content words of a text by plain loops: features of each line, then Viterbi."""
    lines, out = (text or "").split("\n"), 0
    with_words = Counter(x for x in lines if WORD.search(x))
    score = []
    for i, line in enumerate(lines):
        words, size = WORD.findall(line), max(len(line.encode()), 1)
        n = max(len(words), 1)
        upper, lower = (sum(a <= c <= b for c in line) for a, b in ("AZ", "az"))
        repeats = 1 - len(set(words)) / n
        symbols = sum(c in "#*$%&|<>" for c in line)
        x = [1, n < 3, n < 6, n >= 12, symbols / n > 0.1, symbols / n > 0.5, upper > 0.6 * max(upper + lower, 1), repeats > 0.3 and n > 3, repeats > 0.6 and n > 3, with_words[line] > 1, sum("0" <= c <= "9" for c in line) / size > 0.3, line.count("!") / n > 0.5, i == 0, i == len(lines) - 1]
        score.append([sum(a * b for a, b in zip(x, chain.emit[:, c], strict=True)) for c in (0, 1)])
    best, back = [score[0]], []
    for now in score[1:]:
        reach = [[best[-1][a] + chain.step[a, c] for a in (0, 1)] for c in (0, 1)]
        back.append([r.index(max(r)) for r in reach])
        best.append([max(r) + e for r, e in zip(reach, now, strict=True)])
    label = [best[-1].index(max(best[-1]))]
    for step in reversed(back):
        label.append(step[label[-1]])
    for line, y in zip(lines, reversed(label), strict=True):
        out += len(WORD.findall(line)) * y
    return out


def test_query_equals_plain_loops(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = quality.fit_lines(docs, labels)
    want = []
    for r in docs.collect():
        counts = brute(r.text)
        want.append((r.doc_id, *counts, not counts[5] and 2 * marked(r.text, chain) >= counts[0]))
    got = queries.op8_quality_rules(spark, sf).select("doc_id", *NAMES, "kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_edges(spark):
    docs, labels = frame(spark, EDGES), spark.createDataFrame([(6, 1), (None, 0), (5, None)], "doc_id long, quality int")
    chain = quality.fit_lines(docs, labels)
    got = quality.judge(docs, chain).collect()
    assert len(got) == len(EDGES) and all((g.n_words, g.kept) == (0, False) for g in got if g.doc_id in (1, 2, 3))
    kept = quality.keep(docs, chain)
    assert kept.columns == docs.columns and kept.count() == sum(g.kept for g in got)
    none = quality.fit_lines(docs, labels.limit(0))
    assert all(g.kept != g.base_failed for g in quality.judge(docs, none).collect())
    assert quality.judge(frame(spark, []), none).count() == quality.keep(frame(spark, []), none).count() == 0
