"""The pipeline against its stages done by hand."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
from llm_cases import EDGES, frame
from test_llm_mixing import copies, hashes_of
from test_llm_packing import restored, tokens
from test_llm_similarity import brute
from tokenizers import Tokenizer

from skirmish.llm import packing, pii, quality, queries


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "pii_pseudonyms", "source_mixing", "harmonic_packing"]


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    chain = quality.fit_lines(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = quality.measure([r.text for r in rows.values()], chain)
    good = ~got["base_failed"] & (2 * got["content_words"] >= got["n_words"])
    kept = [(i, rows[i].text) for i, g in zip(rows, good, strict=True) if g]
    left = [i for i, _, component in brute(kept) if i == component]
    pseudonyms = pii.pseudonymise(docs, queries.PII_KEY)
    masked = {r.doc_id: r.text for r in pseudonyms.collect()}
    _, times = copies([(i, masked[i], None, rows[i].source) for i in left], hashes_of(pseudonyms))
    pieces = corpus_pipeline.run(spark, sf).collect()
    restored(pieces)
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter({i: times[i] * len(tokens(tokenizer, masked[i])) for i in left if times[i]})
    have = Counter()
    for p in pieces:
        have[p.doc_id] += p.length
    assert have == want
    one = min(want)
    first = {p.start: bytes(p.ids) for p in pieces if p.doc_id == one}
    assert np.frombuffer(b"".join(first[s] for s in sorted(first)), "<u4").tolist() == tokens(tokenizer, masked[one])


def test_stages_take_edges_and_empty_tables(spark, sf):
    for rows in (EDGES, []):
        docs = frame(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.columns == (docs.columns if name != "harmonic_packing" else re.findall(r"(\w+) \w+", packing.SCHEMA))
            assert out.count() >= (name not in ("quality_rules", "source_mixing", "jaccard_join") and len(rows))


def test_jaccard_join_keeps_one_of_each_group(spark, sf):
    got = corpus_pipeline.jaccard_join(spark, frame(spark, EDGES), sf)
    assert Counter(r.doc_id for r in got.select("doc_id").collect()) == Counter({i: 2 if i is None else 1 for i in {r[0] for r in EDGES}})
