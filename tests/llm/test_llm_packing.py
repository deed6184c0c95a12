"""Packed pieces give back each document's tokens."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import EDGES, frame
from tokenizers import Tokenizer

from skirmish.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.tokenizer_path())


def tokens(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def restored(pieces):
    """Ids of the documents, each copy from its pieces; sequences must be filled without gaps."""
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        sequences[p.sequence_id].append(p)
    sizes = []
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        sizes.append(at)
    return sizes


def test_round_trip(spark, tokenizer):
    rows = [r for r in EDGES if r[0] != 6] + [(100 + i, "word " * i) for i in range(0, 60, 7)]
    pieces = packing.pack(frame(spark, rows), queries.tokenizer_path()).collect()
    sizes = restored(pieces)
    assert all(n <= 1024 and (n == 1024 or n & (n - 1) == 0) for n in sizes)
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id, p.doc_tokens].append(p)
    for r in rows:
        want = tokens(tokenizer, r[1])
        got = sorted(by_doc.pop((r[0], len(want))), key=lambda p: p.start)
        assert [p.start for p in got] == list(np.cumsum([0, *[p.length for p in got]])[:-1])
        assert np.frombuffer(b"".join(p.ids for p in got), "<u4").tolist() == want
    assert not by_doc


def test_query_packs_every_token_with_little_padding(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    pieces = packing.pack(spark.read.parquet(f"{sf}/documents.parquet"), queries.tokenizer_path()).collect()
    sizes = restored(pieces)
    total = sum(len(tokens(tokenizer, d.text)) for d in docs)
    assert sum(sizes) == total and total / sum(1 << (n - 1).bit_length() for n in sizes) > 0.999


def test_repeated_rows_and_empty_table(spark):
    six = [r for r in EDGES if r[0] == 6]
    pieces = packing.pack(frame(spark, six), queries.tokenizer_path()).collect()
    assert sum(p.length for p in pieces) == 2 * pieces[0].doc_tokens
    assert packing.pack(frame(spark, []), queries.tokenizer_path()).count() == 0


def test_without_cuts(spark):
    pieces = packing.pack(frame(spark, [(i, "word " * (i * 5)) for i in range(100)]), queries.tokenizer_path(), capacity=256, cut=False).collect()
    assert max(restored(pieces)) <= 256
    in_bin = defaultdict(list)
    for p in pieces:
        in_bin[p.sequence_id].append(256 // p.length)
    assert all(len(set(classes)) == 1 and len(classes) <= classes[0] for classes in in_bin.values())
    with pytest.raises(ValueError):
        packing.pack(frame(spark, []), "", capacity=1000)


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "  ", "a \n b", "x  y", "tab\t z", "don't stop 3,141 ok", "日本 語"])
def test_chunks_encode_like_the_whole(tokenizer, text):
    got = packing.Encoder(queries.tokenizer_path()).ids([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == tokens(tokenizer, text)[:-1]


def test_query_rows_give_back_the_whole_table(spark, sf, tokenizer):
    """Every id lies in one piece with its checksum, and sequences have no gap or overlap."""
    got = [r.asDict() for r in queries.op3_harmonic_packing(spark, sf).collect()]
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert docs.keys() == {r.doc_id for r in table}
    for r in table:
        ids, at = np.array(tokens(tokenizer, r.text), "<u4"), 0
        for p in sorted(docs[r.doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for s in sequences.values():
        s.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in s] == list(np.cumsum([0, *[p["length"] for p in s]])[:-1]) and sum(p["length"] for p in s) <= 1024
