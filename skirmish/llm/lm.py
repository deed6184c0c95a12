"""Language-model scores: the marginal probability of a text over all segmentations of its words into subword pieces."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import _SPREAD, MIX2, _powers, in_blocks, mix64, staged, text_slices

#: Text of a block, whose own words one task holds; rounds of expectation-maximisation; words scored at once.
BLOCK_BYTES, ROUNDS, CHUNK = 8 << 20, 2, 60_000
#: Added to each piece's expected count.
SMOOTHING = 0.1
_MARK = "▁".encode()
_SLOTS = 18


def _length_term(n: int) -> np.uint64:
    return np.uint64(n * int(MIX2) & (1 << 64) - 1)


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file as bytes, and the log weights that its scores give.

    Pieces with the word mark anywhere but in front never occur within a word and are left out. The scores of a BPE file
    are falling ranks; a weight is 1 / (rank + 10). Byte pieces come last in rank, so that every text can be segmented.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            key, rank = bytes([int(piece[3:5], 16)]), sp.get_piece_size()
        elif sp.is_control(i) or sp.is_unknown(i) or "▁" in piece[1:]:
            continue
        else:
            key, rank = piece.encode(), -sp.get_score(i)
        weight[key] = weight.get(key, 0.0) + 1 / (max(rank, 0.0) + 10)
    keys = sorted(weight)
    w = np.array([weight[k] for k in keys])
    return keys, np.log(w / w.sum())


def _hash(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, p in enumerate(pieces):
        d = np.frombuffer(p, np.uint8)
        out[i] = (_SPREAD[d] * _powers(len(d))[0]).sum(dtype=np.uint64)
    return mix64(out + np.array([_length_term(len(p)) for p in pieces], np.uint64))


class Lattice:
    """Sums over all segmentations of words, in log space, for all words of one length at once."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp, self.longest = logp, max(map(len, pieces))
        self.of = _hash(pieces)
        slot = (self.of >> np.uint64(64 - _SLOTS)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        rank = np.arange(len(slot)) - np.searchsorted(slot[order], slot[order], "left")
        self.table = np.full((int(rank.max()) + 1, 1 << _SLOTS), -1, np.int32)
        self.table[rank, slot[order]] = order

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of h that are pieces, and which."""
        slot = (h >> np.uint64(64 - _SLOTS)).astype(np.int64)
        rows = np.flatnonzero(self.table[0][slot] >= 0)
        slot, h = slot[rows], h[rows]
        found = np.full(len(rows), -1, np.int32)
        for level in self.table:
            got = level[slot]
            found = np.where((got >= 0) & (self.of[got] == h), got, found)
        hit = found >= 0
        return rows[hit], found[hit]

    def run(self, words: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """words: n x length uint8. Log probabilities, and with counts the expected number of each piece."""
        n, length = words.shape
        up, down = _powers(length + 1)
        prefix = np.zeros((length + 1, n), np.uint64)
        np.cumsum((_SPREAD[words] * up[:length]).T, axis=0, out=prefix[1:])
        fwd = np.full((length + 1, n), -np.inf)
        fwd[0] = 0
        arcs = []
        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                rows, piece = self.find(mix64((prefix[j] - prefix[i]) * down[i] + _length_term(j - i)))
                if len(rows):
                    lp = self.logp[piece]
                    fwd[j, rows] = np.logaddexp(fwd[j, rows], fwd[i, rows] + lp)
                    if counts is not None:
                        arcs.append((i, j, rows, piece))
        if counts is None:
            return fwd[-1], None
        bwd = np.full((length + 1, n), -np.inf)
        bwd[-1] = 0
        expected = np.zeros(len(self.logp))
        for i, j, rows, piece in reversed(arcs):
            lp = self.logp[piece]
            bwd[i, rows] = np.logaddexp(bwd[i, rows], bwd[j, rows] + lp)
        for i, j, rows, piece in arcs:
            share = np.exp(fwd[i, rows] + self.logp[piece] + bwd[j, rows] - fwd[-1, rows])
            expected += np.bincount(piece, weights=share * counts[rows], minlength=len(expected))
        return fwd[-1], expected

    def words(self, words: list[bytes], counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        out, expected = np.zeros(len(words)), np.zeros(len(self.logp))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            step = max(1, (1 << 19) // int(size + 3))
            for a in range(0, len(at), step):
                rows = at[a : a + step]
                grid = np.frombuffer(b"".join(_MARK + words[i] for i in rows), np.uint8).reshape(len(rows), -1)
                out[rows], got = self.run(grid, None if counts is None else counts[rows])
                if got is not None:
                    expected += got
        return out, expected


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes, A-Z lowered) and c, its count in the rows with train; words of other rows have c = 0. docs: text, train."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def flush() -> pd.DataFrame:
            new = [w for w in seen[False] if w not in seen[True]]
            out = pd.DataFrame({"word": [*seen[True], *new], "c": [*seen[True].values(), *[0] * len(new)]})
            seen[True].clear()
            seen[False].clear()
            return out

        for batch in batches:
            col, train = batch["text"].tolist(), batch["train"].to_numpy()
            for a, b in text_slices(col):
                for t, mine in zip(col[a:b], train[a:b], strict=True):
                    if t:
                        seen[bool(mine)].update(t.encode("utf-8", "surrogatepass").lower().split())
                if len(seen[True]) + len(seen[False]) > 400_000:
                    yield flush()
        yield flush()

    plain = docs.select("text", "train")
    return plain.mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_pieces(words: DataFrame, n_words: int, pieces: list[bytes], logp: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Log probabilities of the pieces and of a word's end, by EM over the n_words distinct words with c > 0.

    words: word, c. Each distinct word counts once: the pieces spell words that the word counts don't know. Tasks send one
    vector each, which 64 groups add up, so a round gathers one number a piece.
    """
    known = words.filter("c > 0").select("word")
    log_end = float(np.log(0.5))
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast((pieces, logp))  # as large as the vocabulary file

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            lattice = Lattice(*shared.value)
            total = np.zeros(len(shared.value[0]))
            for t in _chunks(batches):
                total += lattice.words(t["word"].to_pylist(), np.ones(t.num_rows))[1]
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % 64], pa.int32()), "x": pa.array([total.tobytes()], pa.binary())})

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": [0], "x": [np.sum([np.frombuffer(x) for x in rows["x"]], axis=0).tobytes()]})

        got = known.mapInArrow(expect, "part int, x binary").groupBy("part").applyInPandas(add, "part int, x binary").collect()
        expected = np.sum([np.frombuffer(r.x) for r in got], axis=0) if got else np.zeros(len(pieces))
        smooth = expected + SMOOTHING
        whole = smooth.sum() + n_words + 1
        logp, log_end = np.log(smooth / whole), float(np.log((n_words + 1) / whole))
    return logp, log_end


def score(docs: DataFrame, vocabulary_path: str, rounds: int = ROUNDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of every whole text: doc_id, n_tokens, n_known, train_tokens, base_score, score, piece_score.

    docs: doc_id, text, train (boolean; null counts as true); other columns are ignored. A-Z are lowered; tokens are the
    words and one end. score is log10 of the marginal probability of the text: the sum over all paths through the lattice
    of each word, whose arcs are the pieces of the vocabulary, weighted by their fitted scores, and one arc for the whole
    word if the training rows have it. With c, N and V as for the base and the discount d = n1 / (n1 + 2 n2) of words seen
    once and twice, a word has probability max(c - d, 0) / N + d V / N * (its segmentations' sum), the end has its share of N.
    base_score is the word model: sum of log10((c + 0.5) / (N + 0.5 (V + 1))). piece_score is that of the pieces alone, without
    arcs for whole words: each word the sum over its segmentations, times the share of tokens that are words.

    Null or empty text: the end alone. Null doc_id stays null; repeated rows all count and get equal scores. Without
    training rows N = V = 0, the vocabulary's own weights hold, and the end has probability 1/2. Empty table: no rows. Words may be of any length.

    Words are counted with a shuffle of word counts. For the scores, texts go to blocks of about block_bytes by a hash of
    doc_id; each block's distinct words are joined with the scored words, and come back to the block's texts.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), F.coalesce(docs["train"], F.lit(True)).alias("train"))
    words = staged(count_words(plain), "lm-words")
    n_texts = plain.filter("train").count()
    times = lambda k: F.count(F.when(k, 1))
    total = words.agg(F.sum("c").alias("n"), times(F.col("c") > 0).alias("v"), times(F.col("c") == 1).alias("n1"), times(F.col("c") == 2).alias("n2")).first()
    n, v = (total.n or 0) + n_texts, total.v + (n_texts > 0)
    pieces, logp = vocabulary(vocabulary_path)
    logp, log_end = fit_pieces(words, total.v, pieces, logp, rounds if total.v else 0)
    discount = min(max(total.n1 / max(total.n1 + 2 * total.n2, 1), 0.1), 0.9)
    spelled = discount * total.v / n if n else 0.5
    log_word = float(np.log1p(-n_texts / n)) if n > n_texts else float(np.log(0.5))
    shared = docs.sparkSession.sparkContext.broadcast((pieces, logp))

    def marginal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for t in _chunks(batches):
            seen = np.maximum(t["c"].to_numpy() - discount, 0) / max(n, 1)
            pieced = lattice.words(t["word"].to_pylist())[0] + log_end
            with np.errstate(divide="ignore"):
                lp = np.logaddexp(np.log(seen), pieced + np.log(spelled)) / np.log(10)
            table = pa.table({"word": t["word"], "c": t["c"], "lp": pa.array(lp), "pp": pa.array((pieced + log_word) / np.log(10))})
            yield from table.to_batches()

    scored = staged(words.mapInArrow(marginal, "word binary, c long, lp double, pp double"), "lm-scored")

    blocked, _ = in_blocks(plain.select("doc_id", "text"), "doc_id", block_bytes)

    def distinct(rows: pa.Table) -> pa.Table:
        found: set[bytes] = set()
        for t in rows["text"].to_pylist():
            if t:
                found.update(t.encode("utf-8", "surrogatepass").lower().split())
        return pa.table({"block": pa.array([rows["block"][0].as_py()] * len(found), pa.int32()), "word": pa.array(list(found), pa.binary())})

    wanted = blocked.groupBy("block").applyInArrow(distinct, "block int, word binary").join(scored, "word")
    unit, floor = float(np.log10(n + 0.5 * (v + 1))), float(np.log10(0.5))
    base_end, end = float(np.log10(n_texts + 0.5) - unit) if n_texts else float(floor - unit), float(np.log10(n_texts / n if n else 0.5))

    def place(texts: pa.Table, known: pa.Table) -> pa.Table:
        index = dict(zip(known["word"].to_pylist(), range(known.num_rows), strict=True)).__getitem__
        c, lp, pp = (known[k].to_numpy() for k in ("c", "lp", "pp"))
        base, seen = np.log10(c + 0.5) - unit, c > 0
        rows = []
        for t in texts["text"].to_pylist():
            at = np.fromiter(map(index, t.encode("utf-8", "surrogatepass").lower().split()), np.int64) if t else np.zeros(0, np.int64)
            rows.append((len(at) + 1, int(seen[at].sum()) + (n_texts > 0), n, float(base[at].sum()) + base_end, float(lp[at].sum()) + end, float(pp[at].sum()) + end))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 3 + [pa.float64()] * 3
        names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "piece_score"]
        return pa.table({"doc_id": texts["doc_id"]} | {k: pa.array(x, t) for k, x, t in zip(names, cols, kinds, strict=True)})

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, piece_score double"
    return blocked.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(place, schema)
