"""Language identification: multinomial logistic regression on TF-IDF character n-grams, fitted by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import mix64, text_slices

#: Hash buckets of n-grams (a power of two), and the longest n-gram.
BUCKETS, LONGEST = 1 << 16, 3
#: Most labelled documents in the fit; every 5th of them only sets the temperature.
SAMPLE_DOCS = 5000
#: TF-IDF vectors are n-gram shares times IDF times this constant.
SCALE = 10.0

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


class Grams:
    """Bucket of each n-gram of a batch of texts, in the order of the texts. Letters in lower case; all else is a blank, runs of blanks one."""

    def __init__(self, texts: list[str | None]):
        low = [" " + t.lower() + " " if t else "  " for t in texts]
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        alpha = _letters()[codes]
        doc = np.repeat(np.arange(len(low)), sizes)
        self.has_letter = np.bincount(doc, weights=alpha, minlength=len(low)) > 0
        keep = alpha.copy()
        if len(codes):
            keep[1:] |= alpha[:-1]  # a blank right after a letter
            keep[np.cumsum(sizes) - sizes] = True
        codes, self.doc = np.where(alpha, codes, 32)[keep].astype(np.uint64), doc[keep]
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, LONGEST + 1):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
            same = self.doc[: len(h)] == self.doc[n - 1 :]
            self.parts.append(((mix64(h) >> np.uint64(48)).astype(np.int32) & (BUCKETS - 1), same))

    def by_text(self, n_texts: int) -> Iterator[np.ndarray]:
        """The buckets of each text's n-grams."""
        edges = [(b[s], np.searchsorted(self.doc[: len(b)][s], np.arange(n_texts + 1))) for b, s in self.parts]
        for i in range(n_texts):
            yield np.concatenate([b[e[i] : e[i + 1]] for b, e in edges]) if edges else np.zeros(0, np.int32)

    def counts(self, n_texts: int) -> Iterator[np.ndarray]:
        """The bucket counts of each text."""
        for buckets in self.by_text(n_texts):
            yield np.bincount(buckets, minlength=BUCKETS)

    def scores(self, weights: np.ndarray, n_texts: int) -> np.ndarray:
        """Mean over a text's n-grams of the rows of weights (buckets x classes)."""
        total, n = np.zeros((n_texts, weights.shape[1])), np.zeros(n_texts)
        for b, s in self.parts:
            doc, b = self.doc[: len(b)][s], b[s]
            n += np.bincount(doc, minlength=n_texts)
            for c in range(weights.shape[1]):
                total[:, c] += np.bincount(doc, weights=weights[b, c], minlength=n_texts)
        return total / np.maximum(n, 1)[:, None]


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray = field(repr=False)  # buckets x classes, times IDF and scale
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams = Grams(texts)
        logit = (grams.scores(self.weights, len(texts)) + self.bias) / self.temperature
        p = np.exp(logit - logit.max(1, keepdims=True)) if len(texts) else logit
        p = p / p.sum(1, keepdims=True)
        best = p.argmax(1) if len(texts) else np.zeros(0, int)
        known = grams.has_letter
        return [self.classes[c] if k else "und" for c, k in zip(best, known, strict=True)], np.where(known, p.max(1) if len(texts) else 0.0, 0.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for softmax regression: weights (buckets x classes, sparse by l1) and bias."""
    z, n = np.zeros((BUCKETS + 1, n_classes)), np.zeros((BUCKETS + 1, n_classes))

    def solve(i) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for index, value, label in rows:
            i, x = np.append(index, BUCKETS), np.append(value, 1.0)
            w = solve(i)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    w = solve(slice(None))
    return w[:BUCKETS], w[BUCKETS]


def best_temperature(logit: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least log loss on a geometric grid from 1/20 to 20."""
    grid = np.geomspace(0.05, 20, 241)

    def loss(t: float) -> float:
        s = logit / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(label)), label]))

    return float(grid[int(np.argmin([loss(t) for t in grid]))]) if len(label) else 1.0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all texts each bucket occurs, and the number of texts. Workers send one vector each; 64 groups add them up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        df, n = np.zeros(BUCKETS, np.int64), 0
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            col = batch["text"].tolist()
            for a, b in text_slices(col):
                for buckets in Grams(col[a:b]).by_text(b - a):
                    seen[buckets] = True
                    at = np.flatnonzero(seen)
                    df[at] += 1
                    seen[at] = False
                    n += 1
        yield pd.DataFrame({"part": [TaskContext.get().partitionId() % 64], "n": [n], "df": [df.tobytes()]})

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS, np.int64)
        for x in rows["df"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"part": [0], "n": [int(rows["n"].sum())], "df": [total.tobytes()]})

    schema = "part int, n long, df binary"
    got = add(texts.select("text").mapInPandas(run, schema).groupBy("part").applyInPandas(add, schema).toPandas())
    return np.frombuffer(got["df"][0], np.int64), int(got["n"][0])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the columns text and lang of docs (rows with a null in either are not used).

    Document frequencies cover all rows. The regression is fitted to at most sample_docs different texts, the first in the
    order of a hash of the text, whatever their copies; a fifth of them is held back for the temperature. Copies that disagree
    take the least of their languages. Texts of any length, empty ones too, count whole; ties of probability go to the first
    language by code point. Without a row with both columns (empty tables among them) the model knows `und` alone. Other
    columns are ignored.
    """
    known = docs.select(docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang")).dropna()
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    keys = known.select("text", "lang", F.xxhash64("text").alias("key"))
    top = keys.select("key").distinct().orderBy("key").limit(sample_docs).agg(F.max("key").alias("k"), F.count("*").alias("n")).first()
    if not top.n:
        return Model(["und"], np.zeros((BUCKETS, 1)), np.zeros(1))
    some = keys.filter(F.col("key") <= top.k).groupBy("key").agg(F.first("text").alias("text"), F.min("lang").alias("lang"))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            col = batch["text"].tolist()
            for a, b in text_slices(col):
                index, value = [], []
                for row in Grams(col[a:b]).counts(b - a):
                    at = np.flatnonzero(row)
                    index.append(at.astype(np.int32).tobytes())
                    value.append((row[at] / max(row.sum(), 1) * idf[at] * SCALE).astype(np.float32).tobytes())
                yield pd.DataFrame({"key": batch["key"].iloc[a:b].to_numpy(), "lang": batch["lang"].iloc[a:b].to_numpy(), "index": index, "value": value})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        classes = sorted(rows["lang"].unique())
        data = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32).astype(float), classes.index(c)) for i, v, c in zip(rows["index"], rows["value"], rows["lang"], strict=True)]
        held = data[::5] if len(data) >= 50 else []
        train = [r for k, r in enumerate(data) if k % 5] if held else data
        w, bias = ftrl(train, len(classes))
        logit = np.array([v @ w[i] + bias for i, v, _ in held]).reshape(-1, len(classes))
        t = best_temperature(logit, np.array([c for _, _, c in held], int))
        return pd.DataFrame({"classes": [classes], "w": [w.astype(np.float32).tobytes()], "b": [bias.tobytes()], "t": [t]})

    vec = some.mapInPandas(vectors, "key long, lang string, index binary, value binary")
    got = vec.withColumn("part", F.lit(0)).groupBy("part").applyInPandas(learn, "classes array<string>, w binary, b binary, t double").first()
    w = np.frombuffer(got.w, np.float32).reshape(BUCKETS, len(got.classes)).astype(np.float64)
    return Model(list(got.classes), w * idf[:, None] * SCALE, np.frombuffer(got.b), got.t)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability of the prediction) for every whole text.

    Null text or a text without a letter: `und` with score 0. Null doc_id stays null; repeated rows get
    equal results; other columns (lang and source among them) are no inputs; empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x classes numbers: bounded

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            col = batch["text"].tolist()
            for a, b in text_slices(col):
                lang, score = shared.value.predict(col[a:b])
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].to_numpy(), "lang_pred": lang, "score": score})

    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return plain.mapInPandas(run, "doc_id long, lang_pred string, score double")
