"""Approximate nearest neighbours by collision counting over sorted single projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most vectors of a block of the index, fewest where there are more cores than blocks, and queries whose windows are looked up at once.
BLOCK, LEAST_BLOCK, CHUNK = 65536, 4096, 64
#: Projections, share of them in which a candidate must collide, first radius of the windows and its growth.
PROJECTIONS, THRESHOLD, RADIUS, GROWTH = 128, 0.6, 0.25, 1.15
#: Windows stop growing when a vector as near as the k-th best would collide this many standard deviations above the threshold.
CERTAINTY = 0.5
SEED = 7


def reached(distance: float, radius: float) -> bool:
    """Whether a unit vector at this distance from the query is a candidate at this radius, nearly for certain.

    Its projections differ from the query's by a normal variable with this standard deviation.
    """
    p = math.erf(radius / (math.sqrt(2) * distance)) if distance > 0 else 1.0
    return p - CERTAINTY * math.sqrt(p * (1 - p) / PROJECTIONS) >= THRESHOLD


class Index:
    """A block's vectors and, for each projection, its sorted values and the rows in their order."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.axes = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        values = np.ascontiguousarray(((vectors / self.norms[:, None]) @ self.axes).T)
        self.order = np.empty(values.shape, np.int32)
        self.sorted = values
        for order, row in zip(self.order, values, strict=True):
            order[:] = np.argsort(row, kind="stable")
            row[:] = row[order]

    def windows(self, values: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first row and the row after the last of each window: by query, radius and projection."""
        ends = [np.empty((len(values), len(radii), PROJECTIONS), np.int32) for _ in range(2)]
        for p, s in enumerate(self.sorted):
            ends[0][:, :, p] = s.searchsorted(values[:, p, None] - radii)
            ends[1][:, :, p] = s.searchsorted(values[:, p, None] + radii, "right")
        return ends[0], ends[1]

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[list[tuple[float, int]], int]]:
        """For each query with its id in own, the k best found, as (-score, id) in order, and how many vectors were verified.

        Windows round the query's own value in each projection grow by GROWTH (virtual rehashing), the last one to everything.
        Each round counts what they newly cover, and verifies the rows that now collide in THRESHOLD of the projections.
        """
        norms = np.sqrt((queries * queries).sum(1))
        values = (queries / norms[:, None]) @ self.axes
        widest = max(RADIUS, float(np.ptp(self.sorted)) + float(np.ptp(values)))
        radii = RADIUS * GROWTH ** np.arange(math.ceil(math.log(widest / RADIUS, GROWTH)) + 1)
        for i in range(0, len(queries), CHUNK):
            low, high = self.windows(values[i : i + CHUNK], radii)
            for j in range(len(low)):
                yield self._one(queries[i + j], norms[i + j], own[i + j], k, radii, low[j].tolist(), high[j].tolist())

    def _one(self, q: np.ndarray, norm: float, own: int, k: int, radii: np.ndarray, low: list[list[int]], high: list[list[int]]) -> tuple[list[tuple[float, int]], int]:
        n, need = len(self.ids), math.ceil(THRESHOLD * PROJECTIONS)
        counts, open_ = np.zeros(n, np.int64), np.ones(n, bool)
        best: list[tuple[float, int]] = []
        verified, before_a, before_b = 0, low[0], low[0]
        for radius, a, b in zip(radii, low, high, strict=True):
            new = [o[i:j] for o, i, j in zip(self.order, a, before_a, strict=True) if i < j] + [o[i:j] for o, i, j in zip(self.order, before_b, b, strict=True) if i < j]
            before_a, before_b = a, b
            if not new:
                continue
            counts += np.bincount(np.concatenate(new), minlength=n)
            found = np.flatnonzero((counts >= need) & open_)
            if len(found):
                open_[found] = False
                verified += len(found)
                found = found[self.ids[found] != own]
                score = (self.vectors[found] @ q) / (self.norms[found] * norm)
                first = np.lexsort((self.ids[found], -score))[:k]
                best = sorted([*best, *((-float(score[i]), int(self.ids[found[i]])) for i in first)])[:k]
            if verified == n or (len(best) == k and reached(math.sqrt(max(0.0, 2 + 2 * best[-1][0])), radius)):
                break
        return best, verified


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k nearest found vectors of each query by cosine: query_id, rank, vec_id, score.

    vectors: vec_id, embedding; is_query: a condition on vec_id. All rows but the query's own (by vec_id) are candidates.
    The index is cut into blocks by a hash of vec_id. A block lies in one task, vectors first, and all queries stream through it
    in batches, so a task holds a block and a batch, and each vector is sent once, each query once for each block. A block
    gives each query its k best. A vector is verified (cosine in double precision on the given numbers) when it lies in the query's
    window in THRESHOLD of the projections; windows grow until a vector as near as the k-th best would be a candidate with
    CERTAINTY, so near neighbours end a search early. Score ties go to the smaller vec_id.

    Rows take no part if vec_id is null, or the vector is null, empty or zero or has a null or non-finite component. Vectors
    meet only vectors of their own dimension. Repeated rows with one vec_id each count as candidates. Different vectors under one
    vec_id are queries of their own, each with its list; rows equal in id and vector are one query. With fewer than k
    candidates all are returned; a query without candidates or an empty table gives no rows. Other columns are ignored.
    """
    v = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    v = v.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    n = v.count()
    blocks = max(1, -(-n // BLOCK), min(-(-n // LEAST_BLOCK), v.sparkSession.sparkContext.defaultParallelism))
    dim, key = F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("key")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("b")
    data = v.select(dim, block, F.lit(0).alias("asks"), "vec_id", F.lit(0).cast("long").alias("key"), "embedding")
    asked = v.filter(is_query).select("vec_id", "embedding", key).dropDuplicates(["vec_id", "key"])
    asked = asked.select(dim, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("asks"), "vec_id", "key", "embedding")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index, at = None, None

        def matrix(rows: list[pa.RecordBatch]) -> np.ndarray:
            return np.concatenate([r["embedding"].flatten().to_numpy().reshape(r.num_rows, -1) for r in rows])

        for batch in batches:
            place = np.stack([batch[c].to_numpy() for c in ("dim", "b", "asks")])
            cuts = np.flatnonzero(np.append(True, (place[:, 1:] != place[:, :-1]).any(0))) if batch.num_rows else []
            for begin, end in zip(cuts, [*cuts[1:], batch.num_rows]):
                part, (dims, b, asks) = batch.slice(begin, end - begin), place[:, begin].tolist()
                if (dims, b) != at:
                    held, index, at = [], None, (dims, b)
                if not asks:
                    held.append(part)
                    continue
                if index is None and held:
                    index, held = Index(matrix(held), np.concatenate([r["vec_id"].to_numpy() for r in held])), []
                if index is not None:
                    ids, keys = part["vec_id"].to_numpy(), part["key"].to_numpy()
                    out = [(i, key, j, -s) for i, key, (best, _) in zip(ids, keys, index.search(matrix([part]), ids, k), strict=True) for s, j in best]
                    columns = list(zip(*out, strict=True)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "key", "vec_id", "score"])

    near = data.unionAll(asked).repartition("dim", "b").sortWithinPartitions("dim", "b", "asks").mapInArrow(stream, "query_id long, key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
