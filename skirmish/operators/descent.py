"""Models fitted by Newton steps within convex bounds; every step is one pass of sums over the rows, for many models at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

#: A batch of rows and a model's number give the model's design: features (rows x weights), outcomes, offsets and row weights.
Design = Callable[[pd.DataFrame, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


@contextmanager
def kept(rows: DataFrame) -> Iterator[DataFrame]:
    """rows, kept on executors (what a lost one held is computed again) while several passes read them."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def settled(sums: DataFrame) -> DataFrame:
    """A small table of sums (by version and model, or version and entity), made now: once, and while what it is summed from is still kept."""
    return sums.sparkSession.createDataFrame(sums.collect(), sums.schema)


def summed(rows: DataFrame, f: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """The sum of f's vectors (of `size` numbers) over all batches of rows. Tasks add up their batches, Spark the tasks; only sums come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for batch in batches:
            if len(batch):
                total += f(batch)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "v": total[at]})

    out = np.zeros(size)
    got = rows.mapInPandas(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    out[got["at"].to_numpy(int)] = got["v"].to_numpy(float)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Bounds:
    """Least and largest value of each weight; the first `shares` weights sum to 1."""

    low: np.ndarray
    high: np.ndarray
    shares: int = 0

    @staticmethod
    def simplex(shares: int, free: int = 0) -> Bounds:
        """Weights that are not negative and sum to 1, and then free ones."""
        return Bounds(np.repeat([0.0, -np.inf], [shares, free]), np.full(shares + free, np.inf), shares)


def quadratic_minimum(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, bounds: Bounds) -> np.ndarray:
    """The x within bounds that minimises gradient.(x - w) + (x - w).hessian.(x - w) / 2, by an active set from w, which is within them. A few numbers, on the driver."""
    k = len(w)
    h = hessian + 1e-12 * max(np.trace(hessian), 1e-6) * np.eye(k)
    x, share = w.astype(float).copy(), (np.arange(k) < bounds.shares).astype(float)
    side = np.where(x <= bounds.low, -1, np.where(x >= bounds.high, 1, 0))  # the bound at which a weight is held
    for _ in range(100 * k):
        slope = gradient + h @ (x - w)
        free = np.flatnonzero(side == 0)
        move, level = np.zeros(k), 0.0
        if len(free):
            a = h[np.ix_(free, free)]
            if share[free].any():
                a = np.block([[a, share[free][:, None]], [share[free][None], np.zeros((1, 1))]])
                solved = np.linalg.lstsq(a, np.append(-slope[free], 0.0), rcond=None)[0]
                move[free], level = solved[:-1], solved[-1]
            else:
                move[free] = np.linalg.solve(a, -slope[free])
        if np.abs(move).max() < 1e-12:
            if not share[free].any() and bounds.shares:  # one share alone has all: its slope is the level
                level = -slope[: bounds.shares].min()
            pull = (slope + level * share) * side
            pull[bounds.low == bounds.high] = -1
            worst = int(np.argmax(pull))
            if pull[worst] <= 1e-12:
                break
            side[worst] = 0
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(move < 0, (bounds.low - x) / move, np.where(move > 0, (bounds.high - x) / move, np.inf))
        stop = int(np.argmin(room))
        if room[stop] <= 1:
            x = x + room[stop] * move
            x[stop], side[stop] = (bounds.low[stop], -1) if move[stop] < 0 else (bounds.high[stop], 1)
        else:
            x = x + move
    return x


def fit_bounded(rows: DataFrame, design: Design, start: np.ndarray, bounds: list[Bounds], ridge: float | np.ndarray = 0.0, steps: int = 40, tolerance: float = 1e-9) -> np.ndarray:
    """Logistic models within bounds: the weights (models x k) of least mean log loss plus ridge / 2 (one for all models, or one each) times their squares.

    Each step sums every model's loss, gradient and Hessian in one pass, and goes to the bounded minimum of the quadratic; a step
    that raises a model's loss is halved. start lies within bounds (shares sum to 1). rows are read once a step: keep them (see kept). A model without rows keeps its start.
    """
    models, k = start.shape
    span = 2 + k + k * k
    ridges = np.broadcast_to(np.asarray(ridge, float), models)

    def sums(w: np.ndarray) -> np.ndarray:
        def f(batch: pd.DataFrame) -> np.ndarray:
            out = np.zeros((models, span))
            for m in range(models):
                x, y, offset, weight = design(batch, m)
                p = sigmoid(x @ w[m] + offset)
                q = np.clip(p, 1e-12, 1 - 1e-12)
                loss = -(y * np.log(q) + (1 - y) * np.log(1 - q))
                v = weight * p * (1 - p)
                out[m] = np.concatenate([[weight.sum(), weight @ loss], x.T @ (weight * (p - y)), ((x * v[:, None]).T @ x).ravel()])
            return out.ravel()

        return summed(rows, f, models * span).reshape(models, span)

    w = np.stack([np.clip(s, b.low, b.high) for b, s in zip(bounds, start, strict=True)])
    best, held, step = np.full(models, np.inf), w.copy(), np.zeros_like(w)
    open_ = np.ones(models, bool)
    for _ in range(steps):
        got = sums(w)
        for m in np.flatnonzero(open_):
            n = got[m, 0]
            if not n:
                open_[m] = False
                continue
            loss = got[m, 1] / n + ridges[m] / 2 * w[m] @ w[m]
            if loss > best[m] + 1e-15 and np.abs(step[m]).max() > tolerance:
                step[m] /= 2
            else:
                best[m], held[m] = loss, w[m]
                gradient = got[m, 2 : 2 + k] / n + ridges[m] * w[m]
                hessian = got[m, 2 + k :].reshape(k, k) / n + ridges[m] * np.eye(k)
                step[m] = quadratic_minimum(w[m], gradient, hessian, bounds[m]) - w[m]
            open_[m] = np.abs(step[m]).max() > tolerance
            w[m] = held[m] + step[m]
        if not open_.any():
            break
    return w
