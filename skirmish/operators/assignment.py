"""Seats for the members of a side, by dynamic programming over sets of taken seats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Evidence counts in units of 1 / UNIT, so that ties are exact.
UNIT = 1_000_000_000


def best_seats(evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best total and order of seats for each side: evidence is (sides, members, seats) in whole units.

    Each member has a seat of its own, or, where members outnumber the seats, as few as must have none (seat number `seats`).
    Ties go to the smaller order. Work grows with members x 2**seats, for all sides at once.
    """
    sides, members, seats = evidence.shape
    spare, none = max(members - seats, 0), np.iinfo(np.int64).min // 4
    value = np.full((sides, 1 << seats, spare + 1), none, np.int64)
    code = np.zeros_like(value)
    value[:, 0, 0] = 0
    for i in range(members):
        new, order = np.full_like(value, none), np.zeros_like(code)
        for taken in range(1 << seats):
            for s in range(seats + 1):
                if s < seats and taken >> s & 1 == 0:
                    to, v, c = (taken | 1 << s, slice(None)), value[:, taken] + evidence[:, i, s, None], code[:, taken]
                elif s == seats and spare:
                    to, v, c = (taken, slice(1, None)), value[:, taken, :-1], code[:, taken, :-1]
                else:
                    continue
                c = c * (seats + 1) + s
                held, known = new[:, to[0], to[1]], order[:, to[0], to[1]]
                better = (v > none // 2) & ((v > held) | ((v == held) & (c < known)))
                new[:, to[0], to[1]] = np.where(better, v, held)
                order[:, to[0], to[1]] = np.where(better, c, known)
        value, code = new, order
    value, code = value[:, :, spare], code[:, :, spare]
    most = value.max(1)
    return most, np.where(value == most[:, None], code, np.iinfo(np.int64).max).min(1)


def assign(sides: DataFrame, keys: list[str], seats: int) -> DataFrame:
    """sides (keys, evidence: an array of a member's array of `seats` longs) with seats, a letter a member (`-`: none), and value, their total in whole units.

    A side is a row; its members are few. keys are longs. Sides without members have an empty order and value 0.
    """
    schema = ", ".join([*[f"{k} long" for k in keys], "seats string", "value long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, part in batch.groupby(batch["evidence"].map(len)):
                e = np.array([np.concatenate(x) if n else [] for x in part["evidence"]], np.int64).reshape(len(part), n, seats)
                value, code = best_seats(e)
                digits = [[int(c) // (seats + 1) ** (n - 1 - i) % (seats + 1) for i in range(n)] for c in code]
                names = ["".join("-" if d == seats else str(d) for d in x) for x in digits]
                yield part[keys].assign(seats=names, value=value)

    return sides.select(*[F.col(k).cast("long").alias(k) for k in keys], "evidence").mapInPandas(run, schema)
