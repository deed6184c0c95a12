"""Live telemetry as streams: staleness, deduplication, suppression, stability, freezing and grace."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType


def state_hash(phase: str = "phase", t: str = "t", lead: str = "lead", extra: tuple[str, ...] = ()) -> Column:
    """A signature of the state in buckets: half minutes and 250 of lead."""
    return F.sha2(F.concat_ws("|", F.col(phase), F.floor(F.col(t) / 30).cast("string"), F.round(F.col(lead) / 250).cast("long").cast("string"), *[F.col(c).cast("string") for c in extra]).cast("binary"), 256)


def fresh(rows: DataFrame, now: Column, updated: str = "t", seconds: int = 300) -> DataFrame:
    return rows.filter(now - F.col(updated) <= seconds)


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "5 minutes") -> DataFrame:
    """First row of each key among those within the watermark; state is dropped behind it. time: a timestamp with zone."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def suppressed(stream: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Rows of matches that aren't completed (a static table)."""
    return stream.join(completed.select(key).distinct(), key, "left_anti")


def call_budget(stream: DataFrame, time: str, window: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Calls in each tumbling window."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window)).agg(F.count("*").alias("calls"))


def progress(stream: DataFrame, key: str, time: str, won: Column, gap: str = "8 hours", delay: str = "1 day") -> DataFrame:
    """Series as session windows: maps, wins and whether a majority of the format is reached."""
    got = stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("maps"), F.count_if(won).alias("wins"))
    best_of = F.when(F.col("maps") >= 4, 5).when(F.col("maps") >= 2, 3).otherwise(1)
    return got.withColumn("complete", F.greatest("wins", F.col("maps") - F.col("wins")) >= F.floor(best_of / 2) + 1)


FROZEN = StructType([StructField("match_id", LongType()), StructField("hash", StringType()), StructField("stable", LongType()), StructField("frozen", StringType())])


class Freeze(StatefulProcessor):
    """Counts equal picks in a row per match, and freezes the prediction of each new hash at the given count."""

    def __init__(self, needed: int = 2):
        self.needed = needed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("freeze", "hash string, stable long, frozen string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, stable, frozen = self.state.get() if self.state.exists() else (None, 0, None)
        for batch in rows:
            for h in batch.sort_values("t", kind="stable")["hash"]:
                stable = stable + 1 if h == last else 1
                last = h
                if stable >= self.needed and frozen != h:
                    frozen = h
        self.state.update((last, stable, frozen))
        yield pd.DataFrame({"match_id": [key[0]], "hash": [last], "stable": [stable], "frozen": [frozen]})

    def close(self) -> None:
        pass


def frozen(stream: DataFrame, needed: int = 2) -> DataFrame:
    """match_id, hash, stable, frozen for each match of a micro-batch. stream: match_id, t, hash. Needs the RocksDB state store."""
    return stream.groupBy("match_id").transformWithStateInPandas(Freeze(needed), FROZEN, "Update", "None")


RETAINED = StructType([StructField("match_id", LongType()), StructField("t", LongType()), StructField("retained", StringType())])


class Grace(StatefulProcessor):
    """Keeps a match that vanished for a while: when the watermark is past its grace, an event-time timer reports it as expired and forgets it."""

    def __init__(self, seconds: int = 120):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t = max([int(b["t"].max()) for b in rows] + ([self.state.get()[0]] if self.state.exists() else []))
        self.state.update((t,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(1000 * (t + self.seconds))
        yield pd.DataFrame({"match_id": [key[0]], "t": [t], "retained": ["fresh"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        t = self.state.get()[0] if self.state.exists() else 0
        self.state.clear()
        yield pd.DataFrame({"match_id": [key[0]], "t": [t], "retained": ["expired"]})

    def close(self) -> None:
        pass


def with_grace(stream: DataFrame, seconds: int = 120, delay: str = "0 seconds") -> DataFrame:
    """match_id, t, retained (fresh, or expired once grace is over in event time). stream: match_id, t in seconds."""
    timed = stream.withColumn("_at", F.timestamp_seconds("t")).withWatermark("_at", delay)
    return timed.groupBy("match_id").transformWithStateInPandas(Grace(seconds), RETAINED, "Update", "EventTime")


def overlay(stream: DataFrame, state: DataFrame, key: str, running: Column) -> DataFrame:
    """Live rows of the map being played, with the columns of a materialised read model: a stream joined to a static table."""
    return stream.filter(running).join(state, key, "left")
