"""Streams of events: what is seen for the first time in a while, sessions, and answers that follow questions.

Each runs until its input is used up (availableNow) and stops; a run that is started again
goes on from its checkpoint, and its sink takes each micro-batch once.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.sources.shared import ship

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class _FirstSeen(StatefulProcessor):
    """Keeps the time (microseconds) a key was last seen; a timer drops it once the watermark is past the time after which it counts as new."""

    def __init__(self, gap: timedelta) -> None:
        self.gap = gap // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def _expiry(self, us: int) -> int:
        return (us + self.gap) // 1000 + 1

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = np.sort(pd.concat([r["us"] for r in rows]).to_numpy())
        last = self.last.get()[0] if self.last.exists() else None
        since = np.diff(times, prepend=times[0] - self.gap - 1 if last is None else last)
        seen = int(times[-1]) if last is None else max(last, int(times[-1]))
        self.last.update((seen,))
        self.handle.registerTimer(self._expiry(seen))
        yield pd.DataFrame({"key": key[0], "us": times[since > self.gap]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists() and self._expiry(self.last.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "us": np.zeros(0, np.int64)})

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, key: str, gap: timedelta, late: str = "10 minutes") -> DataFrame:
    """key, ts: events of a key that has not been seen for longer than `gap` (on any earlier event), or never.

    events has `ts`; rows later than the watermark are dropped. State is one time a key, and
    goes when the watermark passes its expiry. Needs the RocksDB state store.
    """
    ship(events.sparkSession)
    rows = events.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", late)
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.groupBy("key").transformWithStateInPandas(_FirstSeen(gap), f"key {kind}, us long", "Append", "EventTime")
    return found.select("key", F.timestamp_micros("us").alias("ts"))


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """key, started, ended, n: runs of a key's events no two of which are `gap` apart, once the watermark is past their end."""
    rows = events.withWatermark("ts", late).groupBy(F.col(key).alias("key"), F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def answered(questions: DataFrame, answers: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """key, question_id, answer_id: answers (key, answer_id, ts) that follow a question (key, question_id, ts) of the same key within a time.

    Both streams are kept only as long as the watermarks and `within` allow a match.
    """
    q = questions.select(F.col(key).alias("key"), "question_id", F.col("ts").alias("asked")).withWatermark("asked", late)
    a = answers.select(F.col(key).alias("k"), "answer_id", F.col("ts").alias("told")).withWatermark("told", late)
    return q.join(a, F.expr(f"key = k AND told > asked AND told <= asked + interval {within}")).select("key", "question_id", "answer_id")


def drained(stream: DataFrame, folder: str, name: str, rocks: bool = False) -> DataFrame:
    """Runs an append stream until its source is used up; returns what it wrote, read by its committed batches."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    if rocks:
        spark.conf.set(PROVIDER, ROCKS)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if rocks:
            spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}")


def replayed(events: DataFrame, folder: str, name: str, ts: str = "ts", batches: int = 4) -> DataFrame:
    """A stored table as a stream of a few batches in order of time, as they would arrive; times without a zone are taken as the session's."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    spark, path = events.sparkSession, f"{folder}/{name}"
    ends = events.agg(F.min(ts).alias("a"), F.max(ts).alias("b")).first()
    if ends.a is not None:
        step = (ends.b - ends.a) / batches
        for i in range(batches):
            lo, hi = ends.a + step * i, ends.a + step * (i + 1)
            inside = (F.col(ts) >= F.lit(lo)) & ((F.col(ts) < F.lit(hi)) if i < batches - 1 else F.lit(True))
            events.where(inside).coalesce(1).write.mode("append").parquet(path)
    else:
        events.write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
