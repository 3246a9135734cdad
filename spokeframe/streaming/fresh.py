"""Freshness of stored answers as state with expiry.

State of a key is the newest answer and the last one that was given. Asking gets the same answer for a while, then the newest one: fresh, flagged as
stale, or none once it has expired. Timers at the times of expiry remove both; time to live is no way, as Spark has it by the machine's clock only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR_MS = 3_600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fresh(StatefulProcessor):
    """Rows of a key: at, asks, value. Answers of rows that ask: key, at, value, age_hours, is_stale, from_memo; value and age are null where nothing usable is stored."""

    def __init__(self, fresh_hours: float, usable_hours: float, memo_seconds: float) -> None:
        self.fresh_ms, self.usable_ms, self.memo_ms = int(fresh_hours * HOUR_MS), int(usable_hours * HOUR_MS), int(memo_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "at_us long, value long")
        self.given = handle.getValueState("given", "at_us long, value long, value_at_us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        stored = self.stored.get() if self.stored.exists() else None
        given = self.given.get() if self.given.exists() else None
        was, gave, out = stored, given, []
        every = pd.concat(list(rows)).sort_values(["at", "asks"])
        for at, asks, value in zip(every["at"].astype("datetime64[us]").astype("int64").tolist(), every["asks"].tolist(), every["value"].tolist()):
            if not asks:
                if stored is None or at >= stored[0]:
                    stored = (at, int(value))
                continue
            memo = given is not None and 0 <= at - given[0] < self.memo_ms * 1000
            if not memo:
                usable = stored is not None and 0 <= at - stored[0] < self.usable_ms * 1000
                given = (at, stored[1], stored[0]) if usable else None
            age = None if given is None else (at - given[2]) / 3.6e9
            out.append((key[0], pd.Timestamp(at, unit="us"), None if given is None else given[1], age, None if age is None else age * HOUR_MS >= self.fresh_ms, memo))
        soon = timerValues.getCurrentWatermarkInMs() + 1
        for state, new, old, ends in ((self.stored, stored, was, self.usable_ms), (self.given, given, gave, self.memo_ms)):
            if new is not None and new != old:
                state.update(new)
                self.handle.registerTimer(max(new[0] // 1000 + ends + 1, soon))
        found = pd.DataFrame(out, columns=["key", "at", "value", "age_hours", "is_stale", "from_memo"])
        yield found.astype({"value": "Int64", "age_hours": "Float64", "is_stale": "boolean", "from_memo": "boolean"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for state, ends in ((self.stored, self.usable_ms), (self.given, self.memo_ms)):
            if state.exists() and state.get()[0] // 1000 + ends < now:
                state.clear()
        return iter([])

    def close(self) -> None:
        pass


def answers(rows: DataFrame, fresh_hours: float = 2.0, usable_hours: float = 24.0, memo_seconds: float = 600.0, late: str = "1 hour") -> DataFrame:
    """rows: a stream of key (long), at, asks, value (long). What rows that ask are answered. Rows that come later than `late` are dropped.

    The session's state store must be RocksDB (`ROCKS`) when the query starts.
    """
    kept = rows.select(F.col("key").cast("long").alias("key"), "at", "asks", F.col("value").cast("long").alias("value")).withWatermark("at", late)
    schema = "key long, at timestamp, value long, age_hours double, is_stale boolean, from_memo boolean"
    return kept.groupBy("key").transformWithStateInPandas(Fresh(fresh_hours, usable_hours, memo_seconds), schema, "append", "eventtime")


def run_available(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what is there by now to a table, and stops. A further call goes on from the checkpoint."""
    kind = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(kind)
    spark.conf.set(kind, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(kind, before)
