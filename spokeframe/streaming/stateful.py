"""Streams of rides and weather: upserts, expiry, throttled alerts, and windows over events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rollups import upsert


def upsert_batches(read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], key: str = "id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each batch into a stored table; of a batch's rows of one key the last by start_date wins. Late rows simply land."""

    def merge(batch: DataFrame, _: int) -> None:
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.coalesce("start_date", F.lit(""))).alias("r")).select("r.*")
        old = read()
        write(latest if old is None else upsert(old, latest, key))

    return merge


def throttle(alerts: DataFrame, key: str, at: str, hours: float = 6.0) -> DataFrame:
    """Alerts of which each key has at most one in so many hours. State holds one time a key and goes after that time."""
    gap_us = int(hours * 3_600_000_000)
    schema = alerts.schema

    def passed(_: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(at)
        keep = []
        for stamp in (rows[at].astype("datetime64[us]").astype("int64")).tolist():
            keep.append(last is None or stamp - last >= gap_us)
            last = stamp if keep[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max((last + gap_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[keep]

    watched = alerts.withWatermark(at, f"{int(hours * 60)} minutes")
    return watched.groupBy(key).applyInPandasWithState(passed, schema, "last_us long", "append", GroupStateTimeout.EventTimeTimeout)


def latest_fresh(rows: DataFrame, key: list[str], at: str, now: str, fresh_hours: float = 2.0, usable_hours: float = 24.0) -> DataFrame:
    """The latest row of each key with its age in hours, unless it has expired, and whether it is stale."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 3.6e9
    known = rows.withColumn("age_hours", age).filter((F.col("age_hours") >= 0) & (F.col("age_hours") < usable_hours))
    best = known.groupBy(*key).agg(F.min_by(F.struct(*[c for c in known.columns if c not in key]), "age_hours").alias("r"))
    return best.select(*key, "r.*").withColumn("is_stale", F.col("age_hours") >= fresh_hours)


def event_windows(events: DataFrame, at: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and kind, dropping what comes later than `late`. An addition of this engine."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
