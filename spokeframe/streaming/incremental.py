"""Analysis that keeps up with what comes: each batch of tracks decides what to do, and changes the stored groups once.

A batch without new or removed tracks is a hit and changes nothing; new ones only are merged into the stored groups; where tracks are
removed, all that are left are grouped anew. The stored table notes the batches it holds, so a batch that is run twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.grouping import what_to_analyse
from ..operators.merging import merge_tracks
from ..shared import materialise
from ..sources import store

TRACK = ["id", "direction", "ord", "duration", "coords"]
#: What the order of a batch's tracks is moved by, so that they come after those of earlier batches.
BATCH = 1 << 40


def analyse_batches(root: str, least: float, stream: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch. Rows: id, direction, ord, duration, coords, removed. Of a batch's rows of one id the removal wins."""

    def analysed(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = materialise(batch, "batch")

        def change(old: DataFrame | None, at: dict[str, Any] | None) -> tuple[DataFrame, dict[str, Any]] | None:
            batches = dict(at["batches"]) if at else {}
            if batches.get(stream, -1) >= number:
                return None
            empty = spark.createDataFrame([], rows.drop("removed").schema).withColumns({"group_id": F.lit(""), "place": F.lit(0)})
            known = old if old is not None else empty
            gone = rows.filter("removed").select("id").distinct()
            come = rows.filter("not removed").join(gone, "id", "left_anti").dropDuplicates(["id"]).withColumn("ord", F.col("ord") + number * BATCH)
            now = known.select("id").join(gone, "id", "left_anti").unionByName(come.select("id"))
            told = what_to_analyse(known.select("id"), now, "id").first().asDict()
            note = {"batches": {**batches, stream: number}, "analysis": told["analysis"], "new": told["new"], "removed": told["removed"]}
            if told["analysis"] == "hit":
                return known.select(*TRACK, "group_id", "place", *(["frequency", "rep"] if old is not None else [])), note
            fresh = come.join(known.select("id"), "id", "left_anti").select(*TRACK)
            left = known.join(gone, "id", "left_anti")
            every = materialise(left.select(*TRACK).unionByName(fresh), "tracks")
            full = told["analysis"] == "full" or old is None
            groups = merge_tracks(empty, every, least) if full else merge_tracks(known, fresh, least)
            return groups.select("id", "group_id", "frequency", "place", "rep").join(every, "id"), note

        store.update(spark, root, change)

    return analysed


def keep_up(tracks: DataFrame, root: str, checkpoint: str, least: float) -> None:
    """Analyses what the stream has by now, batch by batch, and stops; started again with the checkpoint, it goes on after the last batch."""
    tracks.writeStream.foreachBatch(analyse_batches(root, least, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
