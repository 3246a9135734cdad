"""What was derived from files, kept until a file changes.

The key of a file is its path, time of modification and size, as the listing tells them. What is stored for a file with the same key is taken as it
is; only other files are read. What is stored of files that are gone or changed is dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import materialise
from . import store

KEY = ["__file", "__modified", "__size"]


def with_file(df: DataFrame) -> DataFrame:
    """Adds the key of each row's file; to be called on what a reader gives."""
    m = lambda name: F.col(f"_metadata.{name}")
    return df.select("*", m("file_path").alias("__file"), m("file_modification_time").alias("__modified"), m("file_size").alias("__size"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """__file, __modified, __size of the files in a folder; nothing of them is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return listed.select(F.col("_metadata.file_path").alias("__file"), F.col("modificationTime").alias("__modified"), F.col("length").alias("__size"))


def remembered(spark: SparkSession, path: str, root: str, read: Callable[[Any], DataFrame], pattern: str = "*") -> tuple[DataFrame, dict[str, int]]:
    """What `read` derives from the files of a folder, and how many files were read and kept. read: takes paths, or the folder, and gives rows with the key of their file."""
    now = materialise(files(spark, path, pattern), "files")
    counts: dict[str, int] = {}

    def change(old: DataFrame | None, at: dict[str, Any] | None) -> tuple[DataFrame, dict[str, Any]] | None:
        known = spark.read.parquet(f"{root}/{at['folder']}-files") if at else None
        changed = now.join(known, KEY, "left_anti") if known is not None else now
        counts.update(read=changed.count(), kept=now.count())
        counts["kept"] -= counts["read"]
        if at and not counts["read"] and counts["kept"] == known.count():
            return None
        everything = known is None or not counts["kept"]
        fresh = read(path) if everything else (read([r["__file"] for r in changed.select("__file").toLocalIterator()]) if counts["read"] else None)
        kept = None if everything else old.join(now, KEY, "left_semi")
        rows = fresh if kept is None else kept if fresh is None else kept.unionByName(fresh)
        return rows, {}

    at = store.update(spark, root, change, lambda folder: now.write.parquet(f"{folder}-files"))
    return spark.read.parquet(f"{root}/{at['folder']}").drop(*KEY), counts
