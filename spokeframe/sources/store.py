"""A stored table that is replaced whole: rows are written beside it, then published by a pointer.

Each version is a folder of its own and a pointer, a small file named by the version's number that can be made only once.
Of two writers that start from one version, one makes the next pointer; the other reads what came first and
merges again. A job that dies before its pointer leaves the version before as it was. On a file system without exclusive creation
(some object stores) one writer at a time is allowed.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.rollups import upsert, upsert_counts

POINTER = "pointer-"
#: Times that an update starts anew because another writer came first.
TRIES = 50


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def make_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with the text; false, and nothing done, where there is one."""
    hadoop, files = _files(spark, path)
    if files.getScheme() == "file":
        target = hadoop.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        own = f"{target}.{uuid.uuid4().hex}"
        with open(own, "w") as f:
            f.write(text)
        try:
            os.link(own, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    if files.exists(hadoop):
        return False
    try:
        out = files.create(hadoop, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def current(spark: SparkSession, root: str) -> dict[str, Any] | None:
    """What the newest pointer says: version, folder, and what its writer noted."""
    hadoop, files = _files(spark, root)
    if not files.exists(hadoop):
        return None
    names = [s.getPath().getName() for s in files.listStatus(hadoop)]
    numbers = [int(n[len(POINTER) :]) for n in names if n.startswith(POINTER) and n[len(POINTER) :].isdigit()]
    if not numbers:
        return None
    stream = files.open(_files(spark, f"{root}/{POINTER}{max(numbers)}")[0])
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, root: str) -> DataFrame | None:
    at = current(spark, root)
    return spark.read.parquet(f"{root}/{at['folder']}") if at else None


def update(spark: SparkSession, root: str, change: Callable[[DataFrame | None, dict[str, Any] | None], tuple[DataFrame, dict[str, Any]] | None], beside: Callable[[str], None] | None = None) -> dict[str, Any] | None:
    """Replaces the table by what `change` makes of it and of its pointer, and notes what it says. `change` runs again where another writer came first; it may say None: nothing to do. `beside` writes what belongs to a version next to its folder."""
    for _ in range(TRIES):
        at = current(spark, root)
        made = change(spark.read.parquet(f"{root}/{at['folder']}") if at else None, at)
        if made is None:
            return at
        rows, note = made
        version = (at["version"] if at else 0) + 1
        folder = f"version-{version}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{root}/{folder}")
        if beside:
            beside(f"{root}/{folder}")
        pointer = {**note, "version": version, "folder": folder}
        if make_once(spark, f"{root}/{POINTER}{version}", json.dumps(pointer)):
            return pointer
        unused, files = _files(spark, f"{root}/{folder}")
        files.delete(unused, True)
    raise RuntimeError(f"other writers came first {TRIES} times")


def merged(old: DataFrame | None, rows: DataFrame, note: dict[str, Any], key: str = "id", order: str = "start_date") -> tuple[DataFrame, dict[str, Any]]:
    """What `update` is to write: the table with the rows merged by key, and the note with how many are new, updated and in all."""
    counts = upsert_counts(old if old is not None else rows.limit(0), rows, key).first().asDict()
    return (rows.orderBy(rows[order].desc_nulls_last(), key) if old is None else upsert(old, rows, key, order)), {**counts, **note}


def merge(spark: SparkSession, root: str, rows: DataFrame, key: str = "id", order: str = "start_date", stream: str = "", batch: int | None = None) -> dict[str, Any]:
    """Merges rows by key and notes how many are new, updated and in all. A batch of a stream that is in the table already changes nothing."""

    def change(old: DataFrame | None, at: dict[str, Any] | None) -> tuple[DataFrame, dict[str, Any]] | None:
        batches = dict(at["batches"]) if at else {}
        if batch is not None and batches.get(stream, -1) >= batch:
            return None
        note = {"batches": {**batches, **({stream: batch} if batch is not None else {})}, **({"left": at["left"]} if at and "left" in at else {})}
        return merged(old, rows, note, key, order)

    found = update(spark, root, change)
    assert found is not None
    return found
