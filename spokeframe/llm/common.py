"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialise, ready, running, shared_dir, table

__all__ = ["fresh", "materialise", "parts", "ready", "row_hash", "running", "shared_dir", "table", "times"]


def fresh(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_hash(docs: DataFrame) -> Column:
    """One hash of all columns of a row; of maps, which have no hash, that of their JSON."""
    hashed = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if any(kind in f.dataType.simpleString() for kind in ("map<", "variant")) else F.col(f"`{f.name}`")
    return F.xxhash64(*[hashed(f) for f in docs.schema.fields])


def parts(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that a worker makes Python objects of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Copies of a row that are made at a time.
COPIES = 1000


def times(rows: DataFrame, copies: str) -> DataFrame:
    """Rows as often as their copies say, some COPIES at a time; adds copy, from 0."""
    many = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col(copies) - 1) / COPIES))))
    many = many.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least(F.lit(COPIES), F.col(copies) - F.col("part") * COPIES) - 1)))
    return many.withColumn("copy", F.col("part") * COPIES + F.col("copy")).drop("part")
