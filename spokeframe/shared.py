"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes of an Arrow batch to Python workers, where the session has Spark's own default of 64 MB.
BATCH = "8m"


def ready(spark: SparkSession) -> None:
    """Lets Python workers on this host import the package from where the driver has it, and bounds what a worker holds.

    Long texts make large batches, of which each task has copies in the JVM and in its worker; so batches are smaller,
    and workers give freed memory back.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    env.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")
    env.setdefault("MALLOC_TRIM_THRESHOLD_", str(1 << 20))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("64MB", "64m", f"{1 << 26}b", str(1 << 26)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_machine(master: str) -> bool:
    return master == "local" or master.startswith(("local[", "local-cluster["))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset and all runs on one machine, as in tests, a temporary one is set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not one_machine(sc.master):
            raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="spokeframe-")
        sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/spokeframe-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the name of its file system, as readers outside the JVM need it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM has gone first; the cluster's own retention removes the folder
        pass


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes the rows to the shared folder and reads them back: a lost executor repeats nothing before this point."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(rows: DataFrame, order: list[Column], sums: dict[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds `place`, from 0, in an order over all rows (or all of each `by`), and under new names the sums of columns over the rows before.

    Rows are dealt out by ranges of the order, so each task sorts one range; a row a range, read back from a written
    table, carries on what the ranges before it hold. Rows that tie in the order are in one range.
    """
    by, sums = by or [], sums or {}
    ranged = materialise(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = {"place": F.count("*"), **{name: F.sum(column) for column, name in sums.items()}}
    held = ranged.groupBy(*by, "__range").agg(*[t.alias(f"__{name}") for name, t in totals.items()])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    firsts = held.select(F.col("__range").alias("__of"), *[F.col(c).alias(f"__by_{c}") for c in by], *[zero(F.sum(f"__{name}").over(earlier)).alias(f"__{name}") for name in totals])
    own = Window.partitionBy("__range", *by).orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.withColumns({"place": (F.row_number().over(own) - 1).cast("long"), **{name: zero(F.sum(column).over(before)) for column, name in sums.items()}})
    same = F.col("__range") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    found = found.join(firsts, same).withColumns({name: F.col(name) + F.col(f"__{name}") for name in totals})
    return found.select(*rows.columns, *totals)
