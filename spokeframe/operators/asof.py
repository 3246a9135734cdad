"""As-of join: to each row the last row of its key that is known by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise


def asof_join(asked: DataFrame, known: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """asked with `values` and found_<at> of the latest row of known at or before its time; null where there is none.

    Of rows known at one time, the one with the largest values is found. A null key meets null keys. Both sides are put in one order of
    key and time and dealt out by ranges of it, so a key that holds most rows is spread. In a range the last known row is carried
    forward; what a range begins with comes from the ranges of its key before, by one row a key and range. There is no product of rows.
    """
    row = F.struct(F.col(at).alias("__at"), *values)
    kept = [F.col(c).alias(f"__asked_{c}") for c in asked.columns]
    one = asked.select(F.col(key).alias("__key"), F.col(at).alias("__time"), F.lit(1).alias("__side"), *kept)
    two = known.select(F.col(key).alias("__key"), F.col(at).alias("__time"), F.lit(0).alias("__side"), row.alias("__known"))
    both = one.unionByName(two, allowMissingColumns=True)
    ranged = materialise(both.repartitionByRange("__key", "__time", "__side").withColumn("__range", F.spark_partition_id()), "asof")

    until = Window.partitionBy("__range", "__key").orderBy("__time", "__side", "__known").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("__last", F.last("__known", ignorenulls=True).over(until)).filter("__side = 1")
    earlier = Window.partitionBy("__of_key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy(F.col("__key").alias("__of_key"), F.col("__range").alias("__of")).agg(F.max("__known").alias("__end"))
    before = ends.select("__of_key", "__of", F.last("__end", ignorenulls=True).over(earlier).alias("__before")).filter("__before is not null")
    found = own.join(before, (F.col("__range") == F.col("__of")) & F.col("__key").eqNullSafe(F.col("__of_key")), "left")
    found = found.withColumn("__found", F.coalesce("__last", "__before"))
    return found.select(*[F.col(f"__asked_{c}").alias(c) for c in asked.columns], F.col("__found.__at").alias(f"found_{at}"), *[F.col(f"__found.{v}").alias(v) for v in values])
