"""Roll-ups of rides: one aggregation each, combined on the map side before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import local_start, month_label, period_bounds, week_label
from ..functions.units import even, feet, hours, miles, mph, truthy
from ..shared import running


def summary_columns() -> list[Column]:
    """Totals and means of rides in display units; speed, heart rate and energy count only where they are not zero."""
    n = F.count(F.lit(1))
    distance, elevation = F.sum("distance"), F.sum("total_elevation_gain")
    return [
        n.alias("total_rides"),
        F.coalesce(even(miles(distance), 1), F.lit(0.0)).alias("total_distance_mi"),
        F.coalesce(even(hours(F.sum("moving_time")), 1), F.lit(0.0)).alias("total_time_h"),
        F.coalesce(even(feet(elevation)), F.lit(0.0)).alias("total_elevation_ft"),
        F.coalesce(even(miles(distance / n), 1), F.lit(0.0)).alias("avg_distance_mi"),
        F.coalesce(even(mph(F.avg(truthy(F.col("average_speed")))), 1), F.lit(0.0)).alias("avg_speed_mph"),
        F.coalesce(even(feet(elevation / n)), F.lit(0.0)).alias("avg_elevation_ft"),
        even(F.avg(truthy(F.col("average_heartrate"))), 1).alias("avg_heartrate"),
        F.coalesce(F.sum("kudos_count"), F.lit(0)).alias("total_kudos"),
        F.coalesce(even(F.sum(truthy(F.col("kilojoules"))), 1), F.lit(0.0)).alias("total_kilojoules"),
    ]


def summary(rides: DataFrame, *by: Column) -> DataFrame:
    """One row a group; without groups one row, of zeros where there are no rides."""
    return (rides.groupBy(*by) if by else rides).agg(*summary_columns())


def sport(rides: DataFrame) -> Column:
    return F.coalesce(F.nullif("sport_type", F.lit("")), F.nullif("type", F.lit("")), F.lit("Unknown"))


def in_period(rides: DataFrame, period: str, now: str) -> DataFrame:
    """Rides of a period by their own clock; all but all_time need a start_date as well."""
    start, end = period_bounds(period, now)
    local = local_start(F.col("start_date_local"), F.col("start_date"))
    if start is not None:
        rides = rides.filter(F.col("start_date").isNotNull() & (local >= start))
    return rides.filter(local <= end) if end is not None else rides


def by_label(rides: DataFrame, label: Column, name: str, last: int) -> DataFrame:
    """Summaries of the last so many labels that occur."""
    own = summary(rides.filter("start_date is not null"), label.alias(name))
    return own.orderBy(F.desc(name)).limit(last)


def by_week(rides: DataFrame, last: int = 52) -> DataFrame:
    return by_label(rides, week_label(F.col("start_local")), "week", last)


def by_month(rides: DataFrame, last: int = 24) -> DataFrame:
    return by_label(rides, month_label(F.col("start_local")), "month", last)


def calendar(rides: DataFrame, month: str) -> DataFrame:
    """A row for each day of the month, also for days without rides."""
    first = F.to_date(F.lit(f"{month}-01"))
    days = rides.sparkSession.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("day"))
    own = summary(rides.filter(F.date_format("start_local", "yyyy-MM") == month), F.to_date("start_local").alias("ridden"))
    joined = days.join(own, F.col("day") == F.col("ridden"), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) if c != "avg_heartrate" else F.col(c) for c in own.columns if c != "ridden"]
    return joined.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *zero)


def by_gear(rides: DataFrame, gear: DataFrame) -> DataFrame:
    """Summaries by gear with its name and type; rides without gear are one group of their own."""
    local_day = F.date_format("start_local", "yyyy-MM-dd")
    own = rides.groupBy("gear_id").agg(*summary_columns(), F.coalesce(F.max(local_day), F.lit("")).alias("last_used"))
    meta = gear.select(F.col("id").alias("of"), "name", "type")
    joined = own.join(meta, own["gear_id"] == meta["of"], "left").drop("of")
    return joined.withColumn("name", F.coalesce("name", "gear_id", F.lit("unassigned"))).withColumn("type", F.coalesce("type", F.lit("unknown")))


def records(rides: DataFrame) -> DataFrame:
    """Longest, highest, fastest and hardest ride; of equals the first one by id."""
    ride = F.struct("id", "name", F.date_format("start_local", "yyyy-MM-dd").alias("date"), "distance", "average_speed", "total_elevation_gain", "moving_time")
    best = lambda metric: F.max_by(ride, F.struct(metric, -F.col("id")))
    kinds = {"longest_ride": F.col("distance"), "most_elevation": F.col("total_elevation_gain"), "fastest_speed": F.col("average_speed"), "most_kilojoules": truthy(F.col("kilojoules"))}
    one = rides.agg(*[(F.max_by(ride, F.when(m.isNotNull(), F.struct(m, -F.col("id")))) if k == "most_kilojoules" else best(m)).alias(k) for k, m in kinds.items()])
    rows = one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*kinds))).alias("record", "ride"))
    return rows.filter("ride is not null").select(
        "record", "ride.id", "ride.name", "ride.date",
        even(miles(F.col("ride.distance")), 1).alias("distance_mi"), even(mph(F.col("ride.average_speed")), 1).alias("speed_mph"),
        even(feet(F.col("ride.total_elevation_gain"))).alias("elevation_ft"), even(hours(F.col("ride.moving_time")), 1).alias("time_h"),
    )


def histogram(values: DataFrame, value: str, width: int) -> DataFrame:
    """label, min, max, count of bins of this width from the lowest to the highest that occurs, empty ones too."""
    bins = values.filter(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("long").alias("min")).agg(F.count("*").alias("n"))
    spine = bins.agg(F.min("min").alias("a"), F.max("min").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("min"))
    return spine.join(bins, "min", "left").select(F.concat_ws("-", "min", F.col("min") + width).alias("label"), "min", (F.col("min") + width).alias("max"), F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def speed_histogram(rides: DataFrame) -> DataFrame:
    return histogram(rides.filter("average_speed > 0").select(even(mph(F.col("average_speed")), 1).alias("v")), "v", 2)


def climb_histogram(rides: DataFrame) -> DataFrame:
    return histogram(rides.filter("total_elevation_gain > 0").select(even(feet(F.col("total_elevation_gain"))).alias("v")), "v", 250)


def group_metrics(routes: DataFrame) -> DataFrame:
    """Means, spread and steadiness of each group's routes; the standard deviation is the population's."""
    mean, spread = F.avg("duration"), F.stddev_pop("duration")
    return routes.groupBy("group_id").agg(
        F.min("direction").alias("direction"), F.count("*").alias("uses"), mean.alias("avg_duration"), spread.alias("std_duration"), F.avg("distance").alias("avg_distance"),
        F.avg("average_speed").alias("avg_speed"), F.avg("elevation_gain").alias("avg_elevation"),
        F.when(mean > 0, F.greatest(F.lit(0.0), 1 - spread / mean)).otherwise(0.0).alias("consistency"),
    )


def plus_routes(routes: DataFrame, ratio: float = 1.15) -> DataFrame:
    """Flags routes longer than `ratio` times their direction's median. The medians, a row a direction, are joined to the routes."""
    medians = routes.groupBy("direction").agg(F.percentile("distance", F.lit(0.5)).alias("median"))
    return routes.join(medians, "direction").withColumn("is_plus_route", F.col("distance") > F.col("median") * ratio)


def representative(routes: DataFrame) -> DataFrame:
    """Each group's route in the upper middle by duration, then by id. Places in a group are counted range by range, so a group of any size is spread."""
    placed = running(routes, [F.col("duration").asc(), F.col("activity_id").asc()], by=["group_id"])
    n = routes.groupBy("group_id").agg(F.count("*").alias("__n"))
    return placed.join(n, "group_id").filter(F.col("place") == F.floor(F.col("__n") / 2)).select(*routes.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "start_date") -> DataFrame:
    """Rows by key where the incoming one wins; newest first, without a date last."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__new"))
    return both.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__new", "__rank").orderBy(F.col(order).desc_nulls_last(), key)


def upsert_counts(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    joined = old.select(F.col(key).alias("a")).join(new.select(F.col(key).alias("b")), F.col("a") == F.col("b"), "full")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return joined.agg(n(F.col("a").isNull()).alias("new"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("updated"), F.count("*").alias("total"), n(F.col("a").isNotNull()).alias("previous_total"))


def members(rows: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """rows with `place`, from 0, in the order within their `by`, and `uses`, how many have it. Places are counted range by range, counts come from partial sums."""
    placed = running(rows, order, by=[by])
    uses = rows.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("uses"))
    return placed.join(uses, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
