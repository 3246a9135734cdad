"""Home and work from where and when rides begin and end, and the direction of rides between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, geo
from .grouping import dbscan


def endpoints(rides: DataFrame) -> DataFrame:
    """endpoint, kind, lat, lon, seconds: two rows a ride, when it starts and when it ends."""
    seconds = dates.seconds_of_day(F.col("start_local"))
    a = rides.filter("start_lat is not null and start_lon is not null").select((F.col("id") * 2).alias("endpoint"), F.lit("start").alias("kind"), F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon"), seconds.alias("seconds"))
    end = dates.seconds_of_day(F.col("start_local") + F.make_dt_interval(secs=F.col("elapsed_time")))
    b = rides.filter("end_lat is not null and end_lon is not null").select((F.col("id") * 2 + 1).alias("endpoint"), F.lit("end").alias("kind"), F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon"), end.alias("seconds"))
    return a.unionByName(b)


def cluster_statistics(ends: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, n, lat, lon, radius_m, starts, ends, and mean seconds of departures and arrivals."""
    rows = ends.join(clusters, "endpoint")
    is_start = F.col("kind") == "start"
    s = rows.groupBy("cluster").agg(
        F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.sum(F.when(is_start, 1).otherwise(0)).alias("starts"), F.sum(F.when(~is_start, 1).otherwise(0)).alias("ends"),
        F.floor(F.avg(F.when(is_start, F.col("seconds")))).alias("departure"), F.floor(F.avg(F.when(~is_start, F.col("seconds")))).alias("arrival"),
    )
    middle = s.select("cluster", F.col("lat").alias("mlat"), F.col("lon").alias("mlon"))
    far = rows.join(middle, "cluster").groupBy("cluster").agg(F.max(geo.geodesic_m(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon"))).alias("radius_m"))
    return s.join(far, "cluster")


def home_and_work(rides: DataFrame, eps: float, least: int) -> DataFrame:
    """The two largest clusters, named. A morning departure and an evening arrival speak for home; of equals the second is home."""
    ends = endpoints(rides)
    s = cluster_statistics(ends, dbscan(ends.select("endpoint", F.col("lat").alias("x"), F.col("lon").alias("y")), "endpoint", eps, least))
    two = s.orderBy(F.desc("n"), "cluster").limit(2)
    homely = F.when(F.col("departure").between(6 * 3600, 10 * 3600), 1).otherwise(0) + F.when(F.col("arrival").between(16 * 3600, 20 * 3600), 1).otherwise(0)
    w = Window.orderBy(F.desc("n"), "cluster")
    ranked = two.withColumn("size_rank", F.row_number().over(w)).withColumn("homely", homely)
    first = F.row_number().over(Window.orderBy(F.desc("homely"), F.desc("size_rank")))
    return ranked.withColumn("place", F.when(first == 1, "home").otherwise("work")).drop("size_rank")


def direction(rides: DataFrame, home: tuple[float, float], work: tuple[float, float], near_m: float = 500.0) -> Column:
    """home_to_work or work_to_home where both ends are near; null otherwise."""
    near = lambda side, at: geo.geodesic_m(F.col(f"{side}_lat"), F.col(f"{side}_lon"), F.lit(at[0]), F.lit(at[1])) < near_m
    return F.when(near("start", home) & near("end", work), "home_to_work").when(near("start", work) & near("end", home), "work_to_home")


def out_and_back(coords: Column, radius_m: float = 150.0, share: float = 0.7) -> Column:
    """Whether so many points of the way back lie within a box around a point of the way out."""
    half = F.floor(F.size(coords) / 2).cast("int")
    out, back = F.slice(coords, F.lit(1), half), F.slice(coords, half + 1, F.size(coords) - half)
    high = F.lit(radius_m / 111_320)
    wide = radius_m / (F.greatest(F.lit(0.01), F.abs(F.cos(F.radians(F.get(coords, F.lit(0))["lat"])))) * 111_320)
    near = F.filter(back, lambda r: F.exists(out, lambda o: (F.abs(r["lat"] - o["lat"]) <= high) & (F.abs(r["lon"] - o["lon"]) <= wide)))
    return (F.size(coords) >= 4) & (F.size(near) / F.size(back) >= share)
