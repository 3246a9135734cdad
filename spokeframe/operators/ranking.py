"""Ranking of routes by score, and what follows the order of points: midpoints, runs, turns, wind by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import geo, scores, wind
from ..shared import running
from .rollups import group_metrics


def with_bounds(groups: DataFrame) -> DataFrame:
    """Adds the smallest and largest duration and distance and the most uses: one row, sent to all tasks."""
    bounds = groups.agg(F.min("avg_duration").alias("min_duration"), F.max("avg_duration").alias("max_duration"), F.min("avg_distance").alias("min_distance"), F.max("avg_distance").alias("max_distance"), F.max("uses").alias("max_uses"))
    return groups.join(F.broadcast(bounds))


def group_wind(routes: DataFrame, speed: float, direction: float) -> DataFrame:
    """group_id, direction, uses and the mean head and cross wind of its routes."""
    w = routes.select("group_id", "direction", wind.wind_impact(F.col("coords"), F.lit(speed), F.lit(direction)).alias("w"))
    return w.groupBy("group_id", "direction").agg(F.count("*").alias("uses"), F.avg("w.avg_headwind_kph").alias("head"), F.avg("w.avg_crosswind_kph").alias("cross_kph"))


def rank_routes(routes: DataFrame, speed: float, direction: float, by: str | None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Groups with their four scores, the weighted sum, their place by it and the reason. `by` ranks within its values."""
    own_wind = group_wind(routes, speed, direction).select("group_id", "head", "cross_kph")
    g = with_bounds(group_metrics(routes)).join(own_wind, "group_id", "left")
    c = F.col
    scored = g.select(
        "group_id", "direction", "uses",
        scores.time_score(c("avg_duration"), c("min_duration"), c("max_duration"), c("consistency")).alias("time"),
        scores.falling(c("avg_distance"), c("min_distance"), c("max_distance")).alias("distance"),
        scores.safety_score(c("uses"), c("max_uses"), c("avg_elevation"), c("consistency")).alias("safety"),
        scores.weather_score(c("head"), c("cross_kph")).alias("weather"),
    )
    total = sum((c(name) * weight for name, weight in config.weights.items()), F.lit(0.0))
    scored = running(scored.withColumn("score", total), [F.desc("score"), F.col("group_id").asc()], by=[by] if by else None).withColumn("place", F.col("place") + 1)
    return scored.withColumn("reason", scores.recommendation_reason(c("time"), c("distance"), c("safety"), c("weather")))


def cumulative_midpoint(points: DataFrame, key: str) -> DataFrame:
    """key, idx of the first point at or beyond half of the way."""
    w = Window.partitionBy(key).orderBy("idx")
    step = F.coalesce(geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    cum = points.withColumn("step", step).withColumn("cum", F.sum("step").over(w)).withColumn("total", F.sum("step").over(Window.partitionBy(key)))
    return cum.filter("cum >= total / 2").groupBy(key).agg(F.min("idx").alias("idx"))


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, run, value, points, pct: stretches of equal values on end."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    numbered = df.withColumn("__changed", changed).withColumn("run", F.sum("__changed").over(w))
    found = numbered.groupBy(key, "run", value).agg(F.count("*").alias("points"))
    return found.withColumn("pct", F.col("points") * 100.0 / F.sum("points").over(Window.partitionBy(key)))


def turns(tracks: DataFrame, key: str, least: float = 30.0) -> DataFrame:
    """key, idx of points where the direction changes by `least` degrees, looked at every so many points as the track's length allows."""
    size = F.least(F.lit(10), F.floor(F.size("coords") / 10)).cast("int")
    t = tracks.withColumn("w", size).filter("w > 0").withColumn("idx", F.explode(F.sequence(F.col("w"), F.size("coords") - F.col("w") - 1, F.col("w"))))
    p, a, b = (F.get("coords", i) for i in (F.col("idx"), F.col("idx") - F.col("w"), F.col("idx") + F.col("w")))
    turn = F.abs(geo.bearing(p["lat"], p["lon"], b["lat"], b["lon"]) - geo.bearing(a["lat"], a["lon"], p["lat"], p["lon"]))
    return t.filter(F.least(turn, 360 - turn) >= least).select(key, "idx")


def ride_wind(tracks: DataFrame, wind_direction: float) -> DataFrame:
    """vec_id and how wind suits the halves of a ride in up to eight segments: 0.3 for the first, 0.7 for the second half."""
    n = F.greatest(F.lit(1), F.least(F.lit(8), F.floor(F.size("coords") / 10))).cast("int")
    t = tracks.filter(F.size("coords") >= 4).withColumn("n", n).withColumn("size", F.floor(F.size("coords") / F.col("n")).cast("int"))

    def score(i):
        a, b = F.get("coords", i * F.col("size")), F.get("coords", F.least((i + 1) * F.col("size"), F.size("coords") - 1))
        angle = F.abs(F.pmod(F.lit(wind_direction) - geo.bearing(a["lat"], a["lon"], b["lat"], b["lon"]) + 180, F.lit(360.0)) - 180)
        return F.when(angle < 45, 0.3).when(angle > 135, 1.0).when(angle < 90, 0.5).otherwise(0.8)

    each = F.transform(F.sequence(F.lit(0), F.col("n") - 1), score)
    half = F.floor(F.col("n") / 2).cast("int")
    mean = lambda x: F.when(F.size(x) > 0, geo.mean(x)).otherwise(0.5)
    halves = t.select("vec_id", mean(F.slice(each, F.lit(1), half)).alias("first_half"), mean(F.slice(each, half + 1, F.col("n") - half)).alias("second_half"))
    both = F.col("first_half") * 0.3 + F.col("second_half") * 0.7
    return halves.withColumn("score", F.when(F.round("second_half", 9) > 0.8, F.least(F.lit(1.0), both * 1.1)).otherwise(both))
