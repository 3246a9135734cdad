"""The whole analysis of a rider's history, from rides to scored groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..operators import grouping, locations, ranking, similarity
from ..shared import materialise


def analyse(rides: DataFrame, wind_kph: float, wind_from: float, config: EngineConfig = EngineConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rides: id, start_local, elapsed_time, moving_time, distance, total_elevation_gain, average_speed, start and end, coords.

    Gives home and work, the members of route groups, and the ranked groups. The pairs of similar tracks are written
    before grouping, as they are what costs.
    """
    places = materialise(locations.home_and_work(rides, config.cluster_eps_deg, config.cluster_min), "places")
    at = {r["place"]: (r["lat"], r["lon"]) for r in places.collect()}  # two rows
    if len(at) < 2:
        raise ValueError("the rides have no two places where they often start or end")
    ways = rides.withColumn("direction", locations.direction(rides, at["home"], at["work"], config.near_m)).filter("direction is not null and size(coords) > 1")
    routes = materialise(ways.select(F.col("id").alias("activity_id"), "direction", "distance", F.col("moving_time").alias("duration"), F.col("total_elevation_gain").alias("elevation_gain"), "average_speed", "coords"), "routes")
    edges = materialise(similarity.commute_pairs(routes, "activity_id", ["direction"], config.similarity).select("a", "b"), "pairs")
    grouped = grouping.pivot_groups(routes, edges, "activity_id", "activity_id").join(routes.select("activity_id", "direction"), "activity_id")
    members = materialise(grouping.number_groups(grouped, "direction", "activity_id").select("activity_id", "group_id"), "members")
    ranked = ranking.rank_routes(routes.join(members, "activity_id"), wind_kph, wind_from, by="direction", config=config)
    return places, members, ranked
