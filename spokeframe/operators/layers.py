"""Layers of a map: which groups are drawn, with what points, and where the map is centred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo

# Colours of groups by place, and that of the recommended commute.
COLOURS = ("#007bff", "#28a745", "#dc3545", "#ffc107", "#17a2b8", "#6f42c1", "#fd7e14", "#20c997")
RECOMMENDED = "#28a745"


def or_first(rows: DataFrame, chosen: Column, order: list[Column], most: int = 5) -> DataFrame:
    """The chosen rows; where none is, the first ones in the order, so many at most. That any is chosen is one row for all."""
    any_ = rows.agg(F.coalesce(F.max(F.coalesce(chosen, F.lit(False))), F.lit(False)).alias("__any"))
    first = rows.orderBy(*order).limit(most).join(F.broadcast(any_.filter("not __any")))
    return rows.filter(F.coalesce(chosen, F.lit(False))).unionByName(first.drop("__any"))


def commute_groups(groups: DataFrame) -> DataFrame:
    """Groups named or typed as commutes, or else the first five. groups: ord, name, and route_type where there is one."""
    named = F.lower(F.coalesce("name", F.lit(""))).contains("commute")
    typed = F.coalesce(F.col("route_type") == "commute", F.lit(False)) if "route_type" in groups.columns else F.lit(False)
    return or_first(groups, named | typed, [F.col("ord")])


def map_layers(groups: DataFrame, most: int = 10, shown: int | None = 3, recommended: bool = False) -> DataFrame:
    """groups: ord, name, coords. place, name, show, colour, coords, center_lat, center_lon of the first groups in their order, those without a track left out but counted.

    The centre is the mean of all points of those groups. Long tracks are drawn with every fifth point. All is shown where `shown` is None; of
    commutes the first has the colour of the recommended one. The groups are `most` at most, so one task numbers them.
    """
    top = groups.orderBy("ord").limit(most)
    points = top.select(F.explode("coords").alias("p")).agg(F.avg("p.lat").alias("center_lat"), F.avg("p.lon").alias("center_lon"))
    placed = top.withColumn("place", F.row_number().over(Window.orderBy("ord")) - 1).filter(F.size("coords") > 0)
    colour = F.get(F.array(*[F.lit(c) for c in COLOURS]), F.col("place") % len(COLOURS))
    colour = F.when(F.col("place") == 0, RECOMMENDED).otherwise(colour) if recommended else colour
    drawn = placed.select("place", F.col("name"), F.lit(True).alias("show") if shown is None else (F.col("place") < shown).alias("show"), colour.alias("colour"), geo.sampled(F.col("coords")).alias("coords"))
    return drawn.join(F.broadcast(points))


def merged_coverage(boxes: DataFrame, tiles: DataFrame) -> DataFrame:
    """boxes: box, total_in_bounds. tiles: box, x, y. visited_count, total_in_bounds, coverage_pct of all boxes together: tiles count once, totals add up."""
    seen = tiles.select("x", "y").distinct().agg(F.count("*").alias("visited_count"))
    total = boxes.agg(F.coalesce(F.sum("total_in_bounds"), F.lit(0)).alias("total_in_bounds"))
    share = F.col("visited_count") / F.nullif("total_in_bounds", F.lit(0)) * 1000
    return seen.join(F.broadcast(total)).withColumn("coverage_pct", F.coalesce(F.floor(share + 0.5) / 10, F.lit(0.0)))
