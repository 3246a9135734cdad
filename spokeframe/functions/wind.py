"""Wind and weather as column expressions. Wind comes from its direction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import bearing, haversine_m

# Compass points and weather codes.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
CODES = {
    "Clear Sky": (0,), "Mainly Clear": (1,), "Partly Cloudy": (2,), "Overcast": (3,), "Foggy": (45, 48),
    "Drizzle": (51, 53, 55), "Rain": (61, 63, 65), "Snow": (71, 73, 75, 77), "Rain Showers": (80, 81, 82),
    "Snow Showers": (85, 86), "Thunderstorm": (95, 96, 99),
}


def compass_even(degrees: Column) -> Column:
    """The nearest of 16 points; halves go to the even one."""
    return F.get(F.array(*[F.lit(c) for c in COMPASS]), F.pmod(F.bround((degrees / 22.5).cast("double"), 0).cast("int"), F.lit(16)))


def compass_up(degrees: Column) -> Column:
    """The nearest of 16 points; halves go up."""
    return F.get(F.array(*[F.lit(c) for c in COMPASS]), F.pmod(F.floor((degrees + 11.25) / 22.5).cast("int"), F.lit(16)))


def conditions(code: Column) -> Column:
    out = F.lit("Unknown")
    for text, codes in CODES.items():
        out = F.when(code.isin(*codes), text).otherwise(out)
    return out


def relative_angle(wind_direction: Column, travel: Column) -> Column:
    """Wind against travel from -180 (excluded) to 180."""
    turned = F.pmod(wind_direction - travel, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def headwind(speed: Column, wind_direction: Column, travel: Column) -> Column:
    return speed * F.cos(F.radians(relative_angle(wind_direction, travel)))


def crosswind(speed: Column, wind_direction: Column, travel: Column) -> Column:
    return F.abs(speed * F.sin(F.radians(relative_angle(wind_direction, travel))))


def sampled_segments(coords: Column, rate: int = 10) -> Column:
    """Places 0, rate, 2 rate ... of segments, and always the last one."""
    last = F.size(coords) - 2
    return F.array_union(F.sequence(F.lit(0), last, F.lit(rate)), F.array(last))


def wind_impact(coords: Column, speed: Column, direction: Column, rate: int = 10) -> Column:
    """Means of head and cross wind weighted by the sampled segments' lengths, largest values, time penalty and a verdict."""

    def part(i: Column) -> Column:
        a, b = F.get(coords, i), F.get(coords, i + 1)
        at = bearing(a["lat"], a["lon"], b["lat"], b["lon"])
        return F.struct(headwind(speed, direction, at).alias("head"), crosswind(speed, direction, at).alias("cross"), (haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]) / 1000.0).alias("km"))

    parts = F.transform(sampled_segments(coords, rate), part)
    summed = lambda f: F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + f(x))
    km = summed(lambda x: x["km"])
    head = F.when(km > 0, summed(lambda x: x["head"] * x["km"]) / km).otherwise(0.0)
    cross = F.when(km > 0, summed(lambda x: x["cross"] * x["km"]) / km).otherwise(0.0)
    result = F.struct(
        head.alias("avg_headwind_kph"),
        cross.alias("avg_crosswind_kph"),
        F.array_max(F.transform(parts, lambda x: x["head"])).alias("max_headwind_kph"),
        F.array_max(F.transform(parts, lambda x: x["cross"])).alias("max_crosswind_kph"),
        (head * F.when(head > 0, 1.5).otherwise(1.0) + cross * 0.5).alias("time_penalty_pct"),
        F.when(head < -5, "favorable").when(head > 5, "unfavorable").otherwise("neutral").alias("wind_favorability"),
    )
    return F.when(F.size(coords) >= 2, result)
