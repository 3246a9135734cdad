"""Geometry on latitude and longitude as column expressions; tracks are arrays of (lat, lon) structs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: WGS 84: half the equator's width, and the flattening.
EQUATOR_M, FLATTENING = 6_378_137.0, 1 / 298.257223563


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(a)) * (2 * EARTH_M)


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """On the ellipsoid, by Lambert's formula for long lines, which is within 1e-5 of the distance: 5 mm of 500 m."""
    one, two = (F.atan(F.tan(F.radians(lat)) * (1 - FLATTENING)) for lat in (lat1, lat2))
    h = F.pow(F.sin((two - one) / 2), 2) + F.cos(one) * F.cos(two) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    arc = F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * 2
    p, q = (one + two) / 2, (two - one) / 2
    x = (arc - F.sin(arc)) * F.pow(F.sin(p) * F.cos(q), 2) / F.nullif(1.0 - h, F.lit(0.0))
    y = (arc + F.sin(arc)) * F.pow(F.cos(p) * F.sin(q), 2) / F.nullif(h, F.lit(0.0))
    turned = F.when(arc.isNotNull(), F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return (arc - turned * (FLATTENING / 2)) * EQUATOR_M


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from 0 to 360."""
    across = F.radians(lon2 - lon1)
    y = F.sin(across) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(across)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def quadrant(degrees: Column) -> Column:
    return F.when(degrees < 90, "NE").when(degrees < 180, "SE").when(degrees < 270, "SW").otherwise("NW")


def next_quadrant(name: Column) -> Column:
    return F.when(name == "NE", "SE").when(name == "SE", "SW").when(name == "SW", "NW").when(name == "NW", "NE")


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * float(2**zoom)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    return F.floor((1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0 * float(2**zoom)).cast("long")


def tile_west(x: Column, zoom: int) -> Column:
    return x / float(2**zoom) * 360.0 - 180.0


def tile_north(y: Column, zoom: int) -> Column:
    return F.degrees(F.atan(F.sinh((1.0 - y * 2.0 / float(2**zoom)) * math.pi)))


def displace(lat: Column, lon: Column, km: Column, degrees: Column) -> tuple[Column, Column]:
    """The point so far away in this direction on the sphere."""
    d, b, lat1 = km / (EARTH_M / 1000), F.radians(degrees), F.radians(lat)
    lat2 = F.asin(F.sin(lat1) * F.cos(d) + F.cos(lat1) * F.sin(d) * F.cos(b))
    turned = F.atan2(F.sin(b) * F.sin(d) * F.cos(lat1), F.cos(d) - F.sin(lat1) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(F.radians(lon) + turned)


def bbox(coords: Column) -> Column:
    lat, lon = coords.getField("lat"), coords.getField("lon")
    return F.struct(F.array_min(lat).alias("min_lat"), F.array_min(lon).alias("min_lon"), F.array_max(lat).alias("max_lat"), F.array_max(lon).alias("max_lon"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def mean(values: Column) -> Column:
    return total(values) / F.nullif(F.size(values), F.lit(0))


def segments(coords: Column) -> Column:
    """Consecutive points as (lat1, lon1, lat2, lon2)."""
    steps = F.sequence(F.lit(1), F.size(coords) - 1)
    pairs = F.transform(steps, lambda i: F.struct(F.get(coords, i - 1)["lat"].alias("lat1"), F.get(coords, i - 1)["lon"].alias("lon1"), F.get(coords, i)["lat"].alias("lat2"), F.get(coords, i)["lon"].alias("lon2")))
    return F.when(F.size(coords) > 1, pairs).otherwise(F.slice(pairs, 1, 0))


def path_length_deg(coords: Column) -> Column:
    return total(F.transform(segments(coords), lambda s: F.hypot(s["lat2"] - s["lat1"], s["lon2"] - s["lon1"])))


def to_km(coords: Column) -> Column:
    """Points on a plane in km; a degree of longitude is that at the track's own mean latitude."""
    wide = F.cos(F.radians(mean(coords.getField("lat")))) * 111.32
    return F.transform(coords, lambda p: F.struct((p["lat"] * 111.32).alias("lat"), (p["lon"] * wide).alias("lon")))


def extent_point(points: Column) -> Column:
    """The first of the points farthest from the start."""
    start = F.get(points, F.lit(0))
    far = F.transform(points, lambda p, i: F.struct(F.hypot(p["lat"] - start["lat"], p["lon"] - start["lon"]).alias("d"), (-i).alias("i"), p.alias("p")))
    return F.array_max(far)["p"]


def box_overlap(a: Column, b: Column) -> Column:
    """Common area of two boxes over the smaller one's; 0 where they share none."""
    high = F.greatest(F.lit(0.0), F.least(a["max_lat"], b["max_lat"]) - F.greatest(a["min_lat"], b["min_lat"]))
    wide = F.greatest(F.lit(0.0), F.least(a["max_lon"], b["max_lon"]) - F.greatest(a["min_lon"], b["min_lon"]))
    area = lambda x: (x["max_lat"] - x["min_lat"]) * (x["max_lon"] - x["min_lon"])
    smaller = F.least(area(a), area(b))
    return F.when((high * wide > 0) & (smaller > 0), high * wide / smaller).otherwise(0.0)


def inside(lat: Column, lon: Column, ring: Column) -> Column:
    """Whether a ray from the point crosses the ring's edges an odd number of times."""
    n = F.size(ring)

    def crossed(i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, F.pmod(i - 1 + n, n))
        at = (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"]
        return F.when(((p["lat"] > lat) != (q["lat"] > lat)) & (lon < at), 1).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crossed), F.lit(0), lambda acc, x: acc + x) % 2 == 1


def is_loop(coords: Column, within_m: float = 500.0) -> Column:
    a, b = F.get(coords, F.lit(0)), F.element_at(coords, -1)
    return geodesic_m(a["lat"], a["lon"], b["lat"], b["lon"]) < within_m


def route_type(coords: Column, loop_km: float = 0.5) -> Column:
    """loop, out-and-back or point-to-point, from the points at the quarters."""
    n = F.size(coords)
    at = lambda i: F.get(coords, i.cast("int"))
    km = lambda a, b: haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]) / 1000.0
    start, end, middle = at(F.lit(0)), F.element_at(coords, -1), at(F.floor(n / 2))
    to_middle, retrace = km(start, middle), km(at(F.floor(n / 4)), at(F.floor(n * 3 / 4)))
    closed = (n >= 4) & (km(start, end) <= loop_km)
    return F.when(closed & (to_middle > 1.0) & (retrace < to_middle * 0.3), "out-and-back").when(closed, "loop").otherwise("point-to-point")


def sampled(coords: Column, every: int = 5, above: int = 100) -> Column:
    """Each so many-th point of tracks with more points than `above`."""
    return F.when(F.size(coords) > above, F.filter(coords, lambda _, i: i % every == 0)).otherwise(coords)
