"""Exploration of unvisited tiles: what is in reach, zones, their scores, and tours through them."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..shared import materialise
from . import coverage

QUADRANTS = ("NE", "SE", "SW", "NW")
#: A tour may pass its distance by so much; a zone must give so many tiles a km; visited tiles on the way cost so much.
TOLERANCE, LEAST_PER_KM, OVERLAP = 1.15, 0.15, 0.5
#: Zones of a quadrant that a tour is built from: of one grid, of each of two, and for out and back.
POOL, POOL_OF_TWO, POOL_OUT = 12, 8, 1
INSET_M = 5.0


def reachable(visited: DataFrame, water: DataFrame, bounds: tuple, zoom: int, start: tuple[float, float], reach_km: float, area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """x, y, lat, lon, quadrant of tiles in the bounds and in reach that are neither visited nor water; with a drawn area (south, west, north, east), those whose middle is inside of it."""
    tiles = coverage.all_tiles(visited.sparkSession, bounds, zoom).join(visited.select("x", "y"), ["x", "y"], "left_anti").join(water.select("x", "y"), ["x", "y"], "left_anti")
    at = coverage.centres(tiles, zoom)
    if area:
        at = at.filter(F.col("lat").between(area[0], area[2]) & F.col("lon").between(area[1], area[3]))
    here = [F.lit(start[0]), F.lit(start[1]), F.col("lat"), F.col("lon")]
    return at.filter(geo.haversine_m(*here) / 1000 <= reach_km).withColumn("quadrant", geo.quadrant(geo.bearing(*here)))


def zones(tiles: DataFrame) -> DataFrame:
    """Adds zone within each quadrant: quadrants are told apart by their places among the tile numbers."""
    shifted = tiles.withColumn("ox", F.col("x"))
    far = F.array_position(F.array(*[F.lit(q) for q in QUADRANTS]), F.col("quadrant")) * (1 << 26)
    return coverage.flood_fill(shifted.withColumn("x", F.col("x") + far)).withColumn("x", F.col("ox")).drop("ox", "tile")


def with_neighbours(tiles: DataFrame) -> DataFrame:
    """Tiles by the tours that may take them: those of their own quadrant and of the one before it."""
    takes = F.filter(F.array(*[F.lit(q) for q in QUADRANTS]), lambda q: (q == F.col("quadrant")) | (geo.next_quadrant(q) == F.col("quadrant")))
    return tiles.withColumn("quadrant", F.explode(takes))


def border_ratio(zoned: DataFrame, visited: DataFrame) -> DataFrame:
    """zone, border_ratio: of the sides that lead out of a zone, the share that leads to visited tiles."""
    sides = F.array(*[F.struct((F.col("x") + i).alias("nx"), (F.col("y") + j).alias("ny")) for i, j in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    out = zoned.select("zone", "x", "y", F.explode(sides).alias("s")).select("zone", "s.*")
    own = zoned.select("zone", F.col("x").alias("nx"), F.col("y").alias("ny"))
    seen = visited.select(F.col("x").alias("nx"), F.col("y").alias("ny")).distinct().withColumn("seen", F.lit(1))
    rest = out.join(own, ["zone", "nx", "ny"], "left_anti").join(seen, ["nx", "ny"], "left")
    ratio = rest.groupBy("zone").agg(F.avg(F.coalesce("seen", F.lit(0))).alias("border_ratio"))
    return zoned.select("zone").distinct().join(ratio, "zone", "left").select("zone", F.coalesce("border_ratio", F.lit(0.0)).alias("border_ratio"))


def corridor_tiles(rows: DataFrame, a: tuple[str, str], b: tuple[str, str], zoom: int) -> DataFrame:
    """Adds x, y of the tiles at the inner points of a straight line, four points a km."""
    cols = [F.col(c) for c in (*a, *b)]
    steps = F.greatest(F.lit(2), F.round(geo.haversine_m(*cols) / 1000 * 4).cast("int"))
    on = rows.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("steps") - 1)))
    part = F.col("i") / F.col("steps").cast("double")
    lat, lon = F.col(a[0]) + (F.col(b[0]) - F.col(a[0])) * part, F.col(a[1]) + (F.col(b[1]) - F.col(a[1])) * part
    return on.withColumn("x", geo.tile_x(lon, zoom)).withColumn("y", geo.tile_y(lat, zoom)).drop("steps", "i")


def best_corner(zoned: DataFrame, zoom: int, start: tuple[float, float]) -> DataFrame:
    """zone, lat, lon: the corner that most of a zone's tiles share, of equals the one nearest the start, set 5 m towards the zone's middle."""
    corners = F.array(*[F.struct((F.col("x") + i).alias("cx"), (F.col("y") + j).alias("cy")) for i in (0, 1) for j in (0, 1)])
    c = zoned.select("zone", F.explode(corners).alias("c")).select("zone", "c.*").groupBy("zone", "cx", "cy").agg(F.count("*").alias("shared"))
    c = c.withColumn("lat", geo.tile_north(F.col("cy"), zoom)).withColumn("lon", geo.tile_west(F.col("cx"), zoom))
    far = F.hypot(F.col("lat") - start[0], (F.col("lon") - start[1]) * math.cos(math.radians(start[0])))
    best = c.groupBy("zone").agg(F.min(F.struct((-F.col("shared")).alias("minus"), far.alias("far"), "lat", "lon")).alias("p"))
    mid = zoned.groupBy("zone").agg(F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
    both = best.join(mid, "zone").select("zone", "p.lat", "p.lon", "mlat", "mlon")
    wide = F.cos(F.radians("lat"))
    d = F.hypot(F.col("mlat") - F.col("lat"), (F.col("mlon") - F.col("lon")) * wide)
    d = F.when(d == 0, 1.0).otherwise(d)
    return both.select("zone", (F.col("lat") + (F.col("mlat") - F.col("lat")) / d * (INSET_M / 111_320)).alias("lat"), (F.col("lon") + (F.col("mlon") - F.col("lon")) / d * (F.lit(INSET_M / 111_320) / wide)).alias("lon"))


def score_zones(zoned: DataFrame, visited: DataFrame, zoom: int, start: tuple[float, float], mode: str = "tiles") -> DataFrame:
    """quadrant, zone, n_tiles, km, border_ratio, overlap, place: zones in the order of their tiles less half of the visited tiles on the way.

    The mode orders equals: tiles by most tiles, efficiency by most tiles a km, frontier by the least share of visited border and then most
    tiles, infill by the greatest share and then the nearest.
    """
    mid = zoned.groupBy("quadrant", "zone").agg(F.count("*").alias("n_tiles"), F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
    mid = mid.withColumn("slat", F.lit(start[0])).withColumn("slon", F.lit(start[1]))
    way = corridor_tiles(mid.select("zone", "slat", "slon", "mlat", "mlon"), ("slat", "slon"), ("mlat", "mlon"), zoom)
    on = way.join(visited.select("x", "y").distinct(), ["x", "y"]).groupBy("zone").agg(F.count("*").alias("overlap"))
    km = geo.haversine_m(*[F.col(c) for c in ("slat", "slon", "mlat", "mlon")]) / 1000
    s = mid.join(on, "zone", "left").join(border_ratio(zoned, visited), "zone").select("quadrant", "zone", "n_tiles", km.alias("km"), "border_ratio", F.coalesce("overlap", F.lit(0)).alias("overlap"))
    ties = {"tiles": [F.desc("n_tiles")], "efficiency": [F.desc(F.col("n_tiles") / F.greatest("km", F.lit(0.1)))], "frontier": [F.asc("border_ratio"), F.desc("n_tiles")], "infill": [F.desc("border_ratio"), F.asc("km")]}
    order = Window.partitionBy("quadrant").orderBy(F.desc(F.col("n_tiles") - F.col("overlap") * OVERLAP), *ties[mode], "zone")
    return s.withColumn("place", F.row_number().over(order))


def haversine_km(a: tuple[float, float], b: tuple[float, float]) -> float:
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_M / 1000 * math.asin(math.sqrt(h))


def way_tiles(a: tuple[float, float], b: tuple[float, float], zoom: int) -> list[tuple[int, int]]:
    n = max(2, math.floor(haversine_km(a, b) * 4 + 0.5))
    part = np.arange(1, n) / n
    lat, lon = a[0] + (b[0] - a[0]) * part, a[1] + (b[1] - a[1]) * part
    x = np.floor((lon + 180) / 360 * 2**zoom).astype(int)
    y = np.floor((1 - np.arcsinh(np.tan(np.radians(lat))) / np.pi) / 2 * 2**zoom).astype(int)
    return list(zip(x.tolist(), y.tolist()))


def insertion_tour(start: tuple[float, float], end: tuple[float, float], zones_: list[dict], km: float, zoom: int, visited: set | dict[int, set], exponent: float) -> list[int]:
    """Places of the zones (lat, lon, n_tiles, km) in their order on the tour.

    It begins with the farthest zone. Then the zone and the place between two stops with the most new tiles for the
    detour come in, until none gives enough or the tour gets too long. Tiles on legs already chosen count as visited.
    Zones of several grids have their `zoom`, and visited holds a set for each; a leg claims tiles of the grid of the zone it came in for.
    """
    left = sorted(range(len(zones_)), key=lambda i: (-zones_[i]["km"], i))
    level, point = lambda i: zones_[i].get("zoom", zoom), lambda i: (zones_[i]["lat"], zones_[i]["lon"])
    claimed = {level(i): set() for i in left} | {z: set(t) for z, t in (visited if isinstance(visited, dict) else {zoom: visited}).items()}
    tour = [left.pop(0)] if left else []
    if tour:
        claimed[level(tour[0])].update(way_tiles(start, point(tour[0]), level(tour[0])), way_tiles(point(tour[0]), end, level(tour[0])))
    left.sort()
    length = lambda stops: sum(haversine_km(a, b) for a, b in zip([start, *map(point, stops)], [*map(point, stops), end]))
    while left:
        best = None
        for i in left:
            for at in range(len(tour) + 1):
                before, after = point(tour[at - 1]) if at else start, point(tour[at]) if at < len(tour) else end
                detour = max(haversine_km(before, point(i)) + haversine_km(point(i), after) - haversine_km(before, after), 0.01)
                known = sum(t in claimed[level(i)] for leg in ((before, point(i)), (point(i), after)) for t in way_tiles(*leg, level(i)))
                gain = max(zones_[i]["n_tiles"] - OVERLAP * known, 0.1)
                if gain / detour >= LEAST_PER_KM and (best is None or gain / detour**exponent > best[0]):
                    best = gain / detour**exponent, i, at, before, after
        if best is None:
            break
        _, i, at, before, after = best
        longer = [*tour[:at], i, *tour[at:]]
        if length(longer) > km * TOLERANCE:
            break
        claimed[level(i)].update(way_tiles(before, point(i), level(i)), way_tiles(point(i), after, level(i)))
        tour = longer
        left.remove(i)
    return tour


def headwind(wind: tuple[float, float], a: tuple[float, float], b: tuple[float, float]) -> float:
    """Of wind (speed, direction), the part that comes from ahead on the way from a to b."""
    la, lb, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    travel = math.degrees(math.atan2(math.sin(d) * math.cos(lb), math.cos(la) * math.sin(lb) - math.sin(la) * math.cos(lb) * math.cos(d)))
    return wind[0] * math.cos(math.radians(wind[1] - travel))


def _leg_tiles(rows: pd.DataFrame, start: tuple, end: tuple) -> pd.DataFrame:
    """quadrant, zoom, x, y of the tiles under all legs that a tour of these zones can have, on each grid that they are of."""
    points = [start, end, *zip(rows["lat"], rows["lon"])]
    zooms = sorted(set(rows["zoom"]))
    tiles = {(z, *t) for z in zooms for a in points for b in points if a != b for t in way_tiles(a, b, z)}
    return pd.DataFrame(sorted(tiles), columns=["zoom", "x", "y"]).assign(quadrant=rows["quadrant"].iloc[0])[["quadrant", "zoom", "x", "y"]]


def _tour(rows: pd.DataFrame, near: pd.DataFrame, start: tuple, end: tuple, km: float, zoom: int, exponent: float, wind: tuple | None, columns: list[str]) -> pd.DataFrame:
    if not len(rows):
        return pd.DataFrame(columns=columns)
    rows = rows.sort_values(["grid", "place"]).reset_index(drop=True)
    seen: dict[int, set] = {}
    for level, x, y in zip(near["zoom"], near["x"], near["y"]):
        seen.setdefault(level, set()).add((x, y))
    zones_ = rows[["lat", "lon", "n_tiles", "km", "zoom"]].to_dict("records")
    stops = insertion_tour(start, end, zones_, km, zoom, seen, exponent)
    if wind and start == end and len(stops) > 1:
        first, last = (headwind(wind, start, (zones_[i]["lat"], zones_[i]["lon"])) for i in (stops[0], stops[-1]))
        stops = stops[::-1] if last > first else stops
    return rows.iloc[stops].assign(stop=range(1, len(stops) + 1))[columns]


def tours(zoned: DataFrame, visited: DataFrame, zoom: int, start: tuple[float, float], km: float, mode: str = "tiles", shape: str = "loop", end: tuple[float, float] | None = None, second: tuple[DataFrame, DataFrame, int] | None = None, wind: tuple[float, float] | None = None) -> DataFrame:
    """quadrant, stop, zone, lat, lon, n_tiles: a tour in each quadrant. A group holds at most 16 zones and those visited tiles that lie under the legs between them.

    A loop takes zones of its quadrant and the next one clockwise as one area; out_and_back the best zone of its quadrant; with
    an end it goes from point to point. Reach is the caller's: km / 4 of round trips, km / 3 of others. second: zoned, visited
    and zoom of another grid, whose zones are told apart by a column zoom. wind: speed and direction; a round trip begins into it.
    """
    cap = POOL_OUT if shape == "out_and_back" and not end else POOL_OF_TWO if second else POOL
    here, far = [F.lit(start[0]), F.lit(start[1]), F.col("lat"), F.col("lon")], max(km * TOLERANCE / 2, haversine_km(start, end or start))
    pools, near, own = [], [], []
    for grid, (tiles, seen, level) in enumerate([(zoned, visited, zoom), *([second] if second else [])]):
        own.append(tiles.select("quadrant"))
        if shape == "loop" and not end:
            tiles = zones(with_neighbours(tiles.drop("zone")))
        best = score_zones(tiles, seen, level, start, mode).filter(F.col("place") <= cap).join(best_corner(tiles, level, start), "zone")
        pools.append(best.select("quadrant", "zone", "n_tiles", "km", "place", "lat", "lon", F.lit(grid).alias("grid"), F.lit(level).cast("long").alias("zoom")))
        at = coverage.centres(seen.select("x", "y").distinct(), level)
        near.append(at.filter(geo.haversine_m(*here) / 1000 <= far).select(F.lit(level).cast("long").alias("zoom"), "x", "y"))
    pool, own, near = (x[0].unionByName(x[1]) if second else x[0] for x in (pools, own, near))
    pool = materialise(pool.join(own.distinct(), "quadrant", "left_semi"), "pool")
    legs = pool.groupBy("quadrant").applyInPandas(lambda rows: _leg_tiles(rows, start, end or start), "quadrant string, zoom long, x long, y long")
    on_way = legs.join(near, ["zoom", "x", "y"], "left_semi")
    columns = "quadrant string, zone long, lat double, lon double, n_tiles long, stop long" + (", zoom long" if second else "")
    run = partial(_tour, start=start, end=end or start, km=km, zoom=zoom, exponent=1.0 if mode == "efficiency" else 0.4, wind=wind, columns=[c.split()[0] for c in columns.split(", ")])
    return pool.groupBy("quadrant").cogroup(on_way.groupBy("quadrant")).applyInPandas(lambda rows, tiles: run(rows, tiles), columns)
