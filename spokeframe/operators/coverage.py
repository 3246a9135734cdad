"""Map tiles and roads: interpolation, the tiles a track crosses, coverage, water, corridors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..shared import materialise

#: Steps after which the walk along a segment is given up: broken points can lie half the globe apart.
LONGEST_WALK = 20_000


def interpolate(tracks: DataFrame, key: str, gap_m: float = 80.0) -> DataFrame:
    """key, idx, i, lat, lon: points so dense that no gap passes gap_m. The track's first point has idx -1."""
    seg = tracks.select(key, F.posexplode(geo.segments(F.col("coords"))).alias("idx", "s")).select(key, "idx", "s.*")
    steps = F.greatest(F.lit(1), F.ceil(geo.haversine_m(*[F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]) / gap_m)).cast("int")
    dense = seg.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    part = F.col("i") / F.col("steps").cast("double")
    between = lambda a, b: F.col(a) + part * (F.col(b) - F.col(a))
    inner = dense.select(key, "idx", "i", between("lat1", "lat2").alias("lat"), between("lon1", "lon2").alias("lon"))
    first = tracks.filter(F.size("coords") > 0).select(key, F.lit(-1).alias("idx"), F.lit(0).alias("i"), F.get("coords", F.lit(0))["lat"].alias("lat"), F.get("coords", F.lit(0))["lon"].alias("lon"))
    return first.unionByName(inner)


def walk(fx: np.ndarray, fy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tiles on the line through points in tile units. Where a line meets a corner, it goes on in y first.

    Each step crosses the next grid line in x or in y, so the crossings are sorted by the part of the
    segment at which they lie.
    """
    xs, ys = [], []
    for ax, ay, bx, by in zip(fx[:-1], fy[:-1], fx[1:], fy[1:]):
        x0, y0, x1, y1 = int(ax), int(ay), int(bx), int(by)
        nx, ny = abs(x1 - x0), abs(y1 - y0)
        sx, sy = (1 if bx > ax else -1), (1 if by > ay else -1)
        tx = ((x0 + (sx > 0)) + sx * np.arange(nx) - ax) / (bx - ax) if nx else np.zeros(0)
        ty = ((y0 + (sy > 0)) + sy * np.arange(ny) - ay) / (by - ay) if ny else np.zeros(0)
        in_x = np.r_[np.ones(nx, bool), np.zeros(ny, bool)]
        order = np.lexsort((in_x, np.r_[tx, ty]))[:LONGEST_WALK]
        xs.append(x0 + sx * np.r_[0, np.cumsum(in_x[order])])
        ys.append(y0 + sy * np.r_[0, np.cumsum(~in_x[order])])
    return np.concatenate(xs), np.concatenate(ys)


def tiles_of(coords: Column, zoom: int) -> Column:
    """Distinct tiles a track crosses, as a list of x and one of y."""

    @F.arrow_udf("x array<long>, y array<long>")
    def crossed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        n = 2.0**zoom
        for lats, lons in batches:
            xs, ys, ends = [], [], [0]
            lat, lon = (c.values.to_numpy(zero_copy_only=False) for c in (lats, lons))
            fx, fy = (lon + 180.0) / 360.0 * n, (1.0 - np.arcsinh(np.tan(np.radians(lat))) / np.pi) / 2.0 * n
            starts = lats.offsets.to_numpy()
            for a, b, none in zip(starts[:-1], starts[1:], np.asarray(lats.is_null())):
                if not none and b > a:
                    x, y = walk(fx[a:b], fy[a:b]) if b > a + 1 else (fx[a:b].astype(np.int64), fy[a:b].astype(np.int64))
                    both = np.unique(np.c_[x, y].astype(np.int64), axis=0)
                    xs.append(both[:, 0])
                    ys.append(both[:, 1])
                ends.append(ends[-1] + (len(xs[-1]) if not none and b > a else 0))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(v) if v else [], pa.int64())) for v in (xs, ys)]
            yield pa.StructArray.from_arrays(lists, ["x", "y"])

    return crossed(coords.getField("lat"), coords.getField("lon"))


def crossed_tiles(tracks: DataFrame, zoom: int, *keep: str) -> DataFrame:
    """keep, x, y: a row for each tile of each track."""
    lists = tracks.select(*keep, tiles_of(F.col("coords"), zoom).alias("tiles"))
    return lists.select(*keep, F.explode(F.arrays_zip("tiles.x", "tiles.y")).alias("tile")).select(*keep, "tile.x", "tile.y")


def tile_bounds(bounds: tuple[float, float, float, float], zoom: int) -> tuple[Column, Column, Column, Column]:
    south, west, north, east = (F.lit(float(b)) for b in bounds)
    return geo.tile_x(west, zoom), geo.tile_x(east, zoom), geo.tile_y(north, zoom), geo.tile_y(south, zoom)


def in_bounds(tiles: DataFrame, bounds: tuple[float, float, float, float], zoom: int) -> DataFrame:
    x0, x1, y0, y1 = tile_bounds(bounds, zoom)
    return tiles.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def all_tiles(spark, bounds: tuple[float, float, float, float], zoom: int) -> DataFrame:
    """x, y of every tile in the bounds."""
    x0, x1, y0, y1 = tile_bounds(bounds, zoom)
    return spark.range(1).select(F.explode(F.sequence(x0, x1)).alias("x")).select("x", F.explode(F.sequence(y0, y1)).alias("y"))


def coverage(tiles: DataFrame) -> DataFrame:
    """tiles: x, y, id, ord, date. First visit in scan order and number of distinct rides, per tile."""
    return tiles.groupBy("x", "y").agg(F.min_by("date", "ord").alias("first_ridden"), F.count_distinct("id").alias("rides"))


def coverage_stats(tiles: DataFrame, bounds: tuple[float, float, float, float], zoom: int) -> DataFrame:
    x0, x1, y0, y1 = tile_bounds(bounds, zoom)
    total = (x1 - x0 + 1) * (y1 - y0 + 1)
    seen = in_bounds(tiles, bounds, zoom).select("x", "y").distinct().agg(F.count("*").alias("visited_count"))
    return seen.select("visited_count", total.alias("total_in_bounds"), F.bround(F.col("visited_count") / total * 100, 1).alias("coverage_pct"))


def centres(tiles: DataFrame, zoom: int) -> DataFrame:
    """Adds lat and lon of the tiles' middles."""
    south_north = (geo.tile_north(F.col("y"), zoom) + geo.tile_north(F.col("y") + 1, zoom)) / 2
    return tiles.withColumn("lat", south_north).withColumn("lon", (geo.tile_west(F.col("x"), zoom) + geo.tile_west(F.col("x") + 1, zoom)) / 2)


def water_tiles(tiles: DataFrame, polygons: DataFrame, zoom: int) -> DataFrame:
    """Tiles whose middle lies in a polygon (polygons: ring). Tiles meet only the polygons of their own cell of the map.

    A polygon is listed under each coarse tile its box touches, so the join is on equal cells and no side is sent whole.
    """
    coarse = max(0, zoom - 4)
    box = geo.bbox(F.col("ring"))
    xs = F.sequence(geo.tile_x(box["min_lon"], coarse), geo.tile_x(box["max_lon"], coarse))
    ys = F.sequence(geo.tile_y(box["max_lat"], coarse), geo.tile_y(box["min_lat"], coarse))
    cells = polygons.select("ring", F.explode(xs).alias("cx"), ys.alias("ys")).select("ring", "cx", F.explode("ys").alias("cy"))
    at = centres(tiles, zoom).withColumn("cx", geo.tile_x(F.col("lon"), coarse)).withColumn("cy", geo.tile_y(F.col("lat"), coarse))
    return at.join(cells, ["cx", "cy"]).filter(geo.inside(F.col("lat"), F.col("lon"), F.col("ring"))).select("x", "y").distinct()


def segment_distance(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """From a point to a segment, in degrees."""
    dx, dy = b_lon - a_lon, b_lat - a_lat
    length = dx * dx + dy * dy
    at = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((lon - a_lon) * dx + (lat - a_lat) * dy) / F.nullif(length, F.lit(0.0))))).otherwise(0.0)
    return F.hypot(lon - (a_lon + at * dx), lat - (a_lat + at * dy))


def snap(points: DataFrame, edges: DataFrame, tolerance_m: float = 30.0) -> DataFrame:
    """points: id, lat, lon. edges: edge, lat1, lon1, lat2, lon2. id, edge, distance to each point's nearest edge within the tolerance.

    The map is cut into cells of twice the tolerance. An edge is listed under the cells around points that lie one
    tolerance apart on it, so every point within the tolerance of the edge is in one of them.
    """
    tolerance = tolerance_m / 111_000
    cell = 2 * tolerance
    a, b, c, d = (F.col(x) for x in ("lat1", "lon1", "lat2", "lon2"))
    steps = F.greatest(F.lit(1), F.ceil(F.hypot(c - a, d - b) / tolerance)).cast("int")
    on = edges.withColumn("steps", steps).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    part = F.col("i") / F.col("steps").cast("double")
    y, x = F.floor((a + (c - a) * part) / cell).cast("long"), F.floor((b + (d - b) * part) / cell).cast("long")
    around = F.array(*[F.struct((y + i).alias("cy"), (x + j).alias("cx")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    cells = on.select("edge", "lat1", "lon1", "lat2", "lon2", F.explode(around).alias("at")).select("edge", "lat1", "lon1", "lat2", "lon2", "at.*").distinct()
    at = points.withColumn("cy", F.floor(F.col("lat") / cell).cast("long")).withColumn("cx", F.floor(F.col("lon") / cell).cast("long"))
    far = segment_distance(*[F.col(c) for c in ("lat", "lon", "lat1", "lon1", "lat2", "lon2")])
    near = at.join(cells, ["cx", "cy"]).withColumn("distance", far).filter(F.col("distance") <= tolerance)
    best = near.groupBy("id").agg(F.min(F.struct("distance", "edge")).alias("best"))
    return best.select("id", F.col("best.edge").alias("edge"), F.col("best.distance").alias("distance"))


def corridor_boxes(rides: DataFrame, miles: float, widest_deg: float) -> DataFrame:
    """id, i, south, north, west, east: padded boxes along the straight line from a ride's start to its end."""
    a, b, c, e = (F.col(x) for x in ("start_lat", "start_lon", "end_lat", "end_lon"))
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(c - a), F.abs(e - b)) / widest_deg)).cast("int")
    cut = rides.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda x, y, i: x + (y - x) * (i / F.col("n").cast("double"))
    y0, y1, x0, x1 = at(a, c, F.col("i")), at(a, c, F.col("i") + 1), at(b, e, F.col("i")), at(b, e, F.col("i") + 1)
    pad_lat, pad_lon = F.lit(miles / 69.0), miles / (F.cos(F.radians((y0 + y1) / 2)) * 69.172)
    return cut.select("id", "i", (F.least(y0, y1) - pad_lat).alias("south"), (F.greatest(y0, y1) + pad_lat).alias("north"), (F.least(x0, x1) - pad_lon).alias("west"), (F.greatest(x0, x1) + pad_lon).alias("east"))


def flood_fill(tiles: DataFrame) -> DataFrame:
    """Adds zone, the smallest tile number of the tiles that hang together by their sides. Tiles beyond 2**31 in x or y are not on any map.

    Tiles of a column without a gap are one run, and runs that touch are linked, so the graph is as large as there are runs.
    """
    from .graph import components

    own = tiles.withColumn("tile", F.col("x") * (1 << 31) + F.col("y"))
    spots = own.select("x", "y", "tile").distinct()
    spots = spots.withColumn("gap", F.col("y") - F.row_number().over(Window.partitionBy("x").orderBy("y")))
    heads = spots.groupBy("x", "gap").agg(F.min("tile").alias("run"))
    runs = materialise(spots.join(heads, ["x", "gap"]).select("tile", "run"), "runs")
    pairs = runs.join(runs.select((F.col("tile") - (1 << 31)).alias("tile"), F.col("run").alias("next")), "tile").select(F.col("run").alias("a"), F.col("next").alias("b"))
    named = components(pairs)
    zones = runs.join(named, F.col("run") == F.col("id"), "left").select(F.col("tile").alias("of"), F.coalesce("label", "run").alias("zone"))
    return own.join(zones, F.col("tile") == F.col("of")).drop("of")


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")
