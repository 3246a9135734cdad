"""Queries of routes over roads and of tours refined to a length. Roads are made of the tracks' pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import routing, stops
from ..registry import query
from ..shared import table
from ..sources import testdata as t
from .q_rollups import hav

#: Degrees between crossings; pieces of tracks up to so many are roads; what tracks of every tenth id are moved by: their roads are islands.
GRID, PIECE, ISLAND = 4e-3, 1.6e-2, 1.0

ROADS = f"""cells AS (SELECT vec_id, idx, CAST(floor(lat / {GRID!r} + 5e-1) AS BIGINT) AS y, CAST(floor(lon / {GRID!r} + 5e-1) AS BIGINT) AS x, CASE WHEN vec_id % 10 = 0 THEN {ISLAND} ELSE 0e0 END AS off FROM points),
pieces AS (SELECT a.vec_id, a.y * {GRID!r} + a.off AS lat1, a.x * {GRID!r} AS lon1, b.y * {GRID!r} + b.off AS lat2, b.x * {GRID!r} AS lon2 FROM cells a JOIN cells b ON b.vec_id = a.vec_id AND b.idx = a.idx + 1
  WHERE (a.y, a.x) <> (b.y, b.x) AND sqrt(pow((a.y - b.y) * {GRID!r}, 2) + pow((a.x - b.x) * {GRID!r}, 2)) <= {PIECE!r})"""


def pieces(spark, d):
    """Straight roads between crossings of a grid, where a track goes from one to a near one. Mountain ways are those of every third track; there are no road ways."""
    cell = lambda c: F.floor(F.col(c) / GRID + 0.5)
    p = t.tracks(spark, d).select("vec_id", F.explode(geo.segments(F.col("coords"))).alias("s")).select("vec_id", "s.*")
    p = p.select("vec_id", *[cell(c).alias(c) for c in ("lat1", "lon1", "lat2", "lon2")])
    p = p.filter(((F.col("lat1") != F.col("lat2")) | (F.col("lon1") != F.col("lon2"))) & (F.sqrt(F.pow((F.col("lat1") - F.col("lat2")) * GRID, 2) + F.pow((F.col("lon1") - F.col("lon2")) * GRID, 2)) <= PIECE))
    off = F.when(F.col("vec_id") % 10 == 0, ISLAND).otherwise(0.0)
    profiles = F.when(F.col("vec_id") % 3 == 0, F.array(F.lit("cycling-regular"), F.lit("cycling-mountain"))).otherwise(F.array(F.lit("cycling-regular")))
    return p.select(*[(F.col(c) * GRID + (off if c.startswith("lat") else 0.0)).alias(c) for c in ("lat1", "lon1", "lat2", "lon2")], profiles.alias("profiles"))


def requests(spark, d):
    """A request a supplier: from one place by two others to a fourth. Some places are far from any road or on an island."""
    n = F.col("s_suppkey")
    at = lambda a, b, off=0.0: F.struct((F.lit(41.88) + (n * a % 21 - 10) * GRID + off).alias("lat"), (F.lit(-87.628) + (n * b % 21 - 10) * GRID).alias("lon"))
    far = F.when(n % 5 == 0, 3.0).when(n % 7 == 0, ISLAND).otherwise(0.0)
    end = F.when(n % 29 == 0, 3.0).otherwise(0.0)
    surface = F.when(n % 3 == 0, "paved").when(n % 3 == 1, "unpaved").otherwise("any")
    return table(spark, d, "supplier").select(n.alias("request"), F.array(at(17, 29), at(13, 7, far), at(5, 11), at(3, 19, end)).alias("waypoints"), surface.alias("surface"))


def _node(lat: str, lon: str) -> str:
    return f"(CAST(round(({lat} + 90) * 1e6) AS BIGINT) * 400000000 + CAST(round(({lon} + 180) * 1e6) AS BIGINT))"


def _routes_sql(rounds: int = 40) -> str:
    """Bellman-Ford from every leg's start, road by road; the last rounds change nothing. Waypoints by comparing each with every node."""
    km = "distance"
    steps, last = [], "d0"
    for i in range(1, rounds + 1):
        steps.append(f"d{i} AS MATERIALIZED (SELECT profile, src, node, min({km}) AS {km} FROM (SELECT * FROM {last} UNION ALL SELECT s.profile, s.src, r.b, s.{km} + r.metres FROM {last} s JOIN roads r ON r.profile = s.profile AND r.a = s.node) GROUP BY 1, 2, 3)")
        last = f"d{i}"
    place = lambda a, b, off="0e0": f"round(4188e-2 + (s_suppkey * {a} % 21 - 10) * {GRID!r} + {off}, 6) AS lat, round(-87628e-3 + (s_suppkey * {b} % 21 - 10) * {GRID!r}, 6) AS lon"
    far, end = f"CASE WHEN s_suppkey % 5 = 0 THEN 3e0 WHEN s_suppkey % 7 = 0 THEN {ISLAND} ELSE 0e0 END", "CASE WHEN s_suppkey % 29 = 0 THEN 3e0 ELSE 0e0 END"
    profile = "CASE WHEN s_suppkey % 3 = 1 THEN 'cycling-mountain' ELSE 'cycling-regular' END AS profile"  # paved ways have no roads here
    points = " UNION ALL ".join(f"SELECT s_suppkey AS request, {i} AS pos, {profile}, {place(*x)} FROM supplier" for i, x in enumerate(((17, 29), (13, 7, far), (5, 11), (3, 19, end))))
    return f"""
WITH RECURSIVE {ROADS}, kinds AS (SELECT 'cycling-regular' AS profile, 1 AS k UNION ALL SELECT 'cycling-mountain', 3),
ways AS (SELECT profile, lat1, lon1, lat2, lon2 FROM pieces JOIN kinds ON vec_id % k = 0 UNION ALL SELECT profile, lat2, lon2, lat1, lon1 FROM pieces JOIN kinds ON vec_id % k = 0),
roads AS MATERIALIZED (SELECT profile, {_node('lat1', 'lon1')} AS a, {_node('lat2', 'lon2')} AS b, min({hav('lat1', 'lon1', 'lat2', 'lon2')}) AS metres, min(lat1) AS lat, min(lon1) AS lon FROM ways GROUP BY 1, 2, 3),
nodes AS (SELECT profile, a AS node, min(lat) AS lat, min(lon) AS lon FROM roads GROUP BY 1, 2),
part AS (SELECT profile, node, node AS label FROM nodes UNION SELECT p.profile, r.b, p.label FROM part p JOIN roads r ON r.profile = p.profile AND r.a = p.node WHERE r.b > p.label),
parts AS (SELECT profile, node, min(label) AS label FROM part GROUP BY 1, 2),
w AS ({points}),
near AS (SELECT request, pos, arg_min(node, (off, node)) AS node FROM (SELECT request, pos, node, {hav('w.lat', 'w.lon', 'n.lat', 'n.lon')} AS off FROM w JOIN nodes n ON n.profile = w.profile AND abs(n.lat - w.lat) < 1e-2) WHERE off <= 350 GROUP BY 1, 2),
placed AS (SELECT w.request, w.pos, w.profile, near.node, label, first_value(label) OVER (PARTITION BY w.request ORDER BY w.pos) AS home FROM w LEFT JOIN near USING (request, pos) LEFT JOIN parts ON parts.profile = w.profile AND parts.node = near.node),
kept AS (SELECT *, coalesce(label = home, false) AS fine FROM placed),
told AS (SELECT request, min(CASE WHEN pos IN (0, 3) THEN CAST(fine AS INTEGER) END) AS ok, count(*) FILTER (pos IN (1, 2) AND NOT fine) AS dropped FROM kept GROUP BY 1),
chain AS MATERIALIZED (SELECT request, profile, node AS a, lead(node) OVER (PARTITION BY request ORDER BY pos) AS b FROM kept JOIN told USING (request) WHERE fine AND ok = 1),
d0 AS (SELECT DISTINCT profile, a AS src, a AS node, 0e0 AS {km} FROM chain), {", ".join(steps)},
km AS (SELECT request, sum({km}) AS metres FROM chain c JOIN {last} d ON d.profile = c.profile AND d.src = c.a AND d.node = c.b WHERE c.b IS NOT NULL GROUP BY 1)
SELECT request, CASE WHEN ok = 1 THEN 'success' ELSE 'error' END AS status, CAST(dropped AS INTEGER) AS dropped, CASE WHEN ok = 1 THEN round_even(metres / 1000, 2) END AS distance_km FROM told LEFT JOIN km USING (request)"""


@query("X11_routed_requests", _routes_sql(), "points")
def x11(spark, d):
    return routing.routed(requests(spark, d), pieces(spark, d)).select("request", "status", "dropped", "distance_km")


def _refined_sql() -> str:
    at = lambda a, b: f"[4188e-2 + (c_custkey * {a} % 200 - 100) * 4e-4, -8763e-2 + (c_custkey * {b} % 200 - 100) * 4e-4]"
    leg = hav("p[1][1]", "p[1][2]", "p[2][1]", "p[2][2]")
    length = f"coalesce(list_sum(list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda p: {leg})), 0) / 1000"
    k, lat = "((target - km) / 2 / 6371e0)", "asin(sin(radians(w[1][1])) * cos({k}) + cos(radians(w[1][1])) * sin({k}) * cos(radians(bearing)))"
    lat = lat.format(k=k)
    pad = f"[degrees({lat}), degrees(radians(w[1][2]) + atan2(sin(radians(bearing)) * sin({k}) * cos(radians(w[1][1])), cos({k}) - sin(radians(w[1][1])) * sin({lat})))]"
    change = "abs(km / target - 1) > 15e-2 AND ((km / target > 115e-2 AND len(w) > 3) OR km / target < 85e-2) AND turn < 6"
    return f"""
WITH RECURSIVE r AS (SELECT c_custkey AS request, [{at(17, 29)}, {at(3, 19)}, {at(41, 23)}, {at(17, 29)}] AS w, 10e0 + c_custkey % 45 AS target, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE [{at(7, 5)}, {at(11, 13)}] END AS more, CAST(c_custkey * 7 % 360 AS DOUBLE) AS bearing, [true, true] AS bears FROM customer),
s AS (SELECT 1 AS turn, request, w, target, more, bearing, bears, {length} AS km FROM r UNION ALL
 SELECT turn, request, w, target, more, bearing, bears, {length} AS km FROM (
  SELECT turn + 1 AS turn, request, target, bearing,
   CASE WHEN km > target THEN list_concat(w[1:cut], w[cut + 2:len(w)]) WHEN len(more) > 0 THEN list_concat(w[1:len(w) - 1], more[1:1], w[len(w):len(w)]) ELSE list_concat(w[1:1], [{pad}], w[2:len(w)]) END AS w,
   CASE WHEN km > target THEN list_concat(bears[1:cut - 1], bears[cut + 1:len(bears)]) WHEN len(more) > 0 THEN list_append(bears, true) ELSE list_prepend(false, bears) END AS bears,
   CASE WHEN km < target AND len(more) > 0 THEN more[2:len(more)] ELSE more END AS more
  FROM (SELECT *, coalesce(nullif(list_position(bears, false), 0), len(bears)) AS cut FROM s WHERE {change})))
SELECT request, CAST(len(w) AS INTEGER) AS waypoints, round(km, 4) AS distance_km, turn AS routings, CASE WHEN km / target < 85e-2 THEN 'error' ELSE 'success' END AS status FROM s QUALIFY turn = max(turn) OVER (PARTITION BY request)"""


@query("X10_refined_tours", _refined_sql())
def x10(spark, d):
    """A tour a customer, refined by straight lines; a third of them have no candidates."""
    n = F.col("c_custkey")
    at = lambda a, b: F.struct((F.lit(41.88) + (n * a % 200 - 100) * 4e-4).alias("lat"), (F.lit(-87.63) + (n * b % 200 - 100) * 4e-4).alias("lon"))
    more = F.array(at(7, 5), at(11, 13))
    asked = table(spark, d, "customer").select(
        n.alias("request"), F.array(at(17, 29), at(3, 19), at(41, 23), at(17, 29)).alias("waypoints"), (F.lit(10.0) + n % 45).alias("target_km"),
        F.when(n % 3 == 0, F.slice(more, 1, 0)).otherwise(more).alias("candidates"), (n * 7 % 360).cast("double").alias("bearing"),
    )
    found = routing.refined(asked)
    return found.select("request", F.size("waypoints").alias("waypoints"), F.round("distance_km", 4).alias("distance_km"), "routings", "status")


#: Stops up to which the query seeks the shortest order; SQL tries all.
EXACT = 5


def _orders_sql() -> str:
    leg = lambda a, b: f"{hav(f'{a}[1]', f'{a}[2]', f'{b}[1]', f'{b}[2]')} / 1000"
    at = lambda i: f"[4188e-2 + (c_custkey * (7 + 4 * {i}) % 197 - 98) * 4e-4, -8763e-2 + (c_custkey * (11 + 6 * {i}) % 193 - 96) * 4e-4]"
    return f"""
WITH RECURSIVE t AS (SELECT c_custkey AS tour, {at(0)} AS a, {at(9)} AS b, list_transform(range(CAST(c_custkey % 8 AS BIGINT)), lambda i: {at('(i + 1)')}) AS s FROM customer),
every(tour, b, s, left_, here, km, n) AS (SELECT tour, b, s, range(len(s)), a, 0e0, 0 FROM t WHERE len(s) <= {EXACT} UNION ALL SELECT tour, b, s, list_filter(left_, lambda x: x <> i), s[i + 1], km + {leg('here', 's[i + 1]')}, n + 1 FROM (SELECT *, unnest(left_) AS i FROM every WHERE len(left_) > 0)),
near(tour, b, s, left_, here, km, n) AS (SELECT tour, b, s, range(len(s)), a, 0e0, 0 FROM t WHERE len(s) > {EXACT} UNION ALL SELECT tour, b, s, list_filter(left_, lambda x: x <> i), s[i + 1], km + {leg('here', 's[i + 1]')}, n + 1 FROM (
 SELECT *, list_sort(list_transform(left_, lambda j: struct_pack(km := {leg('here', 's[j + 1]')}, j := j)))[1].j AS i FROM near WHERE len(left_) > 0)),
ends AS (SELECT tour, n, km + {leg('here', 'b')} AS km FROM every WHERE len(left_) = 0 UNION ALL SELECT tour, n, km + {leg('here', 'b')} FROM near WHERE len(left_) = 0)
SELECT tour, CAST(n AS INTEGER) AS stops, round(min(km), 6) AS km FROM ends GROUP BY 1, 2"""


@query("X6_ordered_stops", _orders_sql())
def x6(spark, d):
    """A tour a customer, of none to seven stops."""
    n = F.col("c_custkey")
    at = lambda i: F.struct((F.lit(41.88) + (n * (i * 4 + 7) % 197 - 98) * 4e-4).alias("lat"), (F.lit(-87.63) + (n * (i * 6 + 11) % 193 - 96) * 4e-4).alias("lon"))
    points = F.filter(F.transform(F.array(*[F.lit(i) for i in range(7)]), lambda i: F.when(i < n % 8, at(i + 1))), lambda p: p.isNotNull())
    tours = table(spark, d, "customer").select(n.alias("tour"), at(F.lit(0)).alias("start"), points.alias("stops"), at(F.lit(9)).alias("end"))
    return stops.ordered(tours, EXACT).select("tour", F.size("stops").alias("stops"), F.round("km", 6).alias("km"))
