"""Queries of the names of routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import naming
from ..registry import query
from ..shared import table
from ..sources import testdata as t
from .q_rollups import hav

STREETS = ("Oak Street", "Lake Access Path", "Main Street", "West River Drive", "Elm Avenue")

#: Answers of looked-up places, by cell of the map: road, cycleway, highway, neighbourhood, suburb, amenity, tourism, leisure, water. The last eight have no street of use.
ADDRESS = ("road", "cycleway", "highway", "neighbourhood", "suburb", "amenity", "tourism", "leisure", "water")
ANSWERS = (
    ("Oak Street", None, "residential", None, "Uptown", None, None, None, None),
    ("Simonds Drive", None, None, "Elm Hill", None, None, None, None, None),
    ("", "Lakefront Trail", "cycleway", None, None, None, None, "Lake Park", None),
    ("Main Street", None, "primary", "Old Town", "Oak", None, None, None, "River"),
    ("North Clark Drive", None, None, None, None, "Library", None, None, None),
    ("Elm Avenue", None, "tertiary", None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None),
    ("Grand Boulevard", None, "service", None, None, None, None, None, None),
    ("Harbor Parkway Access", None, None, None, None, None, None, None, "Canal"),
    (None, None, None, "Elm Hill", None, None, None, None, None),
    ("Mill Path", None, "path", None, "Uptown", None, "Old Mill", None, None),
    (None, None, None, None, None, None, None, "Dunes", None),
    ("West Ogden Drive", None, "secondary", None, None, None, None, None, None),
    ("Yard", None, "service", None, None, None, None, None, None),
)
CELL = "(CAST(floor(round(lat, 4) * {fine}) + 2 * floor(round(lon, 4) * {fine}) AS BIGINT) % {good} + {good}) % {good}"


def _literal(value) -> str:
    return "NULL" if value is None else f"'{value}'"


#: Sample points of tracks p(key, idx, lat, lon) with their kinds(key, direction, gain), to what is at them: looked(key, idx, lat, lon).
SAMPLES = f"""
firsts AS (SELECT *, min(idx) OVER (PARTITION BY key, lat, lon) AS first_, count(*) OVER (PARTITION BY key) AS n, least(10, count(*) OVER (PARTITION BY key) // 10) AS w FROM p),
turned AS (SELECT b.key, b.first_ FROM firsts b JOIN firsts a ON a.key = b.key AND a.idx = b.idx - b.w JOIN firsts c ON c.key = b.key AND c.idx = b.idx + b.w, LATERAL (SELECT (degrees(atan2(sin(radians(b.lon - a.lon)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lon - a.lon)))) + 360) % 360 AS one,
 (degrees(atan2(sin(radians(c.lon - b.lon)) * cos(radians(c.lat)), cos(radians(b.lat)) * sin(radians(c.lat)) - sin(radians(b.lat)) * cos(radians(c.lat)) * cos(radians(c.lon - b.lon)))) + 360) % 360 AS two) WHERE b.idx % b.w = 0 AND b.idx >= b.w AND b.idx < b.n - b.w AND least(abs(two - one), 360 - abs(two - one)) >= 30),
moved AS (SELECT key, idx, first_, coalesce({hav('lag(lat) OVER o', 'lag(lon) OVER o', 'lat', 'lon')}, 0) AS step FROM firsts WINDOW o AS (PARTITION BY key ORDER BY idx)),
gone AS (SELECT key, idx, first_, sum(step) OVER (PARTITION BY key ORDER BY idx) AS cum, sum(step) OVER (PARTITION BY key) AS total FROM moved), middle AS (SELECT key, arg_min(first_, idx) AS first_ FROM gone WHERE cum >= total / 2 GROUP BY 1),
fixed AS (SELECT key, first_ FROM firsts WHERE idx = 0 OR idx = n - 1 UNION ALL SELECT key, first_ FROM turned), chosen AS (SELECT key, first_ FROM fixed UNION ALL SELECT key, first_ FROM middle m WHERE NOT EXISTS (SELECT 1 FROM fixed s WHERE s.key = m.key AND s.first_ = m.first_)),
lacks AS (SELECT key, CASE WHEN direction IS NULL THEN 10 ELSE 20 END AS most, CASE WHEN direction IS NULL THEN 10 ELSE 20 END - count(*) AS missing FROM chosen JOIN kinds USING (key) GROUP BY key, direction),
even AS (SELECT f.key, f.first_, missing, row_number() OVER (PARTITION BY f.key ORDER BY min(f.idx)) AS k FROM firsts f JOIN lacks USING (key), LATERAL (SELECT f.n // greatest(1, missing + 1) AS step) WHERE missing > 0 AND idx % step = 0 AND idx >= step AND idx < f.n - step AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.key = f.key AND c.first_ = f.first_) GROUP BY f.key, f.first_, missing),
wanted AS (SELECT key, first_, most, row_number() OVER (PARTITION BY key ORDER BY first_) AS k FROM (SELECT * FROM chosen UNION ALL SELECT key, first_ FROM even WHERE k <= missing) JOIN lacks USING (key)),
sampled AS (SELECT wanted.key, k - 1 AS idx, lat, lon FROM wanted JOIN p ON p.key = wanted.key AND p.idx = first_ WHERE k <= most)"""

#: Names from looked(key, idx, and the details of each sample) and kinds(key, type, direction, gain).
NAMES = """
swapped AS (SELECT *, CASE WHEN street IN ('North Simonds Drive', 'South Simonds Drive', 'Simonds Drive') THEN 'Lakefront Trail' ELSE street END AS way, count(*) OVER (PARTITION BY key) AS n FROM looked),
marked AS (SELECT *, CASE WHEN idx > 0 AND lag(way) OVER o IS NOT DISTINCT FROM way THEN 0 ELSE 1 END AS new_ FROM swapped WINDOW o AS (PARTITION BY key ORDER BY idx)), numbered AS (SELECT *, sum(new_) OVER (PARTITION BY key ORDER BY idx) AS run FROM marked),
seg AS (SELECT key, run, n, way, first(highway ORDER BY idx) AS highway, min(idx) AS start_, count(*) AS points FROM numbered GROUP BY 1, 2, 3, 4),
good AS (SELECT * FROM seg WHERE way <> '' AND points * 10 >= n AND NOT regexp_matches(lower(way), 'access|path|ramp|entrance|exit') AND NOT (lower(way) LIKE '%drive%' AND regexp_matches(lower(way), 'west |east |north |south ') AND NOT regexp_matches(lower(way), 'lake shore|lakeshore|martin luther king')) AND coalesce(highway, '') NOT IN ('service', 'track', 'path', 'unclassified')),
uniq AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run) AS u, count(*) OVER (PARTITION BY key) AS nu FROM (SELECT *, row_number() OVER (PARTITION BY key, way ORDER BY run) AS again FROM good) WHERE again = 1),
best AS (SELECT key, arg_max(way, points * 1000 - run) AS main, max(nu) AS nu, arg_min(way, u) AS first_, arg_max(way, u) AS last_, max(way) FILTER (u = 2) AS second_, arg_max(way, points * 1000 - run) FILTER (u > 1 AND u < nu) AS inner_, arg_max(way, u) FILTER (start_ < n / 2e0) AS turn_ FROM uniq GROUP BY 1),
rest AS (SELECT key, arg_max(way, points * 1000 - run) FILTER (way <> main) AS other, arg_max(way, u) FILTER (way <> main AND start_ < n / 2e0) AS other_turn FROM uniq JOIN best USING (key) GROUP BY 1),
span AS (SELECT key, arg_max(way, points * 1000 - run) AS widest, arg_min(way, points * 1000 + run) AS narrowest, max(points) * 100e0 / max(n) AS share FROM good GROUP BY 1),
met AS (SELECT key, first(park ORDER BY idx) FILTER (park IS NOT NULL) AS park, max(suburb) FILTER (idx = 0) AS suburb, first(landmark ORDER BY idx) FILTER (landmark IS NOT NULL) AS landmark, first(feature ORDER BY idx) FILTER (feature IS NOT NULL) AS feature FROM looked GROUP BY 1),
majors AS (SELECT key, list(street ORDER BY c DESC, i)[1:3] AS major FROM (SELECT key, street, count(*) AS c, min(idx) AS i FROM looked WHERE is_major AND street IS NOT NULL GROUP BY 1, 2) GROUP BY 1), hoods AS (SELECT key, list(neighborhood ORDER BY i) AS hood FROM (SELECT key, neighborhood, min(idx) AS i FROM looked WHERE neighborhood IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
told AS (SELECT key, main, CASE direction WHEN 'home_to_work' THEN ' → Work' WHEN 'work_to_home' THEN ' → Home' ELSE '' END AS arrow, CASE WHEN gain > 30 THEN ' (hilly)' WHEN gain > 15 THEN ' (rolling)' ELSE '' END AS terrain,
 CASE WHEN type = 'loop' THEN CASE WHEN park IS NOT NULL THEN 'Loop through ' || park WHEN nu = 1 THEN 'Loop via ' || main || coalesce(', ' || suburb, '') ELSE 'Loop via ' || main || ' + ' || other END
  WHEN type = 'out-and-back' THEN CASE WHEN nu = 1 THEN 'Via ' || main || ' and back' ELSE main || ' to ' || CASE WHEN coalesce(turn_, last_) <> main THEN coalesce(turn_, last_) ELSE coalesce(other_turn, second_) END || ' and back' END
  WHEN nu >= 3 THEN first_ || ' → ' || inner_ || ' → ' || last_ || CASE WHEN contains(lower(first_ || ' → ' || inner_ || ' → ' || last_), lower(suburb)) THEN '' ELSE coalesce(', ' || suburb, '') END
  WHEN nu = 2 AND share > 60 THEN widest || ' via ' || narrowest WHEN nu = 2 THEN first_ || ' → ' || last_ ELSE 'Via ' || main END AS by_streets,
 CASE WHEN len(major) >= 2 THEN array_to_string(major, ' → ') WHEN len(major) = 1 AND len(hood) > 0 THEN 'Through ' || hood[1] || ' via ' || major[1] WHEN len(hood) > 0 AND landmark IS NOT NULL THEN 'Through ' || hood[1] || ' past ' || landmark
  WHEN len(major) = 1 AND feature IS NOT NULL THEN major[1] || ' along ' || feature WHEN len(major) = 1 THEN 'Via ' || major[1] WHEN len(hood) >= 2 THEN 'Through ' || hood[1] || ' and ' || hood[2] WHEN len(hood) = 1 THEN 'Through ' || hood[1] WHEN feature IS NOT NULL THEN 'Along ' || feature
  ELSE 'Route ' || string_split(CAST(key AS VARCHAR), '_')[-1] || CASE WHEN direction = 'home_to_work' THEN ' to Work' ELSE ' to Home' END END AS by_places
 FROM kinds LEFT JOIN best USING (key) LEFT JOIN rest USING (key) LEFT JOIN span USING (key) LEFT JOIN met USING (key) LEFT JOIN majors USING (key) LEFT JOIN hoods USING (key))
SELECT key, CASE WHEN main IS NOT NULL THEN by_streets || arrow || terrain WHEN arrow <> '' AND NOT contains(by_places, arrow) THEN by_places || arrow || terrain ELSE by_places END AS name FROM told"""

TYPES = f"""
quarters AS (SELECT key, count(*) AS n, max(lat) FILTER (idx = 0) AS y0, max(lon) FILTER (idx = 0) AS x0, arg_max(lat, idx) AS y9, arg_max(lon, idx) AS x9 FROM p GROUP BY 1),
typed AS (SELECT q.key, {hav('y0', 'x0', 'y9', 'x9')} / 1000 AS apart, {hav('y0', 'x0', 'm.lat', 'm.lon')} / 1000 AS far, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 1000 AS retraced FROM quarters q JOIN p m ON m.key = q.key AND m.idx = n // 2 JOIN p a ON a.key = q.key AND a.idx = n // 4 JOIN p b ON b.key = q.key AND b.idx = 3 * n // 4),
kinds AS (SELECT key, CASE WHEN apart > 0.5e0 THEN 'point-to-point' WHEN far > 1 AND retraced < far * 0.3e0 THEN 'out-and-back' ELSE 'loop' END AS type, direction, gain FROM typed JOIN rides USING (key))"""


@query("X12_S18_P26_route_names", f"""
WITH p AS (SELECT vec_id AS key, idx, lat, lon FROM points), rides AS (SELECT activity_id AS key, direction, elevation_gain / (distance / 1000) AS gain FROM routes), {TYPES}, {SAMPLES},
looked AS (SELECT key, idx, [{', '.join(map(_literal, STREETS))}][{CELL.format(fine=200, good=len(STREETS)).replace('2 * ', '')} + 1] AS street, CASE WHEN street = 'Main Street' THEN 'service' ELSE 'residential' END AS highway, false AS is_major, NULL AS neighborhood, NULL AS suburb, NULL AS landmark, NULL AS feature, NULL AS park FROM sampled), {NAMES}""", "points routes")
def x12(spark, d):
    """Streets by cell of the map, as a stand-in for looked-up places."""
    tracks = t.routes(spark, d).select(F.col("activity_id").alias("key"), "coords", "direction", (F.col("elevation_gain") / (F.col("distance") / 1000)).alias("gain_per_km"))
    at = naming.sample_points(tracks, "key").select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"))
    cell = F.pmod((F.floor(F.col("lat") * 200) + F.floor(F.col("lon") * 200)), F.lit(len(STREETS))).cast("int")
    details = at.select("lat", "lon", F.get(F.array(*[F.lit(s) for s in STREETS]), cell).alias("street"), F.when(cell == 2, "service").otherwise("residential").alias("highway"))
    return naming.name_routes(tracks, details)


def _shaped(spark, d):
    """key, coords, direction, gain_per_km: tracks of four straight legs, of which every third returns beside its way and every third to its start."""
    vec, shape = F.col("vec_id"), F.col("vec_id") % 3
    component = lambda i: F.get("embedding", i.cast("int")).cast("double") * 1e-1

    def point(i):
        j = F.when((shape == 1) & (i > 16), 32 - i).otherwise(i)
        leg, part = F.floor(j / 8), (j % 8) / 8.0
        end = F.when((shape == 2) & (leg == 3), 0).otherwise(leg + 1)
        leg = F.when((shape == 2) & (leg == 4), 0).otherwise(leg)
        way = lambda k: component(leg * 2 + k) + (component(end * 2 + k) - component(leg * 2 + k)) * part
        return F.struct((F.lit(41.88) + way(0) + F.when((shape == 1) & (i > 16), 3e-4).otherwise(0.0)).alias("lat"), (F.lit(-87.63) + way(1)).alias("lon"))

    direction = F.when(vec % 4 == 0, "home_to_work").when(vec % 4 == 1, "work_to_home")
    gain = F.when(vec % 7 > 0, (vec % 50).cast("double"))
    return table(spark, d, "embeddings").select(F.concat(F.lit("ride_"), vec.cast("string")).alias("key"), F.transform(F.sequence(F.lit(0), F.lit(32)), point).alias("coords"), direction.alias("direction"), gain.alias("gain_per_km"))


GOOD = len(ANSWERS) - 8
WILD = "CAST(floor(round(lon, 4) * 25) AS BIGINT) % 2 <> 0"
ANSWER_CELL = f"CASE WHEN {WILD} THEN {GOOD} + {CELL.format(fine=100, good=8)} ELSE {CELL.format(fine=100, good=GOOD)} END"
ANSWERS_SQL = "answers AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join(map(_literal, a))})" for i, a in enumerate(ANSWERS)) + f") a(cell, {', '.join(ADDRESS)}))"
DETAILS_SQL = """found AS (SELECT cell, coalesce(nullif(road, ''), cycleway) AS street, highway, coalesce(neighbourhood, suburb) AS neighborhood, coalesce(suburb, neighbourhood) AS suburb, coalesce(amenity, tourism) AS landmark, coalesce(leisure, tourism) AS park, coalesce(water, leisure) AS feature,
 coalesce(highway IN ('motorway', 'trunk', 'primary', 'secondary', 'tertiary'), false) OR coalesce(regexp_matches(lower(road), 'highway|boulevard|avenue|parkway'), false) AS is_major FROM answers)"""


@query("X12_names_by_shape_and_place", f"""
WITH e AS (SELECT vec_id, vec_id % 3 AS shape, embedding AS v, CAST(i AS INTEGER) AS idx, CAST(CASE WHEN vec_id % 3 = 1 AND i > 16 THEN 32 - i ELSE i END AS INTEGER) AS j FROM embeddings, range(33) r(i)),
legs AS (SELECT *, CASE WHEN shape = 2 AND j // 8 = 4 THEN 0 ELSE j // 8 END AS a, CASE WHEN shape = 2 AND j // 8 = 3 THEN 0 ELSE j // 8 + 1 END AS b, (j % 8) / 8e0 AS part FROM e),
ends AS (SELECT *, CAST(v[2 * a + 1] AS DOUBLE) * 1e-1 AS y1, CAST(v[2 * a + 2] AS DOUBLE) * 1e-1 AS x1, CAST(v[2 * b + 1] AS DOUBLE) * 1e-1 AS y2, CAST(v[2 * b + 2] AS DOUBLE) * 1e-1 AS x2 FROM legs),
p AS (SELECT 'ride_' || vec_id AS key, idx, 4188e-2 + (y1 + (y2 - y1) * part) + CASE WHEN shape = 1 AND idx > 16 THEN 3e-4 ELSE 0e0 END AS lat, -8763e-2 + (x1 + (x2 - x1) * part) AS lon FROM ends),
rides AS (SELECT 'ride_' || vec_id AS key, CASE vec_id % 4 WHEN 0 THEN 'home_to_work' WHEN 1 THEN 'work_to_home' END AS direction, CASE WHEN vec_id % 7 > 0 THEN CAST(vec_id % 50 AS DOUBLE) END AS gain FROM embeddings), {TYPES}, {SAMPLES},
{ANSWERS_SQL}, {DETAILS_SQL}, looked AS (SELECT key, idx, street, highway, is_major, neighborhood, suburb, landmark, feature, park FROM (SELECT *, {ANSWER_CELL} AS cell FROM sampled) JOIN found USING (cell)), {NAMES}""")
def x12_places(spark, d):
    """Loops, ways there and back and from one place to another, past streets, parks and neighbourhoods, with a direction and without."""
    tracks = _shaped(spark, d)
    at = naming.sample_points(tracks, "key").select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")).distinct()
    answers = at.select("lat", "lon", F.expr(ANSWER_CELL).cast("int").alias("cell")).select("lat", "lon", *[F.get(F.array(*[F.lit(a[k]).cast("string") for a in ANSWERS]), F.col("cell")).alias(c) for k, c in enumerate(ADDRESS)])
    return naming.name_routes(tracks, naming.places(answers))
