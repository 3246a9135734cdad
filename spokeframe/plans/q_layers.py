"""Queries of map layers and exports, and of rules that other views do not exercise."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, scores
from ..functions.geo import haversine_m
from ..operators import coverage, forecast, layers
from ..operators.locations import out_and_back
from ..registry import query
from ..sources import readers, sinks
from ..sources import testdata as t
from .q_files import _documents
from .q_functions import TILE
from .q_rollups import hav
from .q_scores import DAILY, POINTS, SCORES, TRANSIT, WINDY

NAMED = "named AS (SELECT group_id, direction, uses, row_number() OVER (ORDER BY uses DESC, group_id) AS ord, CASE WHEN direction = 'home_to_work' AND uses % 2 = 0 THEN 'My Commute ' || group_id ELSE 'Way ' || group_id END AS name FROM groups)"


def _groups(spark, d):
    """Groups in the order of their use; every second way to work is named a commute."""
    g = t.routes(spark, d).groupBy("group_id", "direction").agg(F.count("*").alias("uses"))
    name = F.when((F.col("direction") == "home_to_work") & (F.col("uses") % 2 == 0), F.concat(F.lit("My Commute "), "group_id")).otherwise(F.concat(F.lit("Way "), "group_id"))
    return g.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("uses"), "group_id")).cast("long")).withColumn("name", name)


@query("P16_commute_groups_or_first", f"""
WITH {NAMED}, w AS (SELECT 'named' AS kind, * FROM named UNION ALL SELECT 'unnamed', * REPLACE ('Way ' || group_id AS name) FROM named)
SELECT kind, group_id, ord FROM w WHERE lower(name) LIKE '%commute%' OR (kind = 'unnamed' AND ord <= 5) OR (kind = 'named' AND ord <= 5 AND NOT EXISTS (SELECT 1 FROM named WHERE lower(name) LIKE '%commute%'))""", "groups")
def p16(spark, d):
    """Groups of which some are named commutes, and groups of which none is: of those the first five."""
    g = _groups(spark, d)
    kinds = (("named", g), ("unnamed", g.withColumn("name", F.concat(F.lit("Way "), "group_id"))))
    one, two = (layers.commute_groups(x).select(F.lit(k).alias("kind"), "group_id", "ord") for k, x in kinds)
    return one.unionByName(two)


COLOUR = "[" + ", ".join(f"'{c}'" for c in layers.COLOURS) + "][place % 8 + 1]"


@query("K9_map_layers", f"""
WITH r AS (SELECT activity_id, direction, distance, row_number() OVER (ORDER BY distance DESC, activity_id) AS ord FROM routes), top AS (SELECT * FROM r WHERE ord <= 10), commute AS (SELECT * FROM top WHERE ord <= 5),
long_ AS (SELECT vec_id, idx + k * 32 AS pos, lat + k * 1e-5 AS lat, lon FROM points, range(6) n(k) WHERE k = 0 OR vec_id % 2 = 0),
drawn AS (SELECT vec_id, lat, lon FROM long_ WHERE vec_id % 2 = 1 OR pos % 5 = 0), shape AS (SELECT vec_id, count(*) AS points, round(sum(lat), 6) AS lat, round(sum(lon), 6) AS lon FROM drawn GROUP BY 1),
both_ AS (SELECT 'all' AS layer, activity_id, ord - 1 AS place FROM top UNION ALL SELECT 'commute', activity_id, ord - 1 FROM commute), mid AS (SELECT layer, round(avg(lat), 7) AS center_lat, round(avg(lon), 7) AS center_lon FROM both_ JOIN long_ ON vec_id = activity_id GROUP BY 1)
SELECT layer, CAST(place AS INTEGER) AS place, 'Route ' || activity_id AS name, layer = 'commute' OR place < 3 AS show, CASE WHEN layer = 'commute' AND place = 0 THEN '#28a745' ELSE {COLOUR} END AS colour, points, lat, lon, center_lat, center_lon
FROM both_ JOIN shape ON vec_id = activity_id JOIN mid USING (layer)""", "points routes")
def k9(spark, d):
    """The longest routes as groups; tracks of even ids have 192 points, of which every fifth is drawn."""
    c = F.col("coords")
    line = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.transform(c, lambda p: F.struct((p["lat"] + k * 1e-5).alias("lat"), p["lon"].alias("lon")))))
    r = t.routes(spark, d).select(F.concat(F.lit("Route "), F.col("activity_id").cast("string")).alias("name"), F.struct(-F.col("distance"), "activity_id").alias("ord"), F.when(F.col("activity_id") % 2 == 0, line).otherwise(c).alias("coords"))
    one = layers.map_layers(r).withColumn("layer", F.lit("all"))
    two = layers.map_layers(r, 5, None, True).withColumn("layer", F.lit("commute"))
    total = lambda k: F.round(geo.total(F.col("coords").getField(k)), 6).alias(k)
    return one.unionByName(two).select("layer", "place", "name", "show", "colour", F.size("coords").cast("long").alias("points"), total("lat"), total("lon"), F.round("center_lat", 7).alias("center_lat"), F.round("center_lon", 7).alias("center_lon"))


CORRIDORS = ((41.85, -87.66, 41.88, -87.62), (41.87, -87.64, 41.91, -87.60), (41.90, -87.62, 41.94, -87.58))


def _merged_sql(n: int = 2**14) -> str:
    x, y = lambda lon: f"CAST(floor(({lon!r}e0 + 180) / 360 * {n}) AS BIGINT)", lambda lat: f"CAST(floor((1 - asinh(tan(radians({lat!r}e0))) / pi()) / 2 * {n}) AS BIGINT)"
    boxes = " UNION ALL ".join(f"SELECT {x(w)} AS x0, {x(e)} AS x1, {y(north)} AS y0, {y(s)} AS y1" for s, w, north, e in CORRIDORS)
    return f"""
WITH p AS (SELECT DISTINCT {TILE.format(n=n)} FROM points), b AS ({boxes}), v AS (SELECT DISTINCT x, y FROM p JOIN b ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), n AS (SELECT sum((x1 - x0 + 1) * (y1 - y0 + 1)) AS total FROM b)
SELECT count(*) AS visited_count, CAST(any_value(total) AS BIGINT) AS total_in_bounds, floor(count(*) / any_value(total) * 1000 + 0.5e0) / 10 AS coverage_pct FROM v, n"""


@query("A36_merged_boxes", _merged_sql(), "points")
def a36(spark, d):
    """Coverage of three boxes that overlap."""
    p = t.points(spark, d).select(geo.tile_x(F.col("lon"), 14).alias("x"), geo.tile_y(F.col("lat"), 14).alias("y")).distinct()
    boxes = [coverage.tile_bounds(b, 14) for b in CORRIDORS]
    totals = spark.range(1).select(F.explode(F.array(*[((x1 - x0 + 1) * (y1 - y0 + 1)).cast("long") for x0, x1, y0, y1 in boxes])).alias("total_in_bounds"))
    tiles = p.select("x", "y", F.explode(F.array(*[F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), i) for i, (x0, x1, y0, y1) in enumerate(boxes)])).alias("box")).filter("box is not null")
    return layers.merged_coverage(totals, tiles).select("visited_count", "total_in_bounds", F.col("coverage_pct").cast("double").alias("coverage_pct"))


@query("G19_there_and_back", """
WITH p AS (SELECT a.vec_id, a.idx, CASE WHEN a.vec_id % 3 = 0 AND a.idx >= 16 THEN b.lat + 3e-4 ELSE a.lat END AS lat, CASE WHEN a.vec_id % 3 = 0 AND a.idx >= 16 THEN b.lon ELSE a.lon END AS lon FROM points a JOIN points b ON b.vec_id = a.vec_id AND b.idx = 31 - a.idx),
o AS (SELECT vec_id, lat, lon FROM p WHERE idx < 16), r AS (SELECT vec_id, idx, lat, lon FROM p WHERE idx >= 16), z AS (SELECT vec_id, 150 / 111320e0 AS dy, 150 / (111320e0 * greatest(0.01e0, abs(cos(radians(lat))))) AS dx FROM p WHERE idx = 0)
SELECT vec_id, avg(CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.vec_id = r.vec_id AND abs(o.lat - r.lat) <= dy AND abs(o.lon - r.lon) <= dx) THEN 1e0 ELSE 0e0 END) >= 0.7e0 AS out_and_back FROM r JOIN z USING (vec_id) GROUP BY 1""", "points")
def g19(spark, d):
    """Tracks of which every third returns on its way, 33 m beside it."""
    c = F.col("coords")
    back = F.transform(F.reverse(F.slice(c, 1, 16)), lambda p: F.struct((p["lat"] + 3e-4).alias("lat"), p["lon"].alias("lon")))
    line = F.when(F.col("vec_id") % 3 == 0, F.concat(F.slice(c, 1, 16), back)).otherwise(c)
    return t.tracks(spark, d).select("vec_id", out_and_back(line).alias("out_and_back"))


def _few(spark, d):
    """Weather whose days are moved apart, so that a day has few readings."""
    return t.weather(spark, d).withColumn("ts", F.col("ts") + F.make_dt_interval((F.col("event_id") % 500 * 40).cast("int")))


FEW = "weather AS (SELECT * REPLACE (ts + to_days(CAST(event_id % 500 * 40 AS INTEGER)) AS ts) FROM readings), " + DAILY
MEAN = "(hi + lo) / 2"
COMFORT = f"round_even(greatest(0e0, least(1e0, 1 - CASE WHEN {MEAN} < 0 THEN 0.4e0 WHEN {MEAN} < 10 THEN 0.2e0 WHEN {MEAN} > 35 THEN 0.5e0 WHEN {MEAN} > 30 THEN 0.3e0 ELSE 0e0 END - {WINDY.format(w='w')} - CASE WHEN mm > 5 THEN 0.4e0 WHEN mm > 0 THEN 0.2e0 ELSE 0e0 END)), 2)"


@query("C22_commutes_of_many_days", f"""
WITH {FEW}, x AS (SELECT date, 'to_work' AS direction, lo AS temp, w, p, mm, 480 AS middle, 450 AS early FROM daily UNION ALL SELECT date, 'to_home', hi, w, p, mm, 990, 945 FROM daily),
s AS (SELECT *, {POINTS} AS points, {TRANSIT} AS transit FROM x), r AS (SELECT *, CASE WHEN points = 0 THEN 'good' WHEN points <= 2 THEN 'fair' WHEN points <= 4 THEN 'poor' ELSE 'miserable' END AS severity FROM s),
d AS (SELECT date, bool_and(transit) AS both_transit, avg(CASE severity WHEN 'good' THEN 0 WHEN 'fair' THEN 1 WHEN 'poor' THEN 2 ELSE 3 END) AS m FROM r GROUP BY 1)
SELECT strftime(r.date, '%Y-%m-%d') AS date, direction, severity, transit, CAST(CASE WHEN p > 60 THEN early ELSE middle END AS INTEGER) AS departure,
  CASE WHEN both_transit THEN 'avoid' WHEN m = 0 THEN 'excellent' WHEN m <= 0.5 THEN 'good' WHEN m <= 1.5 THEN 'fair' WHEN m <= 2.5 THEN 'poor' ELSE 'avoid' END AS rating FROM r JOIN d ON r.date = d.date""", "readings=weather")
def c22(spark, d):
    return forecast.commute_week(forecast.daily(_few(spark, d))).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("C13_comfort_of_many_days", f"WITH {FEW} SELECT strftime(date, '%Y-%m-%d') AS date, {COMFORT} AS comfort FROM daily", "readings=weather")
def c13(spark, d):
    days = forecast.daily(_few(spark, d))
    return days.select(F.date_format("date", "yyyy-MM-dd").alias("date"), scores.comfort_daily(F.col("temp_max_c"), F.col("temp_min_c"), F.col("wind_speed_max_kph"), F.col("precipitation_sum_mm")).alias("comfort"))


#: A place beside home, from which rides are at many distances.
BESIDE = (41.8833, -87.6341)


@query("J10_rides_beside", f"WITH x AS (SELECT id, {hav('418833e-4', '-876341e-4', 'start_lat', 'start_lon')} AS m FROM activities) SELECT id, round(m, 4) AS metres FROM x WHERE m <= 1609.34e0 ORDER BY m, id LIMIT 100", "activities")
def j10(spark, d):
    m = haversine_m(F.lit(BESIDE[0]), F.lit(BESIDE[1]), F.col("start_lat"), F.col("start_lon"))
    near = t.activities(spark, d).withColumn("m", m).filter(F.col("m") <= 1609.34)
    return near.orderBy("m", "id").limit(100).select("id", F.round("m", 4).alias("metres"))


NEAR = f"coalesce(greatest(0, 1 - {hav('4188e-2', '-8763e-2', 'start_lat', 'start_lon')} / 16093.4e0), 1)"


@query("C11_rides_of_a_week", f"""
WITH {FEW}, week AS (SELECT date, {COMFORT} AS comfort FROM daily WHERE date >= DATE '2025-01-01' ORDER BY date LIMIT 7), rides AS (SELECT id, 1e0 / (id % 7 + 1) AS variety, {NEAR} AS near FROM activities WHERE distance >= 15000)
SELECT strftime(date, '%Y-%m-%d') AS date, id, round(comfort * 0.5e0 + variety * 0.3e0 + near * 0.2e0, 6) AS score FROM week, rides""", "readings=weather activities")
def c11(spark, d):
    """Every ride on each of seven days, by the day's weather, how seldom it was ridden and how near it starts."""
    days = forecast.daily(_few(spark, d)).filter("date >= date '2025-01-01'").orderBy("date").limit(7)
    week = days.select(F.date_format("date", "yyyy-MM-dd").alias("date"), scores.comfort_daily(F.col("temp_max_c"), F.col("temp_min_c"), F.col("wind_speed_max_kph"), F.col("precipitation_sum_mm")).alias("comfort"))
    near = scores.proximity(haversine_m(F.lit(t.HOME[0]), F.lit(t.HOME[1]), F.col("start_lat"), F.col("start_lon")))
    rides = t.activities(spark, d).filter("distance >= 15000").select("id", scores.variety(F.col("id") % 7).alias("variety"), near.alias("near"))
    return rides.join(F.broadcast(week)).select("date", "id", F.round(F.col("comfort") * 0.5 + F.col("variety") * 0.3 + F.col("near") * 0.2, 6).alias("score"))


@query("C10_workout_rides_nearby", f"""
WITH s AS (SELECT id, moving_time / 60e0 AS m, id % 7 AS uses, {NEAR} AS near FROM activities WHERE distance >= 15000),
x AS (SELECT id, CASE WHEN abs(m - 90) <= 15 THEN 1 - abs(m - 90) / 15 * 0.3e0 ELSE greatest(0, 0.7e0 - (abs(m - 90) - 15) / 60) END * 0.5e0 + 1e0 / (uses + 1) * 0.3e0 + near * 0.2e0 AS score FROM s)
SELECT id, round(score, 6) AS score FROM x""", "activities")
def c10(spark, d):
    near = scores.proximity(haversine_m(F.lit(t.HOME[0]), F.lit(t.HOME[1]), F.col("start_lat"), F.col("start_lon")))
    score = scores.duration_fit(F.col("moving_time") / 60.0, F.lit(90.0)) * 0.5 + scores.variety(F.col("id") % 7) * 0.3 + near * 0.2
    return t.activities(spark, d).filter("distance >= 15000").select("id", F.round(score, 6).alias("score"))


def _gpx_sql() -> str:
    head = "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<gpx version=\"1.1\" creator=\"spokeframe\" xmlns=\"http://www.topografix.com/GPX/1/1\">' || chr(10)"
    body = lambda tag: f"string_agg('    <{tag} lat=\"' || lat || '\" lon=\"' || lon || '\"/>', chr(10) ORDER BY idx)"
    title = "'    <name>Ride &lt;' || vec_id || '&gt; &amp; &quot;home&quot;</name>' || chr(10)"
    return f"""
WITH p AS (SELECT vec_id, idx, round(lat, 6) AS lat, round(lon, 6) AS lon FROM points), b AS (SELECT vec_id, {body('rtept')} AS route, {body('trkpt')} AS track FROM p GROUP BY 1)
SELECT vec_id, md5({head} || '  <rte>' || chr(10) || {title} || '    <desc>Score: ' || vec_id || ' &gt; 1</desc>' || chr(10) || route || chr(10) || '  </rte>' || chr(10) || '</gpx>' || chr(10)) AS route,
 md5({head} || '  <trk>' || chr(10) || {title} || '    <trkseg>' || chr(10) || track || chr(10) || '    </trkseg>' || chr(10) || '  </trk>' || chr(10) || '</gpx>' || chr(10)) AS track FROM b"""


@query("K7_K8_gpx_text", _gpx_sql(), "points")
def k7(spark, d):
    """The whole text of routes and tracks, with a title that is escaped."""
    n = F.col("vec_id").cast("string")
    line = F.transform("coords", lambda p: F.struct(F.round(p["lat"], 6).alias("lat"), F.round(p["lon"], 6).alias("lon")))
    name, note = F.concat(F.lit("Ride <"), n, F.lit('> & "home"')), F.concat(F.lit("Score: "), n, F.lit(" > 1"))
    return t.tracks(spark, d).select("vec_id", *[F.md5(sinks.gpx(name, note, line, track).cast("binary")).alias(k) for k, track in (("route", False), ("track", True))])


@query("K6_csv_of_ranked_routes", f"""
WITH {SCORES}, f AS (SELECT c.group_id, c.direction, score, c.uses, c.avg_duration, c.avg_distance, c.avg_speed, weather, safety FROM (SELECT c.*, g.avg_duration, g.avg_distance, g.avg_speed FROM c JOIN groups g USING (group_id)) c)
SELECT group_id AS route_id, direction, printf('%.1f', score) AS score, CAST(uses AS VARCHAR) AS frequency, printf('%.1f', avg_duration / 60) AS avg_duration_min, printf('%.2f', avg_distance) AS avg_distance, printf('%.1f', avg_speed) AS avg_speed, printf('%.1f', weather) AS weather_score, printf('%.1f', safety) AS safety_score, '0.0' AS efficiency_score FROM f""", "points groups")
def k6(spark, d):
    """The export's rows as SQL makes them. No rule gives an efficiency, so that column is zero as in the export."""
    from .q_more import k6 as rows

    return rows(spark, d)


@query("J12_S13_water_of_documents", f"""
WITH ring AS (SELECT vec_id, idx AS i, lat, lon FROM points WHERE idx < 4 + vec_id % 3), edge AS (SELECT r.vec_id, r.lat AS y1, r.lon AS x1, q.lat AS y2, q.lon AS x2 FROM ring r JOIN ring q ON q.vec_id = r.vec_id AND q.i = (r.i + 3 + r.vec_id % 3) % (4 + r.vec_id % 3) WHERE r.vec_id % 5 > 0),
t AS (SELECT x, y, (degrees(atan((exp(pi() * (1 - 2 * y / 16384e0)) - exp(-pi() * (1 - 2 * y / 16384e0))) / 2)) + degrees(atan((exp(pi() * (1 - 2 * (y + 1) / 16384e0)) - exp(-pi() * (1 - 2 * (y + 1) / 16384e0))) / 2))) / 2 AS lat, (x + 0.5e0) / 16384 * 360 - 180 AS lon FROM (SELECT DISTINCT {TILE.format(n=2**14)} FROM points))
SELECT DISTINCT x, y FROM (SELECT x, y FROM t, edge GROUP BY x, y, lat, lon, vec_id HAVING count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1)""", "points")
def j12(spark, d):
    """The first points of each track as a polygon of water, written as the map's documents: ways, outer members of relations, and inner ones, which do not count."""
    n, key = F.col("vec_id"), F.col("vec_id")
    ring = F.slice("coords", 1, (4 + n % 3).cast("int"))
    none = F.lit(None)
    shape = "array<struct<lat:double,lon:double>>"
    member = F.array(F.struct(F.when(n % 5 == 0, "inner").otherwise("outer").alias("role"), ring.alias("geometry")))
    way = n % 2 == 1
    whole = (n % 5 == 0) & way  # ways always count, so these are written with too few points
    e = t.tracks(spark, d).select(key.alias("n"), F.struct(F.when(way, "way").otherwise("relation").alias("type"), F.when(way, F.when(whole, F.slice("coords", 1, 2)).otherwise(ring)).otherwise(none.cast(shape)).alias("geometry"), F.when(~way, member).otherwise(none.cast(f"array<struct<role:string,geometry:{shape}>>")).alias("members")).alias("e"))
    path = _documents(e, "n", lambda r: F.to_json(F.struct(r.getField("e").alias("elements"))), spark)
    tiles = t.points(spark, d).select(geo.tile_x(F.col("lon"), 14).alias("x"), geo.tile_y(F.col("lat"), 14).alias("y")).distinct()
    return coverage.water_tiles(tiles, readers.water_polygons(spark, path), 14)
