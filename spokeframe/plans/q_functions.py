"""Queries of scalar functions: text, dates, units, geometry and wind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geo, text, units, wind
from ..registry import query
from ..shared import table
from ..sources import testdata as t
from .q_rollups import geod

STREETS = text.STREET_KINDS


@query("F1_F2_ride_names", r"SELECT id, coalesce(regexp_matches(lower(name), 'work|commute'), false) AS commute, trim(regexp_replace(regexp_replace(lower(name), '[#\d/\-]+', '', 'g'), '\s+', ' ', 'g')) AS norm FROM activities", "activities")
def f1(spark, d):
    return t.activities(spark, d).select("id", F.coalesce(text.contains_any(F.col("name"), text.COMMUTE_WORDS), F.lit(False)).alias("commute"), text.normalise_ride_name(F.col("name")).alias("norm"))


@query("F3_sanitise_name", r"""
WITH b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[{}<>]', '', 'g'), '\[.*?\]', '', 'g'), '\(.*?\)', '', 'g') AS bare, text FROM documents)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'Unnamed Activity' WHEN length(bare) > 100 THEN trim(substr(bare, 1, 97) || '...') ELSE trim(bare) END AS name FROM b""")
def f3(spark, d):
    return table(spark, d, "documents").select("doc_id", text.sanitise_name(F.col("text")).alias("name"))


@query("F4_F7_redaction", rf"""
SELECT doc_id, regexp_replace(note, '(-?\d+\.\d{{2}})\d+', '\1xx', 'g') AS coordinates,
  regexp_replace(regexp_replace(note, '\d+\s+[A-Z][a-z]+\s+({STREETS})', '[STREET]', 'gi'), '\d+\s+[A-Z][a-z]+\s+[A-Z][a-z]+\s+({STREETS})', '[STREET]', 'gi') AS streets,
  '[ID:' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 8) || ']' AS id_hash, regexp_replace(note, '{text.EMAIL}', '[EMAIL]@\1', 'g') AS emails FROM notes""", "notes")
def f4(spark, d):
    note = F.col("note")
    return t.notes(spark, d).select("doc_id", text.mask_coordinates(note).alias("coordinates"), text.redact_streets(note).alias("streets"), text.hash_id(F.col("doc_id")).alias("id_hash"), text.redact_emails(note).alias("emails"))


@query("F8_F9_computed_redaction", """
SELECT doc_id, 'Ride 41.' || (100000 + doc_id) || ', -87.' || (200000 + doc_id) || ' from ' || (doc_id % 90 + 10) || ' Oak Park Ave, rider' || doc_id || '@mail.example.com token=[TOKEN:' || (3 + length(CAST(doc_id AS VARCHAR))) || '] activity_id: ' || (10000000 + doc_id) || ' Bearer [TOKEN=[TOKEN:1]]' AS tokens,
  replace(note, ' activity_id: ' || (10000000 + doc_id), ' activity_id: [STRAVA:' || substr(sha256(CAST(10000000 + doc_id AS VARCHAR)), 1, 8) || ']') AS provider_ids FROM notes""", "notes")
def f8(spark, d):
    note = F.col("note")
    return t.notes(spark, d).select("doc_id", text.redact_tokens(note).alias("tokens"), text.redact_provider_ids(note).alias("provider_ids"))


@query("F10_redact_documents")
def f10(spark, d):
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("text"))


@query("F11_F13_workouts", r"""
WITH w AS (SELECT p_partkey, p_name AS summary, (p_size % 3) || ':' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') || ' - ' || CASE p_partkey % 7 WHEN 0 THEN 'VO2max' WHEN 1 THEN 'Sweet Spot' WHEN 2 THEN 'Easy spin' WHEN 3 THEN 'Tempo' WHEN 4 THEN 'Over-Under' WHEN 5 THEN 'Group ride' ELSE 'Day off' END AS title,
  CASE WHEN p_partkey % 4 = 0 THEN 'TSS: ' || p_size WHEN p_partkey % 4 = 1 THEN p_size || ' tss, IF 0.' || p_size ELSE '' END AS description FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(lower(title || ' ' || description), 'vo2|v02') THEN 'VO2Max' WHEN regexp_matches(lower(title), 'anaerobic|over-under') THEN 'Anaerobic' WHEN regexp_matches(lower(title), 'sweet spot|threshold') THEN 'Threshold'
  WHEN lower(title) LIKE '%tempo%' THEN 'Tempo' WHEN regexp_matches(lower(title), 'endurance|easy|recovery|base') THEN 'Endurance' WHEN lower(title) LIKE '%group%' THEN 'Group Ride' END AS kind,
  CAST(regexp_extract(title, '^(\d+):(\d\d)', 1) AS INTEGER) * 60 + CAST(regexp_extract(title, '^(\d+):(\d\d)', 2) AS INTEGER) AS minutes,
  CAST(nullif(coalesce(nullif(regexp_extract(lower(description), '(\d+)\s*tss\b', 1), ''), regexp_extract(lower(description), '\btss[:\s]+(\d+)', 1)), '') AS DOUBLE) AS tss,
  CAST(nullif(regexp_extract(lower(description), 'if[:\s]+([0-9.]+)', 1), '') AS DOUBLE) AS intensity FROM w""")
def f11(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    kinds = F.array(*[F.lit(x) for x in ("VO2max", "Sweet Spot", "Easy spin", "Tempo", "Over-Under", "Group ride", "Day off")])
    title = F.concat((F.col("p_size") % 3).cast("string"), F.lit(":"), F.lpad((key % 60).cast("string"), 2, "0"), F.lit(" - "), F.get(kinds, (key % 7).cast("int")))
    size = F.col("p_size").cast("string")
    description = F.when(key % 4 == 0, F.concat(F.lit("TSS: "), size)).when(key % 4 == 1, F.concat(size, F.lit(" tss, IF 0."), size)).otherwise("")
    w = p.select("p_partkey", title.alias("title"), description.alias("description"))
    none = F.lit(None).cast("timestamp")
    return w.select("p_partkey", text.workout_type(F.col("title"), F.col("description")).alias("kind"), text.workout_minutes(none, none, F.col("title")).alias("minutes"), text.stress_score(F.col("description")).alias("tss"), text.intensity_factor(F.col("description")).alias("intensity"))


def _fixed(x: str, digits: int) -> str:
    """What Java's %.nf makes of a double, in SQL: halves go up."""
    return f"CAST(CAST(round(CAST({x} AS DECIMAL(38, 14)), {digits}) AS DECIMAL(18, {digits})) AS VARCHAR)"


@query("F15_fallback_names", f"""
SELECT id, CASE WHEN distance = 0 THEN 'Unnamed Ride' ELSE CASE WHEN start_lat IS NULL OR end_lat IS NULL THEN 'Ride (' WHEN (abs(start_lat - end_lat) + abs(start_lon - end_lon)) * 1e5 < 500 THEN 'Loop Ride (' ELSE 'Out & Back (' END || {_fixed('distance / 1000', 1)} || 'km)' END AS name FROM activities""", "activities")
def f15(spark, d):
    apart = (F.abs(F.col("start_lat") - F.col("end_lat")) + F.abs(F.col("start_lon") - F.col("end_lon"))) * 1e5
    return t.activities(spark, d).select("id", text.fallback_ride_name(apart, F.col("distance")).alias("name"))


@query("F17_place_labels", "SELECT c_custkey, concat_ws(', ', nullif(trim(n_name), ''), nullif(trim(r_name), ''), CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END) AS label FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def f17(spark, d):
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_custkey", text.place_label(F.col("n_name"), F.col("r_name"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))).alias("label"))


@query("F19_F23_dates", """
SELECT id, strftime(start_local, '%Y-%m-%d') AS day, strftime(start_local, '%G-W%V') AS week, strftime(start_local, '%Y-%m') AS month, strftime(start_local, '%A') AS weekday,
  start_local + to_seconds(elapsed_time) AS ends, CAST(hour(start_local) * 3600 + minute(start_local) * 60 + second(start_local) AS INTEGER) AS seconds, strftime(start_local, '%H:%M:%S') AS clock FROM activities WHERE start_local IS NOT NULL""", "activities")
def f19(spark, d):
    at = F.col("start_local")
    rides = t.activities(spark, d).filter(at.isNotNull())
    seconds = dates.seconds_of_day(at)
    return rides.select("id", F.date_format(at, "yyyy-MM-dd").alias("day"), dates.week_label(at).alias("week"), dates.month_label(at).alias("month"), F.date_format(at, "EEEE").alias("weekday"), (at + F.make_dt_interval(secs=F.col("elapsed_time"))).alias("ends"), seconds.cast("int").alias("seconds"), dates.clock(seconds).alias("clock"))


@query("F24_F37_which_way", """
SELECT id, CASE WHEN hour(start_local) < 10 THEN 'today' ELSE 'tomorrow' END AS to_work, CASE WHEN hour(start_local) < 18 THEN 'today' ELSE 'tomorrow' END AS to_home,
  CASE WHEN isodow(start_local) >= 6 THEN 'weekend' WHEN hour(start_local) BETWEEN 5 AND 9 THEN 'to_work' WHEN hour(start_local) BETWEEN 15 AND 18 THEN 'to_home' ELSE 'off_peak' END AS shown FROM activities WHERE start_local IS NOT NULL""", "activities")
def f24(spark, d):
    at = F.col("start_local")
    return t.activities(spark, d).filter(at.isNotNull()).select("id", dates.next_commute_day(F.hour(at), "to_work").alias("to_work"), dates.next_commute_day(F.hour(at), "to_home").alias("to_home"), dates.dashboard_direction(at).alias("shown"))


@query("F25_F26_departure_age", """
SELECT event_id, CAST(CASE WHEN precipitation_prob > 60 THEN 420 + (480 - 420) // 2 ELSE 480 END AS INTEGER) AS minute,
  CASE WHEN temp_c < 2 THEN 'fresh' WHEN temp_c < 24 THEN 'stale' ELSE 'expired' END AS age FROM weather""", "weather")
def f25(spark, d):
    return t.weather(spark, d).select("event_id", dates.departure_minute(F.lit(420), F.lit(540), F.col("precipitation_prob")).alias("minute"), dates.staleness(F.col("temp_c")).alias("age"))


@query("F27_units", f"SELECT id, {_fixed('distance / 1609.34e0', 1)} || ' mi' AS miles, {_fixed('average_speed * 3.6e0', 1)} || ' km/h' AS speed, {_fixed('total_elevation_gain * 3.28084e0', 0)} || ' ft' AS feet FROM activities", "activities")
def f27(spark, d):
    return t.activities(spark, d).select("id", units.distance_text(F.col("distance"), True).alias("miles"), units.speed_text(F.col("average_speed")).alias("speed"), units.elevation_text(F.col("total_elevation_gain"), True).alias("feet"))


COMPASS = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW']"


@query("F28_F29_compass_conditions", f"""
SELECT event_id, {COMPASS}[1 + CAST(round_even(wind_direction_deg / 22.5e0, 0) AS INTEGER) % 16] AS even, {COMPASS}[1 + CAST(floor((wind_direction_deg + 11.25e0) / 22.5e0) AS INTEGER) % 16] AS up,
  CASE WHEN code = 0 THEN 'Clear Sky' WHEN code = 1 THEN 'Mainly Clear' WHEN code = 2 THEN 'Partly Cloudy' WHEN code = 3 THEN 'Overcast' WHEN code IN (45, 48) THEN 'Foggy' WHEN code IN (51, 53, 55) THEN 'Drizzle' WHEN code IN (61, 63, 65) THEN 'Rain'
    WHEN code IN (71, 73, 75, 77) THEN 'Snow' WHEN code IN (80, 81, 82) THEN 'Rain Showers' WHEN code IN (85, 86) THEN 'Snow Showers' WHEN code IN (95, 96, 99) THEN 'Thunderstorm' ELSE 'Unknown' END AS conditions FROM weather""", "weather")
def f28(spark, d):
    deg = F.col("wind_direction_deg")
    return t.weather(spark, d).select("event_id", wind.compass_even(deg).alias("even"), wind.compass_up(deg).alias("up"), wind.conditions(F.col("code")).alias("conditions"))


@query("F38_target_distance", "SELECT CAST(h AS INTEGER) AS hours, round(h * coalesce(nullif(round_even(avg(nullif(average_speed, 0)) * 2.23694e0, 1), 0) * 1.60934e0, 18), 6) AS km FROM activities, generate_series(1, 5) g(h) GROUP BY h", "activities")
def f38(spark, d):
    speed = units.even(units.mph(F.avg(units.truthy(F.col("average_speed")))), 1)
    kmh = t.activities(spark, d).agg(F.coalesce(units.truthy(speed) * 1.60934, F.lit(18.0)).alias("kmh"))
    return kmh.select(F.explode(F.sequence(F.lit(1), F.lit(5))).alias("hours"), "kmh").select("hours", F.round(F.col("hours") * F.col("kmh"), 6).alias("km"))


@query("F32_F33_F34_sampling", """
SELECT vec_id, count(*) AS points, CAST(sum(CASE WHEN idx % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS every_fifth, string_agg(CASE WHEN idx IN (0, 10, 20, 30) THEN CAST(idx AS VARCHAR) END, ',' ORDER BY idx) AS segments FROM points GROUP BY vec_id""", "points")
def f33(spark, d):
    c = F.col("coords")
    return t.tracks(spark, d).select("vec_id", F.size(c).cast("long").alias("points"), F.size(geo.sampled(c, 5, 10)).cast("long").alias("every_fifth"), F.array_join(F.sort_array(wind.sampled_segments(c)).cast("array<string>"), ",").alias("segments"))


@query("F35_F36_keys", """
SELECT vec_id, substr(sha256(string_agg(printf('%.3f,%.3f', floor(lat * 1000) / 1000, floor(lon * 1000) / 1000), ';' ORDER BY idx)), 1, 16) AS route_key, substr(md5(string_agg(CAST(CAST(floor(lat * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY idx)), 1, 12) AS box_key
FROM points WHERE idx IN (0, 8, 16, 24, 31) GROUP BY vec_id""", "points")
def f35(spark, d):
    some = F.transform(F.array(*[F.lit(i) for i in (0, 8, 16, 24, 31)]), lambda i: F.get("coords", i))
    cut = lambda x: F.floor(x * 1000) / 1000
    key = F.array_join(F.transform(some, lambda p: F.format_string("%.3f,%.3f", cut(p["lat"]), cut(p["lon"]))), ";")
    box = F.array_join(F.transform(some, lambda p: F.floor(p["lat"] * 10000).cast("string")), ",")
    return t.tracks(spark, d).select("vec_id", F.substring(F.sha2(key, 256), 1, 16).alias("route_key"), F.substring(F.md5(box.cast("binary")), 1, 12).alias("box_key"))


SEGMENTS = """seg AS (SELECT vec_id, idx, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM points WINDOW w AS (PARTITION BY vec_id ORDER BY idx))"""
HAV = "(12742000 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"
BEARING = "((degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360) % 360)"


@query("G1_G3_G28_segments", f"WITH {SEGMENTS} SELECT vec_id, idx, round({HAV}, 5) AS metres, round({BEARING}, 6) AS bearing, CASE WHEN {BEARING} < 90 THEN 'NE' WHEN {BEARING} < 180 THEN 'SE' WHEN {BEARING} < 270 THEN 'SW' ELSE 'NW' END AS quadrant FROM seg WHERE lat2 IS NOT NULL", "points")
def g1(spark, d):
    seg = t.tracks(spark, d).select("vec_id", F.posexplode(geo.segments(F.col("coords"))).alias("idx", "s")).select("vec_id", "idx", "s.*")
    at = [F.col(c) for c in ("lat1", "lon1", "lat2", "lon2")]
    degrees = geo.bearing(*at)
    return seg.select("vec_id", "idx", F.round(geo.haversine_m(*at), 5).alias("metres"), F.round(degrees, 6).alias("bearing"), geo.quadrant(degrees).alias("quadrant"))


@query("G4_box_centroid_length", f"""
WITH {SEGMENTS}, len AS (SELECT vec_id, sum(sqrt(pow(lat2 - lat1, 2) + pow(lon2 - lon1, 2))) AS length FROM seg WHERE lat2 IS NOT NULL GROUP BY 1)
SELECT p.vec_id, round(min(lat), 8) AS min_lat, round(max(lon), 8) AS max_lon, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon, round(any_value(length), 8) AS length FROM points p JOIN len USING (vec_id) GROUP BY p.vec_id""", "points")
def g4(spark, d):
    c, box = F.col("coords"), geo.bbox(F.col("coords"))
    r = lambda x: F.round(x, 8)
    return t.tracks(spark, d).select("vec_id", r(box["min_lat"]).alias("min_lat"), r(box["max_lon"]).alias("max_lon"), r(geo.mean(c.getField("lat"))).alias("lat"), r(geo.mean(c.getField("lon"))).alias("lon"), r(geo.path_length_deg(c)).alias("length"))


KM = "m AS (SELECT vec_id, avg(lat) AS mid FROM points GROUP BY 1), km AS (SELECT p.vec_id, idx, lat * 111.32e0 AS y, lon * 111.32e0 * cos(radians(mid)) AS x FROM points p JOIN m USING (vec_id))"


@query("G5_G6_extent", f"""
WITH {KM}, s AS (SELECT vec_id, x AS x0, y AS y0 FROM km WHERE idx = 0), e AS (SELECT vec_id, arg_max(idx, (round(sqrt(pow(x - x0, 2) + pow(y - y0, 2)), 9), -idx)) AS far, max(sqrt(pow(x - x0, 2) + pow(y - y0, 2))) AS d FROM km JOIN s USING (vec_id) GROUP BY 1),
l AS (SELECT vec_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM km WINDOW w AS (PARTITION BY vec_id ORDER BY idx))
SELECT vec_id, round(d, 6) AS extent_km, round((SELECT sum(step) FROM l WHERE l.vec_id = e.vec_id), 6) AS path_km FROM e""", "points")
def g5(spark, d):
    k = t.tracks(spark, d).select("vec_id", geo.to_km(F.col("coords")).alias("km"))
    start, far = F.get("km", F.lit(0)), geo.extent_point(F.col("km"))
    return k.select("vec_id", F.round(F.hypot(far["lat"] - start["lat"], far["lon"] - start["lon"]), 6).alias("extent_km"), F.round(geo.path_length_deg(F.col("km")), 6).alias("path_km"))


@query("G14_wind_components", f"""
WITH x AS (SELECT event_id, wind_speed_kph AS v, (wind_direction_deg - 90 + 360) % 360 AS turned FROM weather), y AS (SELECT *, CASE WHEN turned > 180 THEN turned - 360 ELSE turned END AS angle FROM x)
SELECT event_id, round(v * cos(radians(angle)), 6) + 0 AS head, round(abs(v * sin(radians(angle))), 6) AS cross_kph, round(angle, 6) AS angle FROM y""", "weather")
def g14(spark, d):
    v, w, travel = F.col("wind_speed_kph"), F.col("wind_direction_deg"), F.lit(90.0)
    return t.weather(spark, d).select("event_id", (F.round(wind.headwind(v, w, travel), 6) + 0.0).alias("head"), F.round(wind.crosswind(v, w, travel), 6).alias("cross_kph"), F.round(wind.relative_angle(w, travel), 6).alias("angle"))


IMPACT = f"""{SEGMENTS}, part AS (SELECT vec_id, {HAV} / 1000 AS km, {BEARING} AS b FROM seg WHERE idx IN (0, 10, 20, 30)), turned AS (SELECT *, ((225 - b) % 360 + 360) % 360 AS raw FROM part),
angled AS (SELECT vec_id, km, 25 * cos(radians(CASE WHEN raw > 180 THEN raw - 360 ELSE raw END)) AS head, abs(25 * sin(radians(CASE WHEN raw > 180 THEN raw - 360 ELSE raw END))) AS cross_kph FROM turned),
impact AS (SELECT vec_id, sum(head * km) / sum(km) AS head, sum(cross_kph * km) / sum(km) AS cross_kph, max(head) AS max_head, max(cross_kph) AS max_cross FROM angled GROUP BY 1)"""


@query("G15_wind_impact", f"""
WITH {IMPACT} SELECT vec_id, round(head, 6) AS avg_headwind_kph, round(cross_kph, 6) AS avg_crosswind_kph, round(max_head, 6) AS max_headwind_kph, round(max_cross, 6) AS max_crosswind_kph,
  round(head * CASE WHEN head > 0 THEN 1.5 ELSE 1.0 END + cross_kph * 0.5, 6) AS time_penalty_pct, CASE WHEN head < -5 THEN 'favorable' WHEN head > 5 THEN 'unfavorable' ELSE 'neutral' END AS wind_favorability FROM impact""", "points")
def g15(spark, d):
    found = t.tracks(spark, d).select("vec_id", wind.wind_impact(F.col("coords"), F.lit(25.0), F.lit(225.0)).alias("w")).select("vec_id", "w.*")
    return found.select(*[F.round(c, 6).alias(c) if c.endswith(("kph", "pct")) else F.col(c) for c in found.columns])


@query("G17_route_type", f"""
WITH q AS (SELECT vec_id, max(CASE WHEN idx = 0 THEN lat END) AS a1, max(CASE WHEN idx = 0 THEN lon END) AS b1, max(CASE WHEN idx = 31 THEN lat END) AS a2, max(CASE WHEN idx = 31 THEN lon END) AS b2, max(CASE WHEN idx = 16 THEN lat END) AS a3, max(CASE WHEN idx = 16 THEN lon END) AS b3,
  max(CASE WHEN idx = 8 THEN lat END) AS a4, max(CASE WHEN idx = 8 THEN lon END) AS b4, max(CASE WHEN idx = 24 THEN lat END) AS a5, max(CASE WHEN idx = 24 THEN lon END) AS b5 FROM points GROUP BY 1),
h AS (SELECT vec_id, {HAV.replace('lat1', 'a1').replace('lon1', 'b1').replace('lat2', 'a2').replace('lon2', 'b2')} AS ends, {HAV.replace('lat1', 'a1').replace('lon1', 'b1').replace('lat2', 'a3').replace('lon2', 'b3')} AS mid, {HAV.replace('lat1', 'a4').replace('lon1', 'b4').replace('lat2', 'a5').replace('lon2', 'b5')} AS back, {geod('a1', 'b1', 'a2', 'b2')} AS apart FROM q)
SELECT vec_id, CASE WHEN ends <= 1500 AND mid > 1000 AND back < mid * 0.3 THEN 'out-and-back' WHEN ends <= 1500 THEN 'loop' ELSE 'point-to-point' END AS type, apart < 500 AS is_loop FROM h""", "points")
def g17(spark, d):
    return t.tracks(spark, d).select("vec_id", geo.route_type(F.col("coords"), 1.5).alias("type"), geo.is_loop(F.col("coords")).alias("is_loop"))


TILE = "CAST(floor((lon + 180) / 360 * {n}) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * {n}) AS BIGINT) AS y"


@query("G20_tiles", f"SELECT vec_id, idx, {TILE.format(n=2**14)}, round(floor((lon + 180) / 360 * {2**14}) / {2**14} * 360 - 180, 8) AS west FROM points", "points")
def g20(spark, d):
    x = geo.tile_x(F.col("lon"), 14)
    return t.points(spark, d).select("vec_id", "idx", x.alias("x"), geo.tile_y(F.col("lat"), 14).alias("y"), F.round(geo.tile_west(x, 14), 8).alias("west"))


@query("G22_interpolation", f"""
WITH {SEGMENTS}, k AS (SELECT *, CAST(greatest(1, ceil({HAV} / 80)) AS INTEGER) AS steps FROM seg WHERE lat2 IS NOT NULL)
SELECT vec_id, idx, CAST(i AS INTEGER) AS i, round(lat1 + i / CAST(steps AS DOUBLE) * (lat2 - lat1), 7) AS lat, round(lon1 + i / CAST(steps AS DOUBLE) * (lon2 - lon1), 7) AS lon FROM k, LATERAL (SELECT unnest(generate_series(1, steps)) AS i)""", "points")
def g22(spark, d):
    from ..operators.coverage import interpolate

    return interpolate(t.tracks(spark, d), "vec_id").filter("idx >= 0").select("vec_id", "idx", "i", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("G23_point_in_polygon", """
WITH ring(i, a, b) AS (VALUES (0, 41.87e0, -87.64e0), (1, 41.89e0, -87.645e0), (2, 41.895e0, -87.62e0), (3, 41.88e0, -87.625e0), (4, 41.872e0, -87.615e0)),
edge AS (SELECT r.a AS y1, r.b AS x1, q.a AS y2, q.b AS x2 FROM ring r JOIN ring q ON q.i = (r.i + 4) % 5)
SELECT vec_id, idx, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1 AS inside FROM points, edge GROUP BY vec_id, idx""", "points")
def g23(spark, d):
    corners = ((41.87, -87.64), (41.89, -87.645), (41.895, -87.62), (41.88, -87.625), (41.872, -87.615))
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in corners])
    return t.points(spark, d).select("vec_id", "idx", geo.inside(F.col("lat"), F.col("lon"), ring).alias("inside"))


@query("G24_displacement", """
WITH x AS (SELECT vec_id, idx, radians(lat) AS a, radians(lon) AS b, (idx + 1) / 6371e0 AS k, radians(idx * 11e0) AS g FROM points), y AS (SELECT *, asin(sin(a) * cos(k) + cos(a) * sin(k) * cos(g)) AS a2 FROM x)
SELECT vec_id, idx, round(degrees(a2), 7) AS lat, round(degrees(b + atan2(sin(g) * sin(k) * cos(a), cos(k) - sin(a) * sin(a2))), 7) AS lon FROM y""", "points")
def g24(spark, d):
    lat, lon = geo.displace(F.col("lat"), F.col("lon"), (F.col("idx") + 1).cast("double"), F.col("idx") * 11.0)
    return t.points(spark, d).select("vec_id", "idx", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query("G25_corridor_boxes", """
WITH e AS (SELECT id, start_lat AS a, start_lon AS b, end_lat AS c, end_lon AS d, CAST(greatest(1, ceil(greatest(abs(end_lat - start_lat), abs(end_lon - start_lon)) / 1e-2)) AS INTEGER) AS n FROM activities WHERE start_lat IS NOT NULL AND end_lat IS NOT NULL),
s AS (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM e), p AS (SELECT id, CAST(i AS INTEGER) AS i, a + (c - a) * (i / CAST(n AS DOUBLE)) AS y0, b + (d - b) * (i / CAST(n AS DOUBLE)) AS x0, a + (c - a) * ((i + 1) / CAST(n AS DOUBLE)) AS y1, b + (d - b) * ((i + 1) / CAST(n AS DOUBLE)) AS x1 FROM s)
SELECT id, i, round(least(y0, y1) - 2 / 69e0, 7) AS south, round(greatest(x0, x1) + 2 / (69.172e0 * cos(radians((y0 + y1) / 2))), 7) AS east FROM p""", "activities")
def g25(spark, d):
    from ..operators.coverage import corridor_boxes

    rides = t.activities(spark, d).filter("start_lat is not null and end_lat is not null")
    return corridor_boxes(rides, miles=2.0, widest_deg=1e-2).select("id", "i", F.round("south", 7).alias("south"), F.round("east", 7).alias("east"))


@query("P17_P18_A18_A19_windows", f"""
WITH h AS (SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN hour(ts) BETWEEN 7 AND 8 THEN 'morning' WHEN hour(ts) BETWEEN 15 AND 17 THEN 'evening' END AS part, event_id, ts, round_even(temp_c * 9 / 5 + 32, 0) AS f, round_even(wind_speed_kph * 0.621371e0, 0) AS mph, precipitation_prob AS p,
  {COMPASS}[1 + CAST(round_even(wind_direction_deg / 22.5e0, 0) AS INTEGER) % 16] AS way, wind_direction_deg FROM weather),
m AS (SELECT day, part, way, count(*) AS n FROM h WHERE part IS NOT NULL GROUP BY 1, 2, 3), w AS (SELECT day, part, arg_min(way, (-n, way)) AS way FROM m GROUP BY 1, 2)
SELECT h.day, h.part, round_even(avg(f), 0) AS avg_temp_f, round_even(avg(mph), 0) AS avg_wind_mph, max(p) AS max_precip_prob, any_value(w.way) AS dominant_wind, strftime(arg_min(ts, (p * 2 + mph, event_id)), '%H:%M') AS optimal_departure, round(avg(wind_direction_deg), 6) AS mean_direction
FROM h JOIN w ON h.day = w.day AND h.part = w.part GROUP BY 1, 2""", "weather")
def p17(spark, d):
    from ..operators.forecast import window_summary

    return window_summary(t.weather(spark, d))
