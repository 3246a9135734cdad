"""Queries of readers and sinks: rows are written as the files that a reader takes, and read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..registry import query
from ..shared import shared_dir, table
from ..sources import readers, sinks
from ..sources import testdata as t
from .q_functions import SEGMENTS
from .q_tracks import EDGES, _edges

#: Rows of a document, and numbers of a document of roads, some megabytes.
PAGE, ROADS = 200, 20_000
POINT = "CASE WHEN o_orderkey % 7 = 0 OR o_custkey % 5 = 0 THEN 0e0 ELSE"


def _documents(rows, key: str, make, spark, size: int = PAGE) -> str:
    """Writes documents of so many rows at most, a file each; `make` turns the list of a document's rows into its text."""
    path = shared_dir(spark)
    packed = rows.groupBy(F.floor(F.col(key) / size).alias("page")).agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("rows"))
    packed.select("page", make(F.col("rows")).alias("value")).write.partitionBy("page").text(path)
    return path


@query("S1_S9_activity_documents", """
SELECT id, name, type, sport_type, round(distance, 6) AS distance, moving_time, round(start_lat, 8) AS start_lat, round(start_lon, 8) AS start_lon, round(end_lat, 8) AS end_lat, gear_id, kudos_count FROM activities""", "activities")
def s1(spark, d):
    pair = lambda side: F.when(F.col(f"{side}_lat").isNotNull(), F.array(f"{side}_lat", f"{side}_lon")).alias(f"{side}_latlng")
    rides = t.activities(spark, d).select("id", "name", "type", "sport_type", "distance", "moving_time", "gear_id", "kudos_count", pair("start"), pair("end"))
    path = _documents(rides, "id", lambda r: F.to_json(F.struct(r.alias("activities"))), spark)
    back = readers.read_activities(spark, path)
    rounded = [F.round(c, n).alias(c) for c, n in (("distance", 6), ("start_lat", 8), ("start_lon", 8), ("end_lat", 8))]
    return back.select("id", "name", "type", "sport_type", "moving_time", "gear_id", "kudos_count", *rounded)


@query("S3_coverage_rides", "SELECT id, type FROM activities WHERE type IN ('Ride', 'GravelRide', 'MountainBikeRide', 'EBikeRide') OR sport_type IN ('Ride', 'GravelRide', 'MountainBikeRide', 'EBikeRide')", "activities")
def s3(spark, d):
    return readers.coverage_rides(t.activities(spark, d)).select("id", "type")


@query("S6_detailed_tracks", "SELECT id, CASE WHEN id % 3 = 0 THEN 'detailed ' || id WHEN id % 4 > 0 THEN 'short ' || id END AS polyline FROM activities", "activities")
def s6(spark, d):
    key = F.col("id")
    name = lambda kind: F.concat(F.lit(kind), key.cast("string")).alias("polyline")
    rides = t.activities(spark, d)
    return readers.enrich(rides.select("id", F.when(key % 4 > 0, name("short ")).alias("polyline")), rides.filter(key % 3 == 0).select("id", name("detailed "))).select("id", "polyline")


@query("S7_J19_second_provider", f"""
WITH raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'GRAVEL_CYCLING' WHEN 1 THEN 'indoor_cycling' WHEN 2 THEN 'trail_running' WHEN 3 THEN 'hiking' WHEN 4 THEN 'kayaking' END AS kind, CASE WHEN o_custkey % 3 = 0 THEN 0e0 ELSE o_custkey + 0.5e0 END AS moving,
  {POINT} 4188e-2 END AS lat, {POINT} o_custkey * -1e-1 END AS lon FROM orders)
SELECT id, CASE lower(kind) WHEN 'gravel_cycling' THEN 'GravelRide' WHEN 'indoor_cycling' THEN 'VirtualRide' WHEN 'trail_running' THEN 'Run' WHEN 'hiking' THEN 'Hike' ELSE 'Ride' END AS type,
  CASE WHEN moving <> 0 THEN CAST(floor(moving) AS BIGINT) ELSE CAST(77 AS BIGINT) END AS moving_time, lat <> 0 AND lon <> 0 AS has_start FROM raw""")
def s7(spark, d):
    o = table(spark, d, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*[F.lit(k) for k in ("GRAVEL_CYCLING", "indoor_cycling", "trail_running", "hiking", "kayaking", None)])
    none = F.lit(None).cast("double")
    at = lambda value: F.when((key % 7 == 0) | (cust % 5 == 0), 0.0).otherwise(value)
    raw = o.select(
        key.alias("activityId"), F.lit(None).cast("string").alias("activityName"), F.struct(F.get(kinds, (key % 6).cast("int")).alias("typeKey")).alias("activityType"), F.lit("2001-01-01 06:00:00").alias("startTimeLocal"),
        none.alias("distance"), F.when(cust % 3 == 0, 0.0).otherwise(cust + 0.5).alias("movingDuration"), F.lit(77.9).alias("duration"), none.alias("elevationGain"), at(F.lit(41.88)).alias("startLatitude"), at(cust * -1e-1).alias("startLongitude"),
        none.alias("endLatitude"), none.alias("endLongitude"), none.alias("averageSpeed"), none.alias("maxSpeed"), none.alias("averageHR"),
    )
    return readers.second_provider(raw).select("id", "type", "moving_time", F.col("start_latlng").isNotNull().alias("has_start"))


@query("S10_gear_documents", "SELECT id, name, type FROM gear", "gear")
def s10(spark, d):
    kind = lambda r, k: F.filter(r, lambda g: g["type"] == k)
    gear = t.gear(spark, d).withColumn("n", F.substring("id", 2, 9).cast("long")).select("id", "name", "type", "n")
    path = _documents(gear, "n", lambda r: F.to_json(F.struct(kind(r, "bike").alias("bikes"), kind(r, "shoe").alias("shoes"))), spark)
    return readers.read_gear(spark, path).select("id", "name", "type")


@query("S11_forecast_rows", """
SELECT event_id % 200 AS n, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS time, round(temp_c, 6) AS temperature_2m, CASE WHEN event_id % 200 < 50 THEN round(wind_speed_kph, 6) END AS wind_speed_10m
FROM weather WHERE event_id % 200 < 100""", "weather")
def s11(spark, d):
    """Of each document the first hundred times; its list of winds is shorter than that of its times."""
    w = t.weather(spark, d).select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), "temp_c", "wind_speed_kph")
    hourly = lambda r: F.struct(r.getField("time").alias("time"), r.getField("temp_c").alias("temperature_2m"), F.slice(r.getField("wind_speed_kph"), 1, 50).alias("wind_speed_10m"))
    make = lambda r: F.to_json(F.struct(F.floor(F.get(r, F.lit(0))["event_id"] / PAGE).cast("double").alias("lat"), hourly(r).alias("hourly")))
    doc = readers.read_weather(spark, _documents(w, "event_id", make, spark))
    rows = readers.forecast_rows(doc, "hourly", readers.HOURLY, 100)
    return rows.select("time", F.col("n").cast("long").alias("n"), F.round("temperature_2m", 6).alias("temperature_2m"), F.round("wind_speed_10m", 6).alias("wind_speed_10m"))


@query("S12_calendar_files", r"""
SELECT CAST(id AS VARCHAR) AS workout_id, workout_name || ', ' || coalesce(workout_type, 'rest') AS workout_name, strftime(day, '%Y-%m-%d') AS day, coalesce(duration_minutes, 0) > 0 AS timed, duration_minutes, CAST(tss AS DOUBLE) AS tss FROM workouts""", "workouts")
def s12(spark, d):
    w = t.workouts(spark, d).select("id", F.date_format("day", "yyyyMMdd").alias("day"), "workout_name", "workout_type", "duration_minutes", "tss")
    start = lambda e: F.concat(e["day"], F.lit("T060000"))
    end = lambda e: F.when(e["duration_minutes"].isNotNull(), F.concat(F.lit("DTEND:"), e["day"], F.lit("T06"), F.lpad(e["duration_minutes"].cast("string"), 2, "0"), F.lit("00\r\n")))
    note = lambda e: F.when(e["tss"].isNotNull(), F.concat(F.lit("DESCRIPTION:ride it\\, "), e["tss"].cast("string"), F.lit(" TSS\r\n")))
    none = F.lit("")
    event = lambda e: F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), e["id"].cast("string"), F.lit("\r\nSUMMARY:"), e["workout_name"], F.lit("\\,\r\n  "), F.coalesce(e["workout_type"], F.lit("rest")), F.lit("\r\nDTSTART:"), start(e), F.lit("\r\n"), F.coalesce(end(e), none), F.coalesce(note(e), none), F.lit("END:VEVENT\r\n"))
    path = _documents(w, "id", lambda r: F.concat(F.lit("BEGIN:VCALENDAR\r\n"), F.array_join(F.transform(r, event), ""), F.lit("END:VCALENDAR\r\n")), spark)
    found = readers.ics_events(spark.read.text(path, wholetext=True))
    return found.select("workout_id", "workout_name", F.date_format("workout_date", "yyyy-MM-dd").alias("day"), (F.coalesce("duration_minutes", F.lit(0)) > 0).alias("timed"), F.col("duration_minutes").cast("long").alias("duration_minutes"), "tss")


@query("S14_road_graph", f"""
WITH {EDGES}, mid AS (SELECT *, edge % 2 = 0 AS bent, (lat1 + lat2) / 2 + 1e-4 AS lat3, (lon1 + lon2) / 2 AS lon3 FROM edges)
SELECT edge, 0 AS place, round(lat1, 8) AS lat1, round(lon1, 8) AS lon1, round(CASE WHEN bent THEN lat3 ELSE lat2 END, 8) AS lat2, round(CASE WHEN bent THEN lon3 ELSE lon2 END, 8) AS lon2 FROM mid UNION ALL SELECT edge, 1, round(lat3, 8), round(lon3, 8), round(lat2, 8), round(lon2, 8) FROM mid WHERE bent""")
def s14(spark, d):
    """The grid of streets as a graph: every second one bends in its middle."""
    return _graph(spark, _edges(spark))


@query("S14_roads_of_tracks", f"""
WITH {SEGMENTS}, six AS (SELECT vec_id, idx, round(lat1, 6) AS lat1, round(lon1, 6) AS lon1, round(lat2, 6) AS lat2, round(lon2, 6) AS lon2 FROM seg WHERE lat2 IS NOT NULL),
mid AS (SELECT vec_id * 100 + idx AS edge, lat1, lon1, lat2, lon2, (vec_id * 100 + idx) % 2 = 0 AS bent, (lat1 + lat2) / 2 + 1e-4 AS lat3, (lon1 + lon2) / 2 AS lon3 FROM six)
SELECT edge, 0 AS place, round(lat1, 8) AS lat1, round(lon1, 8) AS lon1, round(CASE WHEN bent THEN lat3 ELSE lat2 END, 8) AS lat2, round(CASE WHEN bent THEN lon3 ELSE lon2 END, 8) AS lon2 FROM mid UNION ALL SELECT edge, 1, round(lat3, 8), round(lon3, 8), round(lat2, 8), round(lon2, 8) FROM mid WHERE bent""", "points")
def s14_tracks(spark, d):
    """The pieces of all tracks, to six decimals, as a graph of roads."""
    seg = t.tracks(spark, d).select("vec_id", F.posexplode(geo.segments(F.col("coords"))).alias("idx", "s"))
    seg = seg.select((F.col("vec_id") * 100 + F.col("idx")).alias("edge"), *[F.round(f"s.{c}", 6).alias(c) for c in ("lat1", "lon1", "lat2", "lon2")])
    return _graph(spark, seg)


def _graph(spark, edges):
    """Roads written as GraphML and read back; every second one bends in its middle. The first document has the keys."""
    text_ = lambda c: c.cast("decimal(18,10)").cast("string")
    node = lambda e, n: F.concat(F.lit('<node id="'), e["edge"].cast("string"), F.lit(f'.{n}"><data key="d4">'), text_(e[f"lat{n}"]), F.lit('</data><data key="d5">'), text_(e[f"lon{n}"]), F.lit("</data></node>\n"))
    pair = lambda lat, lon: F.concat(text_(lon), F.lit(" "), text_(lat))
    line = lambda e: F.concat(F.lit("LINESTRING ("), pair(e["lat1"], e["lon1"]), F.lit(", "), pair((e["lat1"] + e["lat2"]) / 2 + 1e-4, (e["lon1"] + e["lon2"]) / 2), F.lit(", "), pair(e["lat2"], e["lon2"]), F.lit(")"))
    drawn = lambda e: F.when(e["edge"] % 2 == 0, F.concat(F.lit('<data key="d17">'), line(e), F.lit("</data>"))).otherwise("")
    edge = lambda e: F.concat(F.lit('<edge source="'), e["edge"].cast("string"), F.lit('.1" target="'), e["edge"].cast("string"), F.lit('.2" id="0"><data key="d9">street</data>'), drawn(e), F.lit("</edge>\n"))
    keys = "".join(f'<key id="{k}" for="{of}" attr.name="{name}" attr.type="string"/>\n' for k, of, name in (("d4", "node", "y"), ("d5", "node", "x"), ("d9", "edge", "name"), ("d17", "edge", "geometry")))
    of_document = lambda r: F.when(F.get(r, F.lit(0))["edge"] == 0, keys).otherwise("")
    make = lambda r: F.concat(F.lit("<graphml>\n"), of_document(r), F.lit("<graph>\n"), F.array_join(F.transform(r, lambda e: F.concat(node(e, 1), node(e, 2), edge(e))), ""), F.lit("</graph>\n</graphml>"))
    found = readers.road_edges(spark, _documents(edges, "edge", make, spark, ROADS))
    return found.select(F.substring_index("edge", ".", 1).cast("long").alias("edge"), "place", *[F.round(c, 8).alias(c) for c in ("lat1", "lon1", "lat2", "lon2")])


@query("S16_routed_answers", "SELECT round_even(sum(lat), 6) AS lat, round_even((5000 + (vec_id * 53) % 4000 + 7e-1) / 1000e0, 2) AS distance_km, round_even((1200 + (vec_id * 37) % 1800) / 60e0, 1) AS duration_min, count(*) AS points FROM points GROUP BY vec_id", "points")
def s16(spark, d):
    """Answers come as lists of them, a file for each list."""
    line = F.transform("coords", lambda p: F.array(p["lon"], p["lat"]))
    summary = F.struct(F.struct((F.col("distance") + 0.7).alias("distance"), F.col("duration").cast("double").alias("duration")).alias("summary"))
    feature = F.struct(F.struct(line.alias("coordinates")).alias("geometry"), summary.alias("properties"))
    answers = t.routes(spark, d).select("activity_id", feature.alias("f"))
    path = _documents(answers, "activity_id", lambda r: F.to_json(F.transform(r, lambda a: F.struct(F.array(a["f"]).alias("features")))), spark)
    return readers.routed(spark, path).select(F.bround(geo.total(F.col("coords").getField("lat")), 6).alias("lat"), "distance_km", "duration_min", F.size("coords").cast("long").alias("points"))


@query("S17_J19_short_address", """
WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey AS VARCHAR) END AS number, CASE WHEN c_custkey % 4 > 0 THEN c_mktsegment || ' Road' END AS road, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE n_name END AS town,
  CASE c_custkey % 6 WHEN 0 THEN 'Illinois' WHEN 1 THEN 'New York' WHEN 2 THEN 'District of Columbia' WHEN 3 THEN 'Ontario' WHEN 4 THEN '' END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, nullif(concat_ws(', ', CASE WHEN number IS NOT NULL AND road IS NOT NULL THEN number || ' ' || road ELSE road END, nullif(town, ''), CASE state WHEN 'Illinois' THEN 'IL' WHEN 'New York' THEN 'NY' WHEN 'District of Columbia' THEN 'DC' ELSE nullif(state, '') END), '') AS label FROM a""")
def s17(spark, d):
    c, n = (table(spark, d, x) for x in ("customer", "nation"))
    key = F.col("c_custkey")
    states = F.array(*[F.lit(s) for s in ("Illinois", "New York", "District of Columbia", "Ontario", "", None)])
    road, town = F.when(key % 4 > 0, F.concat("c_mktsegment", F.lit(" Road"))), F.when(key % 5 == 0, "").otherwise(F.col("n_name"))
    found = text.short_address(F.when(key % 3 > 0, key.cast("string")), [road], [F.lit(None).cast("string"), town], F.get(states, (key % 6).cast("int")))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", found.alias("label"))


@query("K3_K4_stored_groups", "SELECT r.activity_id, r.group_id, uses, true AS reusable, false AS other_settings FROM routes r JOIN groups g USING (group_id)", "groups")
def k3(spark, d):
    """Groups and members as stored, and whether they may be used again: for the same ids and settings, not for others."""
    r = t.routes(spark, d)
    path = shared_dir(spark)
    sinks.write_groups(r.groupBy("group_id").agg(F.count("*").alias("uses")), r.select("activity_id", "group_id"), path, "similarity 0.7")
    same, other = (sinks.reusable(spark, path, r.select("activity_id"), c) for c in ("similarity 0.7", "similarity 0.8"))
    members, groups = (spark.read.parquet(f"{path}/{x}") for x in ("members", "groups"))
    return members.join(groups, "group_id").select("activity_id", "group_id", "uses", F.lit(same).alias("reusable"), F.lit(other).alias("other_settings"))


@query("K5_json_export", "SELECT activity_id, direction, group_id, distance, duration FROM routes", "routes")
def k5(spark, d):
    path = f"{shared_dir(spark)}/export"
    rows = t.routes(spark, d).select("activity_id", "direction", "group_id", "distance", "duration")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)
