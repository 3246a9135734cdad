"""Views of the test tables as rides, tracks and weather, by the same arithmetic in Spark and in SQL.

The test tables hold no rides, so queries read these views. `VIEWS` has the SQL of each for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import local_start
from ..shared import table

#: The present moment of all queries over the test tables.
NOW = "2001-08-01 12:00:00"
HOME, WORK = (41.88, -87.63), (41.92, -87.66)
BOUNDS = (41.85, -87.66, 41.91, -87.60)  # south, west, north, east

NAMES = ("Morning Ride", "Commute to Work", "Home from work", "Lunch Ride", " Sunday Loop ", "Lakefront #", None, "Virtual trainer 12/3")
SPORTS = {"1-URGENT": "Ride", "2-HIGH": "GravelRide", "3-MEDIUM": "VirtualRide", "4-NOT SPECIFIED": "Run"}

VIEWS = {
    "activities": """
SELECT o_orderkey AS id,
       CASE o_orderkey % 8 WHEN 0 THEN 'Morning Ride' WHEN 1 THEN 'Commute to Work' WHEN 2 THEN 'Home from work' WHEN 3 THEN 'Lunch Ride'
            WHEN 4 THEN ' Sunday Loop ' WHEN 5 THEN 'Lakefront #' || (o_custkey % 5) WHEN 6 THEN NULL ELSE 'Virtual trainer 12/3' END AS name,
       CASE o_orderpriority WHEN '3-MEDIUM' THEN 'VirtualRide' WHEN '4-NOT SPECIFIED' THEN 'Run' ELSE 'Ride' END AS type,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Ride' WHEN '2-HIGH' THEN 'GravelRide' WHEN '3-MEDIUM' THEN 'VirtualRide' WHEN '4-NOT SPECIFIED' THEN 'Run' END AS sport_type,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE strftime(o_orderdate + to_hours(o_orderkey % 24) + INTERVAL 6 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS start_date,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE strftime(o_orderdate + to_hours(o_orderkey % 24), '%Y-%m-%dT%H:%M:%SZ') END AS start_date_local,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + to_hours(o_orderkey % 24)
            WHEN o_orderkey % 97 <> 0 THEN o_orderdate + to_hours(o_orderkey % 24) + INTERVAL 6 HOUR END AS start_local,
       o_totalprice / 10 AS distance, CAST(1200 + (o_orderkey * 37) % 9000 AS BIGINT) AS moving_time,
       CAST(1200 + (o_orderkey * 37) % 9000 + o_custkey % 600 AS BIGINT) AS elapsed_time,
       CAST((o_orderkey * 13) % 900 AS DOUBLE) AS total_elevation_gain,
       CASE WHEN o_custkey % 13 = 0 THEN 0e0 ELSE (o_totalprice / 10) / (1200 + (o_orderkey * 37) % 9000) END AS average_speed,
       CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'b' || (o_custkey % 7) END AS gear_id,
       CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(100 + o_orderkey % 80 AS DOUBLE) END AS average_heartrate,
       CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST((o_orderkey * 7) % 1200 AS DOUBLE) END AS kilojoules,
       CAST(o_orderkey % 9 AS BIGINT) AS kudos_count,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE 4188e-2 + ((o_orderkey * 17) % 200 - 100) * 4e-4 END AS start_lat,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE -8763e-2 + ((o_orderkey * 29) % 200 - 100) * 4e-4 END AS start_lon,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 4188e-2 + ((o_custkey * 31) % 200 - 100) * 4e-4 END AS end_lat,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE -8763e-2 + ((o_custkey * 11) % 200 - 100) * 4e-4 END AS end_lon
FROM orders""",
    "points": """
SELECT vec_id, label, CAST(i AS INTEGER) AS idx, 4188e-2 + CAST(embedding[2 * i + 1] AS DOUBLE) * 1e-1 AS lat, -8763e-2 + CAST(embedding[2 * i + 2] AS DOUBLE) * 1e-1 AS lon
FROM embeddings, range(32) t(i)""",
    "routes": """
SELECT vec_id AS activity_id, CASE WHEN label < 5 THEN 'home_to_work' ELSE 'work_to_home' END AS direction,
       CASE WHEN label < 5 THEN 'home_to_work_' ELSE 'work_to_home_' END || label AS group_id,
       CAST(5000 + (vec_id * 53) % 4000 AS DOUBLE) AS distance, CAST(1200 + (vec_id * 37) % 1800 AS BIGINT) AS duration,
       CAST((vec_id * 7) % 300 AS DOUBLE) AS elevation_gain, CAST(5000 + (vec_id * 53) % 4000 AS DOUBLE) / (1200 + (vec_id * 37) % 1800) AS average_speed
FROM embeddings""",
    "weather": """
SELECT event_id, ts, value % 4500e-2 - 5e0 AS temp_c, (value * 3e0) % 5000e-2 AS wind_speed_kph, (value * 7e0) % 36000e-2 AS wind_direction_deg,
       (value * 11e0) % 10100e-2 AS precipitation_prob, CASE WHEN event_id % 3 = 0 THEN value % 1200e-2 ELSE 0e0 END AS precipitation_mm,
       CAST(event_id % 100 AS INTEGER) AS code
FROM events""",
    "gear": """
SELECT 'b' || n_nationkey AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'bike' ELSE 'shoe' END AS type FROM nation WHERE n_nationkey < 5""",
    "workouts": """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, 'Workout ' || (o_orderkey % 50) AS workout_name,
       CASE o_orderkey % 6 WHEN 0 THEN 'Endurance' WHEN 1 THEN 'Threshold' WHEN 2 THEN 'VO2Max' WHEN 3 THEN 'Group Ride' WHEN 4 THEN 'Recovery' END AS workout_type,
       CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE CAST(20 + o_orderkey % 30 AS BIGINT) END AS duration_minutes, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 160 AS BIGINT) END AS tss,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 97 AS DOUBLE) + 0.5e0 END AS temp_f, CAST(greatest(0, o_orderkey % 7 - 4) AS DOUBLE) AS precip_mm
FROM orders""",
    "notes": """
SELECT doc_id, text, 'Ride 41.' || (100000 + doc_id) || ', -87.' || (200000 + doc_id) || ' from ' || (doc_id % 90 + 10) || ' Oak Park Ave, rider' || doc_id || '@mail.example.com token = abc' || doc_id || ' activity_id: ' || (10000000 + doc_id) || ' Bearer k' || doc_id AS note
FROM documents""",
}
# Tracks in groups: of 64 ids the first 32 are copies of the first one, the others copies by eight. Copies are moved north by steps, so that some are near and some
# hang together in chains; those of one step tie.
BASE = "vec_id - vec_id % CASE WHEN vec_id % 64 < 32 THEN 32 ELSE 8 END"
VIEWS["twin_points"] = f"""
SELECT e.vec_id, b.label, CAST(i AS INTEGER) AS idx, 4188e-2 + CAST(b.embedding[2 * i + 1] AS DOUBLE) * 1e-1 + CASE WHEN e.vec_id % 64 < 32 THEN e.vec_id % 5 * 3e-4 ELSE e.vec_id % 8 * 2e-4 END AS lat, -8763e-2 + CAST(b.embedding[2 * i + 2] AS DOUBLE) * 1e-1 AS lon
FROM (SELECT vec_id, {BASE} AS base FROM embeddings) e JOIN embeddings b ON b.vec_id = base, range(32) t(i)"""
VIEWS["twin_routes"] = f"""
SELECT e.vec_id AS activity_id, CASE WHEN label < 5 THEN 'home_to_work' ELSE 'work_to_home' END AS direction, CASE WHEN label < 5 THEN 'home_to_work_' ELSE 'work_to_home_' END || 'b' || base AS group_id,
       CAST(5000 + (e.vec_id * 53) % 4000 AS DOUBLE) AS distance, CAST(1200 + (e.vec_id * 37) % 180 AS BIGINT) AS duration, CAST((e.vec_id * 7) % 300 AS DOUBLE) AS elevation_gain, CAST(5000 + (e.vec_id * 53) % 4000 AS DOUBLE) / (1200 + (e.vec_id * 37) % 180) AS average_speed
FROM (SELECT vec_id, {BASE} AS base FROM embeddings) e JOIN embeddings b ON b.vec_id = base"""
VIEWS["groups"] = """
SELECT group_id, min(direction) AS direction, CAST(count(*) AS BIGINT) AS uses, avg(duration) AS avg_duration, stddev_pop(duration) AS std_duration, avg(distance) AS avg_distance,
       avg(average_speed) AS avg_speed, avg(elevation_gain) AS avg_elevation, CASE WHEN avg(duration) > 0 THEN greatest(0e0, 1 - stddev_pop(duration) / avg(duration)) ELSE 0e0 END AS consistency
FROM routes GROUP BY group_id"""
NEEDS = {"groups": ["routes"]}


def with_views(sql: str, uses: list[str]) -> str:
    """The statement behind definitions of the views it reads; `a=b` is view b under the name a."""
    names: dict[str, str] = {}
    for use in uses:
        name, _, of = use.partition("=")
        names |= {n: n for n in NEEDS.get(name, []) if n not in names} | {name: of or name}
    heads = [f"{n} AS ({VIEWS[of]}\n)" for n, of in names.items()]
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            heads.append(body[len(start) :].lstrip())
            return start + ",\n".join(heads)
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = F.lit(None).cast("string")
    for i, text in enumerate(NAMES):
        value = F.concat(F.lit(text), (cust % 5).cast("string")) if i == 5 else F.lit(text)
        name = F.when(key % 8 == i, value).otherwise(name)
    sport = F.create_map(*[F.lit(x) for kv in SPORTS.items() for x in kv])
    priority = F.col("o_orderpriority")
    local = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(key % 24).cast("int"))
    iso = lambda ts: F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    distance, moving = F.col("o_totalprice") / 10, 1200 + (key * 37) % 9000
    around = lambda centre, n: F.lit(centre) + (n % 200 - 100) * 4e-4
    df = o.select(
        key.alias("id"),
        name.alias("name"),
        F.when(priority == "3-MEDIUM", "VirtualRide").when(priority == "4-NOT SPECIFIED", "Run").otherwise("Ride").alias("type"),
        F.try_element_at(sport, priority).alias("sport_type"),
        F.when(key % 97 != 0, iso(local + F.expr("interval 6 hours"))).alias("start_date"),
        F.when(key % 5 != 0, iso(local)).alias("start_date_local"),
        distance.alias("distance"),
        moving.cast("long").alias("moving_time"),
        (moving + cust % 600).cast("long").alias("elapsed_time"),
        ((key * 13) % 900).cast("double").alias("total_elevation_gain"),
        F.when(cust % 13 == 0, 0.0).otherwise(distance / moving).alias("average_speed"),
        F.when(cust % 11 != 0, F.concat(F.lit("b"), (cust % 7).cast("string"))).alias("gear_id"),
        F.when(cust % 4 != 0, (100 + key % 80).cast("double")).alias("average_heartrate"),
        F.when(cust % 5 != 0, ((key * 7) % 1200).cast("double")).alias("kilojoules"),
        (key % 9).cast("long").alias("kudos_count"),
        F.when(key % 19 != 0, around(41.88, key * 17)).alias("start_lat"),
        F.when(key % 19 != 0, around(-87.63, key * 29)).alias("start_lon"),
        F.when(key % 23 != 0, around(41.88, cust * 31)).alias("end_lat"),
        F.when(key % 23 != 0, around(-87.63, cust * 11)).alias("end_lon"),
    )
    return df.withColumn("start_local", local_start(F.col("start_date_local"), F.col("start_date")))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, coords: 32 points each."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get(F.col("embedding"), i).cast("double")
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.lit(41.88) + at(i * 2) * 1e-1).alias("lat"), (F.lit(-87.63) + at(i * 2 + 1) * 1e-1).alias("lon")))
    return e.select("vec_id", "label", points.alias("coords"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks(spark, sf_dir).select("vec_id", "label", F.posexplode("coords").alias("idx", "p")).select("vec_id", "label", "idx", "p.lat", "p.lon")


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """activity_id, direction, group_id, distance, duration, elevation_gain, average_speed, coords."""
    vec = F.col("vec_id")
    direction = F.when(F.col("label") < 5, "home_to_work").otherwise("work_to_home")
    distance, duration = (5000 + (vec * 53) % 4000).cast("double"), (1200 + (vec * 37) % 1800).cast("long")
    return tracks(spark, sf_dir).select(
        vec.alias("activity_id"),
        direction.alias("direction"),
        F.concat(direction, F.lit("_"), F.col("label").cast("string")).alias("group_id"),
        distance.alias("distance"),
        duration.alias("duration"),
        ((vec * 7) % 300).cast("double").alias("elevation_gain"),
        (distance / duration).alias("average_speed"),
        "coords",
    )


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As routes, of tracks that are copies of one another."""
    e = table(spark, sf_dir, "embeddings")
    vec = F.col("vec_id")
    based = e.select(vec, (vec - vec % F.when(vec % 64 < 32, 32).otherwise(8)).alias("base"), F.when(vec % 64 < 32, vec % 5 * 3e-4).otherwise(vec % 8 * 2e-4).alias("step"))
    both = based.join(e.select(F.col("vec_id").alias("base"), "label", "embedding"), "base")
    at = lambda i: F.get(F.col("embedding"), i).cast("double")
    line = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((F.lit(41.88) + at(i * 2) * 1e-1 + F.col("step")).alias("lat"), (F.lit(-87.63) + at(i * 2 + 1) * 1e-1).alias("lon")))
    direction = F.when(F.col("label") < 5, "home_to_work").otherwise("work_to_home")
    distance, duration = (5000 + (vec * 53) % 4000).cast("double"), (1200 + (vec * 37) % 180).cast("long")
    return both.select(
        vec.alias("activity_id"), direction.alias("direction"), F.concat(direction, F.lit("_b"), F.col("base").cast("string")).alias("group_id"), distance.alias("distance"), duration.alias("duration"),
        ((vec * 7) % 300).cast("double").alias("elevation_gain"), (distance / duration).alias("average_speed"), line.alias("coords"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        (v % 45.0 - 5.0).alias("temp_c"),
        ((v * 3.0) % 50.0).alias("wind_speed_kph"),
        ((v * 7.0) % 360.0).alias("wind_direction_deg"),
        ((v * 11.0) % 101.0).alias("precipitation_prob"),
        F.when(F.col("event_id") % 3 == 0, v % 12.0).otherwise(0.0).alias("precipitation_mm"),
        (F.col("event_id") % 100).cast("int").alias("code"),
    )


def workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned workouts with the weather of their day."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kinds = F.array(*[F.lit(k) for k in ("Endurance", "Threshold", "VO2Max", "Group Ride", "Recovery", None)])
    return o.select(
        key.alias("id"),
        F.to_date("o_orderdate").alias("day"),
        F.concat(F.lit("Workout "), (key % 50).cast("string")).alias("workout_name"),
        F.get(kinds, (key % 6).cast("int")).alias("workout_type"),
        F.when(cust % 5 != 0, (20 + key % 30).cast("long")).alias("duration_minutes"),
        F.when(cust % 3 != 0, (key % 160).cast("long")).alias("tss"),
        F.when(key % 11 != 0, (key % 97).cast("double") + 0.5).alias("temp_f"),
        F.greatest(F.lit(0), key % 7 - 4).cast("double").alias("precip_mm"),
    )


def gear(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").filter("n_nationkey < 5")
    return n.select(F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "bike").otherwise("shoe").alias("type"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a line that has all kinds of what is to be redacted."""
    n = F.col("doc_id")
    text = lambda x: x.cast("string")
    note = F.concat(
        F.lit("Ride 41."), text(100000 + n), F.lit(", -87."), text(200000 + n), F.lit(" from "), text(n % 90 + 10), F.lit(" Oak Park Ave, rider"), text(n),
        F.lit("@mail.example.com token = abc"), text(n), F.lit(" activity_id: "), text(10000000 + n), F.lit(" Bearer k"), text(n),
    )
    return table(spark, sf_dir, "documents").select("doc_id", "text", note.alias("note"))
