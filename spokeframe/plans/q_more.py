"""Queries of lookups, exports and the forms of streams over stored tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import rollups
from ..operators.locations import direction
from ..registry import query
from ..shared import running, shared_dir, table
from ..sources import sinks
from ..sources import testdata as t
from ..streaming import fresh
from ..streaming.stateful import latest_fresh
from .q_rollups import geod


@query("P3_direction", f"""
WITH x AS (SELECT id, {geod('start_lat', 'start_lon', '4188e-2', '-8763e-2')} AS sh, {geod('start_lat', 'start_lon', '4192e-2', '-8766e-2')} AS sw, {geod('end_lat', 'end_lon', '4188e-2', '-8763e-2')} AS eh, {geod('end_lat', 'end_lon', '4192e-2', '-8766e-2')} AS ew FROM activities)
SELECT id, CASE WHEN sh < 4000 AND ew < 4000 THEN 'home_to_work' WHEN sw < 4000 AND eh < 4000 THEN 'work_to_home' END AS direction FROM x""", "activities")
def p3(spark, d):
    rides = t.activities(spark, d)
    return rides.select("id", direction(rides, t.HOME, t.WORK, 4000.0).alias("direction"))


@query("G2_V7_geodesic", f"SELECT id, round({geod('start_lat', 'start_lon', 'end_lat', 'end_lon')}, 4) AS metres FROM activities WHERE start_lat IS NOT NULL AND end_lat IS NOT NULL", "activities")
def g2(spark, d):
    rides = t.activities(spark, d).filter("start_lat is not null and end_lat is not null")
    return rides.select("id", F.round(geo.geodesic_m(*[F.col(c) for c in ("start_lat", "start_lon", "end_lat", "end_lon")]), 4).alias("metres"))


@query("G18_loops", f"SELECT p.vec_id FROM points p JOIN points q USING (vec_id) WHERE p.idx = 0 AND q.idx = 31 AND {geod('p.lat', 'p.lon', 'q.lat', 'q.lon')} < 2000", "points")
def g18(spark, d):
    return t.tracks(spark, d).filter(geo.is_loop(F.col("coords"), 2000.0)).select("vec_id")


@query("J9_rides_near_a_click", f"SELECT DISTINCT vec_id FROM points WHERE {geod('lat', 'lon', '4190e-2', '-8762e-2')} <= 1500", "points")
def j9(spark, d):
    near = F.exists("coords", lambda p: geo.geodesic_m(p["lat"], p["lon"], F.lit(41.90), F.lit(-87.62)) <= 1500)
    return t.tracks(spark, d).filter(near).select("vec_id")


@query("J4_J5_lookup", "SELECT r.activity_id, r.distance, count(p.idx) AS points FROM routes r JOIN points p ON p.vec_id = r.activity_id WHERE r.group_id = 'home_to_work_3' GROUP BY 1, 2", "routes points")
def j4(spark, d):
    return t.routes(spark, d).filter("group_id = 'home_to_work_3'").select("activity_id", "distance", F.size("coords").cast("long").alias("points"))


@query("P19_workouts_in_range", """
WITH w AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, l_quantity AS minutes FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '2001-07-25' AND TIMESTAMP '2001-08-08')
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS workouts, min(minutes) AS shortest FROM w GROUP BY 1""")
def j16(spark, d):
    day = F.to_date("l_shipdate")
    w = table(spark, d, "lineitem").filter(F.col("l_shipdate").between(F.lit("2001-07-25").cast("timestamp_ntz"), F.lit("2001-08-08").cast("timestamp_ntz")))
    return w.groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("workouts"), F.min("l_quantity").alias("shortest"))


@query("P10_client_targets", "SELECT id FROM activities WHERE abs(distance / 1000 - 30) <= 20 AND abs(moving_time / 3600e0 - 2) <= 1.5e0", "activities")
def p10(spark, d):
    return t.activities(spark, d).filter((F.abs(F.col("distance") / 1000 - 30) <= 20) & (F.abs(F.col("moving_time") / 3600.0 - 2) <= 1.5)).select("id")


@query("P14_O2_top_routes", "WITH r AS (SELECT group_id, activity_id, distance, row_number() OVER (PARTITION BY group_id ORDER BY distance DESC, activity_id) AS k FROM routes) SELECT * FROM r WHERE k <= 6", "routes")
def p14(spark, d):
    k = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("distance"), "activity_id"))
    return t.routes(spark, d).select("group_id", "activity_id", "distance", k.cast("long").alias("k")).filter("k <= 6")


@query("P16_commute_layer", "SELECT id FROM activities WHERE lower(coalesce(name, '')) LIKE '%commute%' OR type = 'commute'", "activities")
def p16(spark, d):
    return t.activities(spark, d).filter(F.lower(F.coalesce("name", F.lit(""))).contains("commute") | (F.col("type") == "commute")).select("id")


@query("P23_date_range", "SELECT id FROM activities WHERE start_local >= TIMESTAMP '2000-03-01' AND start_local < TIMESTAMP '2000-04-16'", "activities")
def p23(spark, d):
    """An end without a time means the whole of its day."""
    start, end = F.to_timestamp_ntz(F.lit("2000-03-01")), F.to_timestamp_ntz(F.lit("2000-04-15")) + F.expr("interval 1 day")
    return t.activities(spark, d).filter((F.col("start_local") >= start) & (F.col("start_local") < end)).select("id")


@query("O5_O6_groups_by_frequency", "SELECT group_id, uses, row_number() OVER (ORDER BY uses DESC, group_id) AS place FROM groups", "groups")
def o5(spark, d):
    g = rollups.group_metrics(t.routes(spark, d)).select("group_id", "uses")
    return running(g, [F.desc("uses"), F.col("group_id").asc()]).withColumn("place", F.col("place") + 1)


@query("O10_first_then_sorted", "SELECT id, start_date, name FROM (SELECT id, start_date, name FROM activities ORDER BY start_date DESC NULLS LAST, id LIMIT 20)", "activities")
def o10(spark, d):
    first = t.activities(spark, d).orderBy(F.col("start_date").desc_nulls_last(), "id").limit(20).select("id", "start_date", "name")
    return first.orderBy(F.col("name").asc_nulls_last(), "id")


@query("U5_overlay", "SELECT coalesce(b.group_id, a.group_id) AS group_id, coalesce(b.n, a.n) AS n FROM (SELECT group_id, count(*) AS n FROM routes WHERE activity_id % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT group_id, -count(*) AS n FROM routes WHERE activity_id % 3 = 0 GROUP BY 1) b ON a.group_id = b.group_id", "routes")
def u5(spark, d):
    n = t.routes(spark, d)
    a = n.filter("activity_id % 2 = 0").groupBy("group_id").agg(F.count("*").alias("n"))
    b = n.filter("activity_id % 3 = 0").groupBy("group_id").agg((-F.count("*")).alias("n"))
    ranked = a.withColumn("p", F.lit(0)).unionByName(b.withColumn("p", F.lit(1)))
    return ranked.groupBy("group_id").agg(F.max_by("n", "p").alias("n"))


@query("F16_number_pairs", r"SELECT doc_id, regexp_extract(note, '(-?\d+\.\d+),\s*(-?\d+\.\d+)', 1) AS lat, regexp_extract(note, '(-?\d+\.\d+),\s*(-?\d+\.\d+)', 2) AS lon FROM notes", "notes")
def f16(spark, d):
    part = lambda i: F.regexp_extract("note", r"(-?\d+\.\d+),\s*(-?\d+\.\d+)", i)
    return t.notes(spark, d).select("doc_id", part(1).alias("lat"), part(2).alias("lon"))


@query("W3_A18_segment_steps", """
WITH s AS (SELECT vec_id, idx, lead(lat) OVER w - lat AS dlat, lead(lon) OVER w - lon AS dlon FROM points WINDOW w AS (PARTITION BY vec_id ORDER BY idx))
SELECT vec_id, count(dlat) AS steps, round(sum(abs(dlat)), 7) AS north_south, round(sum(abs(dlon)), 7) AS east_west FROM s GROUP BY 1""", "points")
def w3(spark, d):
    s = t.tracks(spark, d).select("vec_id", F.explode(geo.segments(F.col("coords"))).alias("s"))
    return s.groupBy("vec_id").agg(F.count("*").alias("steps"), F.round(F.sum(F.abs(F.col("s.lat2") - F.col("s.lat1"))), 7).alias("north_south"), F.round(F.sum(F.abs(F.col("s.lon2") - F.col("s.lon1"))), 7).alias("east_west"))


@query("K6_csv_rows")
def k6(spark, d):
    from ..operators.ranking import rank_routes

    r = t.routes(spark, d)
    ranked = rank_routes(r, 25.0, 225.0, by=None).join(rollups.group_metrics(r).drop("direction", "uses"), "group_id")
    rows = sinks.csv_rows(ranked)
    return rows.toDF(*[c.lower().replace(" ", "_").replace("(", "").replace(")", "") for c in rows.columns])


@query("K7_K8_gpx", """
WITH r AS (SELECT vec_id, string_agg('    <rtept/>', chr(10) ORDER BY idx) AS body FROM points GROUP BY 1) SELECT vec_id, (length(body) + 1) // 13 AS points FROM r""", "points")
def k7(spark, d):
    text = sinks.gpx(F.col("vec_id").cast("string"), F.lit("a & b"), F.col("coords"))
    return t.tracks(spark, d).select("vec_id", (F.size(F.split(text, "<rtept ")) - 1).cast("long").alias("points"))


@query("K9_map_layer", "SELECT vec_id, CAST(vec_id % 8 AS INTEGER) AS colour, count(*) AS points, round(avg(lat), 7) AS lat, round(avg(lon), 7) AS lon FROM points GROUP BY 1, 2", "points")
def k9(spark, d):
    c = F.col("coords")
    return t.tracks(spark, d).select("vec_id", (F.col("vec_id") % 8).cast("int").alias("colour"), F.size(geo.sampled(c)).cast("long").alias("points"), F.round(geo.mean(c.getField("lat")), 7).alias("lat"), F.round(geo.mean(c.getField("lon")), 7).alias("lon"))


@query("K12_job_history", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def k12(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("T3_latest_fresh", """
WITH a AS (SELECT user_id, event_id, (epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 3.6e9 AS age FROM events), k AS (SELECT * FROM a WHERE age >= 0 AND age < 24)
SELECT user_id, arg_min(event_id, age) AS event_id, round(min(age), 6) AS age_hours, min(age) >= 2 AS is_stale FROM k GROUP BY 1""")
def t3(spark, d):
    found = latest_fresh(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", "2024-01-20 12:00:00")
    return found.select("user_id", "event_id", F.round("age_hours", 6).alias("age_hours"), "is_stale")


@query("T3_fresh_state", """
WITH a AS (SELECT user_id, event_id, (epoch_us(TIMESTAMP '2024-01-20 12:00:00') - epoch_us(ts)) / 3.6e9 AS age FROM events), k AS (SELECT * FROM a WHERE age >= 0 AND age < 24),
last AS (SELECT user_id, arg_min(event_id, age) AS event_id, round(min(age), 6) AS age_hours, min(age) >= 2 AS is_stale FROM k GROUP BY 1)
SELECT user_id, event_id, age_hours, is_stale FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN last USING (user_id)""")
def t3_state(spark, d):
    """The events up to a moment as a stream of stored answers, in three starts of one query; in the last each user is asked for at that moment."""
    path, now = shared_dir(spark), F.lit("2024-01-20 12:00:00").cast("timestamp")
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.lit(False).alias("asks"), F.col("event_id").alias("value"))
    asks = e.select("key").distinct().select("key", now.alias("at"), F.lit(True).alias("asks"), F.lit(None).cast("long").alias("value"))
    half = F.lit("2024-01-10").cast("timestamp")
    for part in (e.filter(F.col("at") < half), e.filter((F.col("at") >= half) & (F.col("at") <= now)), asks):
        part.write.mode("append").parquet(f"{path}/in")
        fresh.run_available(spark, fresh.answers(spark.readStream.schema(e.schema).parquet(f"{path}/in"), late="30 days"), f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out").select(F.col("key").alias("user_id"), F.col("value").alias("event_id"), F.round("age_hours", 6).alias("age_hours"), "is_stale")


@query("T4_throttled_alerts", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, k, us AS prior, true AS sent FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.us - r.prior >= 21600000000 THEN e.us ELSE r.prior END, e.us - r.prior >= 21600000000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id FROM r WHERE sent""")
def t4(spark, d):
    """The stream's rule over a stored table: each user's alerts, of which one in six hours is sent.

    Users are dealt out and sorted, and a worker reads on with the current user and the time of their last alert alone, however many alerts they have.
    """
    gap = 21_600_000_000

    def sent(batches):
        user, last = None, None
        for batch in batches:
            keep = []
            for who, at in zip(batch["user_id"].to_pylist(), batch["at"].to_pylist()):
                if who != user or last is None or at - last >= gap:
                    user, last = who, at
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["user_id", "event_id"])

    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return e.repartition("user_id").sortWithinPartitions("user_id", "at", "event_id").mapInArrow(sent, "user_id long, event_id long")


@query("T5_retention", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def t5(spark, d):
    return table(spark, d, "events").filter(F.col("ts").cast("timestamp_ntz") < F.expr("timestamp_ntz '2024-01-31' - interval 7 days")).select("event_id")


@query("E1_hourly_event_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def e1(spark, d):
    """An addition of this engine: the batch form of the windows over a stream of events."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "value")
