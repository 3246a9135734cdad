"""Queries of provider lists, backfill and the stored table: what they read is written from the given tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import polyline
from ..operators import smoothing
from ..registry import query
from ..shared import shared_dir, table
from ..sources import memo, provider, store
from ..sources import testdata as t

#: Rides of a page: of lists that are read at once, and of backfill, which merges each page.
PAGE, BACKFILL_PAGE = 200, 5000
AFTER, BEFORE = "1996-06-01", "1997-06-01T12:00:00Z"


@query("S4_provider_list", f"SELECT id, name, sport_type, start_date, round(distance, 6) AS distance, gear_id, kudos_count FROM activities WHERE start_date > '{AFTER}' AND start_date < '{BEFORE}'", "activities")
def s4(spark, d):
    """A year of the list; row groups of pages outside of it stay closed."""
    path = f"{shared_dir(spark)}/pages"
    provider.write_pages(t.activities(spark, d).select("id", "name", "type", "sport_type", "start_date", "distance", "gear_id", "kudos_count"), path, PAGE)
    return provider.fetch(spark, path, AFTER, BEFORE).select("id", "name", "sport_type", "start_date", F.round("distance", 6).alias("distance"), "gear_id", "kudos_count")


@query("S5_backfill", f"""
WITH n AS (SELECT CAST(ceil(count(*) / {BACKFILL_PAGE}e0) AS BIGINT) AS pages, count(*) AS new_rides FROM activities)
SELECT id, name, start_date, pages, new_rides FROM activities, n""", "activities")
def s5(spark, d):
    """The whole history, paged backward into a store. The last run of the stream finds no page."""
    path = shared_dir(spark)
    provider.write_pages(t.activities(spark, d).select("id", "name", "start_date"), f"{path}/pages", BACKFILL_PAGE)
    done = provider.backfill(spark, f"{path}/pages", f"{path}/store", f"{path}/checkpoint")
    counts = [F.lit(done[k]).cast("long").alias(name) for k, name in (("pages", "pages"), ("new", "new_rides"))]
    return store.read(spark, f"{path}/store").select("id", "name", "start_date", *counts)


@query("S8_second_provider_tracks", """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 AND vec_id % 2 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN 0 ELSE 32 END AS n FROM embeddings),
p AS (SELECT vec_id, idx, floor(lat * 1e4 + 0.5e0) / 1e4 AS lat, floor(lon * 1e4 + 0.5e0) / 1e4 AS lon FROM points),
c AS (SELECT vec_id, count(*) AS points, round(sum(lat), 4) AS lat, round(sum(lon), 4) AS lon FROM p WHERE idx % 8 <> 3 GROUP BY 1)
SELECT e.vec_id AS id, CASE WHEN e.vec_id % 3 = 0 THEN 'GravelRide' ELSE 'Ride' END AS type, CASE WHEN n = 32 THEN points END AS points, CASE WHEN n = 32 THEN lat END AS lat, CASE WHEN n = 32 THEN lon END AS lon
FROM e JOIN c USING (vec_id) WHERE 2000 + e.vec_id % 9 >= 2003""", "points")
def s8(spark, d):
    """Rides of the second provider since 2003, with tracks from their details: some have none, some an empty one, and every eighth point lacks a number."""
    path = f"{shared_dir(spark)}/pages"
    tracks, n = t.tracks(spark, d), F.col("vec_id")
    kind = F.struct(F.when(n % 3 == 0, "gravel_cycling").otherwise("cycling").alias("typeKey"))
    raw = tracks.select(n.alias("activityId"), kind.alias("activityType"), F.concat((2000 + n % 9).cast("string"), F.lit("-05-01 06:00:00")).alias("startTimeLocal"), F.lit(60.0).alias("duration"))
    provider.write_pages(raw, path, PAGE, "startTimeLocal", "activityId")
    cut = lambda x: F.floor(x * 1e4 + 0.5) / 1e4
    line = F.transform("coords", lambda p, i: F.struct(F.when(i % 8 != 3, cut(p["lat"])).alias("lat"), cut(p["lon"]).alias("lon")))
    details = tracks.filter((n % 7 != 0) | (n % 2 != 0)).select(n.alias("activityId"), F.struct(F.when(n % 11 != 0, line).alias("polyline")).alias("geoPolylineDTO"))
    found = provider.fetch_second(spark, path, details, "2003").select("id", "type", polyline.decode(F.col("polyline")).alias("c"))
    total = lambda k: F.round(F.aggregate(F.col("c").getField(k), F.lit(0.0), lambda a, x: a + x), 4).alias(k)
    return found.select("id", "type", F.when(F.col("c").isNotNull(), F.size("c")).cast("long").alias("points"), total("lat"), total("lon"))


@query("K1_staged_store", """
WITH a AS (SELECT id, start_date, CASE WHEN id % 2 = 0 THEN distance + 1 ELSE distance END AS distance FROM activities WHERE id % 3 <> 0 OR id % 2 = 0)
SELECT id, start_date, distance, (SELECT count(*) FROM activities WHERE id % 6 = 0) AS new_rides, (SELECT count(*) FROM activities WHERE id % 2 = 0 AND id % 3 <> 0) AS updated, CAST(2 AS BIGINT) AS version FROM a""", "activities")
def k1(spark, d):
    """Two merges, of which the second comes twice and changes the table once."""
    root = shared_dir(spark)
    a = t.activities(spark, d).select("id", "start_date", "distance")
    store.merge(spark, root, a.filter("id % 3 <> 0"), stream="s", batch=0)
    for _ in range(2):
        at = store.merge(spark, root, a.filter("id % 2 = 0").withColumn("distance", F.col("distance") + 1), stream="s", batch=1)
    notes = [F.lit(at[k]).cast("long").alias(name) for k, name in (("new", "new_rides"), ("updated", "updated"), ("version", "version"))]
    return store.read(spark, root).select("id", "start_date", "distance", *notes)


@query("S2_remembered_files", "SELECT id, name, distance, CAST(1 AS BIGINT) AS files_read FROM (SELECT id, name, CASE WHEN id % 20 = 3 THEN distance + 1 ELSE distance END AS distance FROM activities)", "activities")
def s2(spark, d):
    """Rides in twenty files, read; one file is written anew, and the second scan reads that one."""
    path = shared_dir(spark)
    rides = t.activities(spark, d).select("id", "name", "distance", (F.col("id") % 20).alias("of"))
    put = lambda rows: rows.repartition(20, "of").sortWithinPartitions("of").write.partitionBy("of").mode("append").json(f"{path}/rides")
    put(rides)
    read = lambda paths: memo.with_file(spark.read.schema("id long, name string, distance double").json(paths)).select("id", "name", "distance", *memo.KEY)
    memo.remembered(spark, f"{path}/rides", f"{path}/store", read, "*.json")
    rides.filter("of = 3").withColumn("distance", F.col("distance") + 1).coalesce(1).write.partitionBy("of").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(f"{path}/rides")
    rows, counts = memo.remembered(spark, f"{path}/rides", f"{path}/store", read, "*.json")
    return rows.withColumn("files_read", F.lit(counts["read"]).cast("long"))


@query("W8_smoothed_series", """
WITH v AS (SELECT event_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 3e0 END AS x FROM events), n AS (SELECT *, count(x) OVER (ORDER BY ts, event_id) AS k FROM v), vals AS (SELECT k, x FROM n WHERE x IS NOT NULL),
near AS (SELECT p.k, sum(CASE WHEN q.k = 1 THEN 1 ELSE 15e-2 END * pow(85e-2, p.k - q.k) * q.x) AS level FROM vals p JOIN vals q ON q.k BETWEEN p.k - 400 AND p.k GROUP BY 1)
SELECT event_id, round(level, 7) AS smoothed FROM n LEFT JOIN near USING (k)""")
def w8(spark, d):
    """One series of thirds of all events' values; every seventh has none. Older values than 400 weigh less than a double shows."""
    e = table(spark, d, "events").select("event_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value") / 3).alias("x"))
    return smoothing.smoothed(e, "x", ["ts", "event_id"]).select("event_id", F.round("smoothed", 7).alias("smoothed"))
