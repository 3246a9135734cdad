"""Queries of roll-ups, filters, joins, sets and orders over the rides."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, units
from ..functions.dates import month_label
from ..functions.geo import haversine_m
from ..operators import rollups
from ..registry import query
from ..shared import table
from ..sources import testdata as t

SUMMARY = """count(*) AS total_rides,
  coalesce(round_even(sum(distance) * 0.000621371e0, 1), 0) AS total_distance_mi, coalesce(round_even(sum(moving_time) / 3600e0, 1), 0) AS total_time_h,
  coalesce(round_even(sum(total_elevation_gain) * 3.28084e0, 0), 0) AS total_elevation_ft, coalesce(round_even(sum(distance) / count(*) * 0.000621371e0, 1), 0) AS avg_distance_mi,
  coalesce(round_even(avg(nullif(average_speed, 0)) * 2.23694e0, 1), 0) AS avg_speed_mph, coalesce(round_even(sum(total_elevation_gain) / count(*) * 3.28084e0, 0), 0) AS avg_elevation_ft,
  round_even(avg(nullif(average_heartrate, 0)), 1) AS avg_heartrate, CAST(coalesce(sum(kudos_count), 0) AS BIGINT) AS total_kudos,
  coalesce(round_even(sum(nullif(kilojoules, 0)), 1), 0e0) AS total_kilojoules"""
SPORT = "coalesce(nullif(sport_type, ''), nullif(type, ''), 'Unknown')"
PERIODS = {
    "this_week": "start_local >= TIMESTAMP '2001-07-30'",
    "this_month": "start_local >= TIMESTAMP '2001-08-01'",
    "this_year": "start_local >= TIMESTAMP '2001-01-01'",
    "last_30d": "start_local >= TIMESTAMP '2001-07-02 12:00:00'",
    "last_year": "start_local BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '2000-12-31 23:59:59'",
}


@query("A1_ride_summary", f"SELECT {SUMMARY} FROM activities", "activities")
def a1(spark, d):
    return rollups.summary(t.activities(spark, d))


@query("A2_by_sport", f"SELECT {SPORT} AS sport_type, {SUMMARY} FROM activities GROUP BY 1", "activities")
def a2(spark, d):
    rides = t.activities(spark, d)
    return rollups.summary(rides, rollups.sport(rides).alias("sport_type")).orderBy(F.desc("total_rides"), "sport_type")


@query("A3_by_week", f"SELECT strftime(start_local, '%G-W%V') AS week, {SUMMARY} FROM activities WHERE start_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 52", "activities")
def a3(spark, d):
    return rollups.by_week(t.activities(spark, d))


@query("A4_by_month", f"SELECT strftime(start_local, '%Y-%m') AS month, {SUMMARY} FROM activities WHERE start_date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 24", "activities")
def a4(spark, d):
    return rollups.by_month(t.activities(spark, d))


@query("A5_calendar", f"""
WITH own AS (SELECT CAST(start_local AS DATE) AS ridden, {SUMMARY} FROM activities WHERE strftime(start_local, '%Y-%m') = '2001-07' GROUP BY 1),
days AS (SELECT CAST(x AS DATE) AS day FROM generate_series(DATE '2001-07-01', DATE '2001-07-31', INTERVAL 1 DAY) g(x))
SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(total_rides, 0) AS total_rides, coalesce(total_distance_mi, 0) AS total_distance_mi, coalesce(total_time_h, 0) AS total_time_h,
  coalesce(total_elevation_ft, 0) AS total_elevation_ft, coalesce(avg_distance_mi, 0) AS avg_distance_mi, coalesce(avg_speed_mph, 0) AS avg_speed_mph, coalesce(avg_elevation_ft, 0) AS avg_elevation_ft,
  avg_heartrate, coalesce(total_kudos, 0) AS total_kudos, coalesce(total_kilojoules, 0) AS total_kilojoules
FROM days LEFT JOIN own ON day = ridden""", "activities")
def a5(spark, d):
    return rollups.calendar(t.activities(spark, d), "2001-07")


@query("A6_by_gear", f"""
WITH own AS (SELECT gear_id, {SUMMARY}, coalesce(max(strftime(start_local, '%Y-%m-%d')), '') AS last_used FROM activities GROUP BY gear_id)
SELECT own.*, coalesce(g.name, gear_id, 'unassigned') AS name, coalesce(g.type, 'unknown') AS type FROM own LEFT JOIN gear g ON gear_id = g.id""", "activities gear")
def a6(spark, d):
    found = rollups.by_gear(t.activities(spark, d), t.gear(spark, d))
    return found.orderBy(F.when(F.col("type") == "bike", 0).otherwise(1), F.desc("total_distance_mi"), "gear_id")


@query("A7_records", """
WITH best AS (
  SELECT 'longest_ride' AS record, arg_max(id, (distance, -id)) AS id FROM activities UNION ALL SELECT 'most_elevation', arg_max(id, (total_elevation_gain, -id)) FROM activities
  UNION ALL SELECT 'fastest_speed', arg_max(id, (average_speed, -id)) FROM activities UNION ALL SELECT 'most_kilojoules', arg_max(id, (kilojoules, -id)) FROM activities WHERE kilojoules <> 0)
SELECT record, a.id, name, strftime(start_local, '%Y-%m-%d') AS date, round_even(distance * 0.000621371e0, 1) AS distance_mi, round_even(average_speed * 2.23694e0, 1) AS speed_mph,
  round_even(total_elevation_gain * 3.28084e0, 0) AS elevation_ft, round_even(moving_time / 3600e0, 1) AS time_h FROM best JOIN activities a ON a.id = best.id""", "activities")
def a7(spark, d):
    return rollups.records(t.activities(spark, d))


def _histogram_sql(value: str, where: str, width: int) -> str:
    return f"""
WITH v AS (SELECT {value} AS v FROM activities WHERE {where}), b AS (SELECT CAST(floor(v / {width}) * {width} AS BIGINT) AS lo, count(*) AS n FROM v GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(lo) FROM b), (SELECT max(lo) FROM b), {width})) AS BIGINT) AS lo)
SELECT lo || '-' || (lo + {width}) AS label, lo AS min, lo + {width} AS max, coalesce(n, 0) AS count FROM spine LEFT JOIN b USING (lo)"""


@query("A8_speed_histogram", _histogram_sql("round_even(average_speed * 2.23694e0, 1)", "average_speed > 0", 2), "activities")
def a8(spark, d):
    return rollups.speed_histogram(t.activities(spark, d))


@query("A9_climb_histogram", _histogram_sql("round_even(total_elevation_gain * 3.28084e0, 0)", "total_elevation_gain > 0", 250), "activities")
def a9(spark, d):
    return rollups.climb_histogram(t.activities(spark, d))


@query("A20_long_ride_statistics", """
SELECT count(*) AS rides, round(sum(distance) / 1000, 4) AS total_km, round(avg(distance) / 1000, 4) AS avg_km, round(min(distance) / 1000, 4) AS min_km, round(max(distance) / 1000, 4) AS max_km,
  round(avg(CASE WHEN abs(start_lat - end_lat) < 2e-3 AND abs(start_lon - end_lon) < 2e-3 THEN 100e0 ELSE 0e0 END), 4) AS loop_pct FROM activities WHERE distance >= 15000""", "activities")
def a20(spark, d):
    rides = t.activities(spark, d).filter("distance >= 15000")
    loop = (F.abs(F.col("start_lat") - F.col("end_lat")) < 2e-3) & (F.abs(F.col("start_lon") - F.col("end_lon")) < 2e-3)
    km = F.col("distance") / 1000
    return rides.agg(F.count("*").alias("rides"), *[F.round(f(km), 4).alias(n) for f, n in ((F.sum, "total_km"), (F.avg, "avg_km"), (F.min, "min_km"), (F.max, "max_km"))], F.round(F.avg(F.when(loop, 100.0).otherwise(0.0)), 4).alias("loop_pct"))


@query("A21_distance_histogram", _histogram_sql("distance / 1000", "distance >= 15000", 10), "activities")
def a21(spark, d):
    return rollups.histogram(t.activities(spark, d).filter("distance >= 15000").select((F.col("distance") / 1000).alias("v")), "v", 10)


@query("A22_monthly_distance", "SELECT strftime(start_local, '%Y-%m') AS month, count(*) AS rides, round(sum(distance) / 1000, 4) AS km FROM activities WHERE start_local IS NOT NULL GROUP BY 1", "activities")
def a22(spark, d):
    rides = t.activities(spark, d).filter("start_local is not null")
    return rides.groupBy(month_label(F.col("start_local")).alias("month")).agg(F.count("*").alias("rides"), F.round(F.sum("distance") / 1000, 4).alias("km"))


@query("A23_longest_ten", "SELECT id, name, distance FROM activities ORDER BY distance DESC, id LIMIT 10", "activities")
def a23(spark, d):
    return t.activities(spark, d).orderBy(F.desc("distance"), "id").limit(10).select("id", "name", "distance")


@query("A24_cache_statistics", """
SELECT type, year(start_local) AS year, count(*) AS rides, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS pct,
  CAST(sum(CASE WHEN lower(name) LIKE '%work%' OR lower(name) LIKE '%commute%' THEN 1 ELSE 0 END) AS BIGINT) AS commutes, round(sum(distance) / 1000, 4) AS km
FROM activities GROUP BY GROUPING SETS ((type), (year(start_local)))""".replace("OVER ()", "OVER (PARTITION BY grouping(type))"), "activities")
def a24(spark, d):
    rides = t.activities(spark, d).withColumn("year", F.year("start_local"))
    commute = F.when(text.contains_any(F.col("name"), ("work", "commute")), 1).otherwise(0)
    sets = rides.groupingSets([[F.col("type")], [F.col("year")]], "type", "year").agg(F.count("*").alias("rides"), F.sum(commute).alias("commutes"), F.round(F.sum("distance") / 1000, 4).alias("km"), F.grouping("type").alias("g"))
    share = F.round(F.col("rides") * 100.0 / F.sum("rides").over(Window.partitionBy("g")), 6)
    return sets.select("type", F.col("year").cast("long").alias("year"), "rides", share.alias("pct"), "commutes", "km")


@query("A28_group_ride_patterns", r"""
WITH r AS (SELECT *, trim(regexp_replace(regexp_replace(lower(trim(name)), '[#\d/\-]+', '', 'g'), '\s+', ' ', 'g')) AS norm FROM activities
  WHERE type LIKE '%Ride%' AND name IS NOT NULL AND start_local IS NOT NULL AND isodow(start_local) = 6 AND moving_time >= 1800),
k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY start_date DESC NULLS LAST, id) AS rank FROM r WHERE norm NOT IN ('', 'morning ride', 'afternoon ride', 'evening ride', 'lunch ride', 'ride'))
SELECT norm AS normalized_name, max(CASE WHEN rank = 1 THEN name END) AS name, count(*) AS frequency, round_even(avg(moving_time) / 60, 0) AS avg_duration_minutes, round_even(avg(distance) / 1609.34e0, 1) AS avg_distance_miles,
  max(CASE WHEN rank = 1 THEN start_date END) AS latest_date, CAST(max(CASE WHEN rank = 1 THEN id END) AS BIGINT) AS latest_activity_id, string_agg(CASE WHEN rank <= 10 THEN CAST(id AS VARCHAR) END, ',' ORDER BY rank) AS activity_ids
FROM k GROUP BY norm""", "activities")
def a28(spark, d):
    rides = t.activities(spark, d).filter("type like '%Ride%' and name is not null and start_local is not null and moving_time >= 1800").filter(F.weekday("start_local") == 5)
    rides = rides.withColumn("norm", text.normalise_ride_name(F.trim("name"))).filter(~F.col("norm").isin("", "morning ride", "afternoon ride", "evening ride", "lunch ride", "ride"))
    ranked = rides.withColumn("rank", F.row_number().over(Window.partitionBy("norm").orderBy(F.col("start_date").desc_nulls_last(), "id")))
    latest = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    few = F.array_sort(F.collect_list(F.when(F.col("rank") <= 10, F.struct("rank", F.col("id").cast("string").alias("id")))))
    return ranked.groupBy(F.col("norm").alias("normalized_name")).agg(
        latest("name").alias("name"), F.count("*").alias("frequency"), units.even(F.avg("moving_time") / 60).alias("avg_duration_minutes"), units.even(F.avg("distance") / 1609.34, 1).alias("avg_distance_miles"),
        latest("start_date").alias("latest_date"), latest("id").alias("latest_activity_id"), F.array_join(F.transform(few, lambda x: x["id"]), ",").alias("activity_ids"),
    )


@query("A33_upsert_counts", """
WITH o AS (SELECT id FROM activities WHERE id % 3 <> 0), n AS (SELECT id FROM activities WHERE id % 2 = 0)
SELECT CAST(sum(CASE WHEN o.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS new, CAST(sum(CASE WHEN o.id IS NOT NULL AND n.id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS updated, count(*) AS total,
  count(o.id) AS previous_total FROM o FULL JOIN n ON o.id = n.id""", "activities")
def a33(spark, d):
    rides = t.activities(spark, d)
    return rollups.upsert_counts(rides.filter("id % 3 <> 0"), rides.filter("id % 2 = 0"))


@query("A34_cache_info", "SELECT count(*) AS count, min(start_date) AS first_date, max(start_date) AS last_date FROM activities", "activities")
def a34(spark, d):
    return t.activities(spark, d).agg(F.count("*").alias("count"), F.min("start_date").alias("first_date"), F.max("start_date").alias("last_date"))


COMMUTE = """regexp_matches(lower(name), 'work|commute') AND type LIKE '%Ride%' AND distance BETWEEN 2000 AND 30000 AND start_lat IS NOT NULL AND end_lat IS NOT NULL AND lower(name) NOT LIKE '%virtual%'"""


def commutes(rides):
    """Rides named like commutes, of 2 to 30 km, with both ends known and not virtual."""
    return rides.filter(text.contains_any(F.col("name"), text.COMMUTE_WORDS) & F.col("type").contains("Ride") & F.col("distance").between(2000, 30000) & F.col("start_lat").isNotNull() & F.col("end_lat").isNotNull() & ~F.lower("name").contains("virtual"))


@query("P1_commute_candidates", f"SELECT id, name, distance FROM activities WHERE {COMMUTE}", "activities")
def p1(spark, d):
    return commutes(t.activities(spark, d)).select("id", "name", "distance")


@query("P2_long_rides", f"""
SELECT id, distance FROM activities WHERE id NOT IN (SELECT id FROM activities WHERE {COMMUTE}) AND type LIKE '%Ride%' AND type NOT LIKE '%Virtual%' AND start_lat IS NOT NULL AND end_lat IS NOT NULL
  AND NOT coalesce(regexp_matches(lower(name), 'zwift|trainer|indoor|rouvy|sufferfest|peloton'), false) AND distance >= 15000""", "activities")
def p2(spark, d):
    rides = t.activities(spark, d)
    virtual = F.coalesce(text.contains_any(F.col("name"), text.VIRTUAL_WORDS), F.lit(False))
    kept = rides.join(commutes(rides).select("id"), "id", "left_anti")
    return kept.filter(F.col("type").contains("Ride") & ~F.col("type").contains("Virtual") & F.col("start_lat").isNotNull() & F.col("end_lat").isNotNull() & ~virtual & (F.col("distance") >= 15000)).select("id", "distance")


@query("P5_periods", " UNION ALL ".join(f"SELECT '{p}' AS period, count(*) AS rides, round(coalesce(sum(distance), 0), 2) AS distance FROM activities WHERE start_date IS NOT NULL AND {w}" for p, w in PERIODS.items()), "activities")
def p5(spark, d):
    rides, out = t.activities(spark, d), None
    for period in PERIODS:
        one = rollups.in_period(rides, period, t.NOW).agg(F.lit(period).alias("period"), F.count("*").alias("rides"), F.round(F.coalesce(F.sum("distance"), F.lit(0.0)), 2).alias("distance"))
        out = one if out is None else out.unionByName(one)
    return out


@query("P6_P27_list_filters", f"SELECT id, {SPORT} AS sport FROM activities WHERE (gear_id = 'b3' OR gear_id IS NULL) AND {SPORT} IN ('Ride', 'Unknown')", "activities")
def p6(spark, d):
    rides = t.activities(spark, d)
    return rides.withColumn("sport", rollups.sport(rides)).filter("(gear_id = 'b3' or gear_id is null) and sport in ('Ride', 'Unknown')").select("id", "sport")


@query("P7_weekday_rides", "SELECT id FROM activities WHERE type LIKE '%Ride%' AND isodow(start_local) = 3 AND moving_time >= 3600", "activities")
def p7(spark, d):
    return t.activities(spark, d).filter("type like '%Ride%' and moving_time >= 3600").filter(F.weekday("start_local") == 2).select("id")


@query("P8_P9_target_filters", """
SELECT id, round(distance / 1000, 6) AS km FROM activities WHERE distance BETWEEN 10 * 1609.34e0 AND 30 * 1609.34e0 AND abs(moving_time / 3600e0 - 2) <= 1 AND abs(distance / 1000 - 30) <= 10""", "activities")
def p8(spark, d):
    km = F.col("distance") / 1000
    rides = t.activities(spark, d).filter(F.col("distance").between(10 * 1609.34, 30 * 1609.34))
    return rides.filter((F.abs(F.col("moving_time") / 3600.0 - 2) <= 1) & (F.abs(km - 30) <= 10)).select("id", F.round(km, 6).alias("km"))


@query("P11_ends_outside", """
SELECT id FROM activities WHERE NOT coalesce((start_lat < 4185e-2 - 1e-2 OR start_lat > 4191e-2 + 1e-2 OR start_lon < -8766e-2 - 1e-2 OR start_lon > -8760e-2 + 1e-2) AND (end_lat < 4185e-2 - 1e-2 OR end_lat > 4191e-2 + 1e-2 OR end_lon < -8766e-2 - 1e-2 OR end_lon > -8760e-2 + 1e-2), false)""", "activities")
def p11(spark, d):
    south, west, north, east = t.BOUNDS
    out = lambda lat, lon: (F.col(lat) < south - 1e-2) | (F.col(lat) > north + 1e-2) | (F.col(lon) < west - 1e-2) | (F.col(lon) > east + 1e-2)
    return t.activities(spark, d).filter(~F.coalesce(out("start_lat", "start_lon") & out("end_lat", "end_lon"), F.lit(False))).select("id")


@query("P13_library_filters", f"""
SELECT id, trim(name) AS name FROM activities WHERE type <> 'Run' AND lower({SPORT}) = 'gravelride' AND coalesce(distance, 0) >= 12000 AND coalesce(distance, 0) <= 40000
  AND start_local >= TIMESTAMP '2001-08-01 12:00:00' - INTERVAL 700 DAY AND lower(coalesce(name, '')) LIKE '%loop%'""", "activities")
def p13(spark, d):
    rides = t.activities(spark, d)
    return rides.filter((F.col("type") != "Run") & (F.lower(rollups.sport(rides)) == "gravelride") & F.coalesce("distance", F.lit(0.0)).between(12000, 40000)).filter(F.col("start_local") >= F.to_timestamp_ntz(F.lit(t.NOW)) - F.expr("interval 700 days")).filter(F.lower(F.coalesce("name", F.lit(""))).contains("loop")).select("id", F.trim("name").alias("name"))


@query("P15_search", "SELECT id, name FROM activities WHERE lower(name) LIKE '%lakefront%' ORDER BY id LIMIT 20", "activities")
def p15(spark, d):
    return t.activities(spark, d).filter(F.lower("name").contains("lakefront")).orderBy("id").limit(20).select("id", "name")


@query("P21_unnamed_split", "SELECT CASE WHEN name IS NULL OR trim(name) IN ('', 'Morning Ride', 'Afternoon Ride', 'Evening Ride', 'Lunch Ride') THEN 'unnamed' ELSE trim(name) END AS name, count(*) AS rides FROM activities GROUP BY 1", "activities")
def p21(spark, d):
    from ..config import GENERIC_NAMES

    name = F.trim("name")
    return t.activities(spark, d).groupBy(F.when(name.isNull() | name.isin("", *GENERIC_NAMES), "unnamed").otherwise(name).alias("name")).agg(F.count("*").alias("rides"))


@query("P24_P25_activity_rows", """
SELECT id, CASE WHEN name IS NULL OR trim(name) = '' THEN 'Ride on ' || strftime(start_local, '%b %d, %Y') ELSE trim(name) END AS name, substr(start_date, 1, 10) AS date, round_even(distance * 0.000621371e0, 1) AS distance_mi,
  round_even(average_speed * 2.23694e0, 1) AS speed_mph, coalesce(g.name, gear_id) AS gear FROM activities a LEFT JOIN gear g ON a.gear_id = g.id""".replace("SELECT id,", "SELECT a.id,").replace("name IS NULL OR trim(name)", "a.name IS NULL OR trim(a.name)").replace("ELSE trim(name)", "ELSE trim(a.name)"), "activities gear")
def p24(spark, d):
    a, g = t.activities(spark, d), t.gear(spark, d).select(F.col("id").alias("of"), F.col("name").alias("gear_name"))
    named = F.when(F.col("name").isNull() | (F.trim("name") == ""), F.concat(F.lit("Ride on "), F.date_format("start_local", "MMM dd, yyyy"))).otherwise(F.trim("name"))
    return a.join(g, a["gear_id"] == g["of"], "left").select("id", named.alias("name"), F.substring("start_date", 1, 10).alias("date"), units.even(units.miles(F.col("distance")), 1).alias("distance_mi"), units.even(units.mph(F.col("average_speed")), 1).alias("speed_mph"), F.coalesce("gear_name", "gear_id").alias("gear"))


@query("J1_J2_anti_semi", f"""
SELECT 'other' AS kind, count(*) AS n FROM activities a WHERE NOT EXISTS (SELECT 1 FROM activities c WHERE c.id = a.id AND {COMMUTE.replace('name', 'c.name').replace('type ', 'c.type ').replace('distance', 'c.distance').replace('start_lat', 'c.start_lat').replace('end_lat', 'c.end_lat')})
UNION ALL SELECT 'member', count(*) FROM activities WHERE id IN (SELECT activity_id FROM routes)""", "activities routes")
def j1(spark, d):
    a = t.activities(spark, d)
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n(a.join(commutes(a).select("id"), "id", "left_anti"), "other").unionByName(n(a.join(t.routes(spark, d).select(F.col("activity_id").alias("id")), "id", "left_semi"), "member"))


@query("J3_gear_join", "SELECT coalesce(g.name, gear_id, 'none') AS gear, coalesce(g.type, 'unknown') AS type, count(*) AS rides FROM activities LEFT JOIN gear g ON gear_id = g.id GROUP BY 1, 2", "activities gear")
def j3(spark, d):
    a, g = t.activities(spark, d).select("gear_id"), t.gear(spark, d)
    return a.join(g, a["gear_id"] == g["id"], "left").groupBy(F.coalesce("name", "gear_id", F.lit("none")).alias("gear"), F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("rides"))


HAVERSINE = "12742000 * asin(sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2)))"


def hav(a, c, b, d):
    return HAVERSINE.format(a=a, b=b, c=c, d=d)


def geod(a, c, b, d):
    """Lambert's formula on the ellipsoid."""
    flat = "(1 / 298.257223563e0)"
    one, two = (f"atan((1 - {flat}) * tan(radians({x})))" for x in (a, b))
    h = f"(pow(sin(({two} - {one}) / 2), 2) + cos({one}) * cos({two}) * pow(sin(radians({d} - {c}) / 2), 2))"
    arc = f"(2 * asin(sqrt(least(1, {h}))))"
    x = f"(({arc} - sin({arc})) * pow(sin(({one} + {two}) / 2) * cos(({two} - {one}) / 2), 2) / nullif(1 - {h}, 0))"
    y = f"(({arc} + sin({arc})) * pow(cos(({one} + {two}) / 2) * sin(({two} - {one}) / 2), 2) / nullif({h}, 0))"
    return f"6378137e0 * ({arc} - {flat} / 2 * (coalesce({x}, 0) + coalesce({y}, 0)))"


@query("J10_rides_nearby", f"WITH x AS (SELECT id, {hav('4188e-2', '-8763e-2', 'start_lat', 'start_lon')} AS m FROM activities) SELECT id, round(m, 4) AS metres FROM x WHERE m <= 5 * 1609.34e0 ORDER BY m, id LIMIT 25", "activities")
def j10(spark, d):
    m = haversine_m(F.lit(t.HOME[0]), F.lit(t.HOME[1]), F.col("start_lat"), F.col("start_lon"))
    near = t.activities(spark, d).withColumn("m", m).filter(F.col("m") <= 5 * 1609.34)
    return near.orderBy("m", "id").limit(25).select("id", F.round("m", 4).alias("metres"))


@query("J15_rides_by_days", "SELECT a.id, CAST(day AS INTEGER) AS day, distance / 1000 / (1 + day) AS share FROM activities a, generate_series(0, 6) g(day) WHERE distance >= 45000", "activities")
def j15(spark, d):
    days = F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day")
    return t.activities(spark, d).filter("distance >= 45000").select("id", "distance", days).select("id", "day", (F.col("distance") / 1000 / (1 + F.col("day"))).alias("share"))


@query("J20_merge_unseen", "SELECT id, CASE WHEN id % 3 <> 0 THEN 'old' ELSE 'new' END AS came FROM activities WHERE id % 3 <> 0 OR id % 2 = 0", "activities")
def j20(spark, d):
    a = t.activities(spark, d)
    old, new = a.filter("id % 3 <> 0"), a.filter("id % 2 = 0")
    return old.select("id", F.lit("old").alias("came")).unionByName(new.join(old.select("id"), "id", "left_anti").select("id", F.lit("new").alias("came")))


@query("J21_names_overwrite", "SELECT r.group_id, coalesce(n.n_name, r.group_id) AS name, count(*) AS routes FROM routes r LEFT JOIN nation n ON n.n_nationkey = CAST(right(r.group_id, 1) AS INTEGER) AND n.n_nationkey % 2 = 0 GROUP BY 1, 2", "routes")
def j21(spark, d):
    names = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("of"), "n_name")
    r = t.routes(spark, d).select("group_id")
    return r.join(names, F.substring("group_id", -1, 1) == F.col("of"), "left").groupBy("group_id", F.coalesce("n_name", "group_id").alias("name")).agg(F.count("*").alias("routes"))


@query("O1_paged_list", "SELECT id, distance FROM activities ORDER BY distance DESC, id LIMIT 50 OFFSET 100", "activities")
def o1(spark, d):
    return t.activities(spark, d).orderBy(F.desc("distance"), "id").offset(100).limit(50).select("id", "distance")


@query("O3_O4_library_order", "WITH r AS (SELECT id, name, row_number() OVER (ORDER BY lower(coalesce(name, '')), distance DESC, id) AS place FROM activities) SELECT * FROM r WHERE place <= 100", "activities")
def o3(spark, d):
    top = t.activities(spark, d).orderBy(F.lower(F.coalesce("name", F.lit(""))), F.desc("distance"), "id").limit(100)
    w = Window.orderBy(F.lower(F.coalesce("name", F.lit(""))), F.desc("distance"), "id")
    return top.select("id", "name", F.row_number().over(w).alias("place"))


@query("O7_O8_newest_first", "SELECT id, start_date FROM activities ORDER BY start_date DESC NULLS LAST, distance, id LIMIT 100", "activities")
def o8(spark, d):
    return t.activities(spark, d).orderBy(F.col("start_date").desc_nulls_last(), "distance", "id").limit(100).select("id", "start_date")


@query("O9_keep_last", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) SELECT user_id, event_id FROM r WHERE k <= 3")
def o9(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, d, "events").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("user_id", "event_id")


@query("O11_best_day", """
WITH s AS (SELECT CAST(ts AS DATE) AS day, event_id, value FROM events), b AS (SELECT day, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM s GROUP BY day)
SELECT strftime(day, '%Y-%m-%d') AS day, event_id, value FROM b ORDER BY value DESC, day LIMIT 1""")
def o11(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    best = table(spark, d, "events").groupBy(day).agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("event_id"), F.max("value").alias("value"))
    return best.orderBy(F.desc("value"), "day").limit(1)


@query("U1_id_differences", "SELECT id, CASE WHEN id % 3 <> 0 THEN 'removed' ELSE 'new' END AS change FROM activities WHERE (id % 3 <> 0) <> (id % 2 = 0)", "activities")
def u1(spark, d):
    a = t.activities(spark, d).select("id")
    old, new = a.filter("id % 3 <> 0"), a.filter("id % 2 = 0")
    return new.join(old, "id", "left_anti").withColumn("change", F.lit("new")).unionByName(old.join(new, "id", "left_anti").withColumn("change", F.lit("removed")))


@query("U2_upsert", """
SELECT id, CASE WHEN id % 2 = 0 THEN distance + 1 ELSE distance END AS distance, start_date FROM activities WHERE id % 3 <> 0 OR id % 2 = 0""", "activities")
def u2(spark, d):
    a = t.activities(spark, d).select("id", "distance", "start_date")
    return rollups.upsert(a.filter("id % 3 <> 0"), a.filter("id % 2 = 0").withColumn("distance", F.col("distance") + 1))


@query("U3_library_union", "SELECT 'ride' AS kind, id, distance, CAST(NULL AS BIGINT) AS uses FROM activities WHERE distance >= 40000 UNION ALL SELECT 'commute', activity_id, distance, duration FROM routes", "activities routes")
def u3(spark, d):
    rides = t.activities(spark, d).filter("distance >= 40000").select(F.lit("ride").alias("kind"), "id", "distance")
    commute = t.routes(spark, d).select(F.lit("commute").alias("kind"), F.col("activity_id").alias("id"), "distance", F.col("duration").alias("uses"))
    return rides.unionByName(commute, allowMissingColumns=True)


@query("U6_fill_missing_gear", "SELECT a.id, coalesce(a.gear_id, 'b' || (a.id % 5)) AS gear_id FROM activities a", "activities")
def u6(spark, d):
    a = t.activities(spark, d)
    patch = a.select(F.col("id").alias("of"), F.concat(F.lit("b"), (F.col("id") % 5).cast("string")).alias("patched"))
    return a.join(patch, a["id"] == patch["of"], "left").select("id", F.coalesce("gear_id", "patched").alias("gear_id"))
