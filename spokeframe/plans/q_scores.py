"""Queries of scoring models, windows and group metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..functions.units import even
from ..operators import forecast, rollups
from ..operators.ranking import cumulative_midpoint, rank_routes, runs, with_bounds
from ..registry import query
from ..shared import table
from ..sources import testdata as t
from .q_functions import HAV, IMPACT, SEGMENTS

ROUND = 6


def _rounded(df, digits: int = ROUND):
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _groups(spark, d):
    return rollups.group_metrics(t.routes(spark, d))


@query("A10_A11_group_metrics", "SELECT group_id, direction, uses, round(avg_duration, 6) AS avg_duration, round(std_duration, 6) AS std_duration, round(avg_distance, 6) AS avg_distance, round(avg_speed, 6) AS avg_speed, round(avg_elevation, 6) AS avg_elevation, round(consistency, 6) AS consistency FROM groups", "groups")
def a10(spark, d):
    return _rounded(_groups(spark, d))


@query("A12_W10_normalisation", "SELECT group_id, round((avg_duration - min(avg_duration) OVER ()) / nullif(max(avg_duration) OVER () - min(avg_duration) OVER (), 0), 6) AS duration, round(avg_distance / max(avg_distance) OVER (), 6) AS distance FROM groups", "groups")
def a12(spark, d):
    g = with_bounds(_groups(spark, d))
    return g.select("group_id", F.round((F.col("avg_duration") - F.col("min_duration")) / F.nullif(F.col("max_duration") - F.col("min_duration"), F.lit(0.0)), 6).alias("duration"), F.round(F.col("avg_distance") / F.col("max_distance"), 6).alias("distance"))


@query("A13_plus_routes", "WITH m AS (SELECT direction, median(distance) AS median FROM routes GROUP BY 1) SELECT activity_id, direction, median, distance > median * 1.15e0 AS is_plus_route FROM routes JOIN m USING (direction)", "routes")
def a13(spark, d):
    return rollups.plus_routes(t.routes(spark, d)).select("activity_id", "direction", "median", "is_plus_route")


@query("W1_representative", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY duration, activity_id) AS k, count(*) OVER (PARTITION BY group_id) AS n FROM routes) SELECT group_id, activity_id FROM r WHERE k = n // 2 + 1", "routes")
def w1(spark, d):
    return rollups.representative(t.routes(spark, d)).select("group_id", "activity_id")


@query("W2_latest_per_group", "WITH r AS (SELECT trim(name) AS name, id, start_date, row_number() OVER (PARTITION BY trim(name) ORDER BY start_date DESC NULLS LAST, id) AS k FROM activities WHERE name IS NOT NULL) SELECT name, id, start_date FROM r WHERE k = 1", "activities")
def w2(spark, d):
    rides = t.activities(spark, d).filter("name is not null").select(F.trim("name").alias("name"), "id", "start_date")
    best = F.max_by(F.struct("id", "start_date"), F.struct(F.coalesce("start_date", F.lit("")), -F.col("id")))
    return rides.groupBy("name").agg(best.alias("r")).select("name", "r.id", "r.start_date")


@query("A25_A26_name_groups", """
WITH r AS (SELECT trim(name) AS name, id, start_date FROM activities WHERE trim(name) NOT IN ('', 'Morning Ride', 'Afternoon Ride', 'Evening Ride', 'Lunch Ride'))
SELECT name, count(*) OVER (PARTITION BY name) AS uses, row_number() OVER (PARTITION BY name ORDER BY start_date DESC NULLS LAST, id) - 1 AS place, id FROM r""", "activities")
def a25(spark, d):
    """A row a member of a name, newest first, so that a common name makes no long row."""
    from ..config import GENERIC_NAMES

    rides = t.activities(spark, d).select(F.trim("name").alias("name"), "id", "start_date").filter(~F.col("name").isin("", *GENERIC_NAMES))
    return rollups.members(rides, "name", [F.col("start_date").desc_nulls_last(), F.col("id").asc()]).select("name", "uses", "place", "id")


@query("A27_primary_name", "WITH n AS (SELECT id % 10 AS grp, trim(name) AS name, count(*) AS k FROM activities WHERE name IS NOT NULL GROUP BY 1, 2) SELECT grp, arg_max(name, (k, -length(name), name)) AS name FROM n GROUP BY 1", "activities")
def a27(spark, d):
    n = t.activities(spark, d).filter("name is not null").groupBy((F.col("id") % 10).alias("grp"), F.trim("name").alias("name")).count()
    return n.groupBy("grp").agg(F.max_by("name", F.struct("count", -F.length("name"), "name")).alias("name"))


@query("A29_A30_ends_and_centre", """
WITH e AS (SELECT CASE WHEN (label < 5) = (idx = 0) THEN 'home' ELSE 'work' END AS place, lat, lon FROM points WHERE idx IN (0, 31))
SELECT place, count(*) AS n, round(avg(lat), 7) AS lat, round(avg(lon), 7) AS lon FROM e GROUP BY 1 UNION ALL SELECT 'centre', count(*), round(avg(lat), 7), round(avg(lon), 7) FROM points""", "points")
def a29(spark, d):
    c, to_work = F.col("coords"), F.col("direction") == "home_to_work"
    ends = F.array(F.struct(F.when(to_work, "home").otherwise("work").alias("place"), F.get(c, F.lit(0)).alias("p")), F.struct(F.when(to_work, "work").otherwise("home").alias("place"), F.element_at(c, -1).alias("p")))
    means = lambda df: df.agg(F.count("*").alias("n"), F.round(F.avg("p.lat"), 7).alias("lat"), F.round(F.avg("p.lon"), 7).alias("lon"))
    r = t.routes(spark, d)
    places = means(r.select(F.explode(ends).alias("e")).select("e.*").groupBy("place"))
    centre = means(r.select(F.explode("coords").alias("p"))).select(F.lit("centre").alias("place"), "n", "lat", "lon")
    return places.unionByName(centre)


@query("A15_library_statistics", """
SELECT count(*) AS total_routes, CAST(sum(uses) AS BIGINT) AS total_activities, round(sum(avg_distance * uses) / 1000, 4) AS total_km, arg_max(group_id, (uses, group_id)) AS most_used, arg_max(group_id, (round(avg_distance, 6), group_id)) AS longest FROM groups""", "groups")
def a15(spark, d):
    g = _groups(spark, d)
    return g.agg(F.count("*").alias("total_routes"), F.sum("uses").alias("total_activities"), F.round(F.sum(F.col("avg_distance") * F.col("uses")) / 1000, 4).alias("total_km"), F.max_by("group_id", F.struct("uses", "group_id")).alias("most_used"), F.max_by("group_id", F.struct(F.round("avg_distance", 6), "group_id")).alias("longest"))


SCORES = f"""{IMPACT}, gw AS (SELECT group_id, avg(head) AS head, avg(cross_kph) AS cross_kph FROM impact JOIN routes ON vec_id = activity_id GROUP BY 1),
b AS (SELECT g.*, head, cross_kph, min(avg_duration) OVER () AS d0, max(avg_duration) OVER () AS d1, min(avg_distance) OVER () AS k0, max(avg_distance) OVER () AS k1, max(uses) OVER () AS u1 FROM groups g JOIN gw USING (group_id)),
s AS (SELECT group_id, direction, uses, least(100, 100 * (1 - (avg_duration - d0) / (d1 - d0)) + 10 * consistency) AS time, 100 * (1 - (avg_distance - k0) / (k1 - k0)) AS distance,
  uses / CAST(u1 AS DOUBLE) * 100 * 0.4e0 + (100 - least(50, avg_elevation / 10)) * 0.3e0 + consistency * 100 * 0.3e0 AS safety,
  greatest(0, least(100, 50 + CASE WHEN head < 0 THEN least(40, -head * 2) ELSE -least(40, head * 2) END - least(10, cross_kph * 0.5e0))) AS weather FROM b),
c AS (SELECT *, time * 0.25e0 + distance * 0.1e0 + safety * 0.35e0 + weather * 0.3e0 AS score FROM s)"""


@query("C1_C5_route_scores", f"""WITH {SCORES} SELECT group_id, round(time, 5) AS time, round(distance, 5) AS distance, round(safety, 5) AS safety, round(weather, 5) AS weather, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, group_id) AS place,
  'Recommended as ' || coalesce(nullif(array_to_string(list_filter([CASE WHEN time > 80 THEN 'fastest route' END, CASE WHEN distance > 80 THEN 'shortest distance' END, CASE WHEN safety > 80 THEN 'most familiar and safe' END, CASE WHEN weather > 70 THEN 'favorable wind conditions' END,
    CASE WHEN weather < 30 THEN CASE WHEN greatest(time, distance, safety) > 80 THEN 'but note: strong headwinds expected' ELSE 'best option despite headwinds' END END], lambda x: x IS NOT NULL), ' and '), ''), 'best overall balance') AS reason FROM c""", "points groups")
def c1(spark, d):
    ranked = rank_routes(t.routes(spark, d), 25.0, 225.0, by=None)
    return _rounded(ranked.select("group_id", "time", "distance", "safety", "weather", "score", "place", "reason"), 5)


@query("C6_W11_best_by_direction", f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY score DESC, group_id) AS place FROM c) SELECT direction, group_id, place, round(score, 5) AS score FROM r WHERE place <= 2", "points groups")
def c6(spark, d):
    return _rounded(rank_routes(t.routes(spark, d), 25.0, 225.0, by="direction").filter("place <= 2").select("direction", "group_id", "place", "score"), 5)


HEAT = "CASE WHEN {t} < 0 THEN 0.4e0 WHEN {t} < 10 THEN 0.2e0 {hot} ELSE 0e0 END"
WINDY = "CASE WHEN {w} > 30 THEN 0.3e0 WHEN {w} > 20 THEN 0.15e0 ELSE 0e0 END"


@query("C13_comfort", f"""
WITH s AS (SELECT event_id, greatest(0e0, least(1e0, 1 - {HEAT.format(t='temp_c', hot='WHEN temp_c > 30 THEN 0.3e0')} - {WINDY.format(w='wind_speed_kph')} - CASE WHEN precipitation_mm > 5 THEN 0.4e0 WHEN precipitation_mm > 0 THEN 0.2e0 ELSE 0e0 END)) AS current,
  greatest(0e0, least(1e0, 1 - {HEAT.format(t='temp_c', hot='WHEN temp_c > 30 THEN 0.3e0 WHEN temp_c > 25 THEN 0.1e0')} - {WINDY.format(w='wind_speed_kph')} - CASE WHEN precipitation_mm > 5 THEN 0.4e0 WHEN precipitation_mm > 1 THEN 0.3e0 WHEN precipitation_mm > 0 THEN 0.2e0 ELSE 0e0 END)) AS planner FROM weather)
SELECT event_id, round(current, 6) AS current, round(planner, 6) AS planner, CASE WHEN round(current, 9) >= 0.7 THEN 'favorable' WHEN round(current, 9) >= 0.4 THEN 'neutral' ELSE 'unfavorable' END AS favourability FROM s""", "weather")
def c13(spark, d):
    t_, w, p = F.col("temp_c"), F.col("wind_speed_kph"), F.col("precipitation_mm")
    own = scores.comfort(t_, w, p)
    return t.weather(spark, d).select("event_id", F.round(own, 6).alias("current"), F.round(scores.comfort_planner(t_, w, p), 6).alias("planner"), scores.favourability(F.round(own, 9)).alias("favourability"))


DAILY = "daily AS (SELECT CAST(ts AS DATE) AS date, max(temp_c) AS hi, min(temp_c) AS lo, max(wind_speed_kph) AS w, sum(precipitation_mm) AS mm, max(precipitation_prob) AS p FROM weather GROUP BY 1)"


@query("C13_daily_comfort", f"WITH {DAILY} SELECT strftime(date, '%Y-%m-%d') AS date, round_even(greatest(0e0, least(1e0, 1 - CASE WHEN (hi + lo) / 2 < 0 THEN 0.4e0 WHEN (hi + lo) / 2 < 10 THEN 0.2e0 WHEN (hi + lo) / 2 > 35 THEN 0.5e0 WHEN (hi + lo) / 2 > 30 THEN 0.3e0 ELSE 0e0 END - {WINDY.format(w='w')} - CASE WHEN mm > 5 THEN 0.4e0 WHEN mm > 0 THEN 0.2e0 ELSE 0e0 END)), 2) AS comfort FROM daily", "weather")
def c13d(spark, d):
    days = forecast.daily(t.weather(spark, d))
    return days.select(F.date_format("date", "yyyy-MM-dd").alias("date"), scores.comfort_daily(F.col("temp_max_c"), F.col("temp_min_c"), F.col("wind_speed_max_kph"), F.col("precipitation_sum_mm")).alias("comfort"))


POINTS = """CASE WHEN temp < 0 THEN 3 WHEN temp < 5 THEN 2 WHEN temp < 10 THEN 1 WHEN temp > 30 THEN 2 WHEN temp > 25 THEN 1 ELSE 0 END + CASE WHEN w > 40 THEN 3 WHEN w > 30 THEN 2 WHEN w > 20 THEN 1 ELSE 0 END
  + CASE WHEN p > 80 OR mm > 10 THEN 3 WHEN p > 60 OR mm > 5 THEN 2 WHEN p > 40 OR mm > 2 THEN 1 ELSE 0 END"""
TRANSIT = "((p > 70 OR mm > 5) AND (temp < 5 OR w > 35)) OR (temp < 2 AND p > 50)"


@query("C14_severity", f"WITH x AS (SELECT event_id, temp_c AS temp, wind_speed_kph AS w, precipitation_prob AS p, precipitation_mm AS mm FROM weather), s AS (SELECT *, CAST({POINTS} AS INTEGER) AS points FROM x) SELECT event_id, points, CASE WHEN points = 0 THEN 'good' WHEN points <= 2 THEN 'fair' WHEN points <= 4 THEN 'poor' ELSE 'miserable' END AS severity, {TRANSIT} AS transit FROM s", "weather")
def c14(spark, d):
    x = [F.col(c) for c in ("temp_c", "wind_speed_kph", "precipitation_prob", "precipitation_mm")]
    points = scores.severity_points(*x)
    return t.weather(spark, d).select("event_id", points.alias("points"), scores.severity(points).alias("severity"), scores.needs_transit(*x).alias("transit"))


@query("C22_commute_week", f"""
WITH {DAILY}, x AS (SELECT date, 'to_work' AS direction, lo AS temp, w, p, mm, 480 AS middle, 450 AS early FROM daily UNION ALL SELECT date, 'to_home', hi, w, p, mm, 990, 945 FROM daily),
s AS (SELECT *, {POINTS} AS points, {TRANSIT} AS transit FROM x), r AS (SELECT *, CASE WHEN points = 0 THEN 'good' WHEN points <= 2 THEN 'fair' WHEN points <= 4 THEN 'poor' ELSE 'miserable' END AS severity FROM s),
d AS (SELECT date, bool_and(transit) AS both_transit, avg(CASE severity WHEN 'good' THEN 0 WHEN 'fair' THEN 1 WHEN 'poor' THEN 2 ELSE 3 END) AS m FROM r GROUP BY 1)
SELECT strftime(r.date, '%Y-%m-%d') AS date, direction, severity, transit, CAST(CASE WHEN p > 60 THEN early ELSE middle END AS INTEGER) AS departure,
  CASE WHEN both_transit THEN 'avoid' WHEN m = 0 THEN 'excellent' WHEN m <= 0.5 THEN 'good' WHEN m <= 1.5 THEN 'fair' WHEN m <= 2.5 THEN 'poor' ELSE 'avoid' END AS rating FROM r JOIN d ON r.date = d.date""", "weather")
def c22(spark, d):
    return forecast.commute_week(forecast.daily(t.weather(spark, d))).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("C15_wind_aware_pick", f"""WITH {IMPACT}, g AS (SELECT group_id, direction, count(*) AS uses, avg(head) AS head, avg(cross_kph) AS cross_kph FROM impact JOIN routes ON vec_id = activity_id GROUP BY 1, 2)
SELECT direction, arg_min(group_id, (round(head + 0.3e0 * cross_kph - 0.2e0 * uses, 9), group_id)) AS strong_wind, arg_max(group_id, (uses, group_id)) AS light_wind FROM g GROUP BY 1""", "points routes")
def c15(spark, d):
    from ..operators.ranking import group_wind

    g = group_wind(t.routes(spark, d), 25.0, 225.0)
    cost = F.round(F.col("head") + F.col("cross_kph") * 0.3 - F.col("uses") * 0.2, 9)
    return g.groupBy("direction").agg(F.min_by("group_id", F.struct(cost, "group_id")).alias("strong_wind"), F.max_by("group_id", F.struct("uses", "group_id")).alias("light_wind"))


@query("C10_workout_rides", """
WITH s AS (SELECT id, moving_time / 60e0 AS m, id % 7 AS uses FROM activities WHERE distance >= 15000), x AS (SELECT id, CASE WHEN abs(m - 90) <= 15 THEN 1 - abs(m - 90) / 15 * 0.3e0 ELSE greatest(0, 0.7e0 - (abs(m - 90) - 15) / 60) END * 0.5e0 + 1e0 / (uses + 1) * 0.3e0 + 1 * 0.2e0 AS score FROM s)
SELECT id, round(score, 6) AS score FROM x ORDER BY round(score, 6) DESC, id LIMIT 20""", "activities")
def c10(spark, d):
    rides = t.activities(spark, d).filter("distance >= 15000")
    score = scores.duration_fit(F.col("moving_time") / 60.0, F.lit(90.0)) * 0.5 + scores.variety(F.col("id") % 7) * 0.3 + 0.2
    return rides.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("C11_day_rides", f"""
WITH x AS (SELECT id, 0.5e0 * 0.5e0 + 1e0 / (id % 7 + 1) * 0.3e0 + coalesce(greatest(0, 1 - {HAV.replace('lat1', '4188e-2').replace('lon1', '-8763e-2').replace('lat2', 'start_lat').replace('lon2', 'start_lon')} / 16093.4e0), 1) * 0.2e0 AS score FROM activities WHERE distance >= 15000)
SELECT id, round(score, 6) AS score FROM x""", "activities")
def c11(spark, d):
    from ..functions.geo import haversine_m

    rides = t.activities(spark, d).filter("distance >= 15000")
    near = scores.proximity(haversine_m(F.lit(t.HOME[0]), F.lit(t.HOME[1]), F.col("start_lat"), F.col("start_lon")))
    return rides.select("id", F.round(0.25 + scores.variety(F.col("id") % 7) * 0.3 + near * 0.2, 6).alias("score"))


@query("C12_difficulty", """
WITH x AS (SELECT id, distance / 1000 AS km, moving_time / 3600e0 AS h FROM activities), s AS (SELECT *, least(1e0, CASE WHEN km < 30 THEN 0.2e0 WHEN km < 60 THEN 0.4e0 WHEN km < 100 THEN 0.6e0 ELSE 0.8e0 END + CASE WHEN h < 2 THEN 0.1e0 WHEN h < 4 THEN 0.2e0 WHEN h < 6 THEN 0.3e0 ELSE 0.4e0 END + CASE WHEN km / h >= 30 THEN 0.1e0 ELSE 0 END) AS score FROM x)
SELECT id, round(score, 6) AS score, CASE WHEN score < 0.3e0 THEN 'easy' WHEN score < 0.6e0 THEN 'moderate' WHEN score < 0.8e0 THEN 'hard' ELSE 'extreme' END AS level,
  CAST(1 + CASE WHEN score >= 0.8e0 THEN 1 ELSE 0 END + CASE WHEN h > 4 THEN 2 ELSE 0 END + CASE WHEN h > 6 THEN 1 ELSE 0 END + CASE WHEN km > 80 THEN 2 ELSE 0 END AS INTEGER) AS notes FROM s""", "activities")
def c12(spark, d):
    km, h = F.col("distance") / 1000, F.col("moving_time") / 3600.0
    score = scores.ride_difficulty(km, h)
    level = scores.difficulty_level(score)
    return t.activities(spark, d).select("id", F.round(score, 6).alias("score"), level.alias("level"), F.size(scores.ride_notes(level, km, h)).alias("notes"))


@query("C7_workout_fit", """
WITH w AS (SELECT activity_id, duration / 60e0 AS m, CASE activity_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 60 END AS lo, CASE activity_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 90 WHEN 2 THEN 30 END AS hi, activity_id % 3 = 0 AS indoors FROM routes)
SELECT activity_id, round(greatest(0e0, least(1e0, 0.5e0 + CASE WHEN lo IS NOT NULL AND m < lo THEN -0.3e0 WHEN hi IS NOT NULL AND m > hi THEN -0.2e0 ELSE 0.3e0 END + CASE WHEN indoors THEN -0.2e0 ELSE 0.2e0 END)), 6) AS fit,
  coalesce(lo IS NOT NULL AND m < lo AND NOT indoors, false) AS extend FROM w""", "routes")
def c7(spark, d):
    k = F.col("activity_id") % 4
    m, lo, hi, indoors = F.col("duration") / 60.0, F.when(k == 0, 30).when(k == 1, 60), F.when(k == 0, 60).when(k == 1, 90).when(k == 2, 30), F.col("activity_id") % 3 == 0
    return t.routes(spark, d).select("activity_id", F.round(scores.workout_fit(m, lo, hi, indoors), 6).alias("fit"), F.coalesce((m < lo) & ~indoors, F.lit(False)).alias("extend"))


CONDITIONS = "CASE code % 10 WHEN 0 THEN 'Thunderstorm' WHEN 1 THEN 'Heavy Rain' WHEN 2 THEN 'Light Drizzle' WHEN 3 THEN 'Snow' WHEN 4 THEN 'Overcast' WHEN 5 THEN 'Partly Cloudy' ELSE 'Clear' END"


def _conditions():
    k = F.col("code") % 10
    return F.when(k == 0, "Thunderstorm").when(k == 1, "Heavy Rain").when(k == 2, "Light Drizzle").when(k == 3, "Snow").when(k == 4, "Overcast").when(k == 5, "Partly Cloudy").otherwise("Clear")


@query("C17_C21_bands", f"""
WITH x AS (SELECT event_id, lower({CONDITIONS}) AS c, temp_c, temp_c * 9 / 5 + 32 AS f, CAST(floor(wind_speed_kph) AS INTEGER) AS w, precipitation_prob AS p, precipitation_mm AS mm FROM weather)
SELECT event_id, CASE WHEN mm > 5 THEN 'high' WHEN mm > 2 THEN 'medium' WHEN mm > 0 THEN 'low' ELSE 'none' END AS risk,
  CASE WHEN c LIKE '%thunder%' THEN 'Storm warning' WHEN c LIKE '%snow%' THEN 'Snowy' WHEN regexp_matches(c, 'rain|drizzle') THEN 'Rainy' WHEN w >= 20 THEN w || ' mph crosswind' WHEN w >= 12 THEN w || ' mph wind' WHEN w >= 5 THEN 'Light N wind' ELSE 'Clear' END AS note,
  CASE WHEN c LIKE '%thunder%' THEN 'miserable/Miserable' WHEN f >= 95 OR f <= 25 THEN 'miserable/Extreme Temp' WHEN w >= 25 THEN 'miserable/Very Windy' WHEN c LIKE '%heavy rain%' OR p >= 80 THEN 'miserable/Heavy Rain' WHEN regexp_matches(c, 'rain|drizzle') OR p >= 50 THEN 'poor/Rainy'
    WHEN f >= 85 THEN 'poor/Hot' WHEN f <= 35 THEN 'poor/Cold' WHEN w >= 15 THEN 'poor/Windy' WHEN c LIKE '%snow%' THEN 'poor/Snowy' WHEN regexp_matches(c, 'cloud|overcast') THEN 'fair/Cloudy' WHEN w >= 8 THEN 'fair/Breezy' WHEN f >= 75 OR f <= 45 THEN 'fair/Fair' ELSE 'good/Excellent' END AS banner,
  CASE WHEN temp_c < 0 OR temp_c > 32 OR w > 30 OR p >= 60 THEN '#dc3545' WHEN (temp_c < 8 AND temp_c <> 0) OR temp_c > 28 OR w > 20 OR p >= 30 THEN '#ffc107' ELSE '#28a745' END AS colour,
  c LIKE '%thunder%' OR c LIKE '%heavy rain%' OR temp_c < 10 AS transit FROM x""", "weather")
def c17(spark, d):
    w, f = F.floor("wind_speed_kph").cast("int"), F.col("temp_c") * 9 / 5 + 32
    comfort = F.when(F.col("temp_c") < 10, 0.3).otherwise(0.9)
    return t.weather(spark, d).select(
        "event_id", scores.precipitation_risk(F.col("precipitation_mm")).alias("risk"), scores.condition_note(_conditions(), w, F.lit("N")).alias("note"), scores.banner(f, w, _conditions(), F.col("precipitation_prob")).alias("banner"),
        scores.forecast_colour(F.col("temp_c"), w, F.col("precipitation_prob")).alias("colour"), scores.transit_reason(_conditions(), comfort, f, w, F.col("precipitation_mm")).isNotNull().alias("transit"),
    )


@query("C16_ride_wind_score", f"""
WITH e AS (SELECT a.vec_id, i, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM points a JOIN points b ON a.vec_id = b.vec_id, generate_series(0, 2) g(i) WHERE a.idx = i * 10 AND b.idx = least((i + 1) * 10, 31)),
s AS (SELECT vec_id, i, abs(((225 - {{b}} + 180) % 360 + 360) % 360 - 180) AS angle FROM e), k AS (SELECT vec_id, i, CASE WHEN angle < 45 THEN 0.3e0 WHEN angle > 135 THEN 1e0 WHEN angle < 90 THEN 0.5e0 ELSE 0.8e0 END AS score FROM s),
h AS (SELECT vec_id, avg(CASE WHEN i < 1 THEN score END) AS first_half, avg(CASE WHEN i >= 1 THEN score END) AS second_half FROM k GROUP BY 1)
SELECT vec_id, round(first_half, 6) AS first_half, round(second_half, 6) AS second_half, round(CASE WHEN round(second_half, 9) > 0.8e0 THEN least(1e0, (0.3e0 * first_half + 0.7e0 * second_half) * 1.1e0) ELSE 0.3e0 * first_half + 0.7e0 * second_half END, 6) AS score FROM h""".replace("{b}", __import__("spokeframe.plans.q_functions", fromlist=["BEARING"]).BEARING), "points")
def c16(spark, d):
    from ..operators.ranking import ride_wind

    return _rounded(ride_wind(t.tracks(spark, d), 225.0))


@query("W4_cumulative_midpoint", f"""
WITH {SEGMENTS}, st AS (SELECT vec_id, idx + 1 AS idx, {HAV} AS step FROM seg WHERE lat2 IS NOT NULL UNION ALL SELECT vec_id, 0, 0 FROM seg WHERE idx = 0), c AS (SELECT vec_id, idx, sum(step) OVER (PARTITION BY vec_id ORDER BY idx) AS cum, sum(step) OVER (PARTITION BY vec_id) AS total FROM st)
SELECT vec_id, CAST(min(idx) AS INTEGER) AS idx FROM c WHERE cum >= total / 2 GROUP BY 1""", "points")
def w4(spark, d):
    return cumulative_midpoint(t.points(spark, d), "vec_id")


@query("W5_A31_runs", """
WITH e AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events),
r AS (SELECT user_id, event_type, island, min(ts) AS first, count(*) AS points FROM e GROUP BY 1, 2, 3)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS run, event_type, points, round(100e0 * points / sum(points) OVER (PARTITION BY user_id), 6) AS pct FROM r""")
def w5(spark, d):
    found = runs(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return found.select("user_id", "run", "event_type", "points", F.round("pct", 6).alias("pct"))


@query("W6_turns", f"""
WITH a AS (SELECT p.vec_id, p.idx, p.lat AS lat1, p.lon AS lon1, b.lat AS lat0, b.lon AS lon0, c.lat AS lat2, c.lon AS lon2 FROM points p JOIN points b ON b.vec_id = p.vec_id AND b.idx = p.idx - 3 JOIN points c ON c.vec_id = p.vec_id AND c.idx = p.idx + 3 WHERE p.idx % 3 = 0 AND p.idx < 29),
g AS (SELECT vec_id, idx, abs({{after}} - {{before}}) AS turn FROM a) SELECT vec_id, idx FROM g WHERE least(turn, 360 - turn) >= 30""".replace("{after}", __import__("spokeframe.plans.q_functions", fromlist=["BEARING"]).BEARING).replace("{before}", __import__("spokeframe.plans.q_functions", fromlist=["BEARING"]).BEARING.replace("lat2", "lat9").replace("lon2", "lon9").replace("lat1", "lat0").replace("lon1", "lon0").replace("lat9", "lat1").replace("lon9", "lon1")), "points")
def w6(spark, d):
    from ..operators.ranking import turns

    return turns(t.tracks(spark, d), "vec_id")


@query("W7_ordinal_names", "SELECT group_id, activity_id, CASE WHEN k = 1 THEN group_id ELSE group_id || ' #' || k END AS name FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY activity_id) AS k FROM routes)", "routes")
def w7(spark, d):
    k = F.row_number().over(Window.partitionBy("group_id").orderBy("activity_id"))
    return t.routes(spark, d).withColumn("k", k).select("group_id", "activity_id", F.when(F.col("k") == 1, F.col("group_id")).otherwise(F.concat("group_id", F.lit(" #"), F.col("k").cast("string"))).alias("name"))


@query("A32_surface_mix", "WITH s AS (SELECT user_id, event_id % 7 AS value, event_id % 5 AS span FROM events) SELECT user_id, round_even(100e0 * sum(CASE WHEN value IN (1, 3, 4) THEN span ELSE 0 END) / nullif(sum(span), 0), 0) AS paved_pct, round_even(100e0 * sum(CASE WHEN value IN (2, 5) THEN span ELSE 0 END) / nullif(sum(span), 0), 0) AS unpaved_pct FROM s GROUP BY 1")
def a32(spark, d):
    value, span = F.col("event_id") % 7, F.col("event_id") % 5
    share = lambda codes: even(F.sum(F.when(value.isin(*codes), span).otherwise(0)) * 100.0 / F.nullif(F.sum(span), F.lit(0)))
    return table(spark, d, "events").groupBy("user_id").agg(share((1, 3, 4)).alias("paved_pct"), share((2, 5)).alias("unpaved_pct"))


@query("A35_best_values", "SELECT group_id, round(avg_duration, 6) = round(min(avg_duration) OVER (), 6) AS best_duration, uses = max(uses) OVER () AS best_uses FROM groups", "groups")
def a35(spark, d):
    g = _groups(spark, d)
    best = g.agg(F.min("avg_duration").alias("lo"), F.max("uses").alias("hi"))
    return g.join(F.broadcast(best)).select("group_id", (F.round("avg_duration", 6) == F.round("lo", 6)).alias("best_duration"), (F.col("uses") == F.col("hi")).alias("best_uses"))


@query("J13_J14_asof_weather", """
WITH p AS (SELECT event_id AS id, user_id, ts FROM events WHERE event_type = 'purchase'), w AS (SELECT event_id AS wid, user_id, ts AS wts FROM events WHERE event_type <> 'purchase'), c AS (SELECT id, max((wts, wid)) AS best, any_value(ts) AS ts FROM p JOIN w USING (user_id) WHERE wts <= ts GROUP BY 1)
SELECT p.id, CAST(best[2] AS BIGINT) AS weather_id, CASE WHEN best IS NULL THEN 'none' WHEN epoch(p.ts) - epoch(best[1]) < 7200 THEN 'fresh' WHEN epoch(p.ts) - epoch(best[1]) < 86400 THEN 'stale' ELSE 'expired' END AS age FROM p LEFT JOIN c ON c.id = p.id""")
def j13(spark, d):
    from ..operators.asof import asof_join

    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    asked, known = e.filter("event_type = 'purchase'"), e.filter("event_type <> 'purchase'").withColumnRenamed("event_id", "weather_id")
    found = asof_join(asked, known, "user_id", "ts", ["weather_id"])
    age = (F.unix_micros("ts") - F.unix_micros("found_ts")) / 3.6e9
    from ..functions.dates import staleness

    return found.select(F.col("event_id").alias("id"), "weather_id", F.when(F.col("weather_id").isNull(), "none").otherwise(staleness(age)).alias("age"))
