"""Queries of planned workouts, of the decision what to analyse again, and of small texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import grouping, rollups, workouts
from ..operators.ranking import rank_routes
from ..registry import query
from ..sources import testdata as t
from .q_scores import SCORES

CONSTRAINTS = """
asked AS (SELECT *, CASE WHEN workout_type IN ('Endurance', 'Group Ride') THEN coalesce(nullif(duration_minutes, 0), 60) END AS min_minutes FROM workouts),
constraints AS (SELECT *, CASE workout_type WHEN 'Endurance' THEN min_minutes + 30 WHEN 'Group Ride' THEN min_minutes + 60 WHEN 'Recovery' THEN 45 END AS max_minutes,
  CASE workout_type WHEN 'Endurance' THEN 'low' WHEN 'Threshold' THEN 'high' WHEN 'VO2Max' THEN 'high' WHEN 'Group Ride' THEN 'moderate' WHEN 'Recovery' THEN 'very_low' END AS intensity,
  coalesce(workout_type IN ('Threshold', 'VO2Max'), false) AS indoor_preferred FROM asked)"""
INDOORS = """
weighed AS (SELECT *, temp_f < 40 AS cold, precip_mm > 0 AS wet, CASE WHEN temp_f IS NULL THEN indoor_preferred ELSE temp_f < 40 OR precip_mm > 0 END AS indoors FROM constraints)"""
FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY id) AS k FROM weighed) WHERE k = 1)"
CHOSEN = f"""{SCORES}, ranked AS (SELECT c.direction, c.group_id, row_number() OVER (PARTITION BY c.direction ORDER BY score DESC, c.group_id) AS place, round(avg_duration / 60, 6) AS minutes FROM c JOIN groups g ON g.group_id = c.group_id),
{CONSTRAINTS}, {INDOORS}, {FIRST},
long AS (SELECT f.day, r.direction, arg_min(r.group_id, r.place) AS group_id, arg_min(r.minutes, r.place) AS minutes FROM firsts f JOIN ranked r ON r.minutes >= f.min_minutes GROUP BY 1, 2),
base AS (SELECT * FROM ranked WHERE place = 1),
chosen AS (SELECT f.day, b.direction, f.min_minutes, f.max_minutes, f.indoors,
    coalesce(coalesce(workout_type NOT IN ('VO2Max', 'Sprint', 'Anaerobic'), true) AND NOT indoors AND min_minutes > 0 AND b.minutes < min_minutes AND l.day IS NOT NULL, false) AS is_extended,
    b.group_id AS base_id, b.minutes AS base_minutes, l.group_id AS long_id, l.minutes AS long_minutes
  FROM firsts f CROSS JOIN base b LEFT JOIN long l ON l.day = f.day AND l.direction = b.direction),
picked AS (SELECT day, direction, CASE WHEN is_extended THEN long_id ELSE base_id END AS group_id, CASE WHEN is_extended THEN long_minutes ELSE base_minutes END AS minutes, is_extended, min_minutes, max_minutes, indoors FROM chosen),
fitted AS (SELECT day, direction, group_id, minutes, is_extended, round(greatest(0e0, least(1e0, 0.5e0 + CASE WHEN min_minutes IS NOT NULL AND minutes < min_minutes THEN -0.3e0 WHEN max_minutes IS NOT NULL AND minutes > max_minutes THEN -0.2e0 ELSE 0.3e0 END + CASE WHEN indoors THEN -0.2e0 ELSE 0.2e0 END)), 6) AS fit FROM picked)"""
RIDES = f"""{CHOSEN}, rides AS (SELECT id, moving_time / 60e0 AS minutes, id % 7 AS uses FROM activities WHERE distance >= 15000),
wanted AS (SELECT DISTINCT coalesce(min_minutes, 0) AS asked FROM firsts WHERE NOT indoors),
tried AS (SELECT asked, id, minutes, round(CASE WHEN asked = 0 THEN 1e0 WHEN abs(minutes - asked) <= 15 THEN 1 - abs(minutes - asked) / 15 * 0.3e0 ELSE greatest(0, 0.7e0 - (abs(minutes - asked) - 15) / 60) END * 0.5e0 + 1e0 / (uses + 1) * 0.3e0 + 1e0 * 0.2e0, 6) AS score FROM rides CROSS JOIN wanted),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, id) AS k FROM tried) WHERE k = 1)"""


def _days(spark, d):
    w = workouts.constraints(t.workouts(spark, d))
    w = w.withColumn("decision", workouts.indoor_decision(F.col("indoor_preferred"), F.col("temp_f"), F.col("precip_mm")))
    return workouts.first_of_day(w.withColumn("indoors", F.col("decision.indoors")), "id")


def _routes(spark, d):
    r = t.routes(spark, d)
    minutes = rollups.group_metrics(r).select("group_id", F.round(F.col("avg_duration") / 60, 6).alias("minutes"))
    return rank_routes(r, 25.0, 225.0, by="direction").select("direction", "group_id", "place").join(minutes, "group_id")


@query("J16_first_workout_of_a_date", "SELECT strftime(day, '%Y-%m-%d') AS day, min(id) AS id, count(*) AS workouts FROM workouts GROUP BY 1", "workouts")
def j16(spark, d):
    """Which workout of a date counts."""
    w = t.workouts(spark, d)
    first = workouts.first_of_day(w, "id").select("day", "id")
    return first.join(w.groupBy("day").agg(F.count("*").alias("workouts")), "day").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "id", "workouts")


@query("C9_workout_constraints", f"""WITH {CONSTRAINTS.strip()} SELECT id, min_minutes, max_minutes, intensity, indoor_preferred, array_to_string(list_filter([CASE workout_type WHEN 'Endurance' THEN 'Can extend commute for endurance work' WHEN 'Threshold' THEN 'High-intensity workout - consider indoor trainer' WHEN 'VO2Max' THEN 'High-intensity workout - consider indoor trainer'
  WHEN 'Group Ride' THEN 'Group ride — match to historical day-of-week pattern' WHEN 'Recovery' THEN 'Keep it easy for recovery' END, CASE WHEN tss > 100 THEN 'High training load (TSS: ' || tss || ')' END], lambda x: x IS NOT NULL), '; ') AS notes FROM constraints""", "workouts")
def c9(spark, d):
    w = workouts.constraints(t.workouts(spark, d))
    return w.select("id", "min_minutes", "max_minutes", "intensity", "indoor_preferred", F.array_join("notes", "; ").alias("notes"))


@query("C8_indoor_decision", f"""WITH {CONSTRAINTS.strip()}, {INDOORS}, r AS (SELECT *, nullif(concat_ws(' and ', CASE WHEN cold THEN CAST(round_even(temp_f, 0) AS INTEGER) || '°F is below your 40°F minimum' END, CASE WHEN wet AND temp_f IS NOT NULL THEN 'precipitation detected' END), '') AS reason FROM weighed)
SELECT id, indoors, reason, CASE WHEN reason IS NOT NULL THEN 'Indoor recommended: ' || reason WHEN indoor_preferred AND temp_f IS NOT NULL THEN 'Weather is suitable for outdoor riding (' || CAST(round_even(temp_f, 0) AS INTEGER) || '°F, dry)' END AS note FROM r""", "workouts")
def c8(spark, d):
    w = workouts.constraints(t.workouts(spark, d))
    found = workouts.indoor_decision(F.col("indoor_preferred"), F.col("temp_f"), F.col("precip_mm"))
    return w.select("id", found.alias("x")).select("id", "x.indoors", "x.reason", "x.note")


@query("C7_workout_routes", f"WITH {CHOSEN} SELECT strftime(day, '%Y-%m-%d') AS day, direction, group_id, minutes, is_extended, fit FROM fitted", "points groups workouts")
def c7_routes(spark, d):
    """The route of each day's first workout, extended to one that lasts long enough where it falls short."""
    chosen = workouts.choose_routes(_days(spark, d), _routes(spark, d))
    return chosen.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("fit", F.round("fit", 6))


@query("C23_workout_options", f"""WITH {RIDES}, patterns AS (SELECT dayofweek(start_local) AS weekday, name, count(*) AS frequency, round(avg(moving_time) / 60, 6) AS minutes FROM activities WHERE type = 'Ride' AND name IS NOT NULL AND start_local IS NOT NULL GROUP BY 1, 2),
often AS (SELECT f.day, p.name, p.minutes, p.frequency, row_number() OVER (PARTITION BY f.day ORDER BY p.frequency DESC, p.name DESC) AS k FROM firsts f JOIN patterns p ON p.weekday = dayofweek(f.day) AND p.minutes >= coalesce(f.min_minutes, 30) WHERE f.workout_type = 'Group Ride'),
o AS (SELECT day, 'commute' AS option, group_id AS choice, minutes, CAST(fit AS DOUBLE) AS score FROM fitted WHERE direction = 'home_to_work'
UNION ALL SELECT f.day, 'workout_ride', CAST(b.id AS VARCHAR), b.minutes, b.score FROM firsts f JOIN best b ON b.asked = coalesce(f.min_minutes, 0) WHERE NOT f.indoors
UNION ALL SELECT day, 'group_ride', name, minutes, CAST(frequency AS DOUBLE) FROM often WHERE k = 1
UNION ALL SELECT day, 'indoor', 'Full workout as prescribed', CAST(min_minutes AS DOUBLE), NULL FROM firsts)
SELECT strftime(day, '%Y-%m-%d') AS day, option, choice, round(minutes, 6) AS minutes, score FROM o""", "points groups workouts activities")
def c23(spark, d):
    days = _days(spark, d)
    commutes = workouts.choose_routes(days, _routes(spark, d)).filter("direction = 'home_to_work'").withColumn("fit", F.round("fit", 6))
    a = t.activities(spark, d)
    rides = workouts.best_rides(days, a.filter("distance >= 15000").select("id", (F.col("moving_time") / 60.0).alias("minutes"), (F.col("id") % 7).alias("uses"), F.lit(1.0).alias("near")))
    patterns = a.filter("type = 'Ride' and name is not null and start_local is not null").groupBy((F.dayofweek("start_local") - 1).alias("weekday"), "name").agg(F.count("*").alias("frequency"), F.round(F.avg("moving_time") / 60, 6).alias("minutes"))
    found = workouts.options(days, commutes, rides, patterns)
    return found.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("minutes", F.round("minutes", 6))


@query("T1_what_to_analyse", """
WITH o AS (SELECT activity_id AS id FROM routes WHERE activity_id % 5 <> 0), n AS (SELECT activity_id AS id FROM routes WHERE activity_id % 7 <> 0), c AS (SELECT count(*) FILTER (o.id IS NULL) AS new, count(*) FILTER (n.id IS NULL) AS removed, count(o.id) AS before FROM o FULL JOIN n ON o.id = n.id)
SELECT new, removed, CASE WHEN removed > 0 THEN 'full' WHEN new > 0 THEN 'incremental' ELSE 'hit' END AS analysis, round_even(100e0 * removed / greatest(before, 1), 0) AS removed_pct, 100e0 * removed / greatest(before, 1) >= 10 AS warn FROM c""", "routes")
def t1(spark, d):
    ids = t.routes(spark, d).select("activity_id")
    return grouping.what_to_analyse(ids.filter("activity_id % 5 <> 0"), ids.filter("activity_id % 7 <> 0"), "activity_id")


@query("F14_wind_text", """
WITH x AS (SELECT event_id, wind_speed_kph AS w, precipitation_prob / 101 AS a, wind_direction_deg / 360 AS b FROM weather)
SELECT event_id, CASE WHEN w < 10 THEN 'Light winds - minimal impact on ride' WHEN b > 0.8e0 AND a < 0.5e0 THEN 'Excellent! Headwind out, strong tailwind back - perfect for a long ride' WHEN b > 0.8e0 THEN 'Great tailwinds for the return journey'
  WHEN b > 0.6e0 THEN 'Favorable winds on the way back' WHEN b < 0.4e0 THEN 'Challenging headwinds on return - consider shorter route or different day' ELSE 'Mixed wind conditions - manageable but not ideal' END AS advice FROM x""", "weather")
def f14(spark, d):
    w = t.weather(spark, d)
    return w.select("event_id", text.wind_advice(F.col("precipitation_prob") / 101.0, F.col("wind_direction_deg") / 360.0, F.col("wind_speed_kph")).alias("advice"))
