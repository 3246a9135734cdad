"""Planned workouts: what they ask of a ride, whether to stay indoors, and which ride of a day fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from .naming import SUFFIX

# Limits in minutes by type, sentences, and types that no ride is extended for.
DEFAULT_MINUTES, RECOVERY_MINUTES, HIGH_LOAD = 60, 45, 100
LONGER = {"Endurance": 30, "Group Ride": 60}
INTENSITY = {"Endurance": "low", "Threshold": "high", "VO2Max": "high", "Group Ride": "moderate", "Recovery": "very_low"}
NOTES = {
    "Endurance": "Can extend commute for endurance work",
    "Threshold": "High-intensity workout - consider indoor trainer",
    "VO2Max": "High-intensity workout - consider indoor trainer",
    "Group Ride": "Group ride — match to historical day-of-week pattern",
    "Recovery": "Keep it easy for recovery",
}
NEVER_EXTENDED = ("VO2Max", "Sprint", "Anaerobic")


def _by_type(kind: Column, values: dict) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def first_of_day(workouts: DataFrame, order: str) -> DataFrame:
    """Each day's workout that comes first in the order."""
    rest = [c for c in workouts.columns if c != "day"]
    first = workouts.groupBy("day").agg(F.min_by(F.struct(*rest), order).alias("w"))
    return first.select("day", "w.*")


def constraints(workouts: DataFrame) -> DataFrame:
    """workouts: workout_type, duration_minutes, tss. Adds min_minutes, max_minutes, intensity, indoor_preferred, notes."""
    kind = F.col("workout_type")
    minutes = F.coalesce(F.nullif("duration_minutes", F.lit(0)), F.lit(DEFAULT_MINUTES))
    least = F.when(kind.isin(*LONGER), minutes)
    most = F.coalesce(least + _by_type(kind, LONGER), F.when(kind == "Recovery", RECOVERY_MINUTES))
    load = F.when(F.col("tss") > HIGH_LOAD, F.concat(F.lit("High training load (TSS: "), F.col("tss").cast("string"), F.lit(")")))
    return workouts.withColumns({
        "min_minutes": least.cast("long"), "max_minutes": most.cast("long"), "intensity": _by_type(kind, INTENSITY),
        "indoor_preferred": F.coalesce(kind.isin("Threshold", "VO2Max"), F.lit(False)),
        "notes": F.array_compact(F.array(_by_type(kind, NOTES), load)),
    })


def indoor_decision(indoor_preferred: Column, temp_f: Column, precip_mm: Column, min_temp_f: int = 40, allow_rain: bool = False) -> Column:
    """indoors, reason, note. Weather decides where a temperature is known, otherwise the type of the workout."""
    known = temp_f.isNotNull()
    cold, rain = F.coalesce(temp_f < min_temp_f, F.lit(False)), F.coalesce(precip_mm > 0, F.lit(False))
    wet = known & rain & ~F.lit(allow_rain)
    degrees = F.concat(F.bround(temp_f, 0).cast("int").cast("string"), F.lit("°F"))
    low = F.when(cold, F.concat(degrees, F.lit(f" is below your {min_temp_f}°F minimum")))
    reason = F.when(cold | wet, F.concat_ws(" and ", low, F.when(wet, "precipitation detected")))
    fine = F.concat(F.lit("Weather is suitable for outdoor riding ("), degrees, F.lit(", "), F.when(rain, "light rain").otherwise("dry"), F.lit(")"))
    note = F.when(reason.isNotNull(), F.concat(F.lit("Indoor recommended: "), reason)).when(indoor_preferred & known, fine)
    return F.struct(F.when(known, cold | wet).otherwise(indoor_preferred).alias("indoors"), reason.alias("reason"), note.alias("note"))


def extended(kind: Column, minutes: Column, least: Column, indoors: Column) -> Column:
    """Whether a longer route is to be sought: the ride is short of the workout, which is to be ridden outdoors."""
    return F.coalesce(~F.coalesce(kind.isin(*NEVER_EXTENDED), F.lit(False)) & ~indoors & (least > 0) & (minutes < least), F.lit(False))


def asked_minutes(days: DataFrame, minutes: Column) -> Column:
    """The different whole numbers of minutes that days ask for; workouts last a day at most, so there are 1,440 of them unless the data are broken."""
    found = [r[0] for r in days.select(minutes).distinct().collect() if r[0] is not None]
    return F.array(*[F.lit(m).cast("long") for m in sorted(found)]) if found else F.array().cast("array<long>")


def choose_routes(days: DataFrame, routes: DataFrame) -> DataFrame:
    """The route of each day and direction: the best one, or where that is to be extended the best of those that last long enough.

    days: day, workout_type, min_minutes, max_minutes, indoors. routes: direction, group_id, place, minutes. Routes meet each asked number of minutes
    once, not each day.
    """
    best = routes.groupBy("direction").agg(F.min_by(F.struct("group_id", "minutes"), "place").alias("base"))
    fits = F.filter(asked_minutes(days, F.col("min_minutes")), lambda m: m <= F.col("minutes"))
    long = routes.withColumn("min_minutes", F.explode(fits)).groupBy("direction", "min_minutes").agg(F.min_by(F.struct("group_id", "minutes"), "place").alias("long"))
    ways = days.withColumn("direction", F.explode(F.array(*[F.lit(w) for w in SUFFIX])))
    both = ways.join(best, "direction").join(long, ["direction", "min_minutes"], "left")
    more = extended(F.col("workout_type"), F.col("base.minutes"), F.col("min_minutes"), F.col("indoors")) & F.col("long").isNotNull()
    chosen = F.when(more, F.col("long")).otherwise(F.col("base"))
    fit = scores.workout_fit(F.col("chosen.minutes"), F.col("min_minutes"), F.col("max_minutes"), F.col("indoors"))
    return both.withColumn("is_extended", more).withColumn("chosen", chosen).select("day", "direction", "chosen.group_id", "chosen.minutes", "is_extended", fit.alias("fit"))


def best_rides(days: DataFrame, rides: DataFrame) -> DataFrame:
    """Of each day that is to be ridden outdoors, the ride that fits its minutes best. rides: id, minutes, uses, near (from 0 to 1)."""
    asked = asked_minutes(days.filter("not indoors"), F.coalesce("min_minutes", F.lit(0)))
    fit = F.when(F.col("asked") > 0, scores.duration_fit(F.col("minutes"), F.col("asked").cast("double"))).otherwise(1.0)
    score = F.round(fit * 0.5 + scores.variety(F.col("uses")) * 0.3 + F.col("near") * 0.2, 6)
    best = rides.withColumn("asked", F.explode(asked)).groupBy("asked").agg(F.max_by(F.struct("id", "minutes", score.alias("score")), F.struct(score, -F.col("id"))).alias("best"))
    return days.filter("not indoors").join(best, F.coalesce("min_minutes", F.lit(0)) == F.col("asked")).select("day", "best.id", "best.minutes", "best.score")


def options(days: DataFrame, commutes: DataFrame, rides: DataFrame, groups: DataFrame) -> DataFrame:
    """day, option, choice, minutes, score: what can be done for each day's workout: the commute, a ride, a group ride, or indoors.

    commutes: as choose_routes gives, of one direction. rides: as best_rides gives. groups: weekday (0 is Sunday), name, frequency, minutes.
    """
    row = lambda df, option, choice, minutes, score: df.select("day", F.lit(option).alias("option"), choice.cast("string").alias("choice"), minutes.cast("double").alias("minutes"), score.cast("double").alias("score"))
    c = F.col
    together = days.filter("workout_type = 'Group Ride'").withColumn("weekday", F.dayofweek("day") - 1)
    often = groups.join(together.select("day", "weekday", F.coalesce("min_minutes", F.lit(30)).alias("least")), "weekday").filter(c("minutes") >= c("least"))
    often = often.groupBy("day").agg(F.max_by(F.struct("name", "minutes", "frequency"), F.struct("frequency", "name")).alias("g")).select("day", "g.*")
    parts = [row(commutes, "commute", c("group_id"), c("minutes"), c("fit")), row(rides, "workout_ride", c("id"), c("minutes"), c("score")), row(often, "group_ride", c("name"), c("minutes"), c("frequency")), row(days, "indoor", F.lit("Full workout as prescribed"), c("min_minutes"), F.lit(None))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
