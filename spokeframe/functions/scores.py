"""Scoring models as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _first(*cases: tuple[Column, float], otherwise: float = 0.0) -> Column:
    """The value of the first case that holds."""
    out = F.when(cases[0][0], float(cases[0][1]))
    for condition, value in cases[1:]:
        out = out.when(condition, float(value))
    return out.otherwise(float(otherwise))


def _wind_penalty(kph: Column) -> Column:
    return _first((kph > 30, 0.3), (kph > 20, 0.15))


def comfort(temp_c: Column, wind_kph: Column, precip_mm: Column) -> Column:
    """Current weather, 0 to 1. Above 30 degrees costs 0.3, however hot it is."""
    heat = _first((temp_c < 0, 0.4), (temp_c < 10, 0.2), (temp_c > 30, 0.3))
    return clamp(1.0 - heat - _wind_penalty(wind_kph) - _first((precip_mm > 5, 0.4), (precip_mm > 0, 0.2)), 0.0, 1.0)


def comfort_daily(max_c: Column, min_c: Column, wind_kph: Column, precip_mm: Column) -> Column:
    """A day's weather from the mean of its extremes; above 35 degrees costs more."""
    temp = (F.coalesce(max_c, F.lit(20.0)) + F.coalesce(min_c, F.lit(15.0))) / 2
    heat = _first((temp < 0, 0.4), (temp < 10, 0.2), (temp > 35, 0.5), (temp > 30, 0.3))
    wind, rain = F.coalesce(wind_kph, F.lit(0.0)), F.coalesce(precip_mm, F.lit(0.0))
    return F.bround(clamp(1.0 - heat - _wind_penalty(wind) - _first((rain > 5, 0.4), (rain > 0, 0.2)), 0.0, 1.0), 2)


def comfort_planner(temp_c: Column, wind_kph: Column, precip_mm: Column) -> Column:
    """The planner's: warm from 25 degrees on, and three classes of rain; nulls cost nothing."""
    heat = _first((temp_c < 0, 0.4), (temp_c < 10, 0.2), (temp_c > 30, 0.3), (temp_c > 25, 0.1))
    return clamp(1.0 - heat - _wind_penalty(wind_kph) - _first((precip_mm > 5, 0.4), (precip_mm > 1, 0.3), (precip_mm > 0, 0.2)), 0.0, 1.0)


def favourability(score: Column) -> Column:
    return F.when(score >= 0.7, "favorable").when(score >= 0.4, "neutral").otherwise("unfavorable")


def severity_points(temp_c: Column, wind_kph: Column, precip_prob: Column, precip_mm: Column) -> Column:
    heat = _first((temp_c < 0, 3), (temp_c < 5, 2), (temp_c < 10, 1), (temp_c > 30, 2), (temp_c > 25, 1))
    wind = _first((wind_kph > 40, 3), (wind_kph > 30, 2), (wind_kph > 20, 1))
    rain = _first(((precip_prob > 80) | (precip_mm > 10), 3), ((precip_prob > 60) | (precip_mm > 5), 2), ((precip_prob > 40) | (precip_mm > 2), 1))
    return (heat + wind + rain).cast("int")


def severity(points: Column) -> Column:
    return F.when(points == 0, "good").when(points <= 2, "fair").when(points <= 4, "poor").otherwise("miserable")


def day_rating(morning: Column, evening: Column, both_transit: Column) -> Column:
    """From the two commutes' severities."""
    points = lambda s: F.when(s == "good", 0).when(s == "fair", 1).when(s == "miserable", 3).otherwise(2)
    mean = (points(morning) + points(evening)) / 2
    return F.when(both_transit, "avoid").when(mean == 0, "excellent").when(mean <= 0.5, "good").when(mean <= 1.5, "fair").when(mean <= 2.5, "poor").otherwise("avoid")


def weather_score(head_kph: Column, cross_kph: Column) -> Column:
    """0 to 100: 50 without wind; up to 40 for tail or against head wind, up to 10 against cross wind; 50 where wind is unknown."""
    along = F.when(head_kph < 0, F.least(F.lit(40.0), -head_kph * 2)).otherwise(-F.least(F.lit(40.0), head_kph * 2))
    score = clamp(along + 50.0 - F.least(F.lit(10.0), cross_kph * 0.5), 0.0, 100.0)
    return F.when(head_kph.isNull(), 50.0).otherwise(score)


def falling(x: Column, low: Column, high: Column) -> Column:
    """100 at the lowest value and 0 at the highest; 100 where all are equal."""
    return F.when(high == low, 100.0).otherwise((1.0 - (x - low) / F.nullif(high - low, F.lit(0.0))) * 100.0)


def time_score(duration: Column, low: Column, high: Column, consistency: Column) -> Column:
    return F.least(F.lit(100.0), falling(duration, low, high) + consistency * 10.0)


def safety_score(uses: Column, most_uses: Column, elevation: Column, consistency: Column) -> Column:
    known = F.when(most_uses > 0, uses / F.nullif(most_uses, F.lit(0)) * 100.0).otherwise(100.0)
    return known * 0.4 + (100.0 - F.least(F.lit(50.0), elevation / 10)) * 0.3 + consistency * 100.0 * 0.3


def duration_fit(minutes: Column, target: Column) -> Column:
    """1 at the target, 0.7 at 15 minutes from it, then falling to 0 in 42 minutes; 1 without a target."""
    off = F.abs(minutes - target)
    fit = F.when(off <= 15, 1.0 - off / 15 * 0.3).otherwise(F.greatest(F.lit(0.0), 0.7 - (off - 15) / 60))
    return F.when(target.isNull() | (target == 0), 1.0).otherwise(fit)


def variety(uses: Column) -> Column:
    return 1.0 / (uses + 1)


def proximity(metres: Column, reach_m: float = 16093.4) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - metres / reach_m), F.lit(1.0))


def ride_difficulty(km: Column, hours: Column) -> Column:
    """Score 0 to 1 from distance, duration and speed."""
    speed = F.when(hours > 0, km / F.nullif(hours, F.lit(0.0))).otherwise(0.0)
    by_km = _first((km < 30, 0.2), (km < 60, 0.4), (km < 100, 0.6), otherwise=0.8)
    by_hours = _first((hours < 2, 0.1), (hours < 4, 0.2), (hours < 6, 0.3), otherwise=0.4)
    return F.least(F.lit(1.0), by_km + by_hours + F.when(speed >= 30, 0.1).otherwise(0.0))


def difficulty_level(score: Column) -> Column:
    return F.when(score < 0.3, "easy").when(score < 0.6, "moderate").when(score < 0.8, "hard").otherwise("extreme")


def workout_fit(minutes: Column, low: Column, high: Column, indoors: Column) -> Column:
    length = F.when(low.isNotNull() & (low != 0) & (minutes < low), -0.3).when(high.isNotNull() & (high != 0) & (minutes > high), -0.2).otherwise(0.3)
    return clamp(0.5 + length + F.when(indoors, -0.2).otherwise(0.2), 0.0, 1.0)


def precipitation_risk(mm: Column) -> Column:
    return F.when(mm > 5, "high").when(mm > 2, "medium").when(mm > 0, "low").otherwise("none")


def needs_transit(temp_c: Column, wind_kph: Column, precip_prob: Column, precip_mm: Column) -> Column:
    """Wet and cold, wet and very windy, or freezing rain."""
    wet = (precip_prob > 70) | (precip_mm > 5)
    return (wet & ((temp_c < 5) | (wind_kph > 35))) | ((temp_c < 2) & (precip_prob > 50))


def condition_note(conditions: Column, wind: Column, wind_from: Column) -> Column:
    text = F.lower(conditions)
    return (
        F.when(text.rlike("thunder|storm"), "Storm warning")
        .when(text.contains("snow"), "Snowy")
        .when(text.rlike("rain|drizzle"), "Rainy")
        .when(wind >= 20, F.concat(wind.cast("string"), F.lit(" mph crosswind")))
        .when(wind >= 12, F.concat(wind.cast("string"), F.lit(" mph wind")))
        .when(wind >= 5, F.concat(F.lit("Light "), wind_from, F.lit(" wind")))
        .otherwise("Clear")
    )


def banner(temp_f: Column, wind: Column, conditions: Column, precip_prob: Column) -> Column:
    """Level and label, as level/label; the first rule that holds."""
    text = F.lower(F.coalesce(conditions, F.lit("")))
    temp = F.when((temp_f != 0), temp_f).otherwise(70.0)
    return (
        F.when(text.rlike("thunder|storm"), "miserable/Miserable")
        .when((temp >= 95) | (temp <= 25), "miserable/Extreme Temp")
        .when(wind >= 25, "miserable/Very Windy")
        .when(text.contains("heavy rain") | (precip_prob >= 80), "miserable/Heavy Rain")
        .when(text.rlike("rain|drizzle") | (precip_prob >= 50), "poor/Rainy")
        .when(temp >= 85, "poor/Hot")
        .when(temp <= 35, "poor/Cold")
        .when(wind >= 15, "poor/Windy")
        .when(text.contains("snow"), "poor/Snowy")
        .when(text.rlike("cloud|overcast"), "fair/Cloudy")
        .when(wind >= 8, "fair/Breezy")
        .when((temp >= 75) | (temp <= 45), "fair/Fair")
        .otherwise("good/Excellent")
    )


def transit_reason(conditions: Column, comfort_score: Column, temp_f: Column, wind: Column, precip_mm: Column) -> Column:
    """Why transit is suggested; null where it is not."""
    text = F.lower(F.coalesce(conditions, F.lit("")))
    poor = (
        F.when(text.rlike("rain|drizzle") | (precip_mm > 2), "Rainy conditions — consider public transit or waiting for a dry window")
        .when(text.contains("snow"), "Snowy conditions — transit may be safer")
        .when(temp_f <= 25, F.format_string("Very cold (%.0f°F) — transit recommended", F.bround(temp_f, 0)))
        .when(temp_f >= 95, F.format_string("Extreme heat (%.0f°F) — consider transit", F.bround(temp_f, 0)))
        .when(wind >= 25, F.format_string("Very strong winds (%.0f mph) — transit recommended", F.bround(wind, 0)))
        .otherwise("Poor cycling conditions today — transit is a good alternative")
    )
    return (
        F.when(text.rlike("thunder|storm"), "Dangerous conditions — thunderstorm or severe weather")
        .when(text.rlike("heavy rain|heavy snow|blizzard"), "Heavy precipitation — cycling not advised")
        .when(comfort_score < 0.4, poor)
    )


def status_band(score: Column) -> Column:
    return F.when(score >= 0.7, "Favorable").when(score >= 0.5, "Acceptable").otherwise("Unfavorable")


def forecast_colour(temp_c: Column, wind_kph: Column, precip_prob: Column) -> Column:
    temp = F.when(temp_c != 0, temp_c).otherwise(20.0)
    bad = (temp < 0) | (temp > 32) | (wind_kph > 30) | (precip_prob >= 60)
    fair = (temp < 8) | (temp > 28) | (wind_kph > 20) | (precip_prob >= 30)
    return F.when(bad, "#dc3545").when(fair, "#ffc107").otherwise("#28a745")


def ride_notes(level: Column, km: Column, hours: Column) -> Column:
    """What to bring and plan for, from difficulty, duration and distance."""
    demanding = level == "extreme"
    return F.array_compact(F.array(
        F.when(level == "easy", "Good opportunity for recovery or social ride"),
        F.when(level == "moderate", "Standard long ride - maintain steady endurance pace"),
        F.when(level == "hard", "Challenging ride - ensure proper nutrition and hydration"),
        F.when(demanding, "Very demanding ride - consider breaking into segments"),
        F.when(demanding, "Plan multiple rest stops and carry extra supplies"),
        F.when(hours > 4, "Bring sufficient food and water for extended ride"),
        F.when(hours > 4, "Plan rest stops every 60-90 minutes"),
        F.when(hours > 6, "Consider starting early to avoid afternoon heat/traffic"),
        F.when(km > 80, "Verify bike is in excellent mechanical condition"),
        F.when(km > 80, "Carry spare tube, pump, and basic tools"),
    ))


def recommendation_reason(time: Column, distance: Column, safety: Column, weather: Column) -> Column:
    good = F.array_compact(F.array(
        F.when(time > 80, "fastest route"), F.when(distance > 80, "shortest distance"),
        F.when(safety > 80, "most familiar and safe"), F.when(weather > 70, "favorable wind conditions"),
    ))
    note = F.when(weather < 30, F.when(F.size(good) > 0, "but note: strong headwinds expected").otherwise("best option despite headwinds"))
    reasons = F.array_compact(F.concat(good, F.array(note)))
    return F.concat(F.lit("Recommended as "), F.when(F.size(reasons) > 0, F.array_join(reasons, " and ")).otherwise("best overall balance"))
