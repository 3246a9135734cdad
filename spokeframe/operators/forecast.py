"""Forecast windows and days: summaries of hourly rows, and the week of commutes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, scores, wind
from ..functions.units import even


def window_summary(hourly: DataFrame) -> DataFrame:
    """A row for each day's morning (7 to 8) and evening (15 to 17): means, the wind's commonest direction and the best hour to leave."""
    hour = F.hour("ts")
    part = F.when(hour.between(7, 8), "morning").when(hour.between(15, 17), "evening")
    h = hourly.select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), part.alias("part"), "event_id", "ts", "wind_direction_deg", F.col("precipitation_prob").alias("p"),
        even(F.col("temp_c") * 9 / 5 + 32).alias("f"), even(F.col("wind_speed_kph") * 0.621371).alias("mph"), wind.compass_even(F.col("wind_direction_deg")).alias("way"),
    ).filter("part is not null")
    by_way = h.groupBy("day", "part", "way").agg(
        F.count("*").alias("n"), F.sum("f").alias("f"), F.sum("mph").alias("mph"), F.max("p").alias("p"), F.sum("wind_direction_deg").alias("deg"),
        F.min(F.struct((F.col("p") * 2 + F.col("mph")).alias("cost"), "event_id", "ts")).alias("best"),
    )
    n = F.sum("n")
    return by_way.groupBy("day", "part").agg(
        even(F.sum("f") / n).alias("avg_temp_f"), even(F.sum("mph") / n).alias("avg_wind_mph"), F.max("p").alias("max_precip_prob"),
        F.min(F.struct(-F.col("n"), "way"))["way"].alias("dominant_wind"), F.date_format(F.min("best")["ts"], "HH:mm").alias("optimal_departure"),
        F.round(F.sum("deg") / n, 6).alias("mean_direction"),
    )


def daily(hourly: DataFrame) -> DataFrame:
    """date, temp_max_c, temp_min_c, wind_speed_max_kph, precipitation_sum_mm, precipitation_prob_max."""
    return hourly.groupBy(F.to_date("ts").alias("date")).agg(
        F.max("temp_c").alias("temp_max_c"), F.min("temp_c").alias("temp_min_c"), F.max("wind_speed_kph").alias("wind_speed_max_kph"),
        F.sum("precipitation_mm").alias("precipitation_sum_mm"), F.max("precipitation_prob").alias("precipitation_prob_max"), F.avg("wind_direction_deg").alias("wind_direction_deg"),
    )


def commute_week(days: DataFrame) -> DataFrame:
    """Two rows a day: severity, transit advice and departure; and the day's rating from both."""
    t, w, p, mm = (F.col(c) for c in ("temp", "wind", "prob", "mm"))
    both = days.select("date", F.explode(F.array(
        F.struct(F.lit("to_work").alias("direction"), F.lit(420).alias("start"), F.lit(540).alias("end"), F.col("temp_min_c").alias("temp")),
        F.struct(F.lit("to_home").alias("direction"), F.lit(900).alias("start"), F.lit(1080).alias("end"), F.col("temp_max_c").alias("temp")),
    )).alias("c"), F.col("wind_speed_max_kph").alias("wind"), F.col("precipitation_prob_max").alias("prob"), F.col("precipitation_sum_mm").alias("mm")).select("date", "c.*", "wind", "prob", "mm")
    points = scores.severity_points(t, w, p, mm)
    rated = both.select("date", "direction", scores.severity(points).alias("severity"), scores.needs_transit(t, w, p, mm).alias("transit"), dates.departure_minute(F.col("start"), F.col("end"), p).alias("departure"))
    own = lambda way, c: F.max(F.when(F.col("direction") == way, F.col(c)))
    day = rated.groupBy(F.col("date").alias("of")).agg(scores.day_rating(own("to_work", "severity"), own("to_home", "severity"), F.min("transit")).alias("rating"))
    return rated.join(day, rated["date"] == day["of"]).drop("of")
