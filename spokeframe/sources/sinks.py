"""Writing results: tables, documents, CSV and GPX. Spark's commit protocol makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_HEADER = ("Route ID", "Direction", "Score", "Frequency", "Avg Duration (min)", "Avg Distance", "Avg Speed", "Weather Score", "Safety Score", "Efficiency Score")


def csv_rows(ranked: DataFrame) -> DataFrame:
    """The fixed columns of the export, numbers as text and N/A where there is none."""
    number = lambda c, digits: F.when(c.isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", c.cast("double")))
    c = F.col
    values = (c("group_id"), c("direction"), number(c("score"), 1), c("uses").cast("string"), number(c("avg_duration") / 60, 1), number(c("avg_distance"), 2), number(c("avg_speed"), 1), number(c("weather"), 1), number(c("safety"), 1), number(F.lit(0.0), 1))
    return ranked.select(*[v.alias(h) for v, h in zip(values, CSV_HEADER)])


def write_csv(ranked: DataFrame, path: str) -> None:
    csv_rows(ranked).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def gpx(name: Column, note: Column, coords: Column, track: bool = False) -> Column:
    """One file's text: a route of rtept, or a track of trkpt."""
    tag = "trkpt" if track else "rtept"
    points = F.array_join(F.transform(coords, lambda p: F.concat(F.lit(f'    <{tag} lat="'), p["lat"].cast("string"), F.lit('" lon="'), p["lon"].cast("string"), F.lit('"/>'))), "\n")
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="spokeframe" xmlns="http://www.topografix.com/GPX/1/1">\n')
    title = F.concat(F.lit("    <name>"), escape(name), F.lit("</name>\n"))
    if track:
        body = F.concat(F.lit("  <trk>\n"), title, F.lit("    <trkseg>\n"), points, F.lit("\n    </trkseg>\n  </trk>\n"))
    else:
        body = F.concat(F.lit("  <rte>\n"), title, F.lit("    <desc>"), escape(note), F.lit("</desc>\n"), points, F.lit("\n  </rte>\n"))
    return F.concat(head, body, F.lit("</gpx>\n"))


def write_gpx(routes: DataFrame, path: str, track: bool = False) -> None:
    """routes: name, note, coords. A folder for each name, with one file."""
    files = routes.select(F.col("name").alias("route"), gpx(F.col("name"), F.col("note"), F.col("coords"), track).alias("value"))
    files.write.mode("overwrite").partitionBy("route").text(path)


def write_groups(groups: DataFrame, members: DataFrame, path: str, config: str) -> None:
    """Groups, members, and the settings they were made with: a reader compares ids and settings before it uses them."""
    groups.withColumn("config", F.lit(config)).write.mode("overwrite").parquet(f"{path}/groups")
    members.write.mode("overwrite").parquet(f"{path}/members")


def reusable(spark, path: str, ids: DataFrame, config: str) -> bool:
    """Whether stored groups are of exactly these ids and settings."""
    stored = spark.read.parquet(f"{path}/members").select("activity_id")
    same = spark.read.parquet(f"{path}/groups").filter(F.col("config") != config).isEmpty()
    return same and stored.exceptAll(ids).isEmpty() and ids.exceptAll(stored).isEmpty()


def append_history(spark, history: DataFrame, job: DataFrame, keep: int = 100) -> DataFrame:
    """The newest jobs, so many of them."""
    return history.unionByName(job).orderBy(F.desc("finished_at"), F.desc("job_id")).limit(keep)
