"""Reading rides, gear, weather, workouts, water and routes from files, with fixed schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text

ACTIVITY = """id long, name string, type string, sport_type string, start_date string, start_date_local string, distance double, moving_time long, elapsed_time long,
total_elevation_gain double, start_latlng string, end_latlng string, polyline string, average_speed double, max_speed double, gear_id string, average_heartrate double, max_heartrate double,
average_watts double, kilojoules double, suffer_score long, achievement_count long, pr_count long, kudos_count long"""
WEATHER = "lat double, lon double, current struct<{c}>, hourly struct<time:array<string>,{h}>, daily struct<time:array<string>,{d}>"
HOURLY = ("temperature_2m", "wind_speed_10m", "wind_gusts_10m", "wind_direction_10m", "precipitation_probability")
DAILY = ("temperature_2m_max", "temperature_2m_min", "precipitation_sum", "precipitation_probability_max", "wind_speed_10m_max", "wind_direction_10m_dominant")
# The second provider's kinds of sport; all others are rides.
SPORTS = {
    "cycling": "Ride", "road_biking": "Ride", "gravel_cycling": "GravelRide", "mountain_biking": "Ride", "virtual_ride": "VirtualRide",
    "indoor_cycling": "VirtualRide", "running": "Run", "trail_running": "Run", "walking": "Walk", "hiking": "Hike",
}


def point(value: Column) -> Column:
    """A (lat, lon) from [lat, lon] or [["root", [lat, lon]]]; null where it is neither."""
    plain = F.from_json(value, "array<double>")
    inner = F.regexp_extract(value, r"\[\s*\[\s*\"root\"\s*,\s*(\[[^\]]*\])", 1)
    nested = F.from_json(F.when(inner != "", inner), "array<double>")
    both = F.when((F.size(plain) == 2) & F.get(plain, F.lit(0)).isNotNull(), plain).otherwise(nested)
    return F.when(F.size(both) == 2, F.struct(F.get(both, F.lit(0)).alias("lat"), F.get(both, F.lit(1)).alias("lon")))


def normalise_activities(raw: DataFrame) -> DataFrame:
    a, b = point(F.col("start_latlng")), point(F.col("end_latlng"))
    return raw.withColumn("start_latlng", a).withColumn("end_latlng", b).withColumns({f"{side}_{x}": F.col(f"{side}_latlng.{x}") for side in ("start", "end") for x in ("lat", "lon")})


def read_activities(spark: SparkSession, path: str) -> DataFrame:
    """Rides from documents that are a list of them or hold one under `activities`."""
    listed = spark.read.schema(f"activities array<struct<{_struct(ACTIVITY)}>>").json(path, multiLine=True)
    inside = listed.filter("activities is not null").select(F.explode("activities").alias("a")).select("a.*")
    bare = spark.read.schema(ACTIVITY).json(path, multiLine=True).filter("id is not null").select(*inside.columns)  # not what folders are named by
    return normalise_activities(inside.unionByName(bare))


def _struct(ddl: str) -> str:
    return ",".join(":".join(part.split()) for part in ddl.split(","))


def coverage_rides(activities: DataFrame) -> DataFrame:
    """Rides that count for coverage, by either kind."""
    kinds = ("Ride", "GravelRide", "MountainBikeRide", "EBikeRide")
    return activities.filter(F.col("type").isin(*kinds) | F.col("sport_type").isin(*kinds))


def second_provider(raw: DataFrame) -> DataFrame:
    """Rides of the second provider in the first one's columns. Points need both numbers to be other than zero."""
    table = F.create_map(*[F.lit(x) for kv in SPORTS.items() for x in kv])
    kind = F.coalesce(F.try_element_at(table, F.lower("activityType.typeKey")), F.lit("Ride"))
    at = lambda lat, lon: F.when((F.col(lat) != 0) & (F.col(lon) != 0), F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon")))
    number = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    duration = F.coalesce(F.nullif(F.col("movingDuration"), F.lit(0.0)), F.col("duration"), F.lit(0.0))
    return raw.select(
        F.col("activityId").alias("id"), F.coalesce("activityName", F.lit("Garmin Activity")).alias("name"), kind.alias("type"), kind.alias("sport_type"), F.col("startTimeLocal").alias("start_date"),
        F.col("startTimeLocal").alias("start_date_local"), number("distance").alias("distance"), duration.cast("long").alias("moving_time"), number("duration").cast("long").alias("elapsed_time"),
        number("elevationGain").alias("total_elevation_gain"), at("startLatitude", "startLongitude").alias("start_latlng"), at("endLatitude", "endLongitude").alias("end_latlng"), number("averageSpeed").alias("average_speed"),
        number("maxSpeed").alias("max_speed"), F.col("averageHR").alias("average_heartrate"),
    )


def enrich(base: DataFrame, detailed: DataFrame) -> DataFrame:
    """The detailed track where there is one."""
    more = detailed.select(F.col("id").alias("__id"), F.col("polyline").alias("__polyline"))
    return base.join(more, base["id"] == more["__id"], "left").withColumn("polyline", F.coalesce("__polyline", "polyline")).drop("__id", "__polyline")


def read_gear(spark: SparkSession, path: str) -> DataFrame:
    item = "array<struct<id:string,name:string,type:string,brand:string,model:string,primary:boolean,strava_distance_m:double>>"
    doc = spark.read.schema(f"bikes {item}, shoes {item}").json(path, multiLine=True)
    rows = doc.select(F.explode(F.concat(F.coalesce("bikes", F.array().cast(item)), F.coalesce("shoes", F.array().cast(item)))).alias("g"))
    return rows.select("g.*")


def forecast_rows(doc: DataFrame, part: str, columns: tuple[str, ...], most: int) -> DataFrame:
    """A row for each time of a document whose columns are arrays; at most so many, and as many as the times."""
    zipped = F.arrays_zip(F.col(f"{part}.time").alias("time"), *[F.coalesce(F.col(f"{part}.{c}"), F.array().cast("array<double>")).alias(c) for c in columns])
    return doc.select(F.posexplode(F.slice(zipped, 1, most)).alias("n", "r")).select("n", "r.*").filter("time is not null")


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    lists = lambda names: ",".join(f"{c}:array<double>" for c in names)
    return spark.read.schema(WEATHER.format(c="time:string,temperature_2m:double,wind_speed_10m:double", h=lists(HOURLY), d=lists(DAILY))).json(path, multiLine=True)


def ics_events(lines: DataFrame) -> DataFrame:
    """lines: value, a whole calendar file. A workout for each event with a summary and a start; folded lines are joined."""
    flat = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n[ \t]", "")
    parts = F.filter(F.split(flat, "BEGIN:VEVENT"), lambda _, i: i > 0)
    event = lines.select(F.explode(parts).alias("event")).withColumn("event", F.regexp_replace("event", r"(?s)END:VEVENT.*", ""))
    field = lambda name: F.regexp_extract("event", rf"(?m)^{name}[^:\n]*:(.*)$", 1)
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, r"\\n", "\n"), r"\\([,;\\])", "$1")
    stamp = lambda x: F.coalesce(F.try_to_timestamp(F.regexp_replace(x, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")))
    e = event.select(clean(field("SUMMARY")).alias("summary"), clean(field("DESCRIPTION")).alias("description"), field("DTSTART").alias("s"), field("DTEND").alias("e"), field("UID").alias("uid"))
    e = e.filter("summary <> '' and s <> ''")
    return e.select(
        F.col("uid").alias("workout_id"), F.col("summary").alias("workout_name"), F.to_date(F.substring("s", 1, 8), "yyyyMMdd").alias("workout_date"), text.workout_type(F.col("summary"), F.col("description")).alias("workout_type"),
        text.workout_minutes(stamp(F.col("s")), stamp(F.col("e")), F.col("summary")).alias("duration_minutes"), text.stress_score(F.col("description")).alias("tss"), text.intensity_factor(F.col("description")).alias("intensity_factor"),
    )


def water_polygons(spark: SparkSession, path: str) -> DataFrame:
    """ring: of ways, and of outer members of relations, with three points at least."""
    geometry = "geometry:array<struct<lat:double,lon:double>>"
    doc = spark.read.schema(f"elements array<struct<type:string,{geometry},members:array<struct<role:string,{geometry}>>>>").json(path, multiLine=True)
    e = doc.select(F.explode("elements").alias("e")).select("e.*")
    ways = e.filter("type = 'way'").select(F.col("geometry").alias("ring"))
    outer = e.filter("type = 'relation'").select(F.explode("members").alias("m")).filter("m.role = 'outer'").select(F.col("m.geometry").alias("ring"))
    return ways.unionByName(outer).filter(F.size("ring") >= 3)


def routed(spark: SparkSession, path: str) -> DataFrame:
    """coords, distance_km, duration_min of routing answers, one or a list of them a file, whose points come as (lon, lat)."""
    schema = "features array<struct<geometry:struct<coordinates:array<array<double>>>,properties:struct<summary:struct<distance:double,duration:double>>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.get("features", F.lit(0)).alias("f"))
    coords = F.transform("f.geometry.coordinates", lambda p: F.struct(F.get(p, F.lit(1)).alias("lat"), F.get(p, F.lit(0)).alias("lon")))
    return f.select(coords.alias("coords"), F.bround(F.col("f.properties.summary.distance") / 1000, 2).alias("distance_km"), F.bround(F.col("f.properties.summary.duration") / 60, 1).alias("duration_min"))


def road_edges(spark: SparkSession, path: str) -> DataFrame:
    """edge, place, lat1, lon1, lat2, lon2: the straight pieces of each road of a GraphML file, as `coverage.snap` takes them.

    Data of nodes and edges are named by keys that the file declares: x and y of nodes, geometry of edges, a LINESTRING of
    lon lat pairs. Roads without one are straight between their nodes. Without a way's id, an edge is named by its ends.
    """
    read = lambda tag, schema: spark.read.format("xml").schema(schema).option("rowTag", tag).load(path)
    data = "data array<struct<_key string, _VALUE string>>"
    keys = read("key", "_id string, `_attr.name` string, _for string").select(F.col("_id").alias("key"), F.col("`_attr.name`").alias("name"), F.col("_for").alias("of"))

    def named(rows: DataFrame, of: str, *id_: str) -> DataFrame:
        flat = rows.select(*id_, F.explode("data").alias("d")).select(*id_, F.col("d._key").alias("key"), F.col("d._VALUE").alias("value"))
        return flat.join(keys.filter(F.col("of").isin(of, "all")), "key")

    value = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    nodes = named(read("node", f"_id string, {data}").withColumnRenamed("_id", "node"), "node", "node").groupBy("node").agg(value("y").cast("double").alias("lat"), value("x").cast("double").alias("lon"))
    edges = read("edge", f"_source string, _target string, _id string, {data}")
    edges = edges.select(F.concat_ws("-", "_source", "_target", "_id").alias("edge"), F.col("_source").alias("a"), F.col("_target").alias("b"), "data")
    drawn = named(edges, "edge", "edge").groupBy("edge").agg(value("geometry").alias("wkt"))
    at = lambda side: nodes.select(F.col("node").alias(side), F.struct("lat", "lon").alias(f"p{side}"))
    pairs = F.split(F.regexp_extract("wkt", r"\(([^()]*)\)", 1), r"\s*,\s*")
    number = lambda p, i: F.get(F.split(F.trim(p), r"\s+"), F.lit(i)).try_cast("double")
    line = F.transform(pairs, lambda p: F.struct(number(p, 1).alias("lat"), number(p, 0).alias("lon")))
    whole = edges.drop("data").join(drawn, "edge", "left").join(at("a"), "a", "left").join(at("b"), "b", "left")
    coords = F.when(F.col("wkt").rlike("(?i)^\\s*linestring"), line).otherwise(F.array("pa", "pb"))
    pieces = whole.select("edge", F.posexplode(geo.segments(coords)).alias("place", "s")).select("edge", "place", "s.*")
    return pieces.dropna(subset=["lat1", "lon1", "lat2", "lon2"])
