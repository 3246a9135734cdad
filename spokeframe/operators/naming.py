"""Names of routes from the streets and places they pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .ranking import cumulative_midpoint, turns

# Highway types of little use in a name, signs of access paths, drives that count as streets, highway types and words of
# major streets, streets that count as another one.
NOISY = ("service", "track", "path", "unclassified")
ACCESS = "access|path|ramp|entrance|exit"
MAJOR_DRIVES = "lake shore|lakeshore|martin luther king"
SUFFIX = {"home_to_work": " → Work", "work_to_home": " → Home"}
MAJOR_TYPES = ("motorway", "trunk", "primary", "secondary", "tertiary")
MAJOR_WORDS = "highway|boulevard|avenue|parkway"
EQUIVALENT = {"North Simonds Drive": "Lakefront Trail", "South Simonds Drive": "Lakefront Trail", "Simonds Drive": "Lakefront Trail"}

#: Of a looked-up address, the fields that tell a detail, the first that is filled first.
FIELDS = {
    "street": ("road", "street", "cycleway", "path"),
    "highway": ("highway",),
    "neighborhood": ("neighbourhood", "suburb", "quarter", "district", "city_district"),
    "suburb": ("suburb", "neighbourhood"),
    "landmark": ("amenity", "tourism", "historic"),
    "park": ("leisure", "natural", "tourism"),
    "feature": ("natural", "water", "waterway", "leisure"),
}
DETAILS = (*FIELDS, "is_major")
ARROW = " → "


def access_path(street: Column) -> Column:
    low = F.lower(street)
    side = low.contains("drive") & low.rlike("west |east |north |south ") & ~low.rlike(MAJOR_DRIVES)
    return F.coalesce(low.rlike(ACCESS) | side, F.lit(False))


def places(addresses: DataFrame) -> DataFrame:
    """lat, lon and DETAILS from the fields of looked-up addresses, of which any may be lacking, null or empty."""
    filled = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in addresses.columns else F.lit(None).cast("string")
    major = filled("highway").isin(*MAJOR_TYPES) | F.lower(filled("road")).rlike(MAJOR_WORDS)
    return addresses.select("lat", "lon", *[F.coalesce(*map(filled, cs)).alias(name) for name, cs in FIELDS.items()], F.coalesce(major, F.lit(False)).alias("is_major"))


def sample_points(tracks: DataFrame, key: str, wanted: int = 10, commute: int = 20) -> DataFrame:
    """key, idx, lat, lon: tracks under ten points whole, of others the ends, turns, the middle of the way and, where these are fewer than wanted, evenly spaced points.

    No more than wanted are taken, from the start on. Commutes, told by `direction`, have a number of their own. A place passed again counts as its first passing.
    """
    tracks = tracks.filter(F.size("coords") > 0)
    at = tracks.select(key, F.posexplode("coords").alias("idx", "p")).select(key, "idx", "p.lat", "p.lon")
    turned = turns(tracks, key).groupBy(key).agg(F.array_sort(F.collect_list("idx")).alias("turns"))
    known = tracks.join(turned, key, "left").join(cumulative_midpoint(at, key).withColumnRenamed("idx", "middle"), key, "left")
    n, none = F.size("coords"), F.array().cast("array<int>")
    most = F.when(F.col("direction").isin(*SUFFIX), commute).otherwise(wanted) if "direction" in tracks.columns else F.lit(wanted)
    first = lambda places: F.transform(places, lambda i: (F.array_position("coords", F.get("coords", i)) - 1).cast("int"))
    known = known.withColumn("most", most).withColumn("chosen", first(F.concat(F.array(F.lit(0)), F.coalesce("turns", none), F.array(n - 1))))
    middle = first(F.array(F.coalesce("middle", F.lit(0))))
    known = known.withColumn("chosen", F.concat("chosen", F.array_except(middle, "chosen")))
    missing = F.col("most") - F.size("chosen")
    known = known.withColumn("step", F.greatest(F.lit(1), F.floor(n / F.greatest(F.lit(1), missing + 1))).cast("int"))
    even = F.when((missing > 0) & (n - F.col("step") > F.col("step")), F.sequence(F.col("step"), F.greatest(F.col("step"), n - F.col("step") - 1), F.col("step"))).otherwise(none)
    filled = F.concat("chosen", F.slice(F.array_except(first(even), "chosen"), F.lit(1), F.greatest(F.lit(0), missing)))
    places = F.when(n < 10, F.sequence(F.lit(0), n - 1)).otherwise(F.slice(F.array_sort(filled), F.lit(1), F.col("most")))
    return known.select(key, F.explode(places).alias("idx"), "coords").select(key, "idx", F.get("coords", F.col("idx")).alias("p")).select(key, "idx", "p.lat", "p.lon")


def located(points: DataFrame, details: DataFrame) -> DataFrame:
    """points: key, idx, lat, lon. details: lat, lon and any of DETAILS. key, at: what is at the points, in their order, by places of four decimals.

    Points without an answer count. A key has as many entries as sample_points gives it, at most twenty or so, so a list holds them.
    """
    four = lambda c: F.round(F.col(c), 4)
    kept = [F.col(c) if c in details.columns else F.lit(None).cast("boolean" if c == "is_major" else "string").alias(c) for c in DETAILS]
    known = details.select(four("lat").alias("klat"), four("lon").alias("klon"), *kept).dropDuplicates(["klat", "klon"])
    joined = points.join(known, (four("lat") == F.col("klat")) & (four("lon") == F.col("klon")), "left")
    return joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("idx", *DETAILS))).alias("at"))


def segments(at: Column, synonyms: dict[str, str] = EQUIVALENT) -> Column:
    """street, highway, start, points of stretches of one street; the highway is that of a stretch's first point."""

    def street(e):
        found = e["street"]
        for a, b in synonyms.items():
            found = F.when(e["street"] == a, b).otherwise(found)
        return found

    n = F.size(at)
    changes = lambda i: (i == 0) | ~street(F.get(at, i)).eqNullSafe(street(F.get(at, i - 1)))
    starts = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), changes)
    one = lambda i, k: F.struct(street(F.get(at, i)).alias("street"), F.get(at, i)["highway"].alias("highway"), i.alias("start"), (F.coalesce(F.get(starts, k + 1), n) - i).alias("points"))
    return F.transform(starts, one)


def _longest(segs: Column) -> Column:
    """The street with most points, of equal ones the first."""
    return F.array_max(F.transform(segs, lambda e, i: F.struct(e["points"].alias("points"), (-i).alias("minus"), e["street"].alias("street"))))["street"]


def _shortest(segs: Column) -> Column:
    return F.array_min(F.transform(segs, lambda e, i: F.struct(e["points"].alias("points"), i.alias("i"), e["street"].alias("street"))))["street"]


def _by_streets(kind: Column, good: Column, streets: Column, samples: Column, park: Column, suburb: Column) -> Column:
    """The name by the type of route: `good` are all segments of use, `streets` the first one of each street."""
    n = F.size(streets)
    street = lambda i: F.get(streets, i)["street"]
    last = lambda x: F.try_element_at(x, F.lit(-1))["street"]
    main = _longest(streets)
    others = F.filter(streets, lambda e: e["street"] != main)
    anchored = F.concat(F.lit("Loop via "), main, F.coalesce(F.concat(F.lit(", "), suburb), F.lit("")))
    loop = F.when(park.isNotNull(), F.concat(F.lit("Loop through "), park)).when(n == 1, anchored).otherwise(F.concat(F.lit("Loop via "), main, F.lit(" + "), _longest(others)))

    # The street where the ride turns is the last one that begins in its first half and, if it can be, not the main one.
    out = F.filter(streets, lambda e: e["start"] < samples / 2)
    farthest = F.coalesce(last(out), last(streets))
    turn = F.when(farthest != main, farthest).otherwise(F.coalesce(last(F.filter(out, lambda e: e["street"] != main)), street(F.lit(1))))
    back = F.when(n == 1, F.concat(F.lit("Via "), main, F.lit(" and back"))).otherwise(F.concat(main, F.lit(" to "), turn, F.lit(" and back")))

    middle = _longest(F.slice(streets, F.lit(2), F.greatest(F.lit(0), n - 2)))
    long = F.concat_ws(ARROW, street(F.lit(0)), middle, street(n - 1))
    long = F.concat(long, F.when(~F.contains(F.lower(long), F.lower(suburb)), F.concat(F.lit(", "), suburb)).otherwise(""))
    share = F.array_max(F.transform(good, lambda e: e["points"])) * 100.0 / samples
    two = F.when(share > 60, F.concat(_longest(good), F.lit(" via "), _shortest(good))).otherwise(F.concat_ws(ARROW, street(F.lit(0)), street(F.lit(1))))
    through = F.when(n >= 3, long).when(n == 2, two).otherwise(F.concat(F.lit("Via "), main))
    return F.when(kind == "loop", loop).when(kind == "out-and-back", back).otherwise(through)


def _by_places(at: Column, generic: Column) -> Column:
    """The name of a route without segments of use: by major streets, neighbourhoods, a landmark, a feature."""
    all_of = lambda c: F.filter(F.transform(at, lambda e: e[c]), lambda v: v.isNotNull())
    passed = F.filter(F.transform(at, lambda e: F.when(e["is_major"], e["street"])), lambda v: v.isNotNull())
    ranked = F.array_sort(F.transform(F.array_distinct(passed), lambda s, i: F.struct((-F.size(F.filter(passed, lambda x: x == s))).alias("minus"), i.alias("i"), s.alias("s"))))
    major = F.transform(F.slice(ranked, 1, 3), lambda e: e["s"])
    hoods, landmark, feature = F.array_distinct(all_of("neighborhood")), F.get(all_of("landmark"), F.lit(0)), F.get(all_of("feature"), F.lit(0))
    street, hood, n, m = F.get(major, F.lit(0)), F.get(hoods, F.lit(0)), F.size(major), F.size(hoods)
    return (
        F.when(n >= 2, F.array_join(major, ARROW))
        .when((n == 1) & (m > 0), F.concat(F.lit("Through "), hood, F.lit(" via "), street))
        .when((m > 0) & landmark.isNotNull(), F.concat(F.lit("Through "), hood, F.lit(" past "), landmark))
        .when((n == 1) & feature.isNotNull(), F.concat(street, F.lit(" along "), feature))
        .when(n == 1, F.concat(F.lit("Via "), street))
        .when(m >= 2, F.concat(F.lit("Through "), hood, F.lit(" and "), F.get(hoods, F.lit(1))))
        .when(m == 1, F.concat(F.lit("Through "), hood))
        .when(feature.isNotNull(), F.concat(F.lit("Along "), feature))
        .otherwise(generic)
    )


def names(routes: DataFrame, least_pct: float = 10.0, rolling: float = 15.0, hilly: float = 30.0, synonyms: dict[str, str] = EQUIVALENT) -> DataFrame:
    """routes: key, type, direction, gain_per_km, at as located() gives it. key, name.

    Segments of a street count from `least_pct` of the points on, without access paths and noisy highways; each street once. Where there are
    none, the name tells places instead, and has its terrain only behind a direction. What is null or empty is not told; a route of which
    nothing is known is numbered by what its key has behind the last underscore.
    """
    filled = lambda e: F.struct(*[F.nullif(e[c], F.lit("")).alias(c) for c in FIELDS], e["is_major"].alias("is_major"))
    at, samples = F.coalesce("at", F.array().cast(routes.schema["at"].dataType)), F.size("at")
    found = routes.select("key", "type", "direction", "gain_per_km", F.transform(at, filled).alias("at"))
    found = found.withColumn("segments", segments(F.col("at"), synonyms))
    noisy = lambda e: F.coalesce(e["highway"].isin(*NOISY), F.lit(False))
    useful = lambda e: e["street"].isNotNull() & (e["points"] * 100.0 / samples >= least_pct) & ~access_path(e["street"]) & ~noisy(e)
    found = found.withColumn("good", F.filter("segments", useful))
    known = F.transform("good", lambda e: e["street"])
    found = found.withColumn("streets", F.filter("good", lambda e, i: F.array_position(known, e["street"]) == i + 1))

    arrow = F.lit("")
    for way, text in SUFFIX.items():
        arrow = F.when(F.col("direction") == way, text).otherwise(arrow)
    terrain = F.when(F.col("gain_per_km") > hilly, " (hilly)").when(F.col("gain_per_km") > rolling, " (rolling)").otherwise("")
    park = F.get(F.filter(F.transform("at", lambda e: e["park"]), lambda v: v.isNotNull()), F.lit(0))
    by_streets = _by_streets(F.col("type"), F.col("good"), F.col("streets"), samples, park, F.get("at", F.lit(0))["suburb"])
    way = F.when(F.col("direction") == "home_to_work", " to Work").otherwise(" to Home")
    by_places = _by_places(F.col("at"), F.concat(F.lit("Route "), F.substring_index(F.col("key").cast("string"), "_", -1), way))
    told = F.when((arrow != "") & ~F.contains(by_places, arrow), F.concat(by_places, arrow, terrain)).otherwise(by_places)
    return found.select("key", F.when(F.size("streets") > 0, F.concat(by_streets, arrow, terrain)).otherwise(told).alias("name"))


def name_routes(tracks: DataFrame, details: DataFrame) -> DataFrame:
    """tracks: key, coords, direction, gain_per_km. details: as places() gives them. A track without points is numbered."""
    kinds = tracks.select("key", geo.route_type(F.col("coords")).alias("type"), "direction", "gain_per_km")
    return names(kinds.join(located(sample_points(tracks, "key"), details), "key", "left"))
