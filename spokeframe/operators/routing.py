"""Routes over a road network for many requests at once, and tours refined to a target length.

The roads' ends are nodes. Waypoints go to the nearest node in reach; those without one, and those that the roads do not join to the
start, are dropped, unless they are the start or the end, which fails the request. Legs between equal nodes are found once. All legs
advance together, a road a round: the frontier joins the roads, and what it reaches stays if it is nearer than before and, with the
straight line to the leg's end added, still shorter than the best way there. No request is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..shared import materialise
from .graph import components
from .similarity import around, in_cells, meet

# The profile of each kind of surface, and the one that is taken where a profile has no roads.
PROFILES = {"paved": "cycling-road", "unpaved": "cycling-mountain", "any": "cycling-regular"}
REGULAR = PROFILES["any"]
#: How far a waypoint may be from a road's end, in metres.
SNAP_M = 350.0
#: Metres by which sums of rounded lengths may differ.
SLACK = 1e-6


def node_of(lat: Column, lon: Column) -> Column:
    """One number for a place, to 1e-6 degrees."""
    e6 = lambda x, most: F.round((x + most) * 1e6).cast("long")
    return e6(lat, 90) * 400_000_000 + e6(lon, 180)


def road_network(pieces: DataFrame) -> DataFrame:
    """pieces: lat1, lon1, lat2, lon2, profiles. profile, a, b, metres, both ways, and the places of a and b; of pieces with equal ends the shortest."""
    p = pieces.select("*", geo.haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("metres"), F.explode("profiles").alias("profile"))
    way = lambda a, b: p.select("profile", node_of(F.col(f"lat{a}"), F.col(f"lon{a}")).alias("a"), node_of(F.col(f"lat{b}"), F.col(f"lon{b}")).alias("b"), "metres", F.struct(F.col(f"lat{a}").alias("lat"), F.col(f"lon{a}").alias("lon")).alias("at_a"), F.struct(F.col(f"lat{b}").alias("lat"), F.col(f"lon{b}").alias("lon")).alias("at_b"))
    return way(1, 2).unionByName(way(2, 1)).filter("a <> b").groupBy("profile", "a", "b").agg(F.min("metres").alias("metres"), F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))


def _snapped(points: DataFrame, nodes: DataFrame, reach_m: float) -> DataFrame:
    """points: key, profile, lat, lon. key, node, at: the nearest node of the profile in reach; of equals the first."""
    width = reach_m / 111_000.0
    far = width / F.greatest(F.cos(F.radians(F.col("lat"))), F.lit(0.01))  # longitudes are closer together by latitude; cells are as wide as they need be at 60 degrees
    near = in_cells(points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()), "lat", "lon", 2 * width).withColumn("far", far)
    known = around(in_cells(nodes.select("profile", "node", F.col("at.lat").alias("n_lat"), F.col("at.lon").alias("n_lon")), "n_lat", "n_lon", 2 * width))
    met = meet(near, known, ["cy", "cx", "profile"], "key", "node")
    metres = geo.haversine_m(F.col("a.lat"), F.col("a.lon"), F.col("b.n_lat"), F.col("b.n_lon"))
    within = met.select("a.key", "b.node", F.struct(F.col("b.n_lat").alias("lat"), F.col("b.n_lon").alias("lon")).alias("at"), metres.alias("off")).filter(F.col("off") <= reach_m)
    return within.groupBy("key").agg(F.min(F.struct("off", "node", "at")).alias("n")).select("key", "n.node", "n.at")


def shortest_legs(legs: DataFrame, roads: DataFrame) -> DataFrame:
    """legs: profile, a, b and their places at_a, at_b, distinct and joined by roads. profile, a, b, metres, nodes of the shortest way; of equals the first by its nodes."""
    legs = materialise(legs.withColumn("leg", F.xxhash64("profile", "a", "b")), "legs")
    goal = legs.select("leg", F.col("b").alias("goal"), "at_b", "profile")
    by_node = roads.select("profile", F.col("a").alias("node"), F.col("b").alias("to"), "metres", F.col("at_b").alias("at_to"))
    known = materialise(legs.select("leg", F.col("a").alias("node"), F.lit(0.0).alias("dist"), F.array("a").alias("nodes"), F.lit(True).alias("fresh")), "reached")
    while True:
        best = known.join(goal.select("leg", F.col("goal").alias("node")), ["leg", "node"], "left_semi").select("leg", F.col("dist").alias("best"))
        front = known.filter("fresh").join(goal.drop("goal"), "leg").join(by_node, ["profile", "node"])
        ahead = geo.haversine_m(F.col("at_to.lat"), F.col("at_to.lon"), F.col("at_b.lat"), F.col("at_b.lon"))
        step = front.withColumns({"reached": F.col("dist") + F.col("metres"), "ahead": ahead}).join(best, "leg", "left")
        step = step.filter(F.col("best").isNull() | (F.col("reached") + F.col("ahead") <= F.col("best") + SLACK))
        offered = step.select("leg", F.col("to").alias("node"), F.col("reached").alias("dist"), F.concat("nodes", F.array("to")).alias("nodes"), F.lit(True).alias("fresh"))
        both = offered.unionByName(known.withColumn("fresh", F.lit(False)))
        nearest = both.groupBy("leg", "node").agg(F.min(F.struct("dist", "nodes", "fresh")).alias("s")).select("leg", "node", "s.*")
        known = materialise(nearest, "reached")
        if known.filter("fresh").isEmpty():
            break
    arrived = known.join(goal.select("leg", F.col("goal").alias("node")), ["leg", "node"])
    return arrived.join(legs.select("leg", "profile", "a", "b"), "leg").select("profile", "a", "b", F.col("dist").alias("metres"), "nodes")


def routed(requests: DataFrame, pieces: DataFrame, reach_m: float = SNAP_M) -> DataFrame:
    """requests: request (a number of its own each), waypoints (lat, lon; two at least), surface. request, status, dropped, distance_km, nodes.

    A surface whose profile has no roads takes the regular one. Waypoints alike to six decimals are one for the search. Interior waypoints that are
    out of reach or not joined to the start are dropped and counted; where the start or the end is such, the status is `error`, and distance and nodes are null.
    """
    roads = materialise(road_network(pieces), "roads")
    kinds = F.create_map(*[F.lit(x) for kv in PROFILES.items() for x in kv])
    asked = requests.select("request", "waypoints", F.coalesce(F.try_element_at(kinds, "surface"), F.lit(REGULAR)).alias("profile"))
    open_ = roads.select("profile").distinct().withColumn("open", F.lit(True))
    asked = asked.join(open_, "profile", "left").select("request", "waypoints", F.when(F.col("open"), F.col("profile")).otherwise(REGULAR).alias("profile"))
    points = asked.select("request", "profile", F.size("waypoints").alias("n"), F.posexplode("waypoints").alias("pos", "w")).select("request", "profile", "n", "pos", F.round("w.lat", 6).alias("lat"), F.round("w.lon", 6).alias("lon"))
    points = materialise(points.withColumn("key", F.xxhash64("profile", "lat", "lon")), "waypoints")
    nodes = roads.groupBy("profile", F.col("a").alias("node")).agg(F.min("at_a").alias("at"))
    found = _snapped(points.groupBy("key", "profile").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon")), nodes, reach_m)
    name = lambda node: F.concat_ws("|", "profile", F.col(node).cast("string"))
    part = components(roads.select(name("a").alias("a"), name("b").alias("b"))).select(F.col("id").alias("name"), F.col("label").alias("part"))
    placed = points.join(found, "key", "left").withColumn("name", name("node")).join(part, "name", "left").drop("name", "key")
    first = placed.filter("pos = 0").select("request", F.col("part").alias("home"))
    placed = placed.join(first, "request").withColumn("kept", F.coalesce(F.col("part") == F.col("home"), F.lit(False)))
    ends = F.min(F.when((F.col("pos") == 0) | (F.col("pos") == F.col("n") - 1), F.col("kept").cast("int")))
    told = placed.groupBy("request").agg(ends.alias("ok"), F.sum(F.when(~F.col("kept") & (F.col("pos") > 0) & (F.col("pos") < F.col("n") - 1), 1).otherwise(0)).alias("dropped"))
    told = materialise(told, "told")
    w = Window.partitionBy("request").orderBy("pos")
    chain = placed.filter("kept").join(told.filter("ok = 1").select("request"), "request", "left_semi")
    chain = chain.select("request", "profile", "pos", F.col("node").alias("a"), F.col("at").alias("at_a"), F.lead("node").over(w).alias("b"), F.lead("at").over(w).alias("at_b")).filter("b is not null")
    chain = materialise(chain, "chain")
    legs = chain.filter("a <> b").groupBy("profile", "a", "b").agg(F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
    walked = chain.join(shortest_legs(legs, roads), ["profile", "a", "b"], "left").select("request", "pos", F.coalesce("metres", F.lit(0.0)).alias("metres"), F.coalesce("nodes", F.array("a", "b")).alias("nodes"))
    whole = walked.groupBy("request").agg(F.sort_array(F.collect_list(F.struct("pos", "metres", "nodes"))).alias("legs"))
    metres = F.aggregate("legs", F.lit(0.0), lambda acc, leg: acc + leg["metres"])
    joined = F.aggregate("legs", F.array().cast("array<bigint>"), lambda acc, leg: F.concat(acc, F.when(F.size(acc) > 0, F.slice(leg["nodes"], 2, F.greatest(F.size(leg["nodes"]) - 1, F.lit(0)))).otherwise(leg["nodes"])))
    out = told.join(whole, "request", "left")
    fine = F.col("ok") == 1
    return out.select("request", F.when(fine, "success").otherwise("error").alias("status"), F.col("dropped").cast("int").alias("dropped"), F.when(fine, F.bround(metres / 1000, 2)).alias("distance_km"), F.when(fine, joined).alias("nodes"))


def straight_km(waypoints: Column) -> Column:
    """Length of the lines from waypoint to waypoint."""
    pairs = F.arrays_zip(F.slice(waypoints, 1, F.size(waypoints) - 1).alias("a"), F.slice(waypoints, 2, F.size(waypoints) - 1).alias("b"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + geo.haversine_m(p["a"]["lat"], p["a"]["lon"], p["b"]["lat"], p["b"]["lon"])) / 1000


def by_straight_lines(tours: DataFrame) -> DataFrame:
    return tours.select("request", straight_km(F.col("waypoints")).alias("distance_km"))


def refined(requests: DataFrame, route: Callable[[DataFrame], DataFrame] = by_straight_lines, tolerance: float = 0.15, rounds: int = 6) -> DataFrame:
    """Tours whose length is near the target. requests: request, waypoints, target_km, candidates (points to add, in order), bearing.

    request, waypoints, distance_km, routings, status. All requests advance together, at most so many rounds, each of which routes the tours that are still open.
    Too long: a padding point goes, or else the last inner one, as long as there is more than one. Too short: the next candidate is added at the end, or else a
    padding point half of the deficit away from the start along the bearing. A tour that stays far short of its target, or cannot be
    routed, has status `error`; one that stays too long keeps its length. route: request and distance_km of tours (request, waypoints, and what else requests have).
    """
    extra = [c for c in requests.columns if c not in ("request", "waypoints", "target_km", "candidates", "bearing")]
    inner = F.transform(F.slice("waypoints", 2, F.greatest(F.size("waypoints") - 2, F.lit(0))), lambda _: F.lit(True))
    open_ = requests.withColumns({"bears": inner, "routings": F.lit(0)})
    done = None
    for turn in range(rounds):
        found = open_.join(route(open_.select("request", "waypoints", *extra)), "request", "left").withColumn("routings", F.col("routings") + 1)
        ratio = F.col("distance_km") / F.col("target_km")
        n = F.size("waypoints")
        long_, short = (ratio > 1 + tolerance) & (n > 3), ratio < 1 - tolerance
        change = F.coalesce(F.abs(ratio - 1) > tolerance, F.lit(False)) & F.coalesce(long_ | short, F.lit(False)) if turn < rounds - 1 else F.lit(False)
        found = materialise(found.withColumns({"ratio": ratio, "open": change}), "tours")
        ended = found.filter("not open")
        done = ended if done is None else done.unionByName(ended)
        left = found.filter("open")
        if left.isEmpty():
            break
        start, end = F.get("waypoints", F.lit(0)), F.element_at("waypoints", -1)
        padding = F.array_position("bears", False)
        at = F.when(padding > 0, padding).otherwise(F.size("bears")).cast("int")
        drop = F.concat(F.slice("waypoints", 1, at), F.slice("waypoints", at + 2, n - at - 1))
        drop_bears = F.concat(F.slice("bears", 1, at - 1), F.slice("bears", at + 1, F.size("bears") - at))
        add = F.concat(F.slice("waypoints", 1, n - 1), F.slice("candidates", 1, 1), F.array(end))
        lat, lon = geo.displace(start["lat"], start["lon"], (F.col("target_km") - F.col("distance_km")) / 2, F.col("bearing"))
        pad = F.concat(F.array(start), F.array(F.struct(lat.alias("lat"), lon.alias("lon"))), F.slice("waypoints", 2, n - 1))
        more = F.size("candidates") > 0
        rest = F.slice("candidates", 2, F.greatest(F.size("candidates") - 1, F.lit(0)))
        too_long = F.col("ratio") > 1
        open_ = left.select(
            "request", F.when(too_long, drop).when(more, add).otherwise(pad).alias("waypoints"), "target_km", F.when(~too_long & more, rest).otherwise(F.col("candidates")).alias("candidates"), "bearing", *extra,
            F.when(too_long, drop_bears).when(more, F.concat("bears", F.array(F.lit(True)))).otherwise(F.concat(F.array(F.lit(False)), "bears")).alias("bears"), "routings",
        )
    assert done is not None
    failed = F.col("distance_km").isNull() | (F.col("ratio") < 1 - tolerance)
    return done.select("request", "waypoints", "distance_km", "routings", F.when(failed, "error").otherwise("success").alias("status"))
