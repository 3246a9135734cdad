"""Routes against Dijkstra's algorithm, refined tours against a plain loop."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spokeframe.operators import routing, stops

PIECES = "lat1 double, lon1 double, lat2 double, lon2 double, profiles array<string>"
REQUESTS = "request long, waypoints array<struct<lat:double,lon:double>>, surface string, note string"


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def grid(n=6, gaps=()):
    """Streets between crossings 0.003 degrees apart, without those in gaps."""
    at = lambda i, j: (41.0 + i * 0.003, -87.0 + j * 0.003)
    found = [(at(i, j), at(i + a, j + b)) for i in range(n) for j in range(n) for a, b in ((0, 1), (1, 0)) if i + a < n and j + b < n]
    return [e for k, e in enumerate(found) if k not in gaps]


def dijkstra(edges, start):
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    best, heap = {}, [(0.0, start)]
    while heap:
        d, at = heapq.heappop(heap)
        if at not in best:
            best[at] = d
            for b in near.get(at, []):
                heapq.heappush(heap, (d + metres(at, b), b))
    return best


def plain(edges, waypoints, reach=routing.SNAP_M):
    nodes = sorted({p for e in edges for p in e}, key=lambda p: (p[0], p[1]))
    found = []
    for w in waypoints:
        near = min(((metres(w, n), n) for n in nodes), default=None) if None not in w else None
        found.append(near[1] if near and near[0] <= reach else None)
    if found[0] is None:
        return "error", None
    home = dijkstra(edges, found[0])
    if found[-1] not in home:
        return "error", None
    kept = [n for n in found if n in home]
    total = sum(dijkstra(edges, a)[b] for a, b in zip(kept, kept[1:]))
    return "success", total / 1000


def test_routes(spark):
    rnd = random.Random(5)
    island = [((43.0 + i * 0.003, -87.0), (43.0 + (i + 1) * 0.003, -87.0)) for i in range(3)]
    roads = grid(6, gaps=set(rnd.sample(range(60), 14)))
    mountain = roads[::2]
    pieces = [(*a, *b, ["cycling-regular"] + (["cycling-mountain"] if (a, b) in mountain else [])) for a, b in roads] + [(*a, *b, ["cycling-regular"]) for a, b in island]
    pieces += pieces[:3] + [(41.0, -87.0, 41.0, -87.0, ["cycling-regular"])]  # roads that are there twice, and one without a length
    some = lambda: (41.0 + rnd.randrange(6) * 0.003 + rnd.uniform(-1e-3, 1e-3), -87.0 + rnd.randrange(6) * 0.003 + rnd.uniform(-1e-3, 1e-3))
    asked = [[some() for _ in range(rnd.randrange(2, 6))] for _ in range(25)]
    asked += [[some(), (43.003, -87.0), some()], [some(), (50.0, 1.0), some()], [(50.0, 1.0), some()], [some(), (43.0, -87.0)], [(43.0, -87.0), some(), (43.009, -87.0)], [some(), (None, None), some()]]
    same = some()
    asked += [[same, same], [same, some(), same]]
    surfaces = ["any", "paved", "unpaved", None]
    rows = [(i, w, surfaces[i % 4], "x") for i, w in enumerate(asked)] + [(100, asked[0], "any", "y"), (101, asked[1], "any", "z")]
    got = {r.request: r for r in routing.routed(spark.createDataFrame(rows, REQUESTS), spark.createDataFrame(pieces, PIECES)).collect()}
    assert len(got) == len(rows)
    regular = [*roads, *island]
    for i, w, surface, _ in rows[:-2]:
        status, km = plain(mountain if surface == "unpaved" else regular, [tuple(None if x is None else round(x, 6) for x in p) for p in w])
        assert got[i].status == status, (i, w)
        assert got[i].distance_km is None if km is None else abs(got[i].distance_km - km) <= 0.0051, (i, got[i], km)
        assert (got[i].nodes is None) == (km is None)
    assert got[25].dropped == got[26].dropped == 1 and got[100].distance_km == got[0].distance_km
    for r in got.values():
        for a, b in zip(r.nodes or [], (r.nodes or [])[1:]):
            assert a == b or any({a, b} == {node(*p), node(*q)} for p, q in regular)


def node(lat, lon):
    return round((lat + 90) * 1e6) * 400_000_000 + round((lon + 180) * 1e6)


def test_no_roads_and_no_requests(spark):
    requests = spark.createDataFrame([(1, [(41.0, -87.0), (41.1, -87.0)], "any", "")], REQUESTS)
    got = routing.routed(requests, spark.createDataFrame([], PIECES)).collect()
    assert [(r.status, r.distance_km) for r in got] == [("error", None)]
    pieces = spark.createDataFrame([(*a, *b, ["cycling-regular"]) for a, b in grid(3)], PIECES)
    assert routing.routed(requests.limit(0), pieces).count() == 0


def displaced(lat, lon, km, bearing):
    d, b, a = km / 6371, math.radians(bearing), math.radians(lat)
    lat2 = math.asin(math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(b))
    return math.degrees(lat2), math.degrees(math.radians(lon) + math.atan2(math.sin(b) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(lat2)))


def refine(w, target, more, bearing, rounds=6):
    w, more, bears, turns = list(w), list(more), [True] * (len(w) - 2), 0
    while True:
        km = sum(metres(a, b) for a, b in zip(w, w[1:])) / 1000
        turns += 1
        if abs(km / target - 1) <= 0.15 or turns == rounds:
            break
        if km > target:
            if len(w) <= 3:
                break
            at = bears.index(False) if False in bears else len(bears) - 1
            del w[1 + at], bears[at]
        elif more:
            w.insert(len(w) - 1, more.pop(0))
            bears.append(True)
        else:
            w.insert(1, displaced(*w[0], (target - km) / 2, bearing))
            bears.insert(0, False)
    return w, km, turns, "error" if km / target < 0.85 else "success"


def test_refined_tours(spark):
    rnd = random.Random(11)
    some = lambda: (41.9 + rnd.uniform(-0.1, 0.1), -87.6 + rnd.uniform(-0.1, 0.1))
    tours = []
    for i in range(1000):
        start = some()
        tours.append((i, [start, *(some() for _ in range(rnd.randrange(5))), start if i % 3 else some()], rnd.uniform(2, 90), [some() for _ in range(rnd.randrange(4))], rnd.uniform(0, 360), "x"))
    schema = "request long, waypoints array<struct<lat:double,lon:double>>, target_km double, candidates array<struct<lat:double,lon:double>>, bearing double, surface string"
    got = {r.request: r for r in routing.refined(spark.createDataFrame(tours, schema)).collect()}
    assert len(got) == 1000
    seen = set()
    for i, w, target, more, bearing, _ in tours:
        path, km, turns, status = refine(w, target, more, bearing)
        r = got[i]
        assert (r.status, r.routings, len(r.waypoints)) == (status, turns, len(path)), i
        assert abs(r.distance_km - km) < 1e-6 and all(abs(p.lat - q[0]) < 1e-9 and abs(p.lon - q[1]) < 1e-9 for p, q in zip(r.waypoints, path))
        seen.add((status, turns))
    assert {s for s, _ in seen} == {"success", "error"} and {t for _, t in seen} >= {1, 2, 3, 6}


def test_tours_over_roads(spark):
    """Refinement with routing over roads: a tour that cannot be routed is an error."""
    pieces = spark.createDataFrame([(*a, *b, ["cycling-regular"]) for a, b in grid(8)], PIECES)
    at = lambda i, j: (41.0 + i * 0.003, -87.0 + j * 0.003)
    schema = "request long, waypoints array<struct<lat:double,lon:double>>, target_km double, candidates array<struct<lat:double,lon:double>>, bearing double, surface string"
    rows = [(1, [at(0, 0), at(1, 1), at(0, 0)], 3.5, [at(3, 3)], 0.0, "any"), (2, [(50.0, 1.0), at(0, 0)], 5.0, [], 0.0, "any")]
    got = {r.request: r for r in routing.refined(spark.createDataFrame(rows, schema), lambda tours: routing.routed(tours, pieces)).collect()}
    assert (got[1].status, len(got[1].waypoints)) == ("success", 4) and 2.9 < got[1].distance_km < 4.1 and got[2].status == "error"


@pytest.mark.parametrize("lat,lon", [(41.88, -87.63), (-33.0, 151.2), (0.0, 0.0), (-89.9999, -179.9999)])
def test_nodes_are_told_apart(spark, lat, lon):
    rows = [(lat + i * 1e-6, lon + j * 1e-6) for i in range(3) for j in range(3)]
    found = spark.createDataFrame(rows, "lat double, lon double").select(routing.node_of(F.col("lat"), F.col("lon")).alias("n")).collect()
    assert len({r.n for r in found}) == 9


def test_orders_of_stops(spark):
    """Few stops against all permutations, many against the loop that takes the nearest."""
    rnd = random.Random(6)
    some = lambda: (41.9 + rnd.uniform(-0.1, 0.1), -87.6 + rnd.uniform(-0.1, 0.1))
    length = lambda line: sum(metres(a, b) for a, b in zip(line, line[1:])) / 1000
    rows = []
    for i in range(60):
        start = some()
        rows.append((i, start, [some() for _ in range(i % 8)], start if i % 3 else some(), "x"))
    rows += [(100, some(), [rows[5][1]] * 3, some(), "x"), (101, some(), [some() for _ in range(8)], some(), "x"), (102, some(), [some() for _ in range(15)], some(), "x")]
    point = "struct<lat:double,lon:double>"
    df = spark.createDataFrame(rows, f"tour long, start {point}, stops array<{point}>, end {point}, note string")
    got = {r.tour: r for r in stops.ordered(df).collect()}
    assert len(got) == len(rows)
    for i, start, points, end, _ in rows:
        r = got[i]
        assert sorted(r.places) == list(range(len(points))) and r.note == "x"
        path = [start, *(points[k] for k in r.places), end]
        assert abs(r.km - length(path)) < 1e-9
        if len(points) <= 8:
            assert abs(r.km - min(length([start, *p, end]) for p in itertools.permutations(points))) < 1e-9
        else:
            here, left, want = start, list(range(len(points))), []
            while left:
                k = min(left, key=lambda j: (metres(here, points[j]), j))
                left.remove(k)
                want.append(k)
                here = points[k]
            assert r.places == want
    assert stops.ordered(df.limit(0)).count() == 0


def test_orders_of_stops_join_nothing(spark):
    """A small file may hold many tours: joins of them were broadcast, through the driver. Equal stops keep their places."""
    point = "struct<lat:double,lon:double>"
    at = (41.9, -87.6)
    df = spark.createDataFrame([(1, at, [at, at, (41.95, -87.6), at], at), (2, at, [], at), (3, at, None, at), (4, at, [(None, None), at], at)], f"tour long, start {point}, stops array<{point}>, end {point}")
    found = stops.ordered(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    got = {r.tour: r.places for r in found.collect()}
    assert (got[1], got[2], got[3]) == ([0, 1, 2, 3], [], []) and sorted(got[4]) == [0, 1]
