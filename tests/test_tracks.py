"""Operators that SQL does not express, against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spokeframe.config import COMMUTE, LONG_RIDE
from spokeframe.functions import geo, polyline
from spokeframe.operators import coverage, exploration, graph, grouping, locations, naming, rollups, similarity
from spokeframe.operators.asof import asof_join
from spokeframe.operators.ranking import runs

TRACK = "key long, coords array<struct<lat:double,lon:double>>"


def line(n, lat=41.88, lon=-87.63, step=0.001):
    return [(lat + i * step, lon + (i % 3) * step / 2) for i in range(n)]


@pytest.fixture
def spread(spark):
    """Small tables lie in many ranges too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def frame(spark, tracks):
    return spark.createDataFrame([(i, t) for i, t in enumerate(tracks)], TRACK)


def frechet(a, b):
    d = [[math.dist(p, q) for q in b] for p in a]
    f = [[0.0] * len(b) for _ in a]
    for i in range(len(a)):
        for j in range(len(b)):
            before = [f[x][y] for x, y in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if x >= 0 and y >= 0]
            f[i][j] = max(d[i][j], min(before)) if before else d[i][j]
    return f[-1][-1]


def test_distances(spark):
    rnd = random.Random(1)
    tracks = [[(rnd.random(), rnd.random()) for _ in range(rnd.randrange(1, 9))] for _ in range(12)] + [[]]
    df = frame(spark, tracks)
    both = df.select(F.col("key").alias("a"), F.col("coords").alias("x")).crossJoin(df.select(F.col("key").alias("b"), F.col("coords").alias("y")))
    for r in both.select("a", "b", similarity.path_distances(F.col("x"), F.col("y")).alias("d")).collect():
        a, b = tracks[r.a], tracks[r.b]
        if not a or not b:
            assert r.d is None or r.d.frechet is None
            continue
        ab, ba = [min(math.dist(p, q) for q in b) for p in a], [min(math.dist(p, q) for q in a) for p in b]
        assert math.isclose(r.d.frechet, frechet(a, b), abs_tol=1e-12)
        assert math.isclose(r.d.hausdorff, max(*ab, *ba), abs_tol=1e-12)
        assert math.isclose(r.d.percentile_hausdorff, max(np.percentile(ab, 95), np.percentile(ba, 95)), abs_tol=1e-12)


def test_similarity_of_equal_and_far_tracks(spark):
    df = similarity.with_km(frame(spark, [line(20), line(20), line(20, lat=42.88), line(40)]))
    a, b = df.alias("a"), df.alias("b")
    both = a.crossJoin(b).select(F.col("a.key").alias("x"), F.col("b.key").alias("y"), similarity.km_distance(F.col("a.km"), F.col("b.km")).alias("km"), similarity.passes_km(F.col("a.shape"), F.col("b.shape"), LONG_RIDE).alias("ok"), similarity.passes_km(F.col("a.shape"), F.col("b.shape"), COMMUTE).alias("near"))
    got = {(r.x, r.y): r for r in both.withColumn("s", similarity.km_similarity(F.col("km"))).collect()}
    assert got[0, 1].km == 0 and got[0, 1].s > 0.99 and got[0, 1].ok and got[0, 1].near
    assert got[0, 2].s < 0.1 and not got[0, 2].ok
    assert not got[0, 3].ok  # twice as long


def test_straight_tracks_have_no_common_area(spark):
    straight = [(41.88 + i * 0.001, -87.63) for i in range(10)]
    df = frame(spark, [straight, straight, line(10), line(10)]).withColumn("g", F.lit(1))
    assert [tuple(r) for r in similarity.candidate_pairs(df, "key", ["g"]).collect()] == [(2, 3)]


def test_candidates_meet_once_in_small_parts(spark, monkeypatch):
    """Over several cells, whose parts are cut to a few rows and points."""
    for name, value in (("PART", 5), ("POINTS", 40), ("FINE", 2), ("FEW", 3)):
        monkeypatch.setattr(similarity, name, value)
    rnd = random.Random(5)
    tracks = [[(41.88 + rnd.gauss(0, 0.03) + i * 0.002 * rnd.random(), -87.63 + rnd.gauss(0, 0.002) + i * 0.001) for i in range(rnd.choice([1, 5, 8, 30]))] for _ in range(70)]
    tracks += [[(41.88, -87.63 + i * 0.001) for i in range(4)]] * 2 + [[], None]
    df = spark.createDataFrame([(i * 7 % 79, i % 2 if i % 20 else None, t) for i, t in enumerate(tracks)], "key long, g long, coords array<struct<lat:double,lon:double>>")
    g = similarity.with_geometry(df.filter(F.size("coords") > 0))
    want = sorted((r.a, r.b) for r in g.alias("a").join(g.alias("b"), F.col("a.g") == F.col("b.g")).filter("a.key < b.key").filter(similarity.passes("a", "b")).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).collect())
    for paths in (False, True):
        assert sorted((r.a, r.b) for r in similarity.candidate_pairs(df, "key", ["g"], paths=paths).collect()) == want
    assert len(want) > 100
    assert similarity.candidate_pairs(df.limit(0), "key", ["g"]).count() == 0


def test_hausdorff_of_all_pairs_writes_no_pair(spark, monkeypatch):
    """A table of pairs with both tracks grows with the square of the tracks."""
    monkeypatch.setattr(similarity, "dealt", None)
    from spokeframe.queries import QUERIES

    assert QUERIES["G11_hausdorff"](spark, "/root/testdata/sf0.001").count() > 1000


def test_similarity_of_all_pairs_writes_no_pair(spark, monkeypatch):
    monkeypatch.setattr(similarity, "dealt", None)
    tracks = [line(6, lat=41.88 + i * 0.0001) for i in range(5)] + [line(6, lat=45.0), [], None]
    df = frame(spark, tracks).withColumn("g", F.lit(1))
    got = {(r.a, r.b): r for r in similarity.commute_pairs(df, "key", ["g"]).collect()}
    assert sorted(got) == [(i, j) for i in range(5) for j in range(i + 1, 5)]
    assert all(abs(r.frechet - frechet(tracks[a], tracks[b])) < 1e-12 and r.percentile_hausdorff <= r.frechet and 0 < r.similarity < 1 for (a, b), r in got.items())


def greedy(keys, edges):
    out, left = {}, list(keys)
    while left:
        pivot = left.pop(0)
        out[pivot] = pivot
        for k in [k for k in left if (pivot, k) in edges or (k, pivot) in edges]:
            out[k] = pivot
            left.remove(k)
    return out


def test_pivot_groups_are_the_greedy_ones(spark):
    rnd = random.Random(2)
    for n, m in ((1, 0), (30, 40), (60, 60), (40, 400)):
        order = rnd.sample(range(1000), n)
        edges = {tuple(rnd.sample(range(n), 2)) for _ in range(m)} if n > 1 else set()
        rows = spark.createDataFrame([(k, order[k]) for k in range(n)], "key long, ord long")
        pairs = spark.createDataFrame(list(edges), "a long, b long")
        got = {r.key: r.pivot for r in grouping.pivot_groups(rows, pairs, "key", "ord").collect()}
        assert got == greedy(sorted(range(n), key=order.__getitem__), edges)


def test_pivots_of_chains_and_of_components(spark, monkeypatch):
    """Chains in the order of their rows outlast the rounds; small components are finished by themselves, large ones by rounds."""
    chains = {(i, i + 1) for i in range(60) if i % 20 != 19}
    rows = spark.createDataFrame([(k, k) for k in range(61)], "key long, ord long")
    pairs = spark.createDataFrame(list(chains), "a long, b long")
    for rounds, small in ((1, 100), (2, 3)):
        monkeypatch.setattr(grouping, "ROUNDS", rounds)
        monkeypatch.setattr(grouping, "SMALL", small)
        got = {r.key: r.pivot for r in grouping.pivot_groups(rows, pairs, "key", "ord").collect()}
        assert got == greedy(range(61), chains)


def test_groups_are_numbered_in_order(spark):
    rows = [(p, "ab"[p % 2], (p * 7) % 31) for p in range(31)]
    got = grouping.number_groups(spark.createDataFrame(rows, "pivot long, way string, ord long"), "way", "ord").collect()
    want = {p: f"{w}_{k}" for w in "ab" for k, (p, *_) in enumerate(sorted((r for r in rows if r[1] == w), key=lambda r: r[2]))}
    assert {r.pivot: r.group_id for r in got} == want


def test_consolidated_names(spark):
    far = line(12, lat=43.0)
    rows = [(1, "Old", "2001-01-01", 10000.0, far), (2, "Old", "2001-01-05", 10000.0, line(12)), (3, "Longer name", "2001-01-02", 10000.0, line(12)), (4, "Longer name", "2001-01-03", 10000.0, line(12)), (5, "Long", "2001-01-03", 20000.0, line(12)), (6, "Away", "2001-01-03", 10000.0, far), (7, "No track", "2001-01-03", 10000.0, None), (8, "New", "2001-01-09", 10000.0, line(12))]
    df = spark.createDataFrame(rows, "activity_id long, name string, start_date string, distance double, coords array<struct<lat:double,lon:double>>")
    got = {r.name: r.primary_name for r in grouping.consolidate(df, 2.0).collect()}
    assert got == {"Old": "Old", "Longer name": "Old", "New": "Old", "Long": "Long", "Away": "Away", "No track": "No track"}


def test_consolidation_writes_no_pair(spark, monkeypatch):
    """Near names are those of all pairs; cells and parts are many, and names may be null."""
    for name, value in (("dealt", None), ("PART", 4), ("FINE", 2), ("FEW", 3)):
        monkeypatch.setattr(similarity, name, value)
    rnd = random.Random(3)
    tracks = [line(rnd.choice([10, 11]), lat=41.8 + rnd.choice([0, 0.05, 0.1]) + rnd.gauss(0, 0.008)) for _ in range(40)]
    rows = [(i, f"n{i}" if i != 7 else None, "2001-01-01", 1000.0 + 20 * (i % 20), t) for i, t in enumerate(tracks)]
    df = spark.createDataFrame(rows, "activity_id long, name string, start_date string, distance double, coords array<struct<lat:double,lon:double>>")
    km = similarity.with_km(df.filter("name is not null"))
    both = km.alias("a").join(km.alias("b"), F.expr("a.activity_id < b.activity_id and greatest(a.distance, b.distance) / least(a.distance, b.distance) <= 1.25"))
    near = both.filter(similarity.passes_km(F.col("a.shape"), F.col("b.shape"), LONG_RIDE)).select(F.col("a.activity_id").alias("x"), F.col("b.activity_id").alias("y"), similarity.km_distance(F.col("a.km"), F.col("b.km")).alias("d")).filter("d < 1").collect()
    want = greedy([i for i in range(40) if i != 7], {(r.x, r.y) for r in near})
    got = grouping.consolidate(df, 1.0).filter("name is not null").collect()
    alike = {}
    for r in got:
        alike.setdefault(r.primary_name, set()).add(int(r.name[1:]))
    assert sorted(map(sorted, alike.values())) == sorted(sorted(k for k, p in want.items() if p == q) for q in set(want.values())) and 1 < len(alike) < 39


def test_matches_are_those_of_all_pairs(spark):
    rnd = random.Random(11)
    tracks = [[(41.88 + rnd.gauss(0, 0.003) + i * 0.001, -87.63 + rnd.gauss(0, 0.003)) for i in range(rnd.choice([5, 8]))] for _ in range(40)] + [[], None]
    df = spark.createDataFrame([(i, i % 2, t) for i, t in enumerate(tracks)], "key long, g long, coords array<struct<lat:double,lon:double>>")
    for least in (0.3, 0.45):
        rows, others = df.filter("key < 25"), df.filter("key >= 20").withColumnRenamed("key", "other")
        got = {(r.key, r.other) for r in similarity.commute_matches(rows, others, "key", "other", ["g"], least).collect()}
        both = rows.alias("a").join(others.alias("b"), "g").select("key", "other", similarity.path_distances(F.col("a.coords"), F.col("b.coords")).alias("d"))
        want = {(r.key, r.other) for r in both.select("key", "other", similarity.commute_similarity(F.col("d.frechet"), F.col("d.percentile_hausdorff")).alias("s")).filter(F.col("s") >= least).collect()}
        assert got == want and want
        pairs = {(r.a, r.b) for r in similarity.commute_pairs(df, "key", ["g"], least).collect()}
        assert pairs == {(r.a, r.b) for r in similarity.commute_pairs(df, "key", ["g"]).filter(F.col("similarity") >= least).collect()}


def dbscan(points, eps, least):
    near = [[j for j, q in enumerate(points) if math.dist(p, q) <= eps] for p in points]
    label = {}
    for i in range(len(points)):
        if i in label or len(near[i]) < least:
            continue
        label[i], open_ = i, [i]
        while open_:
            for j in near[open_.pop(0)]:
                if j not in label:
                    label[j] = i
                    if len(near[j]) >= least:
                        open_.append(j)
    return label


def test_dbscan(spark):
    rnd = random.Random(3)
    centres = [(rnd.random(), rnd.random()) for _ in range(4)]
    points = [(x + rnd.gauss(0, 0.02), y + rnd.gauss(0, 0.02)) for x, y in centres for _ in range(30)] + [(rnd.random(), rnd.random()) for _ in range(30)]
    points += points[:5]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "key long, x double, y double")
    for eps, least in ((0.03, 5), (0.08, 4), (0.01, 2)):
        got = {r.key: r.cluster for r in grouping.dbscan(df, "key", eps, least).collect()}
        assert got == dbscan(points, eps, least)


def test_home_and_work(spark):
    rows = []
    for i in range(20):
        go = i % 2 == 0
        a, b = ((41.88, -87.63), (41.95, -87.70)) if go else ((41.95, -87.70), (41.88, -87.63))
        rows.append((i, *a, *b, f"2024-05-{i + 1:02d} {'07:30' if go else '17:00'}:00", 1800))
    df = spark.createDataFrame(rows, "id long, start_lat double, start_lon double, end_lat double, end_lon double, s string, elapsed_time long").withColumn("start_local", F.to_timestamp_ntz("s"))
    got = {r.place: (round(r.lat, 2), round(r.lon, 2)) for r in locations.home_and_work(df, 0.002, 5).collect()}
    assert got == {"home": (41.88, -87.63), "work": (41.95, -87.7)}
    ways = df.select(locations.direction(df, (41.88, -87.63), (41.95, -87.70)).alias("d")).groupBy("d").count().collect()
    assert {r.d: r["count"] for r in ways} == {"home_to_work": 10, "work_to_home": 10}


def test_distinct_names(spark, spread):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), i, rnd.choice(["River", "Hill", "River #2", None]), float(rnd.choice([0, 5000, 5000, 9000, 12000])), float(rnd.choice([10, 100, 300])), i) for i in range(80)]
    df = spark.createDataFrame(rows, "direction string, group_id long, name string, distance double, elevation_gain double, ord long").filter("name is not null")
    got = grouping.distinct_names(df).collect()
    assert len({(r.direction, r.unique_name) for r in got}) == len(got)
    assert all(r.unique_name.startswith(r.name) for r in got)


def slow_walk(a, b, zoom):
    n = 2**zoom
    at = lambda p: ((p[1] + 180) / 360 * n, (1 - math.asinh(math.tan(math.radians(p[0]))) / math.pi) / 2 * n)
    (x0, y0), (x1, y1) = at(a), at(b)
    steps = 4000
    return {(int(x0 + (x1 - x0) * i / steps), int(y0 + (y1 - y0) * i / steps)) for i in range(steps + 1)}


def test_tiles_of_tracks(spark):
    rnd = random.Random(5)
    tracks = [[(41.8 + rnd.random() * 0.05, -87.7 + rnd.random() * 0.05) for _ in range(rnd.choice([1, 2, 5]))] for _ in range(30)] + [[]]
    got = {}
    for r in coverage.crossed_tiles(frame(spark, tracks), 15, "key").collect():
        got.setdefault(r.key, set()).add((r.x, r.y))
    for i, track in enumerate(tracks):
        own = set().union(*[slow_walk(a, b, 15) for a, b in zip(track, track[1:] or track)]) if track else set()
        assert own <= got.get(i, set())
        # The walk goes from side to side, and its tiles beyond the sampled ones are those it only clips.
        assert len(got.get(i, set()) - own) <= max(1, len(own) // 50)


def test_coverage(spark):
    rows = [(1, 1, 7, 0, "2001-02-01"), (1, 1, 8, 1, "2001-01-01"), (1, 1, 7, 2, "2000-01-01"), (2, 1, 8, 1, "2001-01-01")]
    got = coverage.coverage(spark.createDataFrame(rows, "x long, y long, id long, ord long, date string")).collect()
    assert {(r.x, r.y): (r.first_ridden, r.rides) for r in got} == {(1, 1): ("2001-02-01", 2), (2, 1): ("2001-01-01", 1)}


def test_flood_fill(spark):
    rnd = random.Random(6)
    tiles = {(rnd.randrange(12), rnd.randrange(12)) for _ in range(80)}
    got = {(r.x, r.y): r.zone for r in coverage.flood_fill(spark.createDataFrame(list(tiles), "x long, y long")).collect()}
    seen = {}
    for t in tiles:
        if t not in seen:
            open_ = [t]
            seen[t] = t
            while open_:
                x, y = open_.pop()
                for s in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if s in tiles and s not in seen:
                        seen[s] = t
                        open_.append(s)
    assert len(got) == len(tiles)
    assert {(a, b): got[a] == got[b] for a in tiles for b in tiles} == {(a, b): seen[a] == seen[b] for a in tiles for b in tiles}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_snap_finds_the_nearest_edge(spark):
    rnd = random.Random(7)
    edges = [(i, *[41.88 + rnd.random() * 0.01 if k % 2 == 0 else -87.63 + rnd.random() * 0.01 for k in range(4)]) for i in range(40)]
    points = [(i, 41.88 + rnd.random() * 0.01, -87.63 + rnd.random() * 0.01) for i in range(300)]

    def far(p, e):
        (x, y), (x1, y1), (x2, y2) = (p[2], p[1]), (e[2], e[1]), (e[4], e[3])
        k = max(0, min(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return math.hypot(x - x1 - k * (x2 - x1), y - y1 - k * (y2 - y1))

    want = {p[0]: min((far(p, e), e[0]) for e in edges) for p in points}
    want = {i: e for i, (d, e) in want.items() if d <= 30 / 111_000}
    got = coverage.snap(spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(edges, "edge long, lat1 double, lon1 double, lat2 double, lon2 double")).collect()
    assert {r.id: r.edge for r in got} == want and want


def test_polyline(spark):
    points = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    text = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    assert polyline.decode_text(text) == points and polyline.encode_points(points) == text
    df = spark.createDataFrame([(text,), (None,), ("",), ("_p~iF",), ("\x01",), ("é",)], "t string")
    got = [r.c for r in df.select(polyline.decode(F.col("t")).alias("c")).collect()]
    assert [(p.lat, p.lon) for p in got[0]] == points and got[1:] == [None] * 5


def test_simplify():
    points = np.array([(0, 0), (0.5, 1e-6), (1, 0), (1, 1), (1.00001, 0.5), (1, 0)], float)
    assert polyline.kept_points(points, 5e-5).tolist() == [True, False, True, True, False, True]
    assert polyline.kept_points(np.zeros((4, 2)), 5e-5).tolist() == [True, False, False, True]


def test_interpolation_leaves_no_gap(spark):
    dense = coverage.interpolate(frame(spark, [line(5, step=0.01)]), "key").orderBy("idx", "i").collect()
    metres = [1000 * exploration.haversine_km((a.lat, a.lon), (b.lat, b.lon)) for a, b in zip(dense, dense[1:])]
    assert max(metres) <= 80.001 and (dense[-1].lat, dense[-1].lon) == line(5, step=0.01)[-1]


def test_insertion_tour():
    start = (41.88, -87.63)
    zones = [{"lat": 41.88 + a, "lon": -87.63 + b, "n_tiles": n, "km": exploration.haversine_km(start, (41.88 + a, -87.63 + b))} for a, b, n in ((0.05, 0.0, 9), (0.02, 0.02, 8), (0.03, -0.01, 1), (0.04, 0.03, 30), (0.001, 0.001, 2))]
    tour = exploration.insertion_tour(start, start, zones, 20.0, 14, set(), 0.4)
    stops = [start, *[(zones[i]["lat"], zones[i]["lon"]) for i in tour], start]
    assert max(range(5), key=lambda i: zones[i]["km"]) in tour and len(set(tour)) == len(tour)
    assert sum(map(exploration.haversine_km, stops, stops[1:])) <= 23.0
    assert exploration.insertion_tour(start, start, [], 20.0, 14, set(), 0.4) == []


def test_tours_from_tiles(spark):
    visited = spark.createDataFrame([(x, y) for x in range(4200, 4203) for y in range(6090, 6093)], "x long, y long")
    water = spark.createDataFrame([], "x long, y long")
    start = (41.88, -87.63)
    tiles = exploration.reachable(visited, water, (41.7, -87.9, 42.05, -87.4), 14, start, 10.0)
    zoned = exploration.zones(tiles)
    assert zoned.count() == tiles.count()
    for r in exploration.tours(zoned, visited, 14, start, 40.0).collect():
        at = (r.lat, r.lon)
        degrees = geo_bearing(start, at)
        assert r.quadrant in exploration.QUADRANTS and exploration.haversine_km(start, at) < 14 and 0 <= degrees < 360


def test_loops_take_the_next_quadrant(spark):
    start, none = (41.88, -87.63), spark.createDataFrame([], "x long, y long")
    at = coverage.centres(spark.createDataFrame([(4205, y) for y in range(6086, 6098)], "x long, y long"), 14)
    tiles = at.withColumn("quadrant", geo.quadrant(geo.bearing(F.lit(start[0]), F.lit(start[1]), F.col("lat"), F.col("lon"))))
    sides = {r.quadrant: r["count"] for r in tiles.groupBy("quadrant").count().collect()}
    assert set(sides) == {"NE", "SE"}
    found = lambda **more: {(r.quadrant, r.n_tiles) for r in exploration.tours(exploration.zones(tiles), none, 14, start, 40.0, **more).collect()}
    assert found() == {("NE", 12), ("SE", sides["SE"])}
    assert found(shape="out_and_back") == found(end=(41.9, -87.6)) == set(sides.items())


def test_tours_of_two_grids_and_wind(spark):
    start, none = (41.88, -87.63), spark.createDataFrame([], "x long, y long")
    grid = lambda zoom, xy: exploration.zones(coverage.centres(spark.createDataFrame(xy, "x long, y long"), zoom).withColumn("quadrant", F.lit("NE")))
    one, two = grid(14, [(4208, 6086), (4208, 6087), (4212, 6084)]), grid(15, [(8424, 12180), (8425, 12180)])
    go = lambda **more: [(r.zoom, r.lat, r.lon) for r in sorted(exploration.tours(one, none, 14, start, 80.0, second=(two, none, 15), **more).collect(), key=lambda r: r.stop)]
    plain = go()
    assert {z for z, _, _ in plain} == {14, 15}
    for degrees in (0.0, 90.0, 180.0, 270.0):
        turned = go(wind=(20.0, degrees))
        ahead = [exploration.headwind((20.0, degrees), start, p[1:]) for p in (plain[0], plain[-1])]
        assert turned == (plain[::-1] if ahead[1] > ahead[0] else plain)


def geo_bearing(a, b):
    la, lb, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return math.degrees(math.atan2(math.sin(d) * math.cos(lb), math.cos(la) * math.sin(lb) - math.sin(la) * math.cos(lb) * math.cos(d))) % 360


def test_asof(spark, spread):
    """One key has half of all rows, which lie in many ranges; times tie; keys may be null and may be unknown to either side."""
    rnd = random.Random(8)
    pick = lambda: rnd.choice(["a", "a", "a", "b", "c", None])
    asked = [(k, pick(), rnd.randrange(90)) for k in range(400)] + [(900, "d", 5), (901, "a", None)]
    known = [(1000 + k, pick(), rnd.randrange(10, 90, 3)) for k in range(60)] + [(2000, "e", 1)]
    a, b = spark.createDataFrame(asked, "id long, key string, at long"), spark.createDataFrame(known, "v long, key string, at long")
    got = {r.id: (r.v, r.found_at) for r in asof_join(a, b, "key", "at", ["v"]).collect()}
    want = {i: max(((at, v) for v, kk, at in known if kk == k and t is not None and at <= t), default=(None, None))[::-1] for i, k, t in asked}
    assert got == want
    assert asof_join(a.limit(0), b, "key", "at", ["v"]).count() == 0
    assert {r.v for r in asof_join(a, b.limit(0), "key", "at", ["v"]).collect()} == {None}


def test_members(spark, spread):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["x", "x", "x", "y", None]), rnd.randrange(40)) for i in range(500)]
    got = {r.id: (r.uses, r.place) for r in rollups.members(spark.createDataFrame(rows, "id long, name string, at long"), "name", [F.col("at").desc(), F.col("id").asc()]).collect()}
    for name in ("x", "y", None):
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in own] == [(len(own), k) for k in range(len(own))]


def test_runs(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(["a", "a", None, None, "b", "a"])], "key long, ord long, street string")
    got = [(r.run, r.street, r.points) for r in runs(df, "key", ["ord"], "street").orderBy("run").collect()]
    assert got == [(1, "a", 2), (2, None, 2), (3, "b", 1), (4, "a", 1)]


def test_route_types(spark):
    out = [(41.88 + 0.002 * i, -87.63) for i in range(10)]
    ring = [(41.88 + 0.02 * math.sin(a / 3), -87.63 + 0.02 * (1 - math.cos(a / 3))) for a in range(19)] + [(41.88, -87.63)]
    df = frame(spark, [out + out[::-1], ring, out, out[:2]])
    got = [r.t for r in df.select("key", geo.route_type(F.col("coords")).alias("t")).orderBy("key").collect()]
    assert got == ["out-and-back", "loop", "point-to-point", "point-to-point"]
    flags = [r.o for r in df.select("key", locations.out_and_back(F.col("coords")).alias("o")).orderBy("key").collect()]
    assert flags == [True, False, False, False]


def test_points_for_names(spark):
    """The turn is sampled, commutes get more points, the middle is that of the way."""
    street = [(41.9 + i * 1e-4, -87.6) for i in range(101)] + [(41.91, -87.6 + i * 1e-3) for i in range(1, 100)]
    short = street[:7]
    df = spark.createDataFrame([(1, street, "home_to_work"), (2, street, None), (3, short, None)], "key long, coords array<struct<lat:double,lon:double>>, direction string")
    got = {}
    for r in naming.sample_points(df, "key").collect():
        got.setdefault(r.key, []).append(r.idx)
    steps = [1000 * exploration.haversine_km(a, b) for a, b in zip(street, street[1:])]
    middle = next(i for i in range(200) if sum(steps[:i]) >= sum(steps) / 2)
    for key, n in ((1, 20), (2, 10)):
        chosen = [0, 100, 199, middle]
        step = 200 // (n - len(chosen) + 1)
        fill = [i for i in range(step, 200 - step, step) if i not in chosen][: n - len(chosen)]
        assert sorted(got[key]) == sorted(chosen + fill)[:n]
    assert sorted(got[3]) == list(range(7))


def test_modes_order_equal_zones(spark):
    """Zones of equal scores by each mode's own measure."""
    start, zoom = (41.88, -87.63), 14
    cx, cy = 4204, 6090
    tiles = [(cx + 6, cy - 3), (cx + 6, cy - 4), (cx + 10, cy - 8), (cx + 11, cy - 8), (cx + 3, cy - 9), (cx + 3, cy - 10)]
    zoned = exploration.zones(coverage.centres(spark.createDataFrame(tiles, "x long, y long"), zoom).withColumn("quadrant", F.lit("NE")))
    visited = spark.createDataFrame([(cx + 12, cy - 8), (cx + 10, cy - 9), (cx + 3, cy - 11)], "x long, y long")
    key = {"tiles": lambda r: -r.n_tiles, "efficiency": lambda r: -r.n_tiles / max(r.km, 0.1), "frontier": lambda r: (r.border_ratio, -r.n_tiles), "infill": lambda r: (-r.border_ratio, r.km)}
    for mode, own in key.items():
        rows = exploration.score_zones(zoned, visited, zoom, start, mode).orderBy("place").collect()
        assert len(rows) == 3 and rows == sorted(rows, key=lambda r: (-(r.n_tiles - r.overlap * 0.5), own(r), r.zone))
    assert len({r.border_ratio for r in rows}) == 3


def test_workout_rules(spark):
    """What a workout asks, and what weather decides, on the cases that the rules are known by."""
    from spokeframe.operators import workouts

    rows = [(1, "Endurance", 120, 150), (2, "Endurance", None, None), (3, "Threshold", 60, 0), (4, "VO2Max", 45, 101), (5, "Recovery", 90, 100), (6, "Group Ride", 0, None), (7, None, 50, 120)]
    df = spark.createDataFrame(rows, "id long, workout_type string, duration_minutes long, tss long")
    got = {r.id: (r.min_minutes, r.max_minutes, r.intensity, r.indoor_preferred, len(r.notes)) for r in workouts.constraints(df).collect()}
    assert got == {1: (120, 150, "low", False, 2), 2: (60, 90, "low", False, 1), 3: (None, None, "high", True, 1), 4: (None, None, "high", True, 2), 5: (None, 45, "very_low", False, 1), 6: (60, 120, "moderate", False, 1), 7: (None, None, None, False, 1)}
    weather = [(False, 35.4, 0.0), (False, 50.0, 1.0), (True, 70.5, 0.0), (True, None, 9.0), (False, 20.0, 2.0), (False, 40.0, None)]
    df = spark.createDataFrame([(i, *w) for i, w in enumerate(weather)], "id long, p boolean, f double, mm double")
    found = [tuple(r.x) for r in df.select("id", workouts.indoor_decision(F.col("p"), F.col("f"), F.col("mm")).alias("x")).orderBy("id").collect()]
    cold = "35°F is below your 40°F minimum"
    assert found == [(True, cold, f"Indoor recommended: {cold}"), (True, "precipitation detected", "Indoor recommended: precipitation detected"), (False, None, "Weather is suitable for outdoor riding (70°F, dry)"), (True, None, None), (True, "20°F is below your 40°F minimum and precipitation detected", "Indoor recommended: 20°F is below your 40°F minimum and precipitation detected"), (False, None, None)]
    allowed = df.select(workouts.indoor_decision(F.col("p"), F.col("f"), F.col("mm"), 10, True).alias("x")).collect()
    assert [r.x.indoors for r in allowed] == [False, False, False, True, False, False]
    flags = spark.createDataFrame([("Endurance", 30, 60, False), ("Endurance", 30, 60, True), ("VO2Max", 30, 60, False), ("Endurance", 60, 60, False), (None, 30, 60, False), ("Endurance", 30, None, False)], "k string, m long, lo long, i boolean")
    assert [r.x for r in flags.select(workouts.extended(F.col("k"), F.col("m"), F.col("lo"), F.col("i")).alias("x")).collect()] == [True, False, False, False, True, False]


def test_geodesic_distance(spark):
    """Against Vincenty's iteration on the ellipsoid, and a published length."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)

    def vincenty(lat1, lon1, lat2, lon2):
        across = math.radians(lon2 - lon1)
        u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
        lam = across
        for _ in range(200):
            sin_s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
            if sin_s == 0:
                return 0.0
            cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
            s = math.atan2(sin_s, cos_s)
            sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
            cos2 = 1 - sin_a**2
            mid = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
            c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
            new = across + (1 - c) * f * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            done, lam = abs(new - lam) < 1e-13, new
            if done:
                break
        u = cos2 * (a**2 - b**2) / b**2
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = big_b * sin_s * (mid + big_b / 4 * (cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        return b * big_a * (s - d)

    rng = np.random.default_rng(3)
    near = [(y, x, y + dy, x + dx) for y, x, dy, dx in zip(*(v.tolist() for v in (rng.uniform(-80, 80, 200), rng.uniform(-179, 179, 200), rng.normal(0, 0.05, 200), rng.normal(0, 0.05, 200))))]
    rows = [*near, (41.88, -87.63, 41.88, -87.63), (-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777), (40.0, -75.0, 51.5, 0.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(geo.geodesic_m(*[F.col(c) for c in "abcd"])).collect()]
    want = [vincenty(*r) for r in rows]
    assert all(abs(x - y) <= 1e-5 * y + 1e-6 for x, y in zip(got, want))
    assert abs(got[-2] - 54972.271) < 0.1 and got[-3] == 0
