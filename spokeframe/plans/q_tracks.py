"""Queries of track similarity, grouping, clustering, coverage and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import LONG_RIDE, EngineConfig
from ..functions import geo, polyline
from ..operators import coverage, exploration, grouping, merging, rollups, similarity
from ..operators.locations import home_and_work, endpoints
from ..registry import query
from ..shared import materialise, shared_dir
from ..sources import store
from ..sources import testdata as t
from ..streaming import incremental
from .q_functions import BEARING, HAV, SEGMENTS, TILE
from .q_rollups import geod, hav

GEOMETRY = f"""{SEGMENTS}, len AS (SELECT vec_id, sum(sqrt(pow(lat2 - lat1, 2) + pow(lon2 - lon1, 2))) AS length FROM seg WHERE lat2 IS NOT NULL GROUP BY 1),
geom AS (SELECT p.vec_id, CASE WHEN any_value(label) < 5 THEN 'w' ELSE 'h' END AS way, min(lat) AS s, min(lon) AS w, max(lat) AS n, max(lon) AS e, avg(lat) AS c_lat, avg(lon) AS c_lon, any_value(length) AS length FROM points p JOIN len USING (vec_id) GROUP BY 1),
box AS (SELECT a.vec_id AS a, b.vec_id AS b, greatest(0, least(a.n, b.n) - greatest(a.s, b.s)) * greatest(0, least(a.e, b.e) - greatest(a.w, b.w)) AS both_, least((a.n - a.s) * (a.e - a.w), (b.n - b.s) * (b.e - b.w)) AS smaller
  FROM geom a JOIN geom b ON a.way = b.way AND a.vec_id < b.vec_id WHERE greatest(a.length, b.length) / least(a.length, b.length) <= 2 AND sqrt(pow(a.c_lat - b.c_lat, 2) + pow(a.c_lon - b.c_lon, 2)) <= 2e-2),
pairs AS (SELECT a, b FROM box WHERE both_ > 0 AND both_ / smaller >= 0.3)"""

# Discrete Frechet distance of tracks of 32 points: the table of distances diagonal by diagonal, each from the two before it.
PATHS = """line AS (SELECT vec_id, list(lat ORDER BY idx) AS lat, list(lon ORDER BY idx) AS lon FROM {points} GROUP BY 1),
both_ AS (SELECT a, b, p.lat AS la, p.lon AS oa, q.lat AS lb, q.lon AS ob FROM {pairs} JOIN line p ON p.vec_id = a JOIN line q ON q.vec_id = b),
far AS (SELECT a, b, la, oa, lb, ob, list_transform(range(63), lambda k: list_transform(range(32), lambda i: CASE WHEN k - i BETWEEN 0 AND 31 THEN sqrt(pow(la[i + 1] - lb[k - i + 1], 2) + pow(oa[i + 1] - ob[k - i + 1], 2)) ELSE CAST('infinity' AS DOUBLE) END)) AS diagonals FROM both_),
path AS (SELECT a, b, list_transform(range(1, 33), lambda i: list_min(list_transform(range(1, 33), lambda j: sqrt(pow(la[i] - lb[j], 2) + pow(oa[i] - ob[j], 2))))) AS ab, list_transform(range(1, 33), lambda i: list_min(list_transform(range(1, 33), lambda j: sqrt(pow(lb[i] - la[j], 2) + pow(ob[i] - oa[j], 2))))) AS ba,
  list_reduce(diagonals, lambda acc, d: list_concat(list_transform(range(1, 33), lambda i: greatest(d[i], least(acc[i], CASE WHEN i > 1 THEN acc[i - 1] END, CASE WHEN i > 1 THEN acc[i + 31] END))), acc[1:32]))[32] AS frechet FROM far)"""
COMMUTES = """scored AS (SELECT a, b, frechet, p, 1 / (frechet * 111000 / 300 + 1) * CASE WHEN 1 / (p * 111000 / 200 + 1) < 0.5e0 THEN 0.7e0 ELSE 1 END AS similarity
  FROM (SELECT a, b, frechet, greatest(list_aggregate(ab, 'quantile_cont', 0.95e0), list_aggregate(ba, 'quantile_cont', 0.95e0)) AS p FROM path))"""


@query("J6_G9_candidate_pairs", f"WITH {GEOMETRY} SELECT a, b FROM pairs", "points")
def j6(spark, d):
    r = t.routes(spark, d)
    return similarity.candidate_pairs(r, "activity_id", ["direction"])


@query("G11_hausdorff", f"""
WITH {GEOMETRY}, d AS (SELECT a, b, p.idx AS i, q.idx AS j, sqrt(pow(p.lat - q.lat, 2) + pow(p.lon - q.lon, 2)) AS d FROM pairs JOIN points p ON p.vec_id = a JOIN points q ON q.vec_id = b),
ab AS (SELECT a, b, i, min(d) AS d FROM d GROUP BY 1, 2, 3), ba AS (SELECT a, b, j, min(d) AS d FROM d GROUP BY 1, 2, 3), x AS (SELECT a, b, quantile_cont(d, 0.95e0) AS p FROM ab GROUP BY 1, 2), y AS (SELECT a, b, quantile_cont(d, 0.95e0) AS p FROM ba GROUP BY 1, 2)
SELECT a, b, round(greatest(x.p, y.p), 8) AS deviation, round(1 / (1 + greatest(x.p, y.p) * 111000 / 200), 6) AS similarity FROM x JOIN y USING (a, b)""", "points")
def g11(spark, d):
    """By Hausdorff distance alone."""
    pairs = similarity.candidate_pairs(t.routes(spark, d), "activity_id", ["direction"], paths=True)
    found = pairs.select("a", "b", similarity.path_distances(F.col("one"), F.col("two"), frechet=False)["percentile_hausdorff"].alias("p"))
    p = F.col("p")
    return found.select("a", "b", F.round(p, 8).alias("deviation"), F.round(1.0 / (p * similarity.METRES / 200.0 + 1.0), 6).alias("similarity"))


@query("G10_G12_commute_similarity", f"WITH {GEOMETRY}, {PATHS.format(points='points', pairs='pairs')}, {COMMUTES} SELECT a, b, round(frechet, 9) AS frechet, round(p, 9) AS percentile_hausdorff, round(similarity, 7) AS similarity FROM scored", "points")
def g10(spark, d):
    found = similarity.commute_pairs(t.routes(spark, d), "activity_id", ["direction"])
    return found.select("a", "b", F.round("frechet", 9).alias("frechet"), F.round("percentile_hausdorff", 9).alias("percentile_hausdorff"), F.round("similarity", 7).alias("similarity"))


SHAPES = """wide AS (SELECT vec_id, cos(radians(avg(lat))) * 111.32e0 AS wide FROM points GROUP BY 1), km AS (SELECT vec_id, idx, lat * 111.32e0 AS lat, lon * wide AS lon FROM points JOIN wide USING (vec_id)),
step AS (SELECT vec_id, idx, lat, lon, sqrt(pow(lead(lat) OVER w - lat, 2) + pow(lead(lon) OVER w - lon, 2)) AS length, sqrt(pow(lat - first(lat) OVER w, 2) + pow(lon - first(lon) OVER w, 2)) AS out_ FROM km WINDOW w AS (PARTITION BY vec_id ORDER BY idx)),
shape AS (SELECT vec_id, sum(length) AS length, avg(lat) AS y, avg(lon) AS x, arg_max(lat, out_) AS far_y, arg_max(lon, out_) AS far_x FROM step GROUP BY 1)"""
SHAPED_ALIKE = "greatest(p.length, q.length) / least(p.length, q.length) <= 1.25e0 AND sqrt(pow(p.y - q.y, 2) + pow(p.x - q.x, 2)) <= 5 AND sqrt(pow(p.far_y - q.far_y, 2) + pow(p.far_x - q.far_x, 2)) <= 10"
LONG_RIDES = f"""{SHAPES},
reps AS (SELECT activity_id, group_id FROM (SELECT activity_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY duration, activity_id) AS rank, count(*) OVER (PARTITION BY group_id) AS n FROM routes) WHERE rank = n // 2 + 1),
met AS (SELECT p.vec_id AS a, q.vec_id AS b FROM shape p JOIN shape q ON {SHAPED_ALIKE} WHERE q.vec_id IN (SELECT activity_id FROM reps)),
{PATHS.format(points='km', pairs='met')}, near AS (SELECT a AS activity_id, group_id, (frechet + greatest(list_max(ab), list_max(ba))) / 2 AS distance_km FROM path JOIN reps ON activity_id = b)"""


def _long_rides(spark, d):
    """Every track against the representative of each group."""
    r = similarity.with_km(t.routes(spark, d))
    far = similarity.km_distances(r, rollups.representative(r), "activity_id", "group_id", LONG_RIDE)
    return far.withColumn("similarity", similarity.km_similarity(F.col("distance_km")))


@query("G8_G13_long_ride_distance", f"WITH {LONG_RIDES} SELECT activity_id, group_id, round(distance_km, 8) AS distance_km, round(1 / (distance_km * 1000 / 300 + 1), 8) AS similarity FROM near", "points routes")
def g13(spark, d):
    return _long_rides(spark, d).select("activity_id", "group_id", F.round("distance_km", 8).alias("distance_km"), F.round("similarity", 8).alias("similarity"))


@query("J7_J8_nearest_group", f"""
WITH {LONG_RIDES}, good AS (SELECT activity_id, group_id, 1 / (distance_km * 1000 / 300 + 1) AS s FROM near), best AS (SELECT activity_id, arg_min(group_id, [-s]) AS group_id, max(s) AS s FROM (SELECT * FROM good WHERE s >= 0.05e0 ORDER BY group_id) GROUP BY 1)
SELECT r.activity_id, best.group_id, round(s, 8) AS similarity FROM routes r LEFT JOIN best USING (activity_id)""", "points routes")
def j7(spark, d):
    found = grouping.assign_to_groups(t.routes(spark, d), _long_rides(spark, d), "activity_id", 0.05)
    return found.select("activity_id", "group_id", F.round("similarity", 8).alias("similarity"))


@query("X3_pivot_groups", f"""
WITH RECURSIVE {GEOMETRY}, ends AS (SELECT p.vec_id, p.lat AS y1, p.lon AS x1, q.lat AS y2, q.lon AS x2 FROM points p JOIN points q USING (vec_id) WHERE p.idx = 0 AND q.idx = 31),
close_ AS (SELECT a, b FROM pairs JOIN ends p ON p.vec_id = a JOIN ends q ON q.vec_id = b WHERE greatest(sqrt(pow(p.y1 - q.y1, 2) + pow(p.x1 - q.x1, 2)), sqrt(pow(p.y2 - q.y2, 2) + pow(p.x2 - q.x2, 2))) <= 0.00116e0),
{PATHS.format(points='points', pairs='close_')}, {COMMUTES},
earlier AS (SELECT vec_id AS v, row_number() OVER (ORDER BY vec_id) AS n, coalesce(before, []) AS before FROM geom LEFT JOIN (SELECT b AS vec_id, list(a) AS before FROM scored WHERE similarity >= 0.7e0 GROUP BY 1) USING (vec_id)),
fold(n, pivots) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.n, CASE WHEN list_has_any(o.before, pivots) THEN pivots ELSE list_append(pivots, o.v) END FROM fold JOIN earlier o ON o.n = fold.n + 1),
taken AS (SELECT v, coalesce(list_min(list_intersect(before, (SELECT arg_max(pivots, n) FROM fold))), v) AS of_ FROM earlier), placed AS (SELECT vec_id AS of_, direction, row_number() OVER (PARTITION BY direction ORDER BY vec_id) - 1 AS place FROM geom JOIN routes ON vec_id = activity_id WHERE vec_id IN (SELECT of_ FROM taken))
SELECT v AS activity_id, of_ AS "pivot", direction || '_' || place AS group_id FROM taken JOIN placed USING (of_)""", "points=twin_points routes=twin_routes")
def x3(spark, d):
    """Copies of tracks form groups of many sizes."""
    r = t.twins(spark, d)
    edges = similarity.commute_pairs(r, "activity_id", ["direction"], EngineConfig.similarity).select("a", "b")
    grouped = grouping.pivot_groups(r, edges, "activity_id", "activity_id")
    return grouping.number_groups(grouped.join(r.select("activity_id", "direction"), "activity_id"), "direction", "activity_id").select("activity_id", "pivot", "group_id")


def _named(spark, d):
    """Tracks under 40 names, with dates."""
    day = F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("activity_id") * 7 % 200).cast("int")), "yyyy-MM-dd")
    name = F.concat(F.lit("Loop "), (F.col("activity_id") % 40).cast("string"))
    return t.routes(spark, d).withColumn("start_date", day).withColumn("name", F.when(F.col("activity_id") % 41 == 0, F.concat(name, F.lit(" again"))).otherwise(name))


@query("X4_A27_consolidated_names")
def x4(spark, d):
    """Named groups whose newest tracks are near in km become one."""
    return grouping.consolidate(_named(spark, d), 2.0)


@query("X4_A27_consolidated_copies", f"""
WITH RECURSIVE {SHAPES}, named AS (SELECT activity_id AS id, distance, 'Loop ' || (activity_id // 3) || CASE WHEN activity_id % 41 = 0 THEN ' again' ELSE '' END AS name, DATE '2001-01-01' + CAST(activity_id * 7 % 200 AS INTEGER) AS day FROM routes),
per AS (SELECT name, min(id) AS first_, count(*) AS n, avg(distance) AS distance FROM named GROUP BY 1), newest AS (SELECT name, id FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY day DESC, id) AS k FROM named) WHERE k = 1), reps AS (SELECT * FROM per JOIN newest USING (name)),
met AS (SELECT x.id AS a, y.id AS b FROM reps x JOIN reps y ON x.first_ < y.first_ AND greatest(x.distance, y.distance) / least(x.distance, y.distance) <= 1.25e0 JOIN shape p ON p.vec_id = x.id JOIN shape q ON q.vec_id = y.id WHERE {SHAPED_ALIKE}),
{PATHS.format(points='km', pairs='met')}, near AS (SELECT a, b FROM path WHERE (frechet + greatest(list_max(ab), list_max(ba))) / 2 < 2),
earlier AS (SELECT first_ AS v, row_number() OVER (ORDER BY first_) AS n, coalesce(before, []) AS before FROM reps LEFT JOIN (SELECT y.first_, list(x.first_) AS before FROM near JOIN reps x ON x.id = a JOIN reps y ON y.id = b GROUP BY 1) USING (first_)),
fold(n, pivots) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.n, CASE WHEN list_has_any(o.before, pivots) THEN pivots ELSE list_append(pivots, o.v) END FROM fold JOIN earlier o ON o.n = fold.n + 1),
taken AS (SELECT v AS first_, coalesce(list_min(list_intersect(before, (SELECT arg_max(pivots, n) FROM fold))), v) AS of_ FROM earlier), best AS (SELECT of_, arg_max(name, (n, -length(name), -first_)) AS primary_name FROM taken JOIN reps USING (first_) GROUP BY 1)
SELECT name, primary_name FROM taken JOIN reps USING (first_) JOIN best USING (of_)""", "points=twin_points routes=twin_routes")
def x4_copies(spark, d):
    """Names of a few rides each, of which many are copies of one way."""
    vec = F.col("activity_id")
    name = F.concat(F.lit("Loop "), F.floor(vec / 3).cast("string"), F.when(vec % 41 == 0, " again").otherwise(""))
    day = F.date_add(F.lit("2001-01-01").cast("date"), (vec * 7 % 200).cast("int")).cast("string")
    return grouping.consolidate(t.twins(spark, d).withColumn("name", name).withColumn("start_date", day), 2.0)


def _merged(stored: str) -> str:
    """New tracks, every fifth, one after the other into the stored groups: CTE base of direction, group_id, group_ord and members."""
    return f"""
WITH RECURSIVE {GEOMETRY}, ends AS (SELECT p.vec_id, p.lat AS y1, p.lon AS x1, q.lat AS y2, q.lon AS x2 FROM points p JOIN points q USING (vec_id) WHERE p.idx = 0 AND q.idx = 31),
close_ AS (SELECT a, b FROM pairs JOIN ends p ON p.vec_id = a JOIN ends q ON q.vec_id = b WHERE greatest(sqrt(pow(p.y1 - q.y1, 2) + pow(p.x1 - q.x1, 2)), sqrt(pow(p.y2 - q.y2, 2) + pow(p.x2 - q.x2, 2))) <= 0.00116e0),
{PATHS.format(points='points', pairs='close_')}, {COMMUTES}, alike AS (SELECT a, b, similarity AS s FROM scored WHERE similarity >= 0.7e0 UNION ALL SELECT b, a, similarity FROM scored WHERE similarity >= 0.7e0),
met AS (SELECT a AS id, list(struct_pack(m := b, s := s)) AS met FROM alike GROUP BY 1), {stored},
base AS (SELECT direction, group_id, min(group_ord) AS group_ord, list(struct_pack(d := duration, age := 0, ord := activity_id) ORDER BY activity_id) AS base FROM old GROUP BY 1, 2),
known AS (SELECT direction, list(struct_pack(g := group_id, base := base) ORDER BY group_ord) AS known FROM base GROUP BY 1),
rows_ AS (SELECT activity_id AS id, direction, duration, coalesce(met, []) AS met, known, row_number() OVER (ORDER BY activity_id) AS n FROM routes LEFT JOIN met ON id = activity_id JOIN known USING (direction) WHERE activity_id % 5 = 0),
fold(n, taken) AS (SELECT CAST(0 AS BIGINT), CAST([] AS STRUCT(g VARCHAR, d BIGINT, age INTEGER, ord BIGINT)[]) UNION ALL
 SELECT n, CASE WHEN len(fit) = 0 THEN taken ELSE list_append(taken, struct_pack(g := list_filter(fit, lambda f: f.s = list_max(list_transform(fit, lambda e: e.s)))[1].g, d := duration, age := 1, ord := id)) END FROM (
  SELECT n, id, duration, taken, list_filter(list_transform(reps, lambda r: struct_pack(g := r.g, s := list_filter(met, lambda x: x.m = r.rep)[1].s)), lambda f: f.s IS NOT NULL) AS fit FROM (
   SELECT r.n, id, duration, taken, met, list_transform(known, lambda k: struct_pack(g := k.g, rep := list_sort(list_concat(k.base, list_transform(list_filter(taken, lambda x: x.g = k.g), lambda x: struct_pack(d := x.d, age := x.age, ord := x.ord))))[(len(k.base) + len(list_filter(taken, lambda x: x.g = k.g))) // 2 + 1].ord)) AS reps
   FROM fold JOIN rows_ r ON r.n = fold.n + 1))),
matched AS (SELECT unnest(taken, recursive := true) FROM (SELECT arg_max(taken, n) AS taken FROM fold)),
rest AS (SELECT id AS v, direction, row_number() OVER (ORDER BY id) AS n FROM rows_ WHERE id NOT IN (SELECT ord FROM matched)),
earlier AS (SELECT v, n, coalesce(e, []) AS e FROM rest LEFT JOIN (SELECT b AS v, list(a) AS e FROM scored WHERE similarity >= 0.7e0 AND a IN (SELECT v FROM rest) AND b IN (SELECT v FROM rest) GROUP BY 1) USING (v)),
piv(n, pivots) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.n, CASE WHEN list_has_any(o.e, pivots) THEN pivots ELSE list_append(pivots, o.v) END FROM piv JOIN earlier o ON o.n = piv.n + 1),
own AS (SELECT v, direction, coalesce(list_min(list_intersect(e, (SELECT arg_max(pivots, n) FROM piv))), v) AS of_ FROM earlier JOIN rest USING (v)),
made AS (SELECT direction, of_, row_number() OVER (PARTITION BY direction ORDER BY count(*) DESC, of_) - 1 AS k FROM own GROUP BY 1, 2),
members AS (SELECT activity_id AS id, old.direction, old.group_id, 0 AS age, 0 AS made, base.group_ord AS k FROM old JOIN base USING (direction, group_id) UNION ALL SELECT ord, r.direction, g, 1, 0, group_ord FROM matched JOIN rows_ r ON r.id = ord JOIN base ON base.group_id = g
 UNION ALL SELECT v, direction, direction || '_' || (k + (SELECT count(*) FROM base b WHERE b.direction = own.direction)), 1, 1, k FROM own JOIN made USING (direction, of_)),
g AS (SELECT direction, group_id, count(*) AS frequency, row_number() OVER (PARTITION BY direction ORDER BY count(*) DESC, min(made), min(k)) - 1 AS place, list(m.id ORDER BY duration, age, m.id)[count(*) // 2 + 1] AS rep FROM members m JOIN (SELECT activity_id AS id, duration FROM routes) USING (id) GROUP BY 1, 2)
SELECT id AS activity_id, group_id, frequency, CAST(place AS INTEGER) AS place, rep FROM members JOIN g USING (direction, group_id)"""


@query("X14_incremental_groups", _merged("old AS (SELECT *, activity_id AS group_ord FROM routes WHERE activity_id % 5 <> 0)"), "points=twin_points routes=twin_routes")
def x14(spark, d):
    """Every fifth track is new: it goes to the group with the most similar representative, which is chosen again after each; the rest form groups of their own."""
    r = t.twins(spark, d).select(F.col("activity_id").alias("id"), "direction", "group_id", F.col("activity_id").alias("ord"), "duration", "coords")
    found = merging.merge_tracks(r.filter("id % 5 <> 0"), r.filter("id % 5 = 0").drop("group_id"), EngineConfig.similarity)
    return found.select(F.col("id").alias("activity_id"), "group_id", "frequency", "place", "rep")


GROUPED = """before AS (SELECT activity_id AS v, row_number() OVER (ORDER BY activity_id) AS n, coalesce(e, []) AS e FROM routes LEFT JOIN (SELECT b AS activity_id, list(a) AS e FROM scored WHERE similarity >= 0.7e0 AND a % 5 <> 0 GROUP BY 1) USING (activity_id) WHERE activity_id % 5 <> 0),
heads(n, pivots) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT o.n, CASE WHEN list_has_any(o.e, pivots) THEN pivots ELSE list_append(pivots, o.v) END FROM heads JOIN before o ON o.n = heads.n + 1),
first_ AS (SELECT r.*, coalesce(list_min(list_intersect(e, (SELECT arg_max(pivots, n) FROM heads))), v) AS head FROM before JOIN (SELECT activity_id, direction, duration FROM routes) r ON v = activity_id),
ranked AS (SELECT direction, head, row_number() OVER (PARTITION BY direction ORDER BY count(*) DESC, head) - 1 AS group_ord FROM first_ GROUP BY 1, 2),
old AS (SELECT activity_id, direction, duration, direction || '_' || group_ord AS group_id, group_ord FROM first_ JOIN ranked USING (direction, head))"""


@query("T6_T1_kept_up_groups", _merged(GROUPED), "points=twin_points routes=twin_routes")
def t6(spark, d):
    """Four fifths of the tracks come first and are grouped, then the rest; the query starts anew for the second batch."""
    path = shared_dir(spark)
    r = t.twins(spark, d).select(F.col("activity_id").alias("id"), "direction", F.col("activity_id").alias("ord"), "duration", "coords", F.lit(False).alias("removed"))
    for part in ("id % 5 <> 0", "id % 5 = 0"):
        r.filter(part).write.mode("append").parquet(f"{path}/tracks")
        incremental.keep_up(spark.readStream.schema(r.schema).parquet(f"{path}/tracks"), f"{path}/store", f"{path}/checkpoint", EngineConfig.similarity)
    return store.read(spark, f"{path}/store").select(F.col("id").alias("activity_id"), "group_id", "frequency", "place", "rep")


# Places are few in the view: clusters are what cores reach from one to the next.
CLUSTERS = """ends AS (SELECT id * 2 AS endpoint, 'start' AS kind, start_lat AS lat, start_lon AS lon, start_local AS moment FROM activities WHERE start_lat IS NOT NULL AND start_lon IS NOT NULL
  UNION ALL SELECT id * 2 + 1, 'end', end_lat, end_lon, start_local + to_seconds(elapsed_time) FROM activities WHERE end_lat IS NOT NULL AND end_lon IS NOT NULL),
spots AS (SELECT lat, lon, min(endpoint) AS s, count(*) AS w FROM ends GROUP BY 1, 2), near AS (SELECT p.s, q.s AS t, q.w FROM spots p JOIN spots q ON sqrt(pow(p.lat - q.lat, 2) + pow(p.lon - q.lon, 2)) <= 5e-4),
core AS (SELECT s FROM near GROUP BY 1 HAVING sum(w) >= 5), links AS (SELECT s, t FROM near SEMI JOIN core USING (s) WHERE t IN (SELECT s FROM core)),
reach(s, c) AS (SELECT s, s FROM core UNION SELECT l.t, r.c FROM reach r JOIN links l ON l.s = r.s), cores AS (SELECT s, min(c) AS cluster FROM reach GROUP BY 1),
named AS (SELECT near.s, min(cluster) AS cluster FROM near JOIN cores ON cores.s = t WHERE near.s NOT IN (SELECT s FROM core) GROUP BY 1 UNION ALL SELECT s, cluster FROM cores),
clustered AS (SELECT ends.*, cluster FROM ends JOIN spots USING (lat, lon) JOIN named USING (s))"""


@query("X1_dbscan", f"WITH RECURSIVE {CLUSTERS} SELECT endpoint, cluster FROM clustered", "activities")
def x1(spark, d):
    e = endpoints(t.activities(spark, d))
    return grouping.dbscan(e.select("endpoint", F.col("lat").alias("x"), F.col("lon").alias("y")), "endpoint", 0.0005, 5)


@query("X2_A14_home_work", f"""
WITH RECURSIVE {CLUSTERS}, secs AS (SELECT *, hour(moment) * 3600 + minute(moment) * 60 + second(moment) AS seconds FROM clustered),
s AS (SELECT cluster, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, count(*) FILTER (kind = 'start') AS starts, count(*) FILTER (kind = 'end') AS ends, CAST(floor(avg(seconds) FILTER (kind = 'start')) AS BIGINT) AS departure, CAST(floor(avg(seconds) FILTER (kind = 'end')) AS BIGINT) AS arrival FROM secs GROUP BY 1),
two AS (SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS size_rank, CAST(coalesce(departure BETWEEN 21600 AND 36000, false) AS INTEGER) + CAST(coalesce(arrival BETWEEN 57600 AND 72000, false) AS INTEGER) AS homely FROM s ORDER BY n DESC, cluster LIMIT 2),
wide AS (SELECT cluster, max({geod('c.lat', 'c.lon', 'two.lat', 'two.lon')}) AS radius_m FROM clustered c JOIN two USING (cluster) GROUP BY 1)
SELECT cluster, n, round(lat, 8) AS lat, round(lon, 8) AS lon, starts, ends, departure, arrival, round(radius_m, 3) AS radius_m, homely, CASE WHEN row_number() OVER (ORDER BY homely DESC, size_rank DESC) = 1 THEN 'home' ELSE 'work' END AS place FROM two JOIN wide USING (cluster)""", "activities")
def x2(spark, d):
    found = home_and_work(t.activities(spark, d), 0.0005, 5)
    return found.withColumns({"lat": F.round("lat", 8), "lon": F.round("lon", 8), "radius_m": F.round("radius_m", 3)})


@query("X13_distinct_names", """
WITH g AS (SELECT direction, activity_id AS ord, 'Route ' || (activity_id % 40) AS name, distance, CASE WHEN elevation_gain / (distance / 1000) > 30 THEN 'hilly' WHEN elevation_gain / (distance / 1000) > 15 THEN 'rolling' ELSE 'flat' END AS terrain FROM routes),
kinds AS (SELECT direction, name, count(*) AS n, count(DISTINCT terrain) AS kinds FROM g GROUP BY ALL), a AS (SELECT g.*, CASE WHEN n > 1 AND kinds > 1 THEN name || ' — ' || terrain ELSE name END AS base FROM g JOIN kinds USING (direction, name)),
halves AS (SELECT direction, name, base, count(*) AS n, list(distance ORDER BY distance, ord)[count(*) // 2 + 1] AS middle FROM a GROUP BY ALL), b AS (SELECT a.*, n, CASE WHEN distance < middle THEN 'short' ELSE 'long' END AS reach FROM a JOIN halves USING (direction, name, base)),
sides AS (SELECT direction, name, base, count(DISTINCT reach) AS sides FROM b GROUP BY ALL), c AS (SELECT b.*, CASE WHEN n > 1 AND sides > 1 THEN base || ' — ' || reach ELSE base END AS base2 FROM b JOIN sides USING (direction, name, base)),
d AS (SELECT *, row_number() OVER (PARTITION BY direction, name, base, base2 ORDER BY ord) AS k FROM c), e AS (SELECT *, CASE WHEN k = 1 THEN base2 ELSE base2 || ' #' || k END AS numbered FROM d), f AS (SELECT *, row_number() OVER (PARTITION BY direction, numbered ORDER BY ord) AS again FROM e)
SELECT direction, ord AS group_id, name, CASE WHEN again = 1 THEN numbered ELSE numbered || ' #' || again END AS unique_name FROM f""", "routes")
def x13(spark, d):
    r = t.routes(spark, d).select("direction", F.col("activity_id").alias("group_id"), F.concat(F.lit("Route "), (F.col("activity_id") % 40).cast("string")).alias("name"), "distance", "elevation_gain", F.col("activity_id").alias("ord"))
    return grouping.distinct_names(r).select("direction", "group_id", "name", "unique_name")


@query("F31_polyline", "SELECT vec_id, idx, round(lat, 4) AS lat, round(lon, 4) AS lon FROM (SELECT vec_id, idx, floor(lat * 1e4 + 0.5e0) / 1e4 AS lat, floor(lon * 1e4 + 0.5e0) / 1e4 AS lon FROM points)", "points")
def f31(spark, d):
    """There and back again, on points of four decimals."""
    cut = lambda x: F.floor(x * 1e4 + 0.5) / 1e4
    rounded = F.transform("coords", lambda p: F.struct(cut(p["lat"]).alias("lat"), cut(p["lon"]).alias("lon")))
    back = t.tracks(spark, d).select("vec_id", polyline.decode(polyline.encode(rounded)).alias("c"))
    return back.select("vec_id", F.posexplode("c").alias("idx", "p")).select("vec_id", "idx", F.round("p.lat", 4).alias("lat"), F.round("p.lon", 4).alias("lon"))


@query("G16_K10_simplify", """
WITH RECURSIVE open_(vec_id, a, b) AS (SELECT DISTINCT vec_id, 0, 31 FROM points UNION ALL SELECT vec_id, unnest([a, m]), unnest([m, b]) FROM (
  SELECT o.vec_id, o.a, o.b, arg_max(p.idx, d) AS m, max(d) AS far FROM (SELECT o.vec_id, o.a, o.b, p.idx, abs((q.lat - s.lat) * (p.lon - s.lon) - (q.lon - s.lon) * (p.lat - s.lat)) / sqrt(pow(q.lat - s.lat, 2) + pow(q.lon - s.lon, 2)) AS d
    FROM open_ o JOIN points s ON s.vec_id = o.vec_id AND s.idx = o.a JOIN points q ON q.vec_id = o.vec_id AND q.idx = o.b JOIN points p ON p.vec_id = o.vec_id AND p.idx > o.a AND p.idx < o.b) AS o JOIN points p ON p.vec_id = o.vec_id AND p.idx = o.idx GROUP BY 1, 2, 3) WHERE far > 5e-3),
kept AS (SELECT vec_id, unnest([a, b]) AS idx FROM open_)
SELECT vec_id, lat, lon FROM (SELECT DISTINCT vec_id, idx FROM kept) JOIN points USING (vec_id, idx)""", "points")
def g16(spark, d):
    return t.tracks(spark, d).select("vec_id", F.explode(polyline.simplify(F.col("coords"), 5e-3)).alias("p")).select("vec_id", "p.lat", "p.lon")


@query("G19_out_and_back", """
WITH o AS (SELECT vec_id, lat, lon FROM points WHERE idx < 16), r AS (SELECT vec_id, idx, lat, lon FROM points WHERE idx >= 16), z AS (SELECT vec_id, 150 / 111320e0 AS dy, 150 / (111320e0 * greatest(0.01e0, abs(cos(radians(lat))))) AS dx FROM points WHERE idx = 0)
SELECT vec_id, avg(CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.vec_id = r.vec_id AND abs(o.lat - r.lat) <= dy AND abs(o.lon - r.lon) <= dx) THEN 1e0 ELSE 0e0 END) >= 0.7e0 AS out_and_back FROM r JOIN z USING (vec_id) GROUP BY 1""", "points")
def g19(spark, d):
    from ..operators.locations import out_and_back

    return t.tracks(spark, d).select("vec_id", out_and_back(F.col("coords")).alias("out_and_back"))


def _tiles(spark, d, zoom=14):
    """Tiles of tracks, with a scan order and a date."""
    return coverage.crossed_tiles(t.tracks(spark, d), zoom, "vec_id").select("x", "y", F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("vec_id") * 7 % 200).cast("int")), "yyyy-MM-dd").alias("date"))


# The tiles under each segment: crossings of grid lines in the order of their places on it, of equals the one in y first.
WALK = """u AS (SELECT vec_id, idx, (lon + 180) / 360 * {n} AS fx, (1 - asinh(tan(radians(lat))) / pi()) / 2 * {n} AS fy FROM points),
hop AS (SELECT *, CAST(floor(ax) AS BIGINT) AS x0, CAST(floor(ay) AS BIGINT) AS y0, CAST(abs(floor(bx) - floor(ax)) AS BIGINT) AS nx, CAST(abs(floor(by_) - floor(ay)) AS BIGINT) AS ny, CASE WHEN bx > ax THEN 1 ELSE -1 END AS sx, CASE WHEN by_ > ay THEN 1 ELSE -1 END AS sy
  FROM (SELECT vec_id, idx, fx AS ax, fy AS ay, lead(fx) OVER w AS bx, lead(fy) OVER w AS by_ FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY idx)) WHERE bx IS NOT NULL),
crossing AS (SELECT vec_id, idx, x0, y0, sx, sy, k, 1 AS in_x, (x0 + CASE WHEN sx > 0 THEN 1 ELSE 0 END + sx * k - ax) / (bx - ax) AS part FROM hop, LATERAL (SELECT unnest(range(nx)) AS k)
  UNION ALL SELECT vec_id, idx, x0, y0, sx, sy, k, 0, (y0 + CASE WHEN sy > 0 THEN 1 ELSE 0 END + sy * k - ay) / (by_ - ay) FROM hop, LATERAL (SELECT unnest(range(ny)) AS k)),
crossed AS (SELECT vec_id, x0 AS x, y0 AS y FROM hop UNION SELECT vec_id, CAST(x0 + sx * sum(in_x) OVER w AS BIGINT), CAST(y0 + sy * sum(1 - in_x) OVER w AS BIGINT) FROM crossing WINDOW w AS (PARTITION BY vec_id, idx ORDER BY part, in_x, k ROWS UNBOUNDED PRECEDING))"""


@query("G21_A16_W9_tile_coverage", f"WITH {WALK.format(n=2**14)} SELECT x, y, arg_min(strftime(DATE '2001-01-01' + CAST(vec_id * 7 % 200 AS INTEGER), '%Y-%m-%d'), vec_id) AS first_ridden, count(*) AS rides FROM crossed GROUP BY x, y", "points")
def a16(spark, d):
    return coverage.coverage(_tiles(spark, d))


@query("P12_A16_coverage_stats", f"""
WITH {WALK.format(n=2**14)}, b AS (SELECT CAST(floor((-8766e-2 + 180) / 360 * 16384) AS BIGINT) AS x0, CAST(floor((-8760e-2 + 180) / 360 * 16384) AS BIGINT) AS x1, CAST(floor((1 - asinh(tan(radians(4191e-2))) / pi()) / 2 * 16384) AS BIGINT) AS y0, CAST(floor((1 - asinh(tan(radians(4185e-2))) / pi()) / 2 * 16384) AS BIGINT) AS y1),
s AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT x, y FROM crossed) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) AS visited_count, (x1 - x0 + 1) * (y1 - y0 + 1) AS total_in_bounds FROM b)
SELECT visited_count, total_in_bounds, round_even(visited_count / total_in_bounds * 100, 1) AS coverage_pct FROM s""", "points")
def p12(spark, d):
    return coverage.coverage_stats(_tiles(spark, d), t.BOUNDS, 14)


@query("A16_first_visit_of_points", f"""
WITH p AS (SELECT DISTINCT vec_id, {TILE.format(n=2**14)} FROM points) SELECT x, y, arg_min(strftime(DATE '2001-01-01' + CAST(vec_id * 7 % 200 AS INTEGER), '%Y-%m-%d'), vec_id) AS first_ridden, count(*) AS rides FROM p GROUP BY x, y""", "points")
def a16p(spark, d):
    p = t.points(spark, d).select(geo.tile_x(F.col("lon"), 14).alias("x"), geo.tile_y(F.col("lat"), 14).alias("y"), F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"))
    return coverage.coverage(p.withColumn("date", F.date_format(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("id") * 7 % 200).cast("int")), "yyyy-MM-dd")))


@query("J17_J18_U4_tile_sets", f"""
WITH p AS (SELECT DISTINCT vec_id, {TILE.format(n=2**14)} FROM points), seen AS (SELECT DISTINCT x, y FROM p WHERE vec_id % 2 = 0), new AS (SELECT DISTINCT x, y FROM p WHERE vec_id % 2 = 1)
SELECT 'claimed' AS kind, x, y FROM new SEMI JOIN seen USING (x, y) UNION ALL SELECT 'new', x, y FROM new ANTI JOIN seen USING (x, y)""", "points")
def j17(spark, d):
    p = t.points(spark, d).select("vec_id", geo.tile_x(F.col("lon"), 14).alias("x"), geo.tile_y(F.col("lat"), 14).alias("y"))
    seen, new = (p.filter(f"vec_id % 2 = {k}").select("x", "y").distinct() for k in (0, 1))
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "x", "y")
    return kind(new.join(seen, ["x", "y"], "left_semi"), "claimed").unionByName(kind(new.join(seen, ["x", "y"], "left_anti"), "new"))


def _water(spark):
    corners = ((41.87, -87.64), (41.89, -87.645), (41.895, -87.62), (41.88, -87.625), (41.872, -87.615))
    ring = F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in corners])
    return spark.range(1).select(ring.alias("ring"))


WATER = """ring(i, a, b) AS (VALUES (0, 41.87e0, -87.64e0), (1, 41.89e0, -87.645e0), (2, 41.895e0, -87.62e0), (3, 41.88e0, -87.625e0), (4, 41.872e0, -87.615e0)), edge AS (SELECT r.a AS y1, r.b AS x1, q.a AS y2, q.b AS x2 FROM ring r JOIN ring q ON q.i = (r.i + 4) % 5),
b AS (SELECT CAST(floor(({west} + 180) / 360 * {n}) AS BIGINT) AS x0, CAST(floor(({east} + 180) / 360 * {n}) AS BIGINT) AS x1, CAST(floor((1 - asinh(tan(radians({north}))) / pi()) / 2 * {n}) AS BIGINT) AS y0, CAST(floor((1 - asinh(tan(radians({south}))) / pi()) / 2 * {n}) AS BIGINT) AS y1),
t AS (SELECT x, y, (degrees(atan((exp(pi() * (1 - 2 * y / {n}e0)) - exp(-pi() * (1 - 2 * y / {n}e0))) / 2)) + degrees(atan((exp(pi() * (1 - 2 * (y + 1) / {n}e0)) - exp(-pi() * (1 - 2 * (y + 1) / {n}e0))) / 2))) / 2 AS lat, (x + 0.5e0) / {n} * 360 - 180 AS lon FROM b, LATERAL (SELECT unnest(generate_series(x0, x1)) AS x), LATERAL (SELECT unnest(generate_series(y0, y1)) AS y)),
water AS (SELECT x, y FROM t, edge GROUP BY x, y, lat, lon HAVING count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1)"""


@query("J12_S13_water_tiles", f"WITH {WATER.format(n=2**17, south='4185e-2', west='-8766e-2', north='4191e-2', east='-8760e-2')} SELECT x, y FROM water")
def j12(spark, d):
    return coverage.water_tiles(coverage.all_tiles(spark, t.BOUNDS, 17), _water(spark), 17)


def _edges(spark):
    """Roads: a grid of streets, cut at their crossings."""
    i, j = F.col("i"), F.col("j")
    cells = spark.range(41).select(F.col("id").alias("i")).crossJoin(spark.range(40).select(F.col("id").alias("j")))
    lat, lon = lambda n: F.lit(41.83) + n * 25e-4, lambda n: F.lit(-87.68) + n * 25e-4
    across = cells.select((i * 100 + j).alias("edge"), lat(i).alias("lat1"), lon(j).alias("lon1"), lat(i).alias("lat2"), lon(j + 1).alias("lon2"))
    along = cells.select((10000 + i * 100 + j).alias("edge"), lat(j).alias("lat1"), lon(i).alias("lon1"), lat(j + 1).alias("lat2"), lon(i).alias("lon2"))
    return across.unionByName(along)


EDGES = """edges AS (SELECT i * 100 + j AS edge, 4183e-2 + i * 25e-4 AS lat1, -8768e-2 + j * 25e-4 AS lon1, 4183e-2 + i * 25e-4 AS lat2, -8768e-2 + (j + 1) * 25e-4 AS lon2 FROM range(41) a(i), range(40) b(j)
UNION ALL SELECT 10000 + i * 100 + j, 4183e-2 + j * 25e-4, -8768e-2 + i * 25e-4, 4183e-2 + (j + 1) * 25e-4, -8768e-2 + i * 25e-4 FROM range(41) a(i), range(40) b(j))"""
SNAPPED = """pts AS (SELECT vec_id * 100 + idx AS id, lat, lon FROM points), n AS (SELECT id, edge, greatest(0, least(1, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / nullif(pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2), 0))) AS k, lat, lon, lat1, lon1, lat2, lon2 FROM pts JOIN edges
  ON lat BETWEEN least(lat1, lat2) - 30 / 111000e0 AND greatest(lat1, lat2) + 30 / 111000e0 AND lon BETWEEN least(lon1, lon2) - 30 / 111000e0 AND greatest(lon1, lon2) + 30 / 111000e0),
d AS (SELECT id, edge, sqrt(pow(lon - (lon1 + k * (lon2 - lon1)), 2) + pow(lat - (lat1 + k * (lat2 - lat1)), 2)) AS dist FROM n), best AS (SELECT id, min(dist) AS dist FROM d WHERE dist <= 30 / 111000e0 GROUP BY 1)"""


@query("J11_snap_to_roads", f"WITH {EDGES}, {SNAPPED} SELECT id, round(dist, 9) AS distance FROM best", "points")
def j11(spark, d):
    at = t.points(spark, d).select((F.col("vec_id") * 100 + F.col("idx")).alias("id"), "lat", "lon")
    return coverage.snap(at, _edges(spark)).select("id", F.round("distance", 9).alias("distance"))


@query("A17_road_coverage", f"""
WITH {EDGES}, {SEGMENTS}, s AS (SELECT *, greatest(1, CAST(ceil({HAV} / 80) AS BIGINT)) AS steps FROM seg WHERE lat2 IS NOT NULL),
dense AS (SELECT lat1 + (lat2 - lat1) * (k / CAST(steps AS DOUBLE)) AS lat, lon1 + (lon2 - lon1) * (k / CAST(steps AS DOUBLE)) AS lon FROM s, LATERAL (SELECT unnest(range(1, steps + 1)) AS k) UNION ALL SELECT lat, lon FROM points WHERE idx = 0),
p AS (SELECT row_number() OVER () AS id, lat, lon, CAST(floor((lat - 4183e-2) / 25e-4) AS BIGINT) AS cy, CAST(floor((lon + 8768e-2) / 25e-4) AS BIGINT) AS cx FROM dense),
c AS (SELECT edges.*, CAST(round((lat1 - 4183e-2) / 25e-4) AS BIGINT) + i AS cy, CAST(round((lon1 + 8768e-2) / 25e-4) AS BIGINT) + j AS cx FROM edges, range(-1, 2) a(i), range(-1, 2) b(j)),
d AS (SELECT id, edge, lat, lon, lat1, lon1, lat2, lon2, greatest(0, least(1, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / (pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2)))) AS part FROM p JOIN c USING (cy, cx)),
best AS (SELECT id, min([sqrt(pow(lon - (lon1 + part * (lon2 - lon1)), 2) + pow(lat - (lat1 + part * (lat2 - lat1)), 2)), edge]) AS best FROM d GROUP BY 1), r AS (SELECT count(DISTINCT best[2]) AS ridden FROM best WHERE best[1] <= 30 / 111000e0)
SELECT (SELECT count(*) FROM edges) AS total_edges, ridden AS ridden_edges, (SELECT count(*) FROM edges) - ridden AS unridden_edges, round_even(ridden / (SELECT count(*) FROM edges) * 100, 1) AS coverage_pct FROM r""", "points")
def a17(spark, d):
    dense = coverage.interpolate(t.tracks(spark, d), "vec_id")
    at = dense.select(F.xxhash64("vec_id", "idx", "i").alias("id"), "lat", "lon")
    edges = _edges(spark)
    ridden = coverage.snap(at, edges).select("edge").distinct().withColumn("ridden", F.lit(1))
    all_ = edges.join(ridden, "edge", "left").agg(F.count("*").alias("total_edges"), F.coalesce(F.sum("ridden"), F.lit(0)).alias("ridden_edges"))
    return all_.select("total_edges", "ridden_edges", (F.col("total_edges") - F.col("ridden_edges")).alias("unridden_edges"), F.bround(F.col("ridden_edges") / F.greatest("total_edges", F.lit(1)) * 100, 1).alias("coverage_pct"))


AREA, ZOOM, REACH_KM = (41.80, -87.75, 41.96, -87.52), 16, 8.0


#: Every so many columns and rows of tiles count as visited where tours are to have many zones; the drawn area.
LINES, DRAWN = 7, (41.86, -87.69, 41.93, -87.60)


def _scan(spark, d, lines: int | None = None, area: tuple | None = None):
    visited = coverage.crossed_tiles(t.tracks(spark, d), ZOOM)
    if lines:
        every = coverage.all_tiles(spark, AREA, ZOOM)
        visited = visited.select("x", "y").unionByName(every.filter((F.col("x") % lines == 0) | (F.col("y") % lines == 0)))
    visited = materialise(visited.distinct(), "visited")
    water = coverage.water_tiles(coverage.all_tiles(spark, AREA, ZOOM), _water(spark), ZOOM)
    return visited, materialise(exploration.reachable(visited, water, AREA, ZOOM, t.HOME, REACH_KM, area), "reachable")


SCAN = f"""{WALK.format(n=2**16)}, {WATER.format(n=2**16, south='4180e-2', west='-8775e-2', north='4196e-2', east='-8752e-2')}, visited AS (SELECT DISTINCT x, y FROM crossed /* lines */),
near AS (SELECT x, y, lat, lon, {BEARING} AS way FROM (SELECT *, 4188e-2 AS lat1, -8763e-2 AS lon1, lat AS lat2, lon AS lon2 FROM t ANTI JOIN visited USING (x, y) ANTI JOIN water USING (x, y)) WHERE {hav('lat1', 'lon1', 'lat2', 'lon2')} / 1000 <= 8 /* area */),
found AS (SELECT x, y, lat, lon, CASE WHEN way < 90 THEN 'NE' WHEN way < 180 THEN 'SE' WHEN way < 270 THEN 'SW' ELSE 'NW' END AS quadrant FROM near)"""
SCAN_LINES = SCAN.replace("/* lines */", f"UNION SELECT x, y FROM t WHERE x % {LINES} = 0 OR y % {LINES} = 0")
SCAN_DRAWN = SCAN_LINES.replace("/* area */", f"AND lat BETWEEN {DRAWN[0]!r}e0 AND {DRAWN[2]!r}e0 AND lon BETWEEN {DRAWN[1]!r}e0 AND {DRAWN[3]!r}e0")
ZONES = """numbered AS (SELECT *, (x + CASE quadrant WHEN 'NE' THEN 1 WHEN 'SE' THEN 2 WHEN 'SW' THEN 3 ELSE 4 END * CAST(67108864 AS BIGINT)) * CAST(2147483648 AS BIGINT) + y AS tile FROM found),
beside AS (SELECT p.tile AS a, q.tile AS b FROM numbered p JOIN numbered q ON p.quadrant = q.quadrant AND p.x = q.x AND abs(p.y - q.y) = 1 UNION ALL SELECT p.tile, q.tile FROM numbered p JOIN numbered q ON p.quadrant = q.quadrant AND p.y = q.y AND abs(p.x - q.x) = 1),
filled(tile, zone) AS (SELECT tile, tile FROM numbered UNION SELECT b, zone FROM filled JOIN beside ON a = tile), zoned AS (SELECT numbered.*, zone FROM numbered JOIN (SELECT tile, min(zone) AS zone FROM filled GROUP BY 1) USING (tile))"""


@query("P20_reachable_tiles", f"WITH {SCAN} SELECT x, y, round(lat, 8) AS lat, round(lon, 8) AS lon, quadrant FROM found", "points")
def p20(spark, d):
    return _scan(spark, d)[1].withColumns({c: F.round(c, 8) for c in ("lat", "lon")})


@query("X5_G28_zones", f"WITH RECURSIVE {SCAN}, {ZONES} SELECT quadrant, zone, count(*) AS n_tiles, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon FROM zoned GROUP BY 1, 2", "points")
def x5(spark, d):
    return exploration.zones(_scan(spark, d)[1]).groupBy("quadrant", "zone").agg(F.count("*").alias("n_tiles"), F.round(F.avg("lat"), 8).alias("lat"), F.round(F.avg("lon"), 8).alias("lon"))


SCORED_ZONES = f"""
WITH RECURSIVE {{scan}}, {ZONES}, mid AS (SELECT quadrant, zone, count(*) AS n_tiles, avg(lat) AS lat, avg(lon) AS lon FROM zoned GROUP BY 1, 2), far AS (SELECT *, {hav('4188e-2', '-8763e-2', 'lat', 'lon')} / 1000 AS km FROM mid),
way AS (SELECT zone, CAST(floor((lon + 180) / 360 * 65536) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 65536) AS BIGINT) AS y FROM (
  SELECT zone, 4188e-2 + (lat - 4188e-2) * (k / CAST(steps AS DOUBLE)) AS lat, -8763e-2 + (lon + 8763e-2) * (k / CAST(steps AS DOUBLE)) AS lon FROM (SELECT *, greatest(2, CAST(round(km * 4) AS BIGINT)) AS steps FROM far), LATERAL (SELECT unnest(range(1, steps)) AS k))),
passed AS (SELECT zone, count(*) AS overlap FROM way JOIN visited USING (x, y) GROUP BY 1), sides AS (SELECT zone, x + dx AS x, y + dy AS y FROM zoned, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS side(dx, dy)),
edge_ AS (SELECT s.zone, avg(CASE WHEN v.x IS NULL THEN 0e0 ELSE 1e0 END) AS border_ratio FROM (SELECT * FROM sides ANTI JOIN zoned USING (zone, x, y)) s LEFT JOIN visited v ON v.x = s.x AND v.y = s.y GROUP BY 1),
s AS (SELECT quadrant, zone, n_tiles, km, coalesce(border_ratio, 0) AS border_ratio, coalesce(overlap, 0) AS overlap FROM far LEFT JOIN passed USING (zone) LEFT JOIN edge_ USING (zone))
SELECT quadrant, zone, n_tiles, round(km, 8) AS km, round(border_ratio, 8) AS border_ratio, overlap, CAST(row_number() OVER (PARTITION BY quadrant ORDER BY n_tiles - overlap * 0.5e0 DESC, n_tiles DESC, zone) AS INTEGER) AS place FROM s"""


@query("X7_G26_G27_zone_scores", SCORED_ZONES.format(scan=SCAN), "points")
def x7(spark, d):
    visited, tiles = _scan(spark, d)
    found = exploration.score_zones(exploration.zones(tiles), visited, ZOOM, t.HOME)
    return found.withColumns({c: F.round(c, 8) for c in ("km", "border_ratio")})


@query("X8_X9_exploration_tours")
def x8(spark, d):
    visited, tiles = _scan(spark, d)
    return exploration.tours(tiles, visited, ZOOM, t.HOME, 4 * REACH_KM)


@query("X5_zones_of_a_drawn_area", f"WITH RECURSIVE {SCAN_DRAWN}, {ZONES} SELECT quadrant, zone, count(*) AS n_tiles, round(avg(lat), 8) AS lat, round(avg(lon), 8) AS lon FROM zoned GROUP BY 1, 2", "points")
def x5_drawn(spark, d):
    """Zones between lines of visited tiles, in a drawn area."""
    tiles = _scan(spark, d, LINES, DRAWN)[1]
    return exploration.zones(tiles).groupBy("quadrant", "zone").agg(F.count("*").alias("n_tiles"), F.round(F.avg("lat"), 8).alias("lat"), F.round(F.avg("lon"), 8).alias("lon"))


@query("X7_scores_of_many_zones", SCORED_ZONES.format(scan=SCAN_LINES), "points")
def x7_lines(spark, d):
    visited, tiles = _scan(spark, d, LINES)
    found = exploration.score_zones(exploration.zones(tiles), visited, ZOOM, t.HOME)
    return found.select("quadrant", "zone", "n_tiles", F.round("km", 8).alias("km"), F.round("border_ratio", 8).alias("border_ratio"), "overlap", "place")


@query("X8_X9_tours_of_many_zones")
def x8_lines(spark, d):
    """Tours that choose among many zones."""
    visited, tiles = _scan(spark, d, LINES)
    return exploration.tours(tiles, visited, ZOOM, t.HOME, 4 * REACH_KM)


@query("A36_merged_corridors", f"""
WITH p AS (SELECT DISTINCT vec_id % 3 AS box, {TILE.format(n=2**14)} FROM points), n AS (SELECT box, count(*) * 2 AS total FROM p GROUP BY 1) SELECT (SELECT count(*) FROM (SELECT DISTINCT x, y FROM p)) AS visited_count, CAST(sum(total) AS BIGINT) AS total_in_bounds FROM n""", "points")
def a36(spark, d):
    p = t.points(spark, d).select((F.col("vec_id") % 3).alias("box"), geo.tile_x(F.col("lon"), 14).alias("x"), geo.tile_y(F.col("lat"), 14).alias("y")).distinct()
    totals = p.groupBy("box").agg((F.count("*") * 2).alias("total")).agg(F.sum("total").alias("total_in_bounds"))
    return p.select("x", "y").distinct().agg(F.count("*").alias("visited_count")).join(F.broadcast(totals))
