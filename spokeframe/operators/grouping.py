"""Order-dependent grouping without putting a group into one task.

Taking the first ungrouped row, and with it all that are similar, again and again, gives the pivots that form the
first maximal independent set of the similarity graph in the rows' order, with each other row at its first pivot. Rounds
over the edge list find it: a row with no earlier open neighbour is a pivot, and its neighbours are closed. What a long
chain leaves open after ROUNDS rounds is split into its components, and those of few edges are finished by the rule itself,
a component at a time.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LONG_RIDE
from ..shared import materialise, running
from .graph import components
from .similarity import km_near, meet, with_km


#: Rounds over all edges before small components are finished by themselves, and edges of such a component.
ROUNDS, SMALL = 6, 100_000


def _greedy(edges: pd.DataFrame) -> pd.DataFrame:
    """edges of one component: a, b, oa, ob, each both ways. k, taken: pivots (taken false) and the rows they take."""
    near: dict = {}
    for a, b in zip(edges["a"], edges["b"]):
        near.setdefault(a, []).append(b)
    order = edges[["oa", "a"]].drop_duplicates().sort_values(["oa", "a"])
    taken: dict = {}
    for k in order["a"]:
        if k not in taken:
            taken[k] = False
            taken.update((n, True) for n in near[k] if n not in taken)
    return pd.DataFrame({"k": list(taken), "taken": list(taken.values())})


def _finished(live: DataFrame) -> DataFrame:
    """live: edges between open rows. Pivots and taken rows of components with SMALL edges at most."""
    named = components(live.select("a", "b"))
    of = materialise(live.join(named.select(F.col("id").alias("a"), F.col("label").alias("of")), "a"), "of")
    small = of.groupBy("of").agg(F.count("*").alias("n")).filter(F.col("n") <= 2 * SMALL).select("of")
    key = live.schema["a"].dataType.simpleString()
    return materialise(of.join(small, "of", "left_semi").groupBy("of").applyInPandas(_greedy, f"k {key}, taken boolean"), "finished")


def pivot_groups(rows: DataFrame, edges: DataFrame, key: str, order: str) -> DataFrame:
    """rows: key, order. edges: a, b, similar keys. key, pivot: the pivot that took each row; pivots have themselves."""
    rank = rows.select(F.col(key).alias("k"), F.col(order).alias("o"))
    ab = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ab = ab.join(rank.withColumnRenamed("k", "a").withColumnRenamed("o", "oa"), "a").join(rank.withColumnRenamed("k", "b").withColumnRenamed("o", "ob"), "b")
    ab = materialise(ab.filter("a <> b"), "edges")
    open_ = materialise(rank, "open")
    pivots, turn = None, 0
    while not open_.isEmpty():
        live = ab.join(open_.select(F.col("k").alias("a")), "a", "left_semi").join(open_.select(F.col("k").alias("b")), "b", "left_semi")
        if turn == ROUNDS:
            found = _finished(live)
            new, done = found.filter("not taken").select("k"), found.select("k")
            new = open_.join(new, "k", "left_semi")
        else:
            later = live.filter(F.struct("ob", "b") < F.struct("oa", "a")).select(F.col("a").alias("k")).distinct()
            new = materialise(open_.join(later, "k", "left_anti"), "pivots")
            done = live.join(new.select(F.col("k").alias("a")), "a", "left_semi").select(F.col("b").alias("k")).unionByName(new.select("k")).distinct()
        pivots = new if pivots is None else pivots.unionByName(new)
        open_ = materialise(open_.join(done, "k", "left_anti"), "open")
        turn += 1
    if pivots is None:
        return rank.select(F.col("k").alias(key), F.col("k").alias("pivot"))
    near = ab.join(pivots.select(F.col("k").alias("b")), "b", "left_semi").groupBy("a").agg(F.min(F.struct("ob", "b")).alias("first"))
    own = rank.join(pivots.select(F.col("k").alias("p")), F.col("k") == F.col("p"), "left").join(near, F.col("k") == F.col("a"), "left")
    return own.select(F.col("k").alias(key), F.when(F.col("p").isNotNull(), F.col("k")).otherwise(F.col("first.b")).alias("pivot"))


def number_groups(grouped: DataFrame, by: str, order: str) -> DataFrame:
    """grouped: pivot, `by` and order of the pivot's rows. Adds group_id, `by` with the pivot's number from 0 in the order of pivots."""
    pivots = grouped.filter(F.col(order).isNotNull()).groupBy(by, "pivot").agg(F.min(order).alias("o"))
    placed = running(pivots, [F.col("o").asc(), F.col("pivot").asc()], by=[by])
    ids = placed.select(F.col("pivot").alias("of"), F.concat_ws("_", by, F.col("place").cast("string")).alias("group_id"))
    return grouped.join(ids, F.col("pivot") == F.col("of")).drop("of")


def assign_to_groups(rows: DataFrame, similarities: DataFrame, key: str, threshold: float) -> DataFrame:
    """similarities: key, group_id, similarity. Each row's most similar group from the threshold on; of equals the first by id; null where none is."""
    best = similarities.filter(F.col("similarity") >= threshold).groupBy(key).agg(F.min(F.struct((-F.col("similarity")).alias("minus"), "group_id")).alias("best"))
    return rows.select(key).join(best, key, "left").select(key, F.col("best.group_id").alias("group_id"), (-F.col("best.minus")).alias("similarity"))


def dbscan(points: DataFrame, key: str, eps: float, least: int) -> DataFrame:
    """key, cluster of the points (key, x, y) that belong to one; a cluster is named by its first core point.

    A point with `least` neighbours within eps, itself included, is a core; cores within eps hang together; a border point goes to
    the first cluster that reaches it. Cells are so wide that all points of one are within eps of each other, so a cell with `least`
    points makes no pairs of its own: all are cores, and a chain along the cell holds them together. Points at the same place are one row
    with a weight. Other pairs are of neighbouring cells; from crowded to crowded cell they only have to tell whether any two are within eps.
    """
    width = eps / math.sqrt(2) * (1 - 1e-9)  # so much less that no rounding puts points of one cell farther apart than eps
    at = points.select(F.col(key).alias("k"), "x", "y")
    spots = at.groupBy("x", "y").agg(F.min("k").alias("s"), F.count("*").alias("w"))
    spots = spots.withColumn("cx", F.floor(F.col("x") / width)).withColumn("cy", F.floor(F.col("y") / width))
    held = spots.groupBy("cx", "cy").agg(F.sum("w").alias("held"), F.min("s").alias("head"))
    spots = materialise(spots.join(held, ["cx", "cy"]).withColumn("crowded", F.col("held") >= least), "spots")
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4]
    around_ = F.array(*[F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy"), F.lit(i == j == 0).alias("own")) for i, j in steps])
    wide = spots.select(F.col("s").alias("t"), F.col("w").alias("tw"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("head").alias("thead"), F.col("crowded").alias("tcrowded"), F.explode(around_).alias("c")).select("t", "tw", "tx", "ty", "thead", "tcrowded", "c.*")
    wide = wide.filter("not (tcrowded and own)").drop("own")
    met = meet(spots.select("s", "x", "y", "head", "crowded", "cx", "cy"), wide, ["cx", "cy"], "s", "t")
    met = met.filter(F.hypot(F.col("a.x") - F.col("b.tx"), F.col("a.y") - F.col("b.ty")) <= eps).select("a.s", "b.t", "b.tw", "a.head", "b.thead", "a.crowded", "b.tcrowded")
    # Of two crowded cells, that they touch is all that counts; their own pairs say nothing new.
    light = met.filter("not (crowded and tcrowded)").select("s", "t", "tw", "crowded", "tcrowded")
    light = materialise(light, "near")
    touching = met.filter("crowded and tcrowded and head < thead").select(F.col("head").alias("a"), F.col("thead").alias("b")).distinct()
    core = spots.filter("crowded").select("s").unionByName(light.filter("not crowded").groupBy("s").agg(F.sum("tw").alias("n")).filter(F.col("n") >= least).select("s"))
    core = materialise(core, "core")
    one, two = core, core.select(F.col("s").alias("t"))
    links = light.join(one, "s", "left_semi").join(two, "t", "left_semi").filter("s <> t").select(F.col("s").alias("a"), F.col("t").alias("b"))
    own = spots.filter("crowded and s <> head").select(F.col("s").alias("a"), F.col("head").alias("b"))
    named = components(links.unionByName(touching).unionByName(own))
    cores = core.join(named, F.col("s") == F.col("id"), "left").select("s", F.coalesce("label", "s").alias("cluster"))
    border = light.join(core, "s", "left_anti").join(cores.select(F.col("s").alias("t"), "cluster"), "t").groupBy("s").agg(F.min("cluster").alias("cluster"))
    found = cores.unionByName(border)
    return at.join(spots.select("x", "y", "s"), ["x", "y"]).join(found, "s").select(F.col("k").alias(key), "cluster")


def what_to_analyse(known: DataFrame, rides: DataFrame, key: str) -> DataFrame:
    """One row: how many rides are new and how many of the known ones are removed; hit, incremental or full analysis; a warning where a tenth is gone."""
    both = known.select(key).distinct().withColumn("old", F.lit(1)).join(rides.select(key).distinct().withColumn("now", F.lit(1)), key, "full")
    n = both.agg(F.count(F.when(F.col("old").isNull(), 1)).alias("new"), F.count(F.when(F.col("now").isNull(), 1)).alias("removed"), F.count("old").alias("before"))
    pct = F.col("removed") * 100.0 / F.greatest("before", F.lit(1))
    kind = F.when(F.col("removed") > 0, "full").when(F.col("new") > 0, "incremental").otherwise("hit")
    return n.select("new", "removed", kind.alias("analysis"), F.bround(pct, 0).alias("removed_pct"), (pct >= 10).alias("warn"))


def consolidate(rides: DataFrame, within_km: float, ratio: float = 1.25) -> DataFrame:
    """rides: activity_id, name, start_date, distance, coords. name, primary_name: groups of one name whose newest rides' paths are near become one.

    Names go in the order of their first ride, and each takes the later ones that are near, by less than within_km. Mean recorded distances may
    differ by `ratio`. A merged group has the name of most of its rides; of equals the shortest, then the first. A name without a track stays; rides without a name belong to none.
    """
    newest = F.max_by(F.struct("activity_id", "coords"), F.struct("start_date", -F.col("activity_id"))).alias("newest")
    recorded = F.avg(F.when(F.col("distance") != 0, F.col("distance"))).alias("distance")
    groups = materialise(rides.filter("name is not null").groupBy("name").agg(F.min("activity_id").alias("first"), F.count("*").alias("n"), recorded, newest), "names")
    reps = materialise(with_km(groups.filter(F.size("newest.coords") > 0).select("name", "first", "distance", F.col("newest.coords").alias("coords"))), "reps")
    apart = F.greatest("a.distance", "b.distance") / F.nullif(F.least("a.distance", "b.distance"), F.lit(0.0))
    allowed = (F.col("a.first") != F.col("b.first")) & F.coalesce(apart <= ratio, F.lit(True))
    near = materialise(km_near(reps, "name", LONG_RIDE, within_km, allowed, "first", "distance").select("a", "b"), "near")
    taken = pivot_groups(reps.select("name", "first"), near, "name", "first")
    members = groups.join(taken, "name", "left").select("name", "first", "n", F.coalesce("pivot", "name").alias("pivot"))
    primary = members.groupBy("pivot").agg(F.max_by("name", F.struct("n", -F.length("name"), -F.col("first"))).alias("primary_name"))
    return members.join(primary, "pivot").select("name", "primary_name")


def distinct_names(groups: DataFrame) -> DataFrame:
    """groups: direction, group_id, name, distance, elevation_gain, ord. Adds unique_name, different for all groups of a direction.

    Names that clash get the terrain, where that differs; then short or long, where that differs; then a number. What clashes is
    counted by aggregation, middles and numbers range by range, so a name that most groups have is spread over tasks.
    """
    per_km = F.col("elevation_gain") / (F.nullif("distance", F.lit(0.0)) / 1000.0)
    g = groups.withColumn("terrain", F.when(per_km > 30, "hilly").when(per_km > 15, "rolling").otherwise("flat"))
    key = ["direction", "name"]
    counted = _beside(g, g.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("terrain").alias("kinds")), key)
    clash = (F.col("n") > 1) & (F.col("kinds") > 1)
    g = counted.withColumn("base", F.when(clash, F.concat_ws(" — ", "name", "terrain")).otherwise(F.col("name"))).drop("n", "kinds")

    key = [*key, "base"]
    placed = _beside(running(g, [F.col("distance").asc(), F.col("ord").asc()], by=key), g.groupBy(*key).agg(F.count("*").alias("n")), key)
    middles = placed.filter(F.col("place") == F.floor(F.col("n") / 2)).select(*key, F.col("distance").alias("median"))
    g = _beside(placed.drop("place"), middles, key).withColumn("reach", F.when(F.col("distance") < F.col("median"), "short").otherwise("long"))
    g = _beside(g, g.groupBy(*key).agg(F.count_distinct("reach").alias("sides")), key)
    clash = (F.col("n") > 1) & (F.col("sides") > 1)
    g = g.withColumn("base2", F.when(clash, F.concat_ws(" — ", "base", "reach")).otherwise(F.col("base")))

    def numbered(g, name, by):
        g = running(g, [F.col("ord").asc()], by=by)
        return g.withColumn(f"{name}_numbered", F.when(F.col("place") == 0, F.col(name)).otherwise(F.concat_ws(" #", name, (F.col("place") + 1).cast("string")))).drop("place")

    g = numbered(numbered(g, "base2", [*key, "base2"]), "base2_numbered", ["direction", "base2_numbered"])
    return g.withColumnRenamed("base2_numbered_numbered", "unique_name").select(*groups.columns, "unique_name")


def _beside(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """rows with what was found for their key; nulls meet nulls."""
    renamed = found.withColumnsRenamed({c: f"__{c}" for c in key})
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(renamed, same).drop(*[f"__{c}" for c in key])
