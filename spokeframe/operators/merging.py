"""New tracks merged into stored groups one after the other, without going through them one after the other.

The rule is sequential: each new track goes to the group with the most similar representative, and the group's representative, the
middle by duration, is chosen again before the next track comes. Rounds find the same result: all decisions are guessed, each
group's representative at the time of each track follows from the guess, and all decisions are made anew with those. A
decision whose predecessors are right is right in the next round, so when a round changes nothing, it is what the sequence gives. Most tracks
do not depend on which member represents their group, so a few rounds do.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialise
from .grouping import pivot_groups
from .similarity import _ends_within, around, commute_pairs, commute_similarity, dealt, in_cells, passes, path_distances, reach_of, with_geometry

FOUND = "group_id string, age int, ord long, middle long, occurrence long"


class Middle:
    """Counts by duration, in a tree of sums; tells the middle one."""

    def __init__(self, durations: list[int], counts: dict[int, int]) -> None:
        self.values = sorted(durations)
        self.place = {d: i + 1 for i, d in enumerate(self.values)}
        self.sums = [0] * (len(self.values) + 1)
        self.n, self.top = 0, 1 << len(self.values).bit_length()
        for d, n in counts.items():
            self.add(d, n)

    def add(self, duration: int, n: int = 1) -> None:
        at = self.place[duration]
        self.n += n
        while at < len(self.sums):
            self.sums[at] += n
            at += at & -at

    def find(self) -> tuple[int, int] | None:
        """The duration of the upper middle, and which of its occurrences, from 0."""
        if not self.n:
            return None
        at, left, step = 0, self.n // 2, self.top
        while step:
            if at + step < len(self.sums) and self.sums[at + step] <= left:
                at += step
                left -= self.sums[at]
            step >>= 1
        return self.values[at], left


def _middles(events: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
    """events of one group and range: age, ord, asks, duration. before: how often each duration comes in the ranges before."""
    counts = dict(zip(before["duration"].tolist(), before["n"].tolist()))
    events = events.sort_values(["age", "ord", "asks"], ascending=[True, True, False])
    own = [int(d) for d in events["duration"].dropna().tolist()]
    tree, out = Middle(list({*own, *counts}), counts), []
    for age, at, asks, duration in zip(events["age"].tolist(), events["ord"].tolist(), events["asks"].tolist(), events["duration"].tolist()):
        if asks:
            found = tree.find()
            out.append((age, at, *(found or (None, None))))
        else:
            tree.add(int(duration))
    found = pd.DataFrame(out, columns=["age", "ord", "middle", "occurrence"]).astype({"middle": "Int64", "occurrence": "Int64"})
    found.insert(0, "group_id", events["group_id"].iloc[0] if len(events) else None)
    return found


def representatives_at(members: DataFrame, asks: DataFrame) -> DataFrame:
    """members: group_id, age, ord, duration, id. asks: group_id, age, ord. Adds rep: the group's middle member by duration, then by age and ord, among those before the moment; null where there is none.

    Events are dealt out by ranges of moments. What each range starts with is a count a duration, summed over the ranges before it, so a group
    of any size is spread over its ranges, and a task holds a range and the group's different durations.
    """
    asks = asks.select("group_id", "age", "ord").distinct()
    events = members.select("group_id", "age", "ord", F.lit(False).alias("asks"), F.col("duration").cast("long").alias("duration")).unionByName(asks.withColumns({"asks": F.lit(True), "duration": F.lit(None).cast("long")}))
    ranged = materialise(events.repartitionByRange("group_id", "age", "ord").withColumn("range", F.spark_partition_id()), "events")
    last = ranged.groupBy("group_id").agg(F.max("range").alias("last"))
    own = ranged.filter("not asks").groupBy("group_id", "duration", "range").agg(F.count("*").alias("n"))
    w = Window.partitionBy("group_id", "duration").orderBy("range")
    sums = own.select("group_id", "duration", "range", F.sum("n").over(w).alias("n"), F.lead("range").over(w).alias("next")).join(last, "group_id")
    until = F.coalesce("next", "last")
    before = materialise(sums.filter(until > F.col("range")).select("group_id", F.explode(F.sequence(F.col("range") + 1, until)).alias("range"), "duration", "n"), "before")
    found = ranged.groupBy("group_id", "range").cogroup(before.groupBy("group_id", "range")).applyInPandas(_middles, FOUND)
    nth = (F.row_number().over(Window.partitionBy("group_id", "duration").orderBy("age", "ord")) - 1).cast("long")
    numbered = members.select("group_id", F.col("duration").cast("long").alias("middle"), nth.alias("occurrence"), F.col("id").alias("rep"))
    return found.join(numbered, ["group_id", "middle", "occurrence"], "left").select("group_id", "age", "ord", "rep")


def _starts(tracks: DataFrame, within: float) -> DataFrame:
    c = F.col("coords")
    shapes = with_geometry(tracks.filter(F.size(c) > 0)).withColumns({"first": F.get(c, F.lit(0)), "last": F.element_at(c, -1)})
    return in_cells(shapes.withColumns({"y": F.col("first.lat"), "x": F.col("first.lon")}), "y", "x", within).drop("y", "x")


def _decisions(new: DataFrame, members: DataFrame, shapes: DataFrame, order: DataFrame, least: float, within: float) -> DataFrame:
    """id, group_id: the group whose representative at the track's moment is most similar; of equals the group that comes first. Tracks without one are left out."""
    held = members.join(shapes.select("id", "direction", "cy", "cx"), "id").select("direction", "cy", "cx", "group_id").distinct()
    near = around(shapes.join(new.select("id", "age", "ord"), "id").select("id", "direction", "age", "ord", "cy", "cx"))
    asks = materialise(near.join(held, ["direction", "cy", "cx"]).select("id", "group_id", "age", "ord").distinct(), "asks")
    reps = asks.join(representatives_at(members, asks), ["group_id", "age", "ord"]).filter("rep is not null")
    light = shapes.drop("coords", "direction", "cy", "cx")
    side = lambda k, name: light.select(F.col("id").alias(k), F.struct(*[c for c in light.columns if c != "id"]).alias(name))
    both = reps.join(side("a", "one"), F.col("id") == F.col("a")).join(side("b", "two"), F.col("rep") == F.col("b"))
    alike = both.filter(passes("one", "two") & _ends_within(within, "one", "two"))
    pairs = dealt(alike.select("a", "b", "group_id"), "a", "b")
    coords = shapes.select("id", "coords")
    both = pairs.join(coords.select(F.col("id").alias("a"), F.col("coords").alias("ca")), "a").join(coords.select(F.col("id").alias("b"), F.col("coords").alias("cb")), "b")
    scored = both.select("a", "group_id", path_distances(F.col("ca"), F.col("cb")).alias("d")).select("a", "group_id", commute_similarity(F.col("d.frechet"), F.col("d.percentile_hausdorff")).alias("s"))
    best = scored.filter(F.col("s") >= least).join(order, "group_id").groupBy("a").agg(F.max_by("group_id", F.struct("s", -F.col("group_ord"))).alias("group_id"))
    return best.select(F.col("a").alias("id"), "group_id")


def merge_tracks(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """old: id, direction, group_id, ord, duration, coords. new: the same without group_id; ord is the order in which they come, different for all of a table.

    id, direction, group_id, frequency, place, rep of all tracks: new ones that match no group make groups of their own, numbered on after the stored
    ones, those of most tracks first; place is the group's in the direction's order by number of tracks. Stored groups come in the order of their place, or
    without one in that of their first member.
    """
    within = reach_of(least) * (1 + 1e-9)
    cols = ["id", "direction", "ord", "duration", "coords"]
    tracks = old.select(*cols).unionByName(new.select(*cols))
    shapes = materialise(_starts(tracks.select("id", "direction", "coords"), within), "shapes")
    come = materialise(new.select("id", "direction", F.lit(1).alias("age"), "ord", "duration"), "new")
    stored = materialise(old.select("group_id", F.lit(0).alias("age"), "ord", "duration", "id", "direction"), "stored")
    order = old.groupBy("group_id").agg(F.min("place" if "place" in old.columns else "ord").cast("long").alias("group_ord"))
    members, guess = stored.drop("direction"), None
    while True:
        found = materialise(_decisions(come, members, shapes, order, least, within), "decisions")
        if guess is not None and found.exceptAll(guess).isEmpty() and guess.exceptAll(found).isEmpty():
            break
        guess = found
        members = stored.drop("direction").unionByName(come.join(found, "id").select("group_id", "age", "ord", "duration", "id"))
    rest = new.join(found, "id", "left_anti")
    edges = commute_pairs(rest, "id", ["direction"], least).select("a", "b")
    own = pivot_groups(rest, edges, "id", "ord").join(rest.select("id", "direction", "ord", "duration"), "id")
    made = materialise(own.groupBy("direction", "pivot").agg(F.count("*").alias("n"), F.min("ord").alias("first")), "made")
    taken = stored.groupBy("direction").agg(F.countDistinct("group_id").alias("taken"))
    numbered = made.withColumn("k", F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("n"), "first")) - 1).join(taken, "direction", "left")
    numbered = numbered.select("pivot", F.concat_ws("_", "direction", (F.col("k") + F.coalesce("taken", F.lit(0))).cast("string")).alias("group_id"), F.col("k"))
    fresh = own.join(numbered, "pivot").select("id", "direction", "group_id", F.lit(1).alias("age"), "ord", "duration", "k")
    kept = stored.unionByName(come.join(found, "id").select(*stored.columns)).join(order, "group_id").select("id", "direction", "group_id", "age", "ord", "duration", F.col("group_ord").alias("k"), F.lit(0).alias("made"))
    every = materialise(kept.unionByName(fresh.withColumn("made", F.lit(1))), "members")
    groups = every.groupBy("direction", "group_id").agg(F.count("*").alias("frequency"), F.min(F.struct("made", "k")).alias("at"))
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("direction").orderBy(F.desc("frequency"), "at")) - 1)
    reps = representatives_at(every, groups.select("group_id", F.lit(2).alias("age"), F.lit(0).cast("long").alias("ord"))).select("group_id", "rep")
    return every.select("id", "direction", "group_id").join(groups.select("group_id", "frequency", "place"), "group_id").join(reps, "group_id").select("id", "direction", "group_id", "frequency", "place", "rep")
