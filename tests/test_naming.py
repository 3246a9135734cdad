"""Names of routes against the rules in plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spokeframe.operators import naming

AT = "array<struct<idx:int,street:string,highway:string,neighborhood:string,suburb:string,landmark:string,park:string,feature:string,is_major:boolean>>"
ROUTES = f"key string, type string, direction string, gain_per_km double, at {AT}"
STREETS = ["Oak St", "Elm St", "Simonds Drive", "Lakefront Trail", "Lake Path", "West Side Drive", "North Lake Shore Drive", "", None, "A Work"]


def entry(i, street=None, highway=None, hood=None, suburb=None, landmark=None, park=None, feature=None, major=False):
    return (i, street, highway, hood, suburb, landmark, park, feature, major)


def useful(street, highway, points, n):
    low = (street or "").lower()
    if not low or points * 100 / n < 10 or any(w in low for w in ("access", "path", "ramp", "entrance", "exit")) or highway in ("service", "track", "path", "unclassified"):
        return False
    aside = "drive" in low and any(w in low for w in ("west ", "east ", "north ", "south "))
    return not aside or any(w in low for w in ("lake shore", "lakeshore", "martin luther king"))


def plain(key, kind, direction, gain, at):
    arrow = {"home_to_work": " → Work", "work_to_home": " → Home"}.get(direction, "")
    terrain = "" if gain is None or gain <= 15 else " (rolling)" if gain <= 30 else " (hilly)"
    segs = []
    for i, e in enumerate(at):
        street = {"Simonds Drive": "Lakefront Trail"}.get(e[1], e[1])
        if segs and segs[-1][0] == street:
            segs[-1][3] += 1
        else:
            segs.append([street, e[2], i, 1])
    good = [s for s in segs if useful(s[0], s[1], s[3], len(at))]
    streets = list({s[0]: s for s in reversed(good)}.values())[::-1]
    streets.sort(key=lambda s: s[2])
    if streets:
        longest = lambda x: max(x, key=lambda s: s[3])[0]
        names, main = [s[0] for s in streets], longest(streets)
        parks = [e[6] for e in at if e[6]]
        suburb = at[0][4]
        if kind == "loop":
            rest = [s for s in streets if s[0] != main]
            base = f"Loop through {parks[0]}" if parks else f"Loop via {main} + {longest(rest)}" if rest else f"Loop via {main}" + (f", {suburb}" if suburb else "")
        elif kind == "out-and-back" and len(names) == 1:
            base = f"Via {main} and back"
        elif kind == "out-and-back":
            out = [s[0] for s in streets if s[2] < len(at) / 2]
            turn = (out or names)[-1]
            if turn == main:
                turn = ([s for s in out if s != main] or [names[1]])[-1]
            base = f"{main} to {turn} and back"
        elif len(names) >= 3:
            base = " → ".join([names[0], longest(streets[1:-1]), names[-1]])
            base += f", {suburb}" if suburb and suburb.lower() not in base.lower() else ""
        elif len(names) == 2:
            top = max(good, key=lambda s: s[3])
            base = f"{top[0]} via {min(good, key=lambda s: s[3])[0]}" if top[3] * 100 / len(at) > 60 else " → ".join(names)
        else:
            base = f"Via {main}"
        return base + arrow + terrain
    major = [s for s, _ in Counter(e[1] for e in at if e[8] and e[1]).most_common(3)]
    hoods = list(dict.fromkeys(e[3] for e in at if e[3]))
    landmark, feature = (next((e[c] for e in at if e[c]), None) for c in (5, 7))
    if len(major) > 1:
        base = " → ".join(major)
    elif major and hoods:
        base = f"Through {hoods[0]} via {major[0]}"
    elif hoods and landmark:
        base = f"Through {hoods[0]} past {landmark}"
    elif major:
        base = f"{major[0]} along {feature}" if feature else f"Via {major[0]}"
    elif hoods:
        base = "Through " + " and ".join(hoods[:2])
    elif feature:
        base = f"Along {feature}"
    else:
        base = f"Route {key.split('_')[-1]} " + ("to Work" if direction == "home_to_work" else "to Home")
    return base + arrow + terrain if arrow and arrow not in base else base


@pytest.mark.parametrize("seed", range(3))
def test_names_are_those_of_the_rules(spark, seed):
    rnd, rows = random.Random(seed), []
    for i in range(700):
        useless = rnd.random() < 0.4
        pool = [s for s in STREETS if not useful(s, None, 1, 1)] if useless else STREETS
        some = lambda p, *x: rnd.choice(x) if rnd.random() < p else None
        at, street, share = [], None, rnd.choice([0.05, 0.2, 0.6])
        busy, named = rnd.choice([0, 0.1, 0.9]), rnd.choice([0, 0, 0.3])
        for k in range(rnd.choice([1, 2, 5, 10, 20])):
            street = rnd.choice(pool) if rnd.random() < share or not k else street
            at.append(entry(k, street, some(0.3, "service", "primary", "residential"), some(named, "Uptown", "Old Town"), some(0.3, "Uptown", "oak", "Troy"), some(named / 3, "Library"), some(named / 6, "Dunes"), some(named / 2, "River"), rnd.random() < busy))
        rows.append((f"{rnd.choice(['home_to_work_', 'r', ''])}{i}", rnd.choice(["loop", "out-and-back", "point-to-point"]), rnd.choice(["home_to_work", "work_to_home", None]), rnd.choice([None, 15.0, 15.1, 30.0, 31.0]), at))
    got = {r.key: r["name"] for r in naming.names(spark.createDataFrame(rows, ROUTES)).collect()}
    want = {r[0]: plain(*r) for r in rows}
    assert got == want
    starts = Counter(w.split()[0] for w in want.values())
    assert {"Loop", "Via", "Through", "Along", "Route"} <= set(starts) and any(" via " in w for w in want.values()) and any(", Troy" in w for w in want.values())


def test_names_of_fixed_cases(spark):
    runs = lambda *parts: [entry(i, s, h) for i, (s, h) in enumerate([(s, h) for s, h, n in parts for _ in range(n)])]
    rows = [
        ("1", "loop", None, 20.0, runs(("Oak St", None, 5), ("Lake Path", None, 2), ("Elm St", "residential", 3))),
        ("2", "out-and-back", "home_to_work", None, runs(("Oak St", None, 6), ("Elm St", None, 4))),
        ("3", "point-to-point", "work_to_home", 40.0, runs(("A", None, 3), ("B", None, 4), ("C", None, 3))),
        ("g_4", "loop", None, None, runs(("X", "service", 9))),
        ("5", "point-to-point", None, None, runs(("A", None, 7), ("B", None, 3))),
        ("6", "point-to-point", "home_to_work", 40.0, None),
        ("7", "point-to-point", None, 40.0, []),
    ]
    got = {r.key: r["name"] for r in naming.names(spark.createDataFrame(rows, ROUTES)).collect()}
    assert got == {
        "1": "Loop via Oak St + Elm St (rolling)", "2": "Oak St to Elm St and back → Work", "3": "A → B → C → Home (hilly)", "g_4": "Route 4 to Home",
        "5": "A via B", "6": "Route 6 to Work → Work (hilly)", "7": "Route 7 to Home",
    }


def test_details_of_addresses(spark):
    rows = [(41.0, "", "Trail", "Oak", "", None, "Pier", None, "Lake"), (42.0, "Grand Boulevard", None, None, None, "service", None, None, None), (43.0, None, "Boulevard of Dreams", None, None, "primary", None, None, None), (44.0, None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "lat double, road string, cycleway string, suburb string, neighbourhood string, highway string, tourism string, leisure string, natural string").withColumn("lon", F.lit(-87.0))
    got = {r.lat: r.asDict() for r in naming.places(df).collect()}
    assert got[41.0] | {"lon": 0} == {"lat": 41.0, "lon": 0, "street": "Trail", "highway": None, "neighborhood": "Oak", "suburb": "Oak", "landmark": "Pier", "park": "Lake", "feature": "Lake", "is_major": False}
    assert [got[k]["is_major"] for k in (42.0, 43.0, 44.0)] == [True, True, False] and got[44.0]["street"] is None


def test_points_without_answers_count(spark):
    """Two of ten points on a street are a segment, one of twenty is not; a table without some details will do; without rows there is no name."""
    lat = lambda k, i: 40.0 + k + i * 1e-3
    points = [(k, i, lat(k, i), -87.0) for k, n in ((1, 10), (2, 20)) for i in range(n)]
    details = [(lat(1, 3), -87.00001, "Oak St"), (lat(1, 4), -87.0, "Oak St"), (lat(2, 3), -87.0, "Oak St"), (lat(2, 3), -87.0, "Oak St")]
    p = spark.createDataFrame(points, "key long, idx int, lat double, lon double")
    at = naming.located(p, spark.createDataFrame(details, "lat double, lon double, street string"))
    kinds = spark.createDataFrame([(1, "loop", None, None), (2, "loop", None, None), (3, "loop", None, None)], "key long, type string, direction string, gain_per_km double")
    got = {r.key: r["name"] for r in naming.names(kinds.join(at, "key", "left")).collect()}
    assert got == {1: "Loop via Oak St", 2: "Route 2 to Home", 3: "Route 3 to Home"}
    assert naming.names(kinds.join(at, "key", "left").limit(0)).count() == 0
