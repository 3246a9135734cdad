"""Map layers in fixed cases, and answers over the test tables that must not all be alike."""

import os

import duckdb
import pytest

from spokeframe.operators import layers
from spokeframe.queries import ORACLES

GROUPS = "ord long, name string, route_type string, coords array<struct<lat:double,lon:double>>"


def groups(spark, names, types=None):
    rows = [(i, n, (types or {}).get(i), [] if i == 1 else [(40.0 + i, -80.0)] * (150 if i == 2 else 3)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows[::-1], GROUPS)


def test_commutes_or_the_first_five(spark):
    ids = lambda df: sorted(r.ord for r in layers.commute_groups(df).collect())
    assert ids(groups(spark, ["a", "My COMMUTE", None, "commuter"])) == [1, 3]
    assert ids(groups(spark, ["a", "b", None], {2: "commute"})) == [2]
    assert ids(groups(spark, list("abcdefg"))) == [0, 1, 2, 3, 4]
    assert ids(groups(spark, list("ab"))) == [0, 1] and ids(groups(spark, list("ab")).limit(0)) == []
    assert ids(groups(spark, ["x", "commute"]).drop("route_type")) == [1]


def test_layers_of_a_map(spark):
    got = {r.place: r for r in layers.map_layers(groups(spark, [f"g{i}" for i in range(14)])).collect()}
    assert sorted(got) == [0, 2, 3, 4, 5, 6, 7, 8, 9]  # one of the first ten has no track
    assert [got[i].show for i in (0, 2, 3)] == [True, True, False]
    assert (got[0].colour, got[8].colour, got[9].colour) == ("#007bff", "#007bff", "#28a745")
    assert len(got[2].coords) == 30 and len(got[3].coords) == 3
    points = [(40.0 + i, n) for i, n in ((0, 3), (2, 150), *((k, 3) for k in range(3, 10)))]
    assert abs(got[0].center_lat - sum(lat * n for lat, n in points) / sum(n for _, n in points)) < 1e-9
    commute = layers.map_layers(groups(spark, list("abcdefg")), 5, None, True).collect()
    assert [r.colour for r in sorted(commute)][0] == layers.RECOMMENDED and all(r.show for r in commute) and len(commute) == 4
    assert layers.map_layers(groups(spark, []), 10).count() == 0


def test_coverage_of_boxes_together(spark):
    tiles = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (1, 2, 2)], "box int, x long, y long")
    boxes = spark.createDataFrame([(0, 7), (1, 9)], "box int, total_in_bounds long")
    assert tuple(layers.merged_coverage(boxes, tiles).first()) == (2, 16, 12.5)
    assert tuple(layers.merged_coverage(boxes.limit(0), tiles.limit(0)).first()) == (0, 0, 0.0)


@pytest.fixture(scope="module")
def con():
    sf, c = "/root/testdata/sf0.01", duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize(
    "name,columns,least",
    [
        ("C22_commutes_of_many_days", "severity", 4), ("C22_commutes_of_many_days", "rating", 4), ("C22_commutes_of_many_days", "transit", 2), ("C13_comfort_of_many_days", "comfort", 10),
        ("G19_there_and_back", "out_and_back", 2), ("J10_rides_beside", "metres", 2), ("X10_refined_tours", "status", 2), ("X10_refined_tours", "routings", 6), ("X11_routed_requests", "dropped", 3),
        ("X11_routed_requests", "status", 2), ("X5_zones_of_a_drawn_area", "n_tiles", 4), ("X7_scores_of_many_zones", "overlap", 3), ("X14_incremental_groups", "frequency", 5), ("T6_T1_kept_up_groups", "group_id", 20),
        ("C11_rides_of_a_week", "round(score, 2)", 20), ("P16_commute_groups_or_first", "kind", 2), ("K9_map_layers", "points", 2), ("T3_fresh_state", "is_stale", 2), ("X6_ordered_stops", "stops", 8),
    ],
)
def test_answers_vary(con, name, columns, least):
    assert con.execute(f"SELECT count(DISTINCT {columns}) FROM ({ORACLES[name]})").fetchall()[0][0] >= least
