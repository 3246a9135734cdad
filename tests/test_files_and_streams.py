"""Readers, sinks, streams, names and the whole analysis."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from spokeframe.operators.rollups import upsert, upsert_counts
from spokeframe.plans.analysis import analyse
from spokeframe.config import EngineConfig
from spokeframe.sources import readers, sinks
from spokeframe.streaming import stateful

RIDE = {"id": 1, "name": "a", "type": "Ride", "start_date": "2024-01-01T00:00:00Z", "distance": 10.5, "start_latlng": [41.5, -87.5], "polyline": "x"}


def save(path, value):
    path.write_text(json.dumps(value, indent=1))
    return str(path)


def test_activities(spark, tmp_path):
    rides = [RIDE, {**RIDE, "id": 2, "start_latlng": [["root", [42.0, -88.0]]], "end_latlng": None, "type": "Run", "extra": 1}, {**RIDE, "id": 3, "start_latlng": None, "sport_type": "GravelRide", "type": "Workout"}]
    for name, doc in (("doc", {"timestamp": "t", "count": 3, "activities": rides}), ("list", rides)):
        got = {r.id: r for r in readers.read_activities(spark, save(tmp_path / f"{name}.json", doc)).collect()}
        assert sorted(got) == [1, 2, 3]
        assert (got[1].start_lat, got[1].start_lon) == (41.5, -87.5) and (got[2].start_lat, got[2].start_lon) == (42.0, -88.0)
        assert got[3].start_lat is None and got[1].end_lat is None and got[1].kudos_count is None
    kept = readers.coverage_rides(readers.read_activities(spark, str(tmp_path / "list.json")))
    assert sorted(r.id for r in kept.collect()) == [1, 3]


def test_second_provider_and_details(spark):
    schema = "activityId long, activityName string, activityType struct<typeKey:string>, startTimeLocal string, distance double, movingDuration double, duration double, elevationGain double, startLatitude double, startLongitude double, endLatitude double, endLongitude double, averageSpeed double, maxSpeed double, averageHR double"
    rows = [(1, "x", ("GRAVEL_CYCLING",), "2024-01-01", 5.0, 0.0, 90.9, 1.0, 41.0, -87.0, 0.0, -87.0, 1.0, 2.0, None), (2, None, None, None, None, None, None, None, None, None, None, None, None, None, None)]
    a, b = readers.second_provider(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    assert (a.type, a.moving_time, a.start_latlng.lat, a.end_latlng) == ("GravelRide", 90, 41.0, None)
    assert (b.type, b.distance, b.moving_time) == ("Ride", 0.0, 0)
    base, more = spark.createDataFrame([(1, "p"), (2, "q")], "id long, polyline string"), spark.createDataFrame([(1, "long")], "id long, polyline string")
    assert {r.id: r.polyline for r in readers.enrich(base, more).collect()} == {1: "long", 2: "q"}


def test_gear_weather_water_routes(spark, tmp_path):
    gear = readers.read_gear(spark, save(tmp_path / "g.json", {"bikes": [{"id": "b1", "name": "B", "type": "bike"}], "shoes": [{"id": "s1"}]}))
    assert {r.id for r in gear.collect()} == {"b1", "s1"}
    doc = {"lat": 1.0, "lon": 2.0, "hourly": {"time": ["t0", "t1", "t2"], "temperature_2m": [1.0, 2.0], "wind_speed_10m": [3.0, 4.0, 5.0]}}
    w = readers.read_weather(spark, save(tmp_path / "w.json", doc))
    got = readers.forecast_rows(w, "hourly", readers.HOURLY, 2).collect()
    assert [(r.time, r.temperature_2m, r.wind_speed_10m, r.wind_gusts_10m) for r in got] == [("t0", 1.0, 3.0, None), ("t1", 2.0, 4.0, None)]
    p = lambda *xs: [{"lat": float(a), "lon": float(b)} for a, b in xs]
    water = {"elements": [{"type": "way", "geometry": p((0, 0), (0, 1), (1, 1))}, {"type": "way", "geometry": p((0, 0), (0, 1))}, {"type": "relation", "members": [{"role": "outer", "geometry": p((0, 0), (0, 2), (2, 2), (2, 0))}, {"role": "inner", "geometry": p((0, 0), (0, 1), (1, 1))}]}]}
    assert sorted(len(r.ring) for r in readers.water_polygons(spark, save(tmp_path / "o.json", water)).collect()) == [3, 4]
    route = {"features": [{"geometry": {"coordinates": [[-87.6, 41.8], [-87.5, 41.9]]}, "properties": {"summary": {"distance": 12345.6, "duration": 200}}}]}
    r = readers.routed(spark, save(tmp_path / "r.json", route)).first()
    assert (r.distance_km, r.duration_min, r.coords[0].lat, r.coords[1].lon) == (12.35, 3.3, 41.8, -87.5)


@pytest.mark.parametrize("name", ["S14_roads_of_tracks", "S16_routed_answers"])
def test_files_are_not_as_many_as_rides(spark, tmp_path, monkeypatch, name):
    """A folder for each ride, or for each 200 numbers of roads, is too many to list for large tables."""
    from spokeframe.plans import q_files
    from spokeframe.queries import QUERIES

    monkeypatch.setattr(q_files, "shared_dir", lambda _: f"file://{tmp_path}/written")
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= n
    assert 0 < len(list((tmp_path / "written").rglob("*.txt"))) <= 8 < n


def test_routing_answers_in_a_list(spark, tmp_path):
    answer = lambda km: {"features": [{"geometry": {"coordinates": [[-87.6, 41.8]]}, "properties": {"summary": {"distance": km * 1000, "duration": 60}}}]}
    assert sorted(r.distance_km for r in readers.routed(spark, save(tmp_path / "r.json", [answer(1), answer(2)])).collect()) == [1.0, 2.0]


def test_calendar(spark):
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:u1\r\nSUMMARY:1:30 - Sweet\r\n  Spot\\, hard\r\nDTSTART:20240501T060000Z\r\nDTEND:20240501T071500Z\r\nDESCRIPTION:TSS: 88 IF: 0.9\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:u2\r\nSUMMARY:0:45 - Easy\r\nDTSTART;VALUE=DATE:20240502\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:no start\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
    a, b = readers.ics_events(spark.createDataFrame([(ics,)], "value string")).orderBy("workout_id").collect()
    assert (a.workout_name, a.workout_date, a.workout_type, a.duration_minutes, a.tss, a.intensity_factor) == ("1:30 - Sweet Spot, hard", dt.date(2024, 5, 1), "Threshold", 75, 88.0, 0.9)
    assert (b.workout_date, b.workout_type, b.duration_minutes, b.tss) == (dt.date(2024, 5, 2), "Endurance", 45, None)


def test_exports(spark, tmp_path):
    ranked = spark.createDataFrame([("g,1", "home_to_work", 81.26, 3, 1500.0, 7000.5, 4.25, 50.0, None)], "group_id string, direction string, score double, uses long, avg_duration double, avg_distance double, avg_speed double, weather double, safety double")
    sinks.write_csv(ranked, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True)
    assert tuple(back.columns) == sinks.CSV_HEADER
    assert tuple(back.first()) == ("g,1", "home_to_work", "81.3", "3", "25.0", "7000.50", "4.3", "50.0", "N/A", "0.0")
    routes = spark.createDataFrame([("r1", "a < b & c", [(41.0, -87.0), (41.5, -87.5)])], "name string, note string, coords array<struct<lat:double,lon:double>>")
    import xml.etree.ElementTree as ET

    for track, tag in ((False, "rtept"), (True, "trkpt")):
        sinks.write_gpx(routes, str(tmp_path / "x"), track)
        text = spark.read.text(str(tmp_path / "x"), wholetext=True).first().value
        found = [e for e in ET.fromstring(text.encode()).iter() if e.tag.endswith(tag)]
        assert [(e.get("lat"), e.get("lon")) for e in found] == [("41.0", "-87.0"), ("41.5", "-87.5")]
    sinks.write_json(ranked, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_stored_groups_are_reused_only_for_the_same_ids_and_settings(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (2,)], "activity_id long")
    sinks.write_groups(spark.createDataFrame([("g",)], "group_id string"), ids, str(tmp_path), "0.7")
    assert sinks.reusable(spark, str(tmp_path), ids, "0.7")
    assert not sinks.reusable(spark, str(tmp_path), ids, "0.8")
    assert not sinks.reusable(spark, str(tmp_path), ids.limit(1), "0.7")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "2024-01-01", "old"), (2, None, "old")], "id long, start_date string, v string")
    new = spark.createDataFrame([(1, "2024-01-03", "new"), (3, "2024-01-02", "new")], "id long, start_date string, v string")
    assert [tuple(r) for r in upsert(old, new).collect()] == [(1, "2024-01-03", "new"), (3, "2024-01-02", "new"), (2, None, "old")]
    assert tuple(upsert_counts(old, new).first()) == (1, 1, 3, 2)


def test_streamed_upserts(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    state = {}

    def write(df):
        state["rows"] = df.collect()

    read = lambda: spark.createDataFrame(state["rows"], "id long, start_date string, v string") if state else None
    for i, rows in enumerate(([(1, "a", "x"), (2, "b", "x")], [(2, "c", "y"), (2, "b", "z"), (3, None, "y")])):
        spark.createDataFrame(rows, "id long, start_date string, v string").coalesce(1).write.mode("append").parquet(str(pages))
        q = spark.readStream.schema("id long, start_date string, v string").parquet(str(pages)).writeStream.foreachBatch(stateful.upsert_batches(read, write)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {r.id: r.v for r in state["rows"]} == {1: "x", 2: "y", 3: "y"}


def test_throttle(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(hours=h)) for h in (0, 1, 5, 6, 7, 13)] + [("b", t0 + dt.timedelta(hours=2))]
    spark.createDataFrame(rows, "key string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in"))
    q = stateful.throttle(stream, "key", "at").writeStream.format("memory").queryName("sent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.key, (r["at"] - t0).total_seconds() / 3600) for r in spark.table("sent").collect())
    assert got == [("a", 0), ("a", 6), ("a", 13), ("b", 2)]


def test_event_windows(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=m), "x", 1.0) for m in (0, 10, 70, 300)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = stateful.event_windows(stream, "ts").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 1, 2]


def test_analysis(spark):
    rnd = random.Random(9)
    home, work, rows = (41.88, -87.63), (41.95, -87.70), []
    for i in range(40):
        go, detour = i % 2 == 0, 0.02 if i % 8 < 2 else 0.0
        a, b = (home, work) if go else (work, home)
        bend = lambda k: detour * (1 - abs(k - 10) / 10)
        track = [(a[0] + (b[0] - a[0]) * k / 20 + bend(k) + rnd.gauss(0, 1e-5), a[1] + (b[1] - a[1]) * k / 20 + bend(k) + rnd.gauss(0, 1e-5)) for k in range(21)]
        rows.append((i, f"2024-05-{i // 2 + 1:02d} {'07:30' if go else '17:00'}:00", 1800, 1800 + i, 9000.0 + 3000 * bool(detour), 50.0, 5.0, *a, *b, track))
    rides = spark.createDataFrame(rows, "id long, s string, elapsed_time long, moving_time long, distance double, total_elevation_gain double, average_speed double, start_lat double, start_lon double, end_lat double, end_lon double, coords array<struct<lat:double,lon:double>>").withColumn("start_local", F.to_timestamp_ntz("s"))
    places, members, ranked = analyse(rides, 20.0, 270.0, EngineConfig())
    assert {r.place for r in places.collect()} == {"home", "work"}
    by = {}
    for r in members.collect():
        by.setdefault(r.group_id, set()).add((r.activity_id % 2, r.activity_id % 8 < 2))
    assert len(by) == 4 and all(len(v) == 1 for v in by.values())
    got = ranked.collect()
    assert len(got) == 4 and {r.place for r in got} == {1, 2} and all(0 <= r.score <= 100 for r in got)
    with pytest.raises(ValueError):
        analyse(rides.limit(3), 20.0, 270.0)


def test_road_graph(spark, tmp_path):
    keys = '<key id="a" for="node" attr.name="y"/><key id="b" for="node" attr.name="x"/><key id="c" for="edge" attr.name="geometry"/><key id="d" for="edge" attr.name="name"/>'
    nodes = "".join(f'<node id="{n}"><data key="a">{y}</data><data key="b">{x}</data></node>' for n, y, x in ((1, 41.0, -87.0), (2, 41.5, -87.5), (3, 42.0, -88.0)))
    edges = '<edge source="1" target="2" id="0"><data key="d">A</data></edge><edge source="2" target="3" id="0"><data key="c">LINESTRING (-87.5 41.5, -87.6 41.7,-88 42)</data></edge><edge source="2" target="9"><data key="d">lost</data></edge>'
    (tmp_path / "g.graphml").write_text(f"<graphml>{keys}<graph>{nodes}{edges}</graph></graphml>")
    got = sorted(tuple(r) for r in readers.road_edges(spark, str(tmp_path / "g.graphml")).collect())
    assert got == [("1-2-0", 0, 41.0, -87.0, 41.5, -87.5), ("2-3-0", 0, 41.5, -87.5, 41.7, -87.6), ("2-3-0", 1, 41.7, -87.6, 42.0, -88.0)]


def test_short_addresses(spark):
    from spokeframe.functions import text

    rows = [("1", "Oak St", None, "Troy", "New York"), (None, None, "Path", "", "Ontario"), ("5", None, None, None, None), ("5", "", "", "", "")]
    df = spark.createDataFrame(rows, "n string, r1 string, r2 string, town string, state string")
    got = [r[0] for r in df.select(text.short_address(df.n, [df.r1, df.r2], [df.town], df.state)).collect()]
    assert got == ["1 Oak St, Troy, NY", "Path, Ontario", None, None]
