"""Smoothing against a loop, file memo, freshness as state, and the analysis that keeps up."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from spokeframe.operators import smoothing
from spokeframe.sources import memo, store
from spokeframe.streaming import fresh, incremental
from tests.test_merging import LINE, sequential


def loop(values, alpha):
    level, out = None, []
    for x in values:
        if x is not None and x == x:
            level = x if level is None else alpha * x + (1 - alpha) * level
        out.append(level)
    return out


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_smoothing(spark, parts, monkeypatch):
    monkeypatch.setattr(smoothing, "BLOCK", 64)
    rnd = random.Random(parts)
    rows, want = [], {}
    for key, n in (("a", 700), ("b", 1), ("c", 40), (None, 30), ("none", 12)):
        values = [None if key == "none" or rnd.random() < 0.3 or i < 3 and key == "c" else float("nan") if rnd.random() < 0.02 else rnd.uniform(-100, 100) for i in range(n)]
        rows += [(key, i // 2, i, x, "keep") for i, x in enumerate(values)]
        want |= {(key, i): y for i, y in enumerate(loop(values, 0.15))}
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, tie long, x double, y string").repartition(parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = smoothing.smoothed(df, "x", ["at", "tie"], by="k").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) and all(r.y == "keep" for r in got)
    for r in got:
        y = want[r.k, r.tie]
        assert r.smoothed is None if y is None else abs(r.smoothed - y) < 1e-9
    one = smoothing.smoothed(df.filter("k = 'a'").drop("k"), "x", ["at", "tie"], 0.4).collect()
    level = loop([x for k, _, _, x, _ in sorted((r for r in rows if r[0] == "a"), key=lambda r: r[2])], 0.4)
    assert all(abs(r.smoothed - level[r.tie]) < 1e-9 for r in one if level[r.tie] is not None)
    assert smoothing.smoothed(df.limit(0), "x", ["at", "tie"], by="k").count() == 0


def test_files_are_read_again_when_they_change(spark, tmp_path):
    folder, root = tmp_path / "in", f"file://{tmp_path}/store"
    folder.mkdir()
    put = lambda i, *xs: (folder / f"f{i}.json").write_text("\n".join(f'{{"id": {x}}}' for x in xs))
    for i in range(100):
        put(i, i, i + 1000)
    seen = []

    def read(paths):
        seen.append(paths if isinstance(paths, str) else len(paths))
        return memo.with_file(spark.read.schema("id long").json(paths)).select((F.col("id") * 2).alias("twice"), *memo.KEY)

    scan = lambda: memo.remembered(spark, f"file://{folder}", root, read, "*.json")
    ids = lambda df: sorted(r.twice for r in df.collect())
    every = sorted(2 * x for i in range(100) for x in (i, i + 1000))
    df, counts = scan()
    assert ids(df) == every and counts == {"read": 100, "kept": 0}
    df, counts = scan()
    assert ids(df) == every and counts == {"read": 0, "kept": 100} and store.current(spark, root)["version"] == 1
    put(7, 7, 1007, 5000)
    df, counts = scan()
    assert ids(df) == sorted([*every, 10000]) and counts == {"read": 1, "kept": 99} and seen[-1] == 1
    os.remove(folder / "f3.json")
    os.utime(folder / "f4.json", (1, 1))
    put(200, 42)
    df, counts = scan()
    assert ids(df) == sorted({*every, 10000} - {6, 2006}) + [84] or ids(df) == sorted([x for x in [*every, 10000, 84] if x not in (6, 2006)])
    assert counts == {"read": 2, "kept": 98}


def test_fresh_stale_expired_and_remembered(spark, tmp_path):
    """Two starts of one query; answers are those of a loop over all rows."""
    t0, rnd = dt.datetime(2024, 1, 1), random.Random(4)
    rows, want = [], {}
    for key in range(6):
        at, stored, given = t0, None, None
        for i in range(60):
            at += dt.timedelta(seconds=rnd.choice([60, 300, 900, 5400, 9000, 100_000]))
            asks = rnd.random() < 0.6
            rows.append((key, at, asks, None if asks else i))
            if not asks:
                stored = (at, i)
                continue
            held = given is not None and (at - given[0]).total_seconds() < 600
            if not held:
                given = (at, stored) if stored and (at - stored[0]).total_seconds() < 86400 else None
            age = None if given is None else (at - given[1][0]).total_seconds() / 3600
            want[key, at] = (None, None, None, held) if given is None else (given[1][1], round(age, 6), age >= 2, held)
    rows.sort(key=lambda r: r[1])
    schema = "key long, at timestamp, asks boolean, value long"
    run = lambda: fresh.run_available(spark, fresh.answers(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), late="3650 days"), f"{tmp_path}/out", f"{tmp_path}/c")
    for part in (rows[:200], rows[200:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    got = {(r.key, r.at): (r.value, None if r.age_hours is None else round(r.age_hours, 6), r.is_stale, r.from_memo) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == want
    kinds = {(v[0] is None, v[2], v[3]) for v in want.values()}
    assert len(kinds) >= 4


def tracks(spark, rows):
    line = lambda shift: [(41.0 + a + shift, -87.0 + b) for a, b in LINE]
    return spark.createDataFrame([(i, way, at, d, line(s), gone) for i, way, at, d, s, gone in rows], "id long, direction string, ord long, duration long, coords array<struct<lat:double,lon:double>>, removed boolean")


def test_a_batch_counts_once(spark, tmp_path):
    rnd = random.Random(8)
    root = f"file://{tmp_path}/store"
    analyse = incremental.analyse_batches(root, 0.7, "s")
    first = [(i, "a", i, rnd.randrange(100, 110), rnd.uniform(0, 0.004), False) for i in range(14)]
    more = [(50 + i, "a", i, rnd.randrange(100, 110), rnd.uniform(0, 0.004), False) for i in range(10)]
    groups = lambda: {r.id: (r.group_id, r.frequency, r.place, r.rep) for r in store.read(spark, root).collect()}
    analyse(tracks(spark, first), 0)
    plain = lambda rows: [(i, way, at, d, s) for i, way, at, d, s, _ in rows]
    one, _ = sequential([], plain(first), 0.7)
    assert groups() == one and store.current(spark, root)["analysis"] == "incremental"
    by_place = lambda found, rows: [(i, way, found[i][0], (found[i][2], at), d, s) for i, way, at, d, s, _ in rows]
    stored = sorted(by_place(one, first), key=lambda r: r[3])
    two, _ = sequential(stored, plain(more), 0.7)
    for _ in range(2):  # the second time changes nothing
        analyse(tracks(spark, more), 1)
        assert groups() == two and store.current(spark, root)["version"] == 2
    analyse(tracks(spark, more[:3]), 2)
    assert groups() == two and store.current(spark, root)["analysis"] == "hit"
    gone = [(*r[:5], True) for r in (first[0], more[2])]
    analyse(tracks(spark, gone), 3)
    left = [(i, way, at + (1 << 40) * (i >= 50), d, s) for i, way, at, d, s, _ in [*first[1:], *more[:2], *more[3:]]]
    assert groups() == sequential([], left, 0.7)[0] and store.current(spark, root)["analysis"] == "full"
