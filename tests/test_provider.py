"""Provider lists, backfill and the stored table."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from spokeframe import shared
from spokeframe.sources import provider, store

SCHEMA = "id long, name string, start_date string, distance double"


def rides(spark, n=47, step=1):
    rows = [(i, f"r{i}", None if i % 23 == 22 else f"20{10 + i // 12:02d}-{1 + i % 12:02d}-03T04:05:06Z", i / 4) for i in range(0, n, step)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def listed(spark, tmp_path):
    path = f"file://{tmp_path}/pages"
    provider.write_pages(rides(spark), path, 10)
    return path


def test_pages(spark, listed):
    got = provider.pages(spark, listed).orderBy("page").collect()
    assert [len(json.loads(r.body)) for r in got] == [10, 10, 10, 10, 7]
    dates = [[x.get("start_date") for x in json.loads(r.body)] for r in got]
    flat = [x for page in dates for x in page]
    assert flat == sorted((x for x in flat if x), reverse=True) + [None, None]
    assert [(r.newest, r.oldest) for r in got] == [(max(filter(None, p)), min(filter(None, p))) for p in dates]


@pytest.mark.parametrize("after,before", [(None, None), ("2012", None), (None, "2011-03-03T04:05:06Z"), ("2010-05-03T04:05:06Z", "2012-06-01"), ("2050", None)])
def test_dates(spark, listed, after, before):
    want = [r.id for r in rides(spark).collect() if (after is None or (r.start_date or "") > after) and (before is None or (r.start_date and r.start_date < before))]
    got = provider.fetch(spark, listed, after, before)
    assert sorted(r.id for r in got.collect()) == want
    few = provider.fetch(spark, listed, after, before, limit=5).collect()
    assert [r.id for r in few] == [r.id for r in sorted(got.collect(), key=lambda r: (r.start_date or "", -r.id), reverse=True)][:5]


def test_conditions_are_pushed_and_closed_pages_stay_closed(spark, tmp_path, capsys):
    """The data of old pages are overwritten; a fetch of later ones does not see it."""
    path = f"{tmp_path}/pages"
    rows = spark.range(4000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 512).alias("name"), F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("start_date"), F.lit(1.0).alias("distance"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    provider.write_pages(rows, f"file://{path}", 100)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    reader = provider.PageReader(f"file://{path}")
    every = reader.partitions()
    reader.filters = [("newest", "__gt__", "2009-01-01")]
    some = reader.partitions()
    assert 0 < len(some) < len(every)
    used = {p.file for p in some}
    for p in {p.file for p in every} - used:
        size = os.path.getsize(p)
        with open(p, "r+b") as f:
            f.seek(4)
            f.write(b"\xff" * (size // 3))
    found = provider.fetch(spark, f"file://{path}", "2009-01-01")
    found.explain("formatted")
    assert "PushedFilters: [GreaterThan(newest,2009-01-01)]" in capsys.readouterr().out
    assert found.count() == rows.filter("start_date > '2009-01-01'").count()


def test_backfill_goes_on_where_it_stopped(spark, listed, tmp_path):
    root, other = f"file://{tmp_path}/store", f"file://{tmp_path}/other"
    assert provider.backfill(spark, listed, root, f"file://{tmp_path}/c", SCHEMA, most=2) == {"pages": 2, "new": 20}
    assert provider.backfill(spark, listed, root, f"file://{tmp_path}/c", SCHEMA) == {"pages": 3, "new": 27}
    assert provider.backfill(spark, listed, root, f"file://{tmp_path}/c", SCHEMA) == {"pages": 0, "new": 0}
    assert provider.backfill(spark, listed, other, f"file://{tmp_path}/d", SCHEMA) == {"pages": 5, "new": 47}
    want = sorted(map(str, rides(spark).collect()))
    assert sorted(map(str, store.read(spark, root).collect())) == want == sorted(map(str, store.read(spark, other).collect()))


def test_backfill_stops_at_a_page_with_nothing_new(spark, listed, tmp_path):
    root = f"file://{tmp_path}/store"
    known = provider.fetch(spark, listed, schema=SCHEMA).orderBy(F.col("start_date").desc_nulls_last(), "id").limit(20).collect()
    store.merge(spark, root, spark.createDataFrame(known[10:], SCHEMA))
    assert provider.backfill(spark, listed, root, f"file://{tmp_path}/c", SCHEMA) == {"pages": 2, "new": 10}
    assert store.read(spark, root).count() == 20


def test_backfill_writes_the_store_a_few_times(spark, tmp_path):
    """A version a page would be 47."""
    provider.write_pages(rides(spark), f"file://{tmp_path}/pages", 1)
    assert provider.backfill(spark, f"file://{tmp_path}/pages", f"file://{tmp_path}/s", f"file://{tmp_path}/c", SCHEMA) == {"pages": 46, "new": 46}  # the 46th page has no date, so it is the last
    assert store.current(spark, f"file://{tmp_path}/s")["version"] <= 8 and store.read(spark, f"file://{tmp_path}/s").count() == 46


def test_pages_after_one_with_nothing_new_stay_for_the_next_call(spark, tmp_path):
    """The page lies inside of a batch; a later page wins over an earlier one."""
    rows = [(i % 40 if i < 44 else i, f"r{i}", f"20{60 - i // 2:02d}-01-01", 1.0) for i in range(50)]
    provider.write_pages(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/pages", 4)
    root = f"file://{tmp_path}/store"
    store.merge(spark, root, spark.createDataFrame(rows[20:24], SCHEMA))  # the sixth page
    call = lambda most=None: provider.backfill(spark, f"file://{tmp_path}/pages", root, f"file://{tmp_path}/c", SCHEMA, most)
    assert call() == {"pages": 6, "new": 20} and store.read(spark, root).count() == 24
    assert call(1) == {"pages": 1, "new": 4} and call(1) == {"pages": 1, "new": 4}
    assert call() == {"pages": 3, "new": 8}  # the eleventh page repeats the first rides
    assert {r.name for r in store.read(spark, root).filter("id < 4").collect()} == {"r40", "r41", "r42", "r43"}
    assert call() == {"pages": 2, "new": 6} and call() == {"pages": 0, "new": 0} and store.read(spark, root).count() == 46


def test_a_page_without_an_older_date_is_the_last(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x", "2020-01-01" if i < 9 else None, 1.0) for i in range(20)], SCHEMA)
    provider.write_pages(rows, f"file://{tmp_path}/pages", 3)
    reader = provider.BackwardReader(f"file://{tmp_path}/pages")
    at, seen = reader.initialOffset(), []
    while True:
        found, then = reader.read(at)
        found = list(found)
        if not found:
            break
        assert list(reader.readBetweenOffsets(at, then)) == found
        seen += [r["id"] for f in found for r in json.loads(f[3])]
        at = then
    assert at["end"] and seen == list(range(6))  # the second page has the first one's date


def test_no_rides(spark, tmp_path):
    provider.write_pages(rides(spark).limit(0), f"file://{tmp_path}/pages", 10)
    assert provider.fetch(spark, f"file://{tmp_path}/pages", "2000").count() == 0
    assert provider.backfill(spark, f"file://{tmp_path}/pages", f"file://{tmp_path}/s", f"file://{tmp_path}/c", SCHEMA) == {"pages": 0, "new": 0}
    assert store.read(spark, f"file://{tmp_path}/s") is None


def test_two_writers_lose_no_row(spark, tmp_path):
    root, failed = f"file://{tmp_path}/t", []

    def write(first):
        try:
            for k in range(3):
                store.merge(spark, root, rides(spark).filter((F.col("id") % 6) == first + 2 * k))
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in (0, 1)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not failed and store.current(spark, root)["version"] == 6
    assert sorted(map(str, store.read(spark, root).collect())) == sorted(map(str, rides(spark).collect()))


def test_a_writer_that_dies_leaves_the_table(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    store.merge(spark, root, rides(spark).filter("id < 10"))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "make_once", dies)
        with pytest.raises(KeyboardInterrupt):
            store.merge(spark, root, rides(spark))
    assert store.read(spark, root).count() == 10
    assert store.merge(spark, root, rides(spark))["previous_total"] == 10 and store.read(spark, root).count() == 47


def test_pointers_are_made_once(spark, tmp_path):
    assert store.make_once(spark, f"file://{tmp_path}/a/p", "1") and not store.make_once(spark, f"file://{tmp_path}/a/p", "2")
    assert (tmp_path / "a" / "p").read_text() == "1" and os.listdir(tmp_path / "a") == ["p"]


def test_no_local_folder_on_a_cluster():
    assert all(shared.one_machine(m) for m in ("local", "local[4]", "local[*]", "local-cluster[2,1,512]"))
    assert not any(shared.one_machine(m) for m in ("spark://h:7077", "yarn", "k8s://https://h", "localhost"))

    class Session:
        class sparkContext:
            master = "yarn"
            getConf = staticmethod(dict)
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
