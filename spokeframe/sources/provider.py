"""Lists of rides as a provider gives them, page by page from the newest on, as a Spark data source.

A provider's list is stored as a table of pages: number from 0 on, newest and oldest date, and the answer's JSON. As a batch
source it is split by row groups; conditions on dates are pushed to it, so pages outside of them are not opened. As a stream
it pages backward, a page a batch, and its offset is the page and the oldest date seen: a query that is started again goes on
where it stopped. Rows of pages are read from JSON by Spark. Backfill streams numbers and dates alone, three times as many pages a batch as came before, and reads the pages of a batch by the batch source.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

from ..functions import polyline
from ..shared import materialise, qualified, running
from . import readers, store

NAME = "provider_pages"
PAGES = "page long, newest string, oldest string, body string"
#: Bytes of a row group of the pages, the least that a task opens.
GROUP = 1 << 20
COMPARE = {GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
#: The second provider's list and tracks.
SECOND = """activityId long, activityName string, activityType struct<typeKey:string>, startTimeLocal string, distance double, movingDuration double, duration double, elevationGain double,
startLatitude double, startLongitude double, endLatitude double, endLongitude double, averageSpeed double, maxSpeed double, averageHR double"""
DETAILS = "activityId long, geoPolylineDTO struct<polyline:array<struct<lat:double,lon:double>>>"


def write_pages(rides: DataFrame, path: str, size: int, date: str = "start_date", key: str = "id") -> None:
    """Pages of `size` rides, the newest first, those without a date last. Pages are cut range by range."""
    paged = running(rides, [F.col(date).desc_nulls_last(), F.col(key).asc()]).withColumn("page", F.floor(F.col("place") / size))
    body = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("place", F.struct(*rides.columns).alias("ride")))), lambda r: r["ride"]))
    pages = paged.groupBy("page").agg(F.max(date).alias("newest"), F.min(date).alias("oldest"), body.alias("body"))
    pages.repartitionByRange("page").sortWithinPartitions("page").write.option("parquet.block.size", GROUP).parquet(path)


def _opened(path: str) -> ds.Dataset:
    files, inside = pyarrow.fs.FileSystem.from_uri(path)
    return ds.dataset(inside, filesystem=files, format="parquet")


class Group(InputPartition):
    def __init__(self, file: str, group: int) -> None:
        super().__init__((file, group))
        self.file, self.group = file, group


class PageReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.filters: list[tuple[str, str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of the dates and numbers; Spark keeps the others."""
        for f in filters:
            if type(f) in COMPARE and f.attribute[0] in ("newest", "oldest", "page"):
                self.filters.append((f.attribute[0], COMPARE[type(f)], f.value))
            else:
                yield f

    def _condition(self) -> ds.Expression | None:
        found = None
        for column, compare, value in self.filters:
            one = getattr(ds.field(column), compare)(value)
            found = one if found is None else found & one
        return found

    def partitions(self) -> list[InputPartition]:
        some = self._condition()
        pieces = (p for f in _opened(self.path).get_fragments(filter=some) for p in f.split_by_row_group(filter=some))
        return [Group(p.path, p.row_groups[0].id) for p in pieces] or [Group("", 0)]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        files, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        some = self._condition()
        with files.open_input_file(partition.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(200, [partition.group], ["page", "newest", "oldest", "body"]):
                table = pa.Table.from_batches([batch])
                yield from (table.filter(some) if some is not None else table).to_batches()


class BackwardReader(SimpleDataSourceStreamReader):
    """A page a batch, or with `growing` three times as many as came before, `most` at most, and without their bodies. After a page without an older date, and where there is no page, the offset stays as it is."""

    def __init__(self, path: str, growing: bool = False, most: int | None = None) -> None:
        self.path, self.growing, self.most = path, growing, most

    def initialOffset(self) -> dict[str, Any]:
        return {"page": 0, "oldest": None, "end": False}

    def _pages(self, first: int, end: int) -> list[tuple[int, str, str, str | None]]:
        columns = ["page", "newest", "oldest", *([] if self.growing else ["body"])]
        found = _opened(self.path).to_table(filter=(ds.field("page") >= first) & (ds.field("page") < end), columns=columns).to_pylist()
        return [(r["page"], r["newest"], r["oldest"], r.get("body")) for r in sorted(found, key=lambda r: r["page"])]

    def read(self, start: dict[str, Any]) -> tuple[Iterator[tuple], dict[str, Any]]:
        first, many = start["page"], max(1, 3 * start["page"]) if self.growing else 1
        rows, at = [], start
        for row in [] if start["end"] else self._pages(first, first + min(many, self.most or many)):
            if at["end"] or row[0] != at["page"]:
                break
            end = row[2] is None or (at["oldest"] is not None and row[2] >= at["oldest"])
            rows.append(row)
            at = {"page": row[0] + 1, "oldest": row[2], "end": end}
        return iter(rows), at

    def readBetweenOffsets(self, start: dict[str, Any], end: dict[str, Any]) -> Iterator[tuple]:
        return iter(self._pages(start["page"], end["page"]))


class ProviderPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: Any) -> PageReader:
        return PageReader(self.options["path"])

    def simpleStreamReader(self, schema: Any) -> BackwardReader:
        most = self.options.get("most")
        return BackwardReader(self.options["path"], self.options.get("growing") == "true", int(most) if most else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProviderPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def pages(spark: SparkSession, path: str, after: str | None = None, before: str | None = None) -> DataFrame:
    """Pages that may have rides after and before the dates."""
    register(spark)
    found = spark.read.format(NAME).load(qualified(spark, path))
    if after is not None:
        found = found.filter(F.col("newest") > after)
    return found.filter(F.col("oldest") < before) if before is not None else found


def rows_of(paged: DataFrame, schema: str, *beside: str) -> DataFrame:
    ddl = readers._struct(schema.replace("\n", " "))
    return paged.select(*beside, F.inline(F.from_json("body", f"array<struct<{ddl}>>")))


def fetch(spark: SparkSession, path: str, after: str | None = None, before: str | None = None, limit: int | None = None, schema: str = readers.ACTIVITY, date: str = "start_date", key: str = "id") -> DataFrame:
    """Rides strictly after and before the dates; the newest first where a limit is asked for."""
    found = rows_of(pages(spark, path, after, before), schema)
    if after is not None:
        found = found.filter(F.col(date) > after)
    if before is not None:
        found = found.filter(F.col(date) < before)
    return found.orderBy(F.col(date).desc_nulls_last(), key).limit(limit) if limit is not None else found


def fetch_second(spark: SparkSession, path: str, details: DataFrame, since: str, limit: int | None = None) -> DataFrame:
    """The second provider's rides from a date on, in the first one's columns, with tracks encoded as polylines; null where there is none.

    details: activityId and the track's points, as in DETAILS. Points without both numbers are left out.
    """
    raw = fetch(spark, path, None, None, None, SECOND, "startTimeLocal", "activityId").filter(F.col("startTimeLocal") >= since)
    if limit is not None:
        raw = raw.orderBy(F.col("startTimeLocal").desc(), "activityId").limit(limit)
    points = F.filter("geoPolylineDTO.polyline", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull())
    tracks = details.select(F.col("activityId").alias("__id"), points.alias("__points")).filter(F.size("__points") > 0)
    tracks = tracks.select("__id", polyline.encode(F.col("__points")).alias("polyline"))
    return readers.second_provider(raw).join(tracks, F.col("id") == F.col("__id"), "left").drop("__id")


def backfill(spark: SparkSession, path: str, root: str, checkpoint: str, schema: str = readers.ACTIVITY, most: int | None = None) -> dict[str, int]:
    """Pages backward through the list and merges its pages into the store, until there is none, none with an older date, or one with nothing new.

    Counts of pages and new rides of this call. With the same checkpoint a call goes on after the last page that was merged; a page
    whose merging was not noted is merged again, which changes nothing. `most` pages at most.
    A batch has three times as many pages as came before it, so the store, which a merge rewrites, is written as often as the logarithm of the pages. Pages
    are merged as if one after the other: a later one wins, and those of a batch after one with nothing new are not merged but noted, for the next call.
    """
    register(spark)
    done, over = {"pages": 0, "new": 0}, [False]

    def merged(first: int, end: int, until: int, number: int | None) -> None:
        """Pages from the first on, up to one with nothing new; without a number those that an earlier batch left. What stays until the batch's end is noted."""
        listed = pages(spark, path).filter((F.col("page") >= first) & (F.col("page") < end))
        rows = materialise(rows_of(listed, schema, F.col("page").alias("__page")), "rides")
        counted: dict[str, Any] = {}

        def change(old: DataFrame | None, at: dict[str, Any] | None) -> tuple[DataFrame, dict[str, Any]] | None:
            batches, left = dict(at.get("batches", {})) if at else {}, dict(at.get("left", {})) if at else {}
            counted.clear()
            if number is not None and batches.get(checkpoint, -1) >= number:
                counted.update(pages=end - first, new=0, over=False)
                return None
            met = rows.groupBy("id").agg(F.min("__page").alias("__first"))
            fresh = rows.join(met, "id", "left").filter(F.col("id").isNull() | (F.col("__page") == F.col("__first")))
            fresh = fresh.join(old.select("id"), "id", "left_anti") if old is not None else fresh
            new = {r["__page"]: r["count"] for r in fresh.groupBy("__page").count().collect()}
            last = next((p for p in range(first, end) if not new.get(p)), end - 1)
            counted.update(pages=last + 1 - first, new=sum(n for p, n in new.items() if p <= last), over=not new.get(last))
            kept = rows.filter(F.col("__page") <= last)
            if end - first > 1:
                kept = kept.withColumn("__rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__page")))).filter("__rank = 1").drop("__rank")
            if last + 1 < until:
                left[checkpoint] = [last + 1, until]
            else:
                left.pop(checkpoint, None)
            return store.merged(old, kept.drop("__page"), {"batches": {**batches, **({checkpoint: number} if number is not None else {})}, "left": left})

        store.update(spark, root, change)
        done["pages"] += counted["pages"]
        done["new"] += counted["new"]
        over[0] = over[0] or counted["over"]

    def taken(batch: DataFrame, number: int) -> None:
        found = sorted(r.page for r in batch.select("page").collect())
        if found:
            merged(found[0], found[-1] + 1, found[-1] + 1, number)

    def rest() -> list[int]:
        return ((store.current(spark, root) or {}).get("left") or {}).get(checkpoint) or []

    while not over[0] and (most is None or done["pages"] < most):
        last = done["pages"]
        if left := rest():
            merged(left[0], left[1] if most is None else min(left[1], left[0] + most - last), left[1], None)
            continue
        source = spark.readStream.format(NAME).option("growing", "true")
        source = (source.option("most", most - last) if most is not None else source).load(qualified(spark, path))
        source.writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        if done["pages"] == last:
            break
    return done
