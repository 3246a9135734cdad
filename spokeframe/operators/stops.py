"""The order of a tour's stops: the shortest one for few stops, the nearest next stop for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import geo
from .similarity import _lists as lists

#: Distances of a table of sets that is filled at once.
TABLE = 1 << 20


def _km(a: Column, b: Column) -> Column:
    return geo.haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]) / 1000


def _shortest(first: np.ndarray, between: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first, last: (tours, n), between: (tours, n, n) in km. Places in the shortest order, of equals the first by places, a digit of base 16 each.

    A dynamic programme over sets of stops: for a set and the stop it ends with, the shortest way there. An unknown distance counts as shorter than all, as a null does.
    """
    first, between, last = (np.where(np.isnan(x), -np.inf, x) for x in (first, between, last))
    many, n = first.shape
    km, code = np.full((1 << n, n, many), np.inf), np.zeros((1 << n, n, many), np.int64)
    least = lambda way, codes: (m := way.min(axis=0), np.where(way == m, codes, np.iinfo(np.int64).max).min(axis=0))
    for mask in range(1, 1 << n):
        held = [i for i in range(n) if mask >> i & 1]
        for to in held:
            before = [i for i in held if i != to]
            if not before:
                km[mask, to], code[mask, to] = 0.0 + first[:, to], to
            else:
                km[mask, to], at = least(km[mask ^ 1 << to, before] + between[:, before, to].T, code[mask ^ 1 << to, before])
                code[mask, to] = at * 16 + to
    return least(km[-1] + last.T, code[-1])[1]


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with first, between and last as their last three columns, to the rows with the places instead."""
    for batch in batches:
        (first, at, sizes), (between, at_between, _), (last, at_last, _) = map(lists, batch.columns[-3:])
        offsets = np.r_[0, np.cumsum(sizes)]
        out = np.zeros(offsets[-1], np.int32)
        for n in np.unique(sizes[sizes > 0]):
            some, step = np.flatnonzero(sizes == n), max(1, TABLE // (n << n))
            for k in range(0, len(some), step):
                part = some[k : k + step]
                row = lambda values, starts, m: values[starts[part][:, None] + np.arange(m)]  # noqa: B023, E731
                codes = _shortest(row(first, at, n), row(between, at_between, n * n).reshape(-1, n, n), row(last, at_last, n))
                out[offsets[part][:, None] + np.arange(n)] = codes[:, None] >> 4 * np.arange(n - 1, -1, -1) & 15
        places = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], places], [*batch.schema.names[:-3], "places"])


def shortest_orders(tours: DataFrame, most: int) -> DataFrame:
    """Adds places of up to `most` stops, fifteen at most, in the shortest order; of equals the first by places, and of more stops none. Distances are Spark's, orders are found for many tours at once, and no row meets another."""
    few, start, end = F.when(F.size("stops") <= most, F.col("stops")), F.col("start"), F.col("end")
    first, last = F.transform(few, lambda s: _km(start, s)), F.transform(few, lambda s: _km(s, end))
    between = F.flatten(F.transform(few, lambda a: F.transform(few, lambda b: _km(a, b))))
    asked = tours.select("*", first.alias("__first"), between.alias("__between"), last.alias("__last"))
    return asked.mapInArrow(_placed, StructType([*tours.schema.fields, StructField("places", ArrayType(IntegerType()))]))


def nearest_orders() -> Column:
    """Places by the columns start and stops: from the start on always the nearest stop that is left, of equals the first; expressions over one row."""
    left = F.transform("stops", lambda s, i: F.struct(i.alias("place"), s["lat"].alias("lat"), s["lon"].alias("lon")))
    begin = F.struct(F.struct(F.col("start.lat").alias("lat"), F.col("start.lon").alias("lon")).alias("here"), left.alias("left"), F.array().cast("array<int>").alias("places"))

    def step(acc: Column, _: Column) -> Column:
        near = F.array_min(F.transform(acc["left"], lambda s: F.struct(_km(acc["here"], s).alias("km"), s["place"].alias("place"), s["lat"].alias("lat"), s["lon"].alias("lon"))))
        return F.struct(F.struct(near["lat"].alias("lat"), near["lon"].alias("lon")).alias("here"), F.filter(acc["left"], lambda s: s["place"] != near["place"]).alias("left"), F.concat(acc["places"], F.array(near["place"])).alias("places"))

    return F.aggregate("stops", begin, step)["places"]


def ordered(tours: DataFrame, most: int = 8) -> DataFrame:
    """tours: tour (a number of its own each), start, stops, end (lat, lon). Adds places, the order of the stops, and km of the tour. Shortest up to `most` stops, beyond by nearest stops."""
    n = F.size("stops")
    places = F.when(n <= most, F.col("places")).when(n > most, nearest_orders())
    both = shortest_orders(tours, most).withColumn("places", F.coalesce(places, F.array().cast("array<int>")))
    line = F.concat(F.array("start"), F.transform("places", lambda i: F.get("stops", i)), F.array("end"))
    legs = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line) - 1), _km)
    return both.withColumn("km", F.aggregate(legs, F.lit(0.0), lambda a, x: a + x))
