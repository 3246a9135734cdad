"""Exponential smoothing of long series, as a scan of affine maps.

A value turns the level y into a * y + b, and such maps compose, so a range of rows is one map. Each task composes its range; the
maps, a row a series and range, are applied one after the other; then each task fills in its range from the level it starts with.
Inside a task maps are composed by doubling spans on arrays.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialise

#: Rows that are composed at once.
BLOCK = 4096


def _levels(a: np.ndarray, b: np.ndarray, start: float) -> np.ndarray:
    """The level after each of the maps (a, b), from a level to start with."""
    out = np.empty(len(a))
    for at in range(0, len(a), BLOCK):
        m, c = a[at : at + BLOCK].copy(), b[at : at + BLOCK].copy()
        span = 1
        while span < len(m):
            c[span:] += m[span:] * c[:-span]
            m[span:] *= m[:-span].copy()
            span *= 2
        out[at : at + BLOCK] = m * start + c
        start = out[min(at + BLOCK, len(a)) - 1]
    return out


def _maps(values: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    none = np.isnan(values)
    return np.where(none, 1.0, 1.0 - alpha), np.where(none, 0.0, alpha * np.where(none, 0.0, values))


def smoothed(rows: DataFrame, value: str, order: list[str], alpha: float = 0.15, by: str | None = None) -> DataFrame:
    """Adds `smoothed`: the first value, then alpha of each further one and the rest of what was before; rows without a value keep the level, null before the first one.

    order: columns that are different for all rows of a series. A NaN counts as no value.
    """
    key = F.col(by) if by else F.lit(0)
    cast = rows.withColumns({"__key": key, "__x": F.col(value).cast("double")}).withColumn("__row", F.monotonically_increasing_id())
    light = materialise(cast, "series")
    ranged = materialise(light.select("__key", *order, "__x", "__row").repartitionByRange("__key", *order).withColumn("__range", F.spark_partition_id()), "ranges")

    def composed(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k, own in part.sort_values(["__key", *order]).groupby("__key", dropna=False, sort=False):
            x = own["__x"].to_numpy(float)
            some = x[~np.isnan(x)]
            if len(some):
                a, b = _maps(x, alpha)
                out.append((k, part["__range"].iloc[0], (1.0 - alpha) ** len(some), float(_levels(a, b, 0.0)[-1]), float(some[0])))
        return pd.DataFrame(out, columns=["__key", "__range", "a", "b", "first"])

    kind = ranged.schema["__key"].dataType.simpleString()
    maps = ranged.groupBy("__range").applyInPandas(composed, f"__key {kind}, __range int, a double, b double, first double")
    each = maps.groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("__range", "a", "b", "first"))).alias("maps"))
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<struct<range:int,y:double>>").alias("after"))

    def apply(acc, m):
        y = m["a"] * F.coalesce(acc["y"], m["first"]) + m["b"]
        return F.struct(y.alias("y"), F.concat(acc["after"], F.array(F.struct(m["__range"].alias("range"), y.alias("y")))).alias("after"))

    after = each.select("__key", F.explode(F.aggregate("maps", zero, apply)["after"]).alias("s")).select(F.col("__key").alias("of"), F.col("s.range").alias("at"), F.col("s.y").alias("y"))
    spans = ranged.select("__key", "__range").distinct()
    starts = spans.join(after, F.col("__key").eqNullSafe(F.col("of")) & (F.col("at") < F.col("__range"))).groupBy("__key", "__range").agg(F.max_by("y", "at").alias("y"))
    starts = materialise(starts.select("__key", "__range", "y"), "starts")

    def filled(part: pd.DataFrame, begun: pd.DataFrame) -> pd.DataFrame:
        level = {None if pd.isna(k) else k: y for k, y in zip(begun["__key"], begun["y"])}
        out = []
        for k, own in part.sort_values(["__key", *order]).groupby("__key", dropna=False, sort=False):
            x = own["__x"].to_numpy(float)
            some = np.flatnonzero(~np.isnan(x))
            start = level.get(None if pd.isna(k) else k)
            y = np.full(len(x), np.nan)
            if start is not None:
                y = _levels(*_maps(x, alpha), start)
            elif len(some):
                y[some[0] :] = _levels(*_maps(x[some[0] :], alpha), x[some[0]])
            out.append(pd.DataFrame({"__row": own["__row"], "smoothed": y}))
        return pd.concat(out).astype({"smoothed": "Float64"}) if out else pd.DataFrame({"__row": [], "smoothed": []})

    found = ranged.groupBy("__range").cogroup(starts.groupBy("__range")).applyInPandas(filled, "__row long, smoothed double")
    return light.join(found.select("__row", F.when(~F.isnan("smoothed"), F.col("smoothed")).alias("smoothed")), "__row").select(*rows.columns, "smoothed")
