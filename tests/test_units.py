"""Texts of units, against the casts of their SQL."""

import duckdb
from pyspark.sql import functions as F

from spokeframe.functions import units


def test_halves_that_division_misses_go_up_as_in_sql(spark):
    con = duckdb.connect()
    values = [12.05, 12.049999999999999, 16.849999999999998, 67.35, 67.34999999999999, 46.95, 0.05, 0.25, -0.25, 0.0, 2208.5, 2207.5, 1e-9, 123456.75, 93000.25]
    values += [k / 20 for k in range(1, 2000, 2)] + [k / 20 / 3.6 * 3.6 for k in range(1, 2000, 2)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", *[units.fixed(F.col("x"), n).alias(f"d{n}") for n in (0, 1)]).orderBy("i").collect()
    for n in (0, 1):
        sql = f"SELECT CAST(CAST(round(CAST(x AS DECIMAL(38, 14)), {n}) AS DECIMAL(18, {n})) AS VARCHAR) FROM (SELECT unnest(?::DOUBLE[]) AS x)"
        assert [r[f"d{n}"] for r in rows] == [x for (x,) in con.execute(sql, [values]).fetchall()]


def test_texts_of_odd_values(spark):
    df = spark.createDataFrame([(0, None), (1, float("nan")), (2, 19392.547)], "i int, x double")
    got = df.select(units.distance_text(F.col("x"), True).alias("m"), units.elevation_text(F.col("x")).alias("e")).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(None, None), ("NaN mi", "NaN m"), ("12.1 mi", "19393 m")]
