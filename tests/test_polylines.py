"""Polylines of whole batches against one at a time."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spokeframe.functions import polyline

COORDS = "id long, c array<struct<lat:double,lon:double>>"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    some = lambda n: [(rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for _ in range(n)]
    tracks = [None, [], *(some(n) for n in (1, 2, 5, 40, 1)), [], None, [(0.0, 0.0)] * 3, [(-0.000005, 0.000015), (38.5, -120.2)], *(some(rnd.randrange(4)) for _ in range(50))]
    return list(enumerate(tracks))


def test_encoding(spark, rows):
    df = spark.createDataFrame(rows, COORDS).repartition(3)
    got = {r.id: r.p for r in df.select("id", polyline.encode(F.col("c")).alias("p")).collect()}
    assert got == {i: None if c is None else polyline.encode_points(c) for i, c in rows}
    back = {r.id: r.c for r in df.select("id", polyline.decode(polyline.encode(F.col("c"))).alias("c")).collect()}
    for i, c in rows:
        want = None if not c else polyline.decode_text(polyline.encode_points(c))
        assert (None if back[i] is None else [tuple(p) for p in back[i]]) == want
    assert df.limit(0).select(polyline.encode(F.col("c"))).count() == 0


def test_broken_texts(spark):
    good = "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    texts = [None, "", good, good[:-1], good + "?", "é", good + "é", "a b", " ", "????", "\x7f\x7f", good, "~", good * 3]
    found = {r.id: r.c for r in spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", polyline.decode(F.col("t")).alias("c")).collect()}
    for i, text in enumerate(texts):
        try:
            want = polyline.decode_text(text) if text else None
        except (ValueError, UnicodeEncodeError):
            want = None
        assert (None if found[i] is None else [tuple(p) for p in found[i]]) == want, text
    assert found[2] and found[3] is None and found[6] is None


def test_slices_of_batches(rows):
    tracks = pa.array([None if c is None else [{"lat": a, "lon": b} for a, b in c] for _, c in rows], pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())])))
    part = lambda name: pa.array([None if c is None else [p[name] for p in c] for c in tracks.to_pylist()], pa.list_(pa.float64()))
    whole = polyline._encoded(part("lat"), part("lon")).to_pylist()
    assert polyline._encoded(part("lat").slice(3, 9), part("lon").slice(3, 9)).to_pylist() == whole[3:12]
    texts = pa.array(whole)
    assert polyline._decoded(texts.slice(4, 20)).to_pylist() == polyline._decoded(texts).to_pylist()[4:24]


def test_simplified(spark, rows):
    df = spark.createDataFrame(rows, COORDS)
    got = {r.id: [tuple(p) for p in r.s] for r in df.select("id", polyline.simplify(F.col("c"), 20.0).alias("s")).collect()}
    for i, c in rows:
        points = np.array(c or []).reshape(-1, 2)
        want = points[polyline.kept_points(points, 20.0)] if len(points) > 2 else points
        assert got[i] == list(map(tuple, want.tolist()))
