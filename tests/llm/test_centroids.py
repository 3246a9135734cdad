"""Centroids against a loop over Python's integers."""

import hashlib
import math
import random

import pytest

from spokeframe.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int, vector string"


def plain(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    middles = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for step in range(rounds + 1):
        found = [min((apart(v, c), j) for j, c in enumerate(middles)) for _, v in kept]
        if step < rounds:
            for j in range(len(middles)):
                own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
                if own:
                    middles[j] = [sum(x) // len(own) for x in zip(*own)]
    long = lambda x: x if x < 1 << 63 else None
    held = {j: sum(d for d, c in found if c == j) if all(d < 1 << 63 for d, c in found if c == j) else 1 << 63 for j in range(len(middles))}
    total = long(sum(d for d, _ in found)) if all(d < 1 << 63 for d, _ in found) else None
    return sorted((str(i), c, str(long(d)), str(long(held[c])), str(total), hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, found))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(parts)


def found(df):
    return sorted((str(r.vec_id), r.cluster, str(r.distance), str(r.cluster_inertia), str(r.inertia), r.centroid_sha256) for r in centroids.cluster(df).collect())


def vectors(n, seed, size=1.0):
    rnd = random.Random(seed)
    places = [[rnd.gauss(0, size) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rnd.gauss(0, size / 3) for x in places[i % 5]]) for i in range(n)]


@pytest.fixture(scope="module")
def odd():
    rows = vectors(120, 1)
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [None] + [1.0] * 63), (505, [math.nan] + [1.0] * 63), (506, [math.inf] + [1.0] * 63)]
    return rows + [(7, rows[7][1])] * 30 + [(None, rows[3][1]), (None, rows[4][1]), (None, None), (800, [0.0] * 64), (801, [-0.0] * 64)]


def test_clusters(spark, odd):
    want = plain(odd)
    assert found(table(spark, odd)) == want == found(table(spark, odd[::-1], 7))


def test_few_and_none(spark):
    assert found(table(spark, [])) == [] and found(table(spark, [(1, None)])) == []
    for n in (1, 5, 8):
        assert found(table(spark, vectors(n, n))) == plain(vectors(n, n))
    same = [(i, [0.25] * 64) for i in range(40)]  # all centroids tie, so all go to the first and the others stay empty
    assert found(table(spark, same)) == plain(same) and {r[1] for r in plain(same)} == {0}


@pytest.mark.parametrize("size", [1e4, 1e9, 1e30, 1e308])
def test_large_components(spark, size):
    rows = vectors(20, 9, min(size, 1e306)) + [(77, [size] + [0.0] * 63), (78, [-size] * 64)]
    assert found(table(spark, rows)) == plain(rows)


def test_partial_distances_choose_as_whole_ones_do():
    import numpy as np

    rnd = np.random.default_rng(3)
    for n, high in ((200, 3), (200, 1000)):  # few values make many ties
        x, c, order = rnd.integers(-high, high, (n, 64)), rnd.integers(-high, high, (9, 64)), rnd.permutation(64)
        c[5] = c[2]
        whole = ((x[:, None] - c[None]) ** 2).sum(2)
        best, least = centroids.nearest(x, c, order)
        assert (best == whole.argmin(1)).all() and (least == whole.min(1)).all()


def test_parts_of_numbers():
    for v in (0, 5, -5, (1 << 40) - 1, 1 << 40, -(1 << 40), 3**90, -(3**90)):
        assert sum(value << (centroids.BITS * part) for _, _, part, value in centroids._parts(0, 0, v)) == v
        assert all(abs(value) <= 1 << centroids.BITS for *_, value in centroids._parts(0, 0, v))
